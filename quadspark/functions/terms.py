"""RDF terms as canonical N-Triples text, and their parts, as Column expressions.

A term is one string: ``<iri>``, ``_:label``, ``"lex"``, ``"lex"@lang`` or ``"lex"^^<datatype>``. Two
terms are equal if and only if their texts are, so an IRI and literals of the same text differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
#: The graph that triples without a graph belong to.
DEFAULT_GRAPH = "<urn:x-quadspark:default>"
#: Datatypes whose lexical forms are exact decimals.
EXACT = ("integer", "decimal", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger")

#: Sign, digits before and behind the point, exponent.
_NUMBER = r"^([+-]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$"
#: Pieces of an escaped text: a run of \\u codes, a \\U code, another escape, or a run without any.
_PIECES = r"((?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"


def escape(lex: Column) -> Column:
    """Backslash, quote, LF and CR as N-Triples writes them."""
    out = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for raw, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def unescape(lex: Column) -> Column:
    """The text that N-Triples' escapes stand for: backslash with t, b, n, r, f, a quote of either kind or
    another backslash, and code points as \\uXXXX (also in surrogate pairs) and \\UXXXXXXXX."""

    def plain(p: Column) -> Column:
        code = F.substring(p, 2, 1)
        named = F.translate(code, "tbnrf", "\t\b\n\r\f")
        short = F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long_ = F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32")
        return F.when(~p.startswith("\\"), p).when((code == "u") & (F.length(p) > 2), short).when((code == "U") & (F.length(p) > 2), long_).otherwise(named)

    pieces = F.regexp_extract_all(lex, F.lit(_PIECES), 1)
    return F.when(lex.contains("\\"), F.array_join(F.transform(pieces, plain), "")).otherwise(lex)


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value.cast("string"), F.lit(">"))


def bnode(label: Column) -> Column:
    return F.concat(F.lit("_:"), label.cast("string"))


def literal(lex: Column, datatype: str | None = None, lang: Column | None = None) -> Column:
    """A literal; a datatype is an XSD name or a whole IRI. Null texts give null."""
    quoted = F.concat(F.lit('"'), escape(lex.cast("string")), F.lit('"'))
    if lang is not None:
        return F.when(F.coalesce(lang, F.lit("")) == "", quoted).otherwise(F.concat(quoted, F.lit("@"), lang))
    if datatype is None:
        return quoted
    return F.concat(quoted, F.lit(f"^^<{datatype if ':' in datatype else XSD + datatype}>"))


def kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").when(term.startswith('"'), "literal")


def _suffix(term: Column) -> Column:
    """What follows a literal's closing quote: no tag or datatype has a quote in it."""
    return F.substring_index(term, '"', -1)


def lexical(term: Column) -> Column:
    """The text of a term: IRI, label or lexical form."""
    k = kind(term)
    quoted = F.substring(term, F.lit(2), F.length(term) - F.length(_suffix(term)) - 2)
    return F.when(k == "iri", F.substring(term, F.lit(2), F.length(term) - 2)).when(k == "bnode", F.substring(term, F.lit(3), F.length(term))).when(k == "literal", unescape(quoted))


def datatype(term: Column) -> Column:
    """A literal's datatype IRI, empty for plain and language-tagged ones and other terms."""
    end = _suffix(term)
    return F.when((kind(term) == "literal") & end.startswith("^^<"), F.substring(end, F.lit(4), F.length(end) - 4)).otherwise("")


def lang(term: Column) -> Column:
    """A literal's language tag, empty if it has none; case matters."""
    end = _suffix(term)
    return F.when((kind(term) == "literal") & end.startswith("@"), F.substring(end, F.lit(2), F.length(end))).otherwise("")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def decimal_key(lex: Column) -> Column:
    """One text for each decimal value: sign, digits without outer zeros, E, exponent; '0' for all
    zeros; null for what is no number. Scale and notation make no difference, size has no limit."""

    def key(parts: Column) -> Column:
        sign, whole, frac, power = (parts[i] for i in range(4))
        digits = F.ltrim(F.concat(whole, frac), F.lit("0"))
        core = F.rtrim(digits, F.lit("0"))
        exponent = F.coalesce(power.try_cast("bigint"), F.lit(0)) - F.length(frac) + F.length(digits) - F.length(core)
        minus = F.when(sign == "-", "-").otherwise("")
        return F.when(core == "", "0").otherwise(F.concat(minus, core, F.lit("E"), exponent.cast("string")))

    return F.when(lex.rlike(_NUMBER), bound(F.split(F.regexp_replace(lex, _NUMBER, "$1|$2|$3|$4"), r"\|"), key))


def maybe_number(term: Column) -> Column:
    """True of every numeric literal, and of few other terms."""
    return term.startswith('"') & F.substring(term, 2, 1).isin(*"0123456789+-.")


def number_key(term: Column) -> Column:
    """The value of a numeric literal as a decimal_key, null for other terms. Plain literals that
    read as a decimal are numbers too; xsd:float is widened to double, so 3.14 as a float is not 3.14."""

    def key(x: Column) -> Column:
        lex, dt = x["lex"], x["dt"]
        exact = (dt == "") | dt.isin([f"^^<{XSD}{d}>" for d in (*EXACT, "string")])
        double = lex.try_cast("double").cast("string")
        single = lex.try_cast("float").cast("double").cast("string")
        text = F.when(exact, lex).when(lex.rlike(_NUMBER), F.when(dt == f"^^<{XSD}double>", double).when(dt == f"^^<{XSD}float>", single))
        return bound(text, decimal_key)

    end = _suffix(term)  # no number has an escape, so its text is what stands between the quotes
    parts = F.struct(F.substring(term, F.lit(2), F.length(term) - F.length(end) - 2).alias("lex"), end.alias("dt"))
    return F.when(maybe_number(term), bound(parts, key))

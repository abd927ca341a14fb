"""N-Quads and N-Triples text, read and written by line in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import terms as t
from quadspark.operators.pattern import POSITIONS

_IRI = r'<[^\x00-\x20<>"{}|^`]*>'
_BNODE = r'_:[^\s<>"\x01]+'
#: A literal ends at the line's last quote: nothing behind it has one.
_LINE = rf'^\s*({_IRI}|{_BNODE})\s+({_IRI})\s+({_IRI}|{_BNODE}|".*"(?:\^\^{_IRI}|@[A-Za-z0-9-]+)?)\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#[^"]*)?$'
#: What may follow a backslash in a literal, and in an IRI.
_CODE = r"\\(?:u[0-9A-Fa-f]{4}|U(?:000[0-9A-Fa-f]|0010)[0-9A-Fa-f]{4})"
_ESCAPE = _CODE[:-1] + r"|[tbnrf\"'\\])"
#: Stands between a line's parts, of which only the literal may hold it, and before those of good lines.
_BETWEEN, _GOOD = "\x01", "\x02"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(g, s, p, o, bad): quads of lines, in canonical terms; ``bad`` holds a line that is none. Blank
    lines and comments give no row, lines without a graph belong to the default graph. A line is
    matched once; its parts are cut out of what the match put together."""
    c = F.col(column)
    one = F.regexp_replace(c, _LINE, f"{_GOOD}$1{_BETWEEN}$2{_BETWEEN}$3{_BETWEEN}$4")
    own = lines.where(~c.rlike(r"^\s*(#.*)?$")).select(c.alias("_line"), one.alias("_one"))
    at = F.col("_one")
    s = F.substring_index(at, _BETWEEN, 1)
    behind = F.substring(at, F.length(s) + 2, F.length(at))
    p, g = F.substring_index(behind, _BETWEEN, 1), F.substring_index(at, _BETWEEN, -1)
    o = F.substring(behind, F.length(p) + 2, F.length(behind) - F.length(p) - F.length(g) - 2)
    own = own.select("_line", at.startswith(_GOOD).alias("_match"), F.substring(s, 2, F.length(s)).alias("_s"), p.alias("_p"), o.alias("_o"), g.alias("_g"))
    # a literal's text holds no quote but escaped ones, so two are left, or none; and no other backslash
    bare = F.when(F.col("_o").contains("\\"), F.regexp_replace("_o", _ESCAPE, "")).otherwise(F.col("_o"))
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    fair = (quotes <= 2) & ~bare.contains("\\")
    for x in ("_s", "_p", "_g"):
        fair &= ~F.col(x).contains("\\") | ~F.regexp_replace(x, _CODE, "").contains("\\")
    fair &= ~F.col("_o").startswith("<") | ~F.col("_o").contains("\\") | ~F.regexp_replace("_o", _CODE, "").contains("\\")
    own = own.withColumn("_ok", F.col("_match") & ~F.col("_line").startswith(_GOOD) & fair)
    part = lambda x: F.when(F.col("_ok"), x)
    graph = F.when(F.col("_g") == "", F.lit(t.DEFAULT_GRAPH)).otherwise(t.unescape(F.col("_g")))
    return own.select(part(graph).alias("g"), part(t.unescape(F.col("_s"))).alias("s"), part(t.unescape(F.col("_p"))).alias("p"), part(canonical(F.col("_o"))).alias("o"), F.when(~F.col("_ok"), F.col("_line")).alias("bad"))


def canonical(term: Column) -> Column:
    """A literal with the escapes that this library writes, other terms without any."""
    end = F.substring_index(term, '"', -1)
    text = F.substring(term, F.lit(2), F.length(term) - F.length(end) - 2)
    literal = F.concat(F.lit('"'), t.escape(t.unescape(text)), F.lit('"'), t.unescape(end))
    escaped = term.contains("\\") | term.contains("\r") | term.contains("\n")
    return F.when(~escaped, term).when(term.startswith('"'), literal).otherwise(t.unescape(term))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Quads of a file or folder, each once. A line that is no quad is an error, or left out."""
    rows = parsed(spark.read.text(path))
    if strict:
        rows = rows.withColumn("s", F.when(rows["bad"].isNotNull(), F.raise_error(F.concat(F.lit("not a quad: "), "bad"))).otherwise(F.col("s")))
    else:
        rows = rows.where("bad is null")
    return rows.select(*POSITIONS).dropDuplicates(POSITIONS)


def lines(quads: DataFrame) -> DataFrame:
    """(value): a line for each quad; those of the default graph are triples."""
    end = F.when(F.col("g") == t.DEFAULT_GRAPH, F.lit(" .")).otherwise(F.concat(F.lit(" "), "g", F.lit(" .")))
    return quads.select(F.concat("s", F.lit(" "), "p", F.lit(" "), "o", end).alias("value"))


def write(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines(quads).write.mode(mode).text(path)

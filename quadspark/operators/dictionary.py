"""The term dictionary: ids of terms, encoded quads, and results of registering values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms as t
from quadspark.operators.pattern import POSITIONS
from quadspark.plans.lineage import stored
from quadspark.plans.numbering import numbered

ENCODED = ["g_id", "s_id", "p_id", "o_id"]
#: Terms of graphs and predicates that are broadcast at most.
FEW = 100_000


def used_terms(quads: DataFrame) -> DataFrame:
    """Every term of every position once."""
    return quads.select(F.explode(F.array(*POSITIONS)).alias("term")).distinct()


def build(quads: DataFrame) -> DataFrame:
    """(term, term_id) with ids in the order of the terms' bytes."""
    return numbered(used_terms(quads), ["term"], "term_id")


def described(terms: DataFrame) -> DataFrame:
    """Terms with kind, lexical form, datatype, language and numeric key."""
    c = F.col("term")
    return terms.select("*", t.kind(c).alias("kind"), t.lexical(c).alias("lex"), t.datatype(c).alias("datatype"), t.lang(c).alias("lang"), t.number_key(c).alias("num_key"))


def grown(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """The dictionary with new terms behind its largest id; ids are never used again."""
    new = terms.select("term").distinct().join(dictionary, "term", "left_anti")
    last = dictionary.agg(F.coalesce(F.max("term_id"), F.lit(-1)).alias("n")).first()["n"]
    named = numbered(new, ["term"], "_n")
    return dictionary.select("term", "term_id").unionByName(named.select("term", (F.col("_n") + F.lit(last + 1)).alias("term_id")))


def lookup(dictionary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, term_id) of each wanted term; -1 for unknown ones."""
    got = wanted.select("term").join(dictionary.select("term", "term_id"), "term", "left")
    return got.select("term", F.coalesce("term_id", F.lit(-1)).alias("term_id"))


def by_id(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """(term_id, term) of ids that are in use."""
    return ids.select("term_id").join(dictionary.select("term_id", "term"), "term_id")


def few_keys(rows: DataFrame, columns: list[str], dictionary: DataFrame, key: str) -> DataFrame:
    """The part of the dictionary that these columns name, to be broadcast if they name at most FEW; then
    the dictionary is not shuffled to find it."""
    named = stored(rows.select(F.explode(F.array(*columns)).alias(key)).distinct())
    own = F.broadcast if named.count() <= FEW else lambda df: df
    return own(stored(dictionary.join(own(named), key, "left_semi").select("term", "term_id")))


def translated(rows: DataFrame, dictionary: DataFrame, pairs: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    """``rows`` with a new column for each old one, looked up. Graphs and predicates are few but each is
    in very many rows: their part of the dictionary goes to the rows, before the shuffles where it makes
    these narrower, behind them where they would carry its terms. Subjects and objects are shuffled,
    where adaptive execution splits what a frequent term makes too large; terms are sorted by a hash,
    since comparing texts of equal beginnings takes far longer."""
    small = [old for old, _ in pairs if old[0] in "gp"]
    few = few_keys(rows, small, dictionary, key) if small else None
    for old, new in sorted(pairs, key=lambda x: (x[0] in small) != (key == "term")):
        by, on = (few if old in small else dictionary).select(F.col(key).alias(old), F.col(value).alias(new)), [old]
        if key == "term" and old not in small:
            rows, by = (x.withColumn("_hash", F.xxhash64(old)) for x in (rows, by))
            on = ["_hash", old]
        rows = rows.join(by, on).drop("_hash")
    return rows


def encode(quads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(g_id, s_id, p_id, o_id); looks terms up, never registers them."""
    return translated(quads.select(*POSITIONS), dictionary, list(zip(POSITIONS, ENCODED)), "term", "term_id").select(*ENCODED)


def decode(encoded: DataFrame, dictionary: DataFrame, positions: list[str] | None = None) -> DataFrame:
    """Terms of encoded quads; as triples with positions s, p, o."""
    positions = POSITIONS if positions is None else positions
    out = translated(encoded, dictionary, [(f"{c}_id", c) for c in positions], "term_id", "term")
    return out.select(*[c for c in encoded.columns if c not in ENCODED], *positions)


def with_quad_ids(encoded: DataFrame) -> DataFrame:
    """Encoded quads with quad_id in their own order."""
    return numbered(encoded, ENCODED, "quad_id")


def quads_by_id(encoded: DataFrame, ids: DataFrame) -> DataFrame:
    """Encoded quads of these ids; ids without a quad give nothing."""
    return encoded.join(ids.select("quad_id").distinct(), "quad_id", "left_semi")


def register_result(dictionary: DataFrame, values: DataFrame) -> DataFrame:
    """(term, existed, term_id, was_added) of registering distinct values."""
    after = grown(dictionary, values)
    got = values.select("term").distinct().join(after, "term").join(dictionary.select("term", F.lit(True).alias("_had")), "term", "left")
    existed = F.coalesce("_had", F.lit(False))
    return got.select("term", existed.alias("existed"), "term_id", (~existed & (F.col("term_id") != -1)).alias("was_added"))


def delete_result(dictionary: DataFrame, values: DataFrame) -> DataFrame:
    """(term, existed, term_id) of deleting distinct values; -1 where there was none."""
    got = lookup(dictionary, values.select("term").distinct())
    return got.select("term", (F.col("term_id") >= 0).alias("existed"), "term_id")


def contains(dictionary: DataFrame, values: DataFrame) -> DataFrame:
    """The values that are in the dictionary."""
    return values.select("term").distinct().join(dictionary, "term", "left_semi")


def page_size(n: int) -> int:
    """Pages of about equal number and size: the root of n, rounded up; an error beyond 2 ** 31 - 1."""
    root = int(n**0.5)
    while root * root < n:
        root += 1
    while root and (root - 1) * (root - 1) >= n:
        root -= 1
    if root > 2**31 - 1:
        raise ValueError(f"{n} is too large")
    return root


def page_sizes(n: Column) -> Column:
    """page_size of a column of whole numbers that are not negative, exact also where doubles are not."""
    root = F.floor(F.sqrt(n.cast("double")))
    low = F.when(root * root > n, root - 1).otherwise(root)
    return F.when(low * low >= n, low).otherwise(low + 1).cast("bigint")

"""Sparse bitmaps as rows (name, page, bits), one for each page that is not empty.

An AND, OR or XOR of many bitmaps is one aggregation by page, 64 ids a word, combined before the
shuffle. Pages are BIGINTs, so their order is that of unsigned 32-bit numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.functions import bits as b


def build(ids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, page, bits) of rows (keys, id); an id beyond the range is an error."""
    keys = ["name"] if keys is None else keys
    id_ = b.checked(F.col("id"))
    return ids.select(*keys, b.page(id_).alias("page"), b.mask(id_).alias("_m")).groupBy(*keys, "page").agg(F.bit_or("_m").alias("bits"))


def intersection(maps: DataFrame, names: int) -> DataFrame:
    """(page, bits) in all of ``names`` bitmaps (rows of distinct name and page); empty if there are
    none, or if one is empty."""
    got = maps.groupBy("page").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("_n"))
    return got.where((F.col("_n") == names) & (F.col("bits") != 0)).select("page", "bits")


def union(maps: DataFrame) -> DataFrame:
    return maps.groupBy("page").agg(F.bit_or("bits").alias("bits")).where("bits <> 0")


def xor(maps: DataFrame) -> DataFrame:
    """Ids in an odd number of the bitmaps: of two, in one but not the other."""
    return maps.groupBy("page").agg(F.bit_xor("bits").alias("bits")).where("bits <> 0")


def clear(maps: DataFrame, ids: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Without these (keys, id); pages that become empty go."""
    keys = ["name"] if keys is None else keys
    gone = build(ids, keys).withColumnRenamed("bits", "_gone")
    left = maps.join(gone, [*keys, "page"], "left")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("bigint"))))
    return left.withColumn("bits", bits).where("bits <> 0").select(*keys, "page", "bits")


def contains(maps: DataFrame, ids: DataFrame) -> DataFrame:
    """(name, id, held) for each asked (name, id)."""
    asked = ids.withColumn("page", b.page(F.col("id")))
    got = asked.join(maps, ["name", "page"], "left")
    return got.select("name", "id", F.coalesce(b.word_contains(F.col("bits"), F.col("id")), F.lit(False)).alias("held"))


def iterate(maps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id) for each bit; ascending within a word."""
    keys = ["name"] if keys is None else keys
    return maps.select(*keys, F.explode(b.ids(F.col("page"), F.col("bits"))).alias("id"))


def lowest(maps: DataFrame, names: DataFrame) -> DataFrame:
    """(name, lowest) of each of ``names``: its smallest id, -1 if it is empty."""
    low = iterate(maps).groupBy("name").agg(F.min("id").alias("_low"))
    return names.select("name").distinct().join(low, "name", "left").select("name", F.coalesce("_low", F.lit(-1)).alias("lowest"))


def pages(maps: DataFrame) -> DataFrame:
    """(name, n_pages, first_page, last_page, n_ids)."""
    return maps.groupBy("name").agg(F.count("*").alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum(F.bit_count("bits").cast("bigint")).alias("n_ids"))


def higher_page(maps: DataFrame, page: int) -> DataFrame:
    """(name, page): each bitmap's next page after this one."""
    return maps.where(F.col("page") > page).groupBy("name").agg(F.min("page").alias("page"))


def posting_lists(encoded: DataFrame) -> DataFrame:
    """(pos, term_id, page, bits): for each position and term, the bitmap of its quads' ids."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.col(f"{p}_id").alias("term_id")) for p in "gspo"])).alias("_x")
    rows = encoded.select(F.col("quad_id").alias("id"), each).select("id", "_x.*")
    return build(rows, ["pos", "term_id"])


def find(encoded: DataFrame, postings: DataFrame, pattern: dict[str, int]) -> DataFrame:
    """Encoded quads of a pattern (position: term id) by their posting lists. An unknown term (-1),
    or one that the position never holds, gives nothing; no bound position gives all."""
    if not pattern:
        return encoded
    asked = None
    for pos, term in pattern.items():
        own = (F.col("pos") == pos) & (F.col("term_id") == term)
        asked = own if asked is None else asked | own
    hits = intersection(postings.where(asked), len(pattern))
    ids = hits.select(F.explode(b.ids(F.col("page"), F.col("bits"))).alias("quad_id"))
    return encoded.join(ids, "quad_id", "left_semi")

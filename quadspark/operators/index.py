"""Indexes of items to ids, by language tag and by numeric value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.functions import terms as t

#: Ids of an index lie in [0, MAX_ID).
MAX_ID = 2**31 - 1


def register(index: DataFrame, new: DataFrame) -> DataFrame:
    """``index`` (item, id) with these rows, each once; ids out of range are an error."""
    bad = (F.col("id") < 0) | (F.col("id") >= MAX_ID)
    checked = F.when(bad, F.raise_error(F.lit("index id out of range")).cast("bigint")).otherwise(F.col("id"))
    return index.select("item", "id").unionByName(new.select("item", checked.alias("id"))).distinct()


def delete(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Without these (item, id); an item goes with its last id."""
    return index.join(gone.select("item", "id"), ["item", "id"], "left_anti").select("item", "id")


def get(index: DataFrame, item: str) -> DataFrame:
    """Ids of an item; none if it is unknown."""
    return index.where(F.col("item") == item).select("id")


def size(index: DataFrame) -> DataFrame:
    """Number of items."""
    return index.agg(F.countDistinct("item").alias("n"))


def by_lang(dictionary: DataFrame) -> DataFrame:
    """(item, id): language tags of literals that have one."""
    return dictionary.select(t.lang(F.col("term")).alias("item"), F.col("term_id").alias("id")).where("item <> ''")


def by_number(dictionary: DataFrame) -> DataFrame:
    """(item, id): values of numeric literals, of whatever form and datatype. Terms that cannot be one
    are left out first; the generator keeps the key from being computed for the filter and again."""
    keyed = F.array(F.struct(t.number_key(F.col("term")).alias("item"), F.col("term_id").alias("id")))
    own = dictionary.where(t.maybe_number(F.col("term")))
    return own.select(F.inline(F.filter(keyed, lambda x: x["item"].isNotNull())))


def find_by_index(encoded: DataFrame, index: DataFrame, item: str, position: str = "o") -> DataFrame:
    """Encoded quads whose term of a position has this item in a stored index: no term is read or parsed.
    An item has few ids against the quads', but no bound, so the planner chooses how to join."""
    ids = get(index, item).select(F.col("id").alias(f"{position}_id")).distinct()
    return encoded.join(ids, f"{position}_id", "left_semi").select(*encoded.columns)


def find_by_lang(quads: DataFrame, lang: str) -> DataFrame:
    """Quads whose object has this language tag."""
    return quads.where(t.lang(F.col("o")) == lang)


def find_by_number(quads: DataFrame, value: str) -> DataFrame:
    """Quads whose object has this numeric value, given in any decimal notation."""
    return quads.where(t.maybe_number(F.col("o")) & (t.number_key(F.col("o")) == t.decimal_key(F.lit(value))))

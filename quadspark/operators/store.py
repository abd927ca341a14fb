"""Set semantics of a quad store over immutable tables: insert, delete, overlays, lists by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadspark.functions.terms import DEFAULT_GRAPH
from quadspark.operators.pattern import POSITIONS, condition
from quadspark.plans.numbering import numbered


def normalised(quads: DataFrame) -> DataFrame:
    """Quads with a null graph are triples: they go to the default graph. Other nulls are no quads."""
    own = quads.select(F.coalesce("g", F.lit(DEFAULT_GRAPH)).alias("g"), "s", "p", "o")
    return own.where("s is not null and p is not null and o is not null")


def register(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` and the quads of ``new`` that are not among them, each once."""
    return existing.select(*POSITIONS).unionByName(normalised(new)).dropDuplicates(POSITIONS)


def additions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """What register would add: the delta to append. ``existing`` is read, not rewritten."""
    return normalised(new).dropDuplicates(POSITIONS).join(existing.select(*POSITIONS), POSITIONS, "left_anti")


def delete(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """``quads`` without those of ``gone``; unknown ones do nothing."""
    return quads.select(*POSITIONS).join(normalised(gone), POSITIONS, "left_anti")


def remove_pattern(quads: DataFrame, g=None, s=None, p=None, o=None) -> DataFrame:
    """``quads`` without those that match."""
    return quads.select(*POSITIONS).where(~condition(g, s, p, o))


def clear_graph(quads: DataFrame, g: str) -> DataFrame:
    return remove_pattern(quads, g=g)


def overlay(base: DataFrame, adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """What a transaction reads: its adds win over its deletes."""
    return delete(base, deletes).unionByName(normalised(adds)).dropDuplicates(POSITIONS)


def size(quads: DataFrame) -> DataFrame:
    return quads.agg(F.count("*").alias("n"))


def graph_sizes(quads: DataFrame) -> DataFrame:
    """Quads of each graph, clamped to 2 ** 31 - 1."""
    return quads.groupBy("g").agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("bigint").alias("n"))


# -- values by id: (id BIGINT, payload) ---------------------------------------------------------
#: The largest id of a list: so many pages of so many values.
MAX_ID = (2**31 - 1) ** 2 - 1


def checked(rows: DataFrame) -> DataFrame:
    """The rows; an error if an id is negative or beyond MAX_ID."""
    bad = (F.col("id") < 0) | (F.col("id") > F.lit(MAX_ID))
    return rows.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("list id out of range: "), F.col("id").cast("string"))).cast("bigint")).otherwise(F.col("id")))


def append(rows: DataFrame, values: DataFrame, order: list[str]) -> DataFrame:
    """``values`` behind the largest id that was ever used, in this order."""
    last = rows.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("n")).first()["n"]
    new = numbered(values, order, "_n").withColumn("id", F.col("_n") + F.lit(last + 1))
    return rows.unionByName(checked(new).select(*rows.columns))


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` take the place of those of the same id."""
    return rows.join(new.select("id"), "id", "left_anti").select(*rows.columns).unionByName(checked(new).select(*rows.columns))


def remove(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti").select(*rows.columns)


def list_sizes(rows: DataFrame) -> DataFrame:
    """Live rows, and the next id."""
    return rows.agg(F.count("*").alias("live"), (F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("next"))

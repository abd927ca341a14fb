"""Dense ids in sort order without a task that sees all rows."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.plans.lineage import drop, written


def packed(rows: DataFrame, order: list[str]) -> list[str | Column]:
    """Sort keys of the same order, in which leading whole numbers are one, as many as fit 63 bits. A sort
    has its first key at hand and fetches rows for the others, which takes long where the first are equal.
    Numbers that are null or negative stay as they are."""
    types = dict(rows.dtypes)
    lead = list(takewhile(lambda c: types[c] in ("int", "bigint"), order))
    if len(lead) < 2:
        return order
    r = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(lead) for k, f in (("n", F.count), ("min", F.min), ("max", F.max))]).first()
    if not r["n"] or any(r[f"n{i}"] < r["n"] or r[f"min{i}"] < 0 for i in range(len(lead))):
        return order
    bits = [r[f"max{i}"].bit_length() for i in range(len(lead))]
    fit = sum(x <= 63 for x in accumulate(bits))
    key = reduce(lambda k, x: F.shiftleft(k, x[1]).bitwiseOR(F.col(x[0]).cast("bigint")), list(zip(lead, bits))[1:fit], F.col(lead[0]).cast("bigint"))
    return [key, *order[fit:]]


def numbered(rows: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``rows`` with ``name`` 0, 1, 2, ... in the order of these columns.

    Rows are written as they are, because range partitioning reads them twice, then range-partitioned,
    sorted and written with their partition and place; the partitions' counts, one number for each, give
    every partition its first id.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = written(rows)
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = packed(whole, order)
    kept = written(whole.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", part.alias("_p"), place.alias("_place")))
    drop(whole)
    counts = {r["_p"]: r["n"] for r in kept.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    # a row for each partition, which is far less than what any of them holds
    first = F.broadcast(spark.createDataFrame(starts, "_p int, _first long"))
    return kept.join(first, "_p").select(*rows.columns, (F.col("_first") + F.col("_place")).alias(name))

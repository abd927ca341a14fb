"""Best-fit packing planned on the histogram of lengths.

1. Each text becomes ids (one pass, written once to the shared folder as piece rows without ids).
2. The number of pieces of each length, at most ``capacity`` numbers, goes to the driver, where
   best-fit-decreasing runs over counts: one step places all pieces of a length into all alike bins.
3. Pieces get their rank within their length from (length, bucket) windows and the buckets' running
   counts, so no length, however common, meets in one task, and take the slot planned for that rank.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quadspark.llm.shared import save, sliced, utf8
from quadspark.llm.tokens import Engine, encode_spliced

#: A plan of at most so many runs (48 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_RUNS = 200_000
#: Pieces of one length in one bucket, about.
BUCKET_ROWS = 20_000


@dataclass
class Run:
    """Ranks first .. first + bins * each - 1 of a length: the k-th of them goes to sequence
    base + k % bins at offset + length * (k // bins)."""

    length: int
    first: int
    bins: int
    each: int
    base: int
    offset: int


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit-decreasing over counts: the runs, and the number of sequences.

    Open bins are kept as groups of alike ones, (first sequence, number), by remaining room. The
    work grows with the number of different lengths and rooms, not with the number of pieces.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs: list[Run] = []
    total = 0

    def place(length: int, first: int, n: int, room: int, base: int, bins: int) -> int:
        """Put up to n pieces into bins of this room; the number put."""
        each = room // length
        full = min(bins, n // each)
        offset = capacity - room
        if full:
            runs.append(Run(length, first, full, each, base, offset))
            rooms[room - each * length].append((base, full))
        put = full * each
        rest = n - put
        if rest and full < bins:  # here rest < each: one more bin takes it
            runs.append(Run(length, first + put, 1, rest, base + full, offset))
            rooms[room - rest * length].append((base + full, 1))
            put, full = n, full + 1
        if full < bins:
            rooms[room].append((base + full, bins - full))
        return put

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit in {capacity}")
        n, first, room = counts[length], 0, length
        while n and room < capacity:
            if not rooms[room]:
                room += 1
                continue
            base, bins = rooms[room].pop()
            put = place(length, first, n, room, base, bins)
            first, n = first + put, n - put
        if n:
            each = capacity // length
            bins = -(-n // each)
            place(length, first, n, capacity, total, bins)
            total += bins
    return runs, total


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones but for the first."""
    if n == 0:
        return []
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenize_pieces(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int | None = 0,
    chunk: int = 65_536,
    overlap: int = 512,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each document's ids, end_id
    appended. A null text is empty: its document is the end id alone (nothing, without an end id)."""
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    out = T.StructType(fields)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches):
        engine = Engine.get(tokenizer, ranks)
        for b in sliced(batches):
            at: list[int] = []
            rows: list[tuple] = []
            for i, raw in enumerate(b.column(1).to_pylist()):
                parts, _ = encode_spliced(engine, raw.decode("utf-8", "replace"), chunk, overlap)
                ids = np.concatenate([*parts, tail]).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    own = ids[start : start + length]
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(own.tobytes()), *([own.tolist()] if keep_ids else [])))
            cols = list(zip(*rows)) if rows else [[]] * (len(fields) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=out.names)

    return docs.select(F.col(id_col), utf8(text_col).alias("_raw")).mapInArrow(run, out)


def assign_sequences(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a stored table with piece, start and length) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_best_fit(counts, capacity)
    most = max(counts.values(), default=0)
    buckets = max(16, -(-most // BUCKET_ROWS))
    # from an Arrow table: rows of a list would pass through Python workers of their own, which stay
    of_run = {"length": "length", **{f"_{x}": x for x in ("first", "bins", "each", "base", "offset")}}
    plan = spark.createDataFrame(pa.table({c: pa.array([getattr(r, x) for r in runs], pa.int64()) for c, x in of_run.items()}))
    key = F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("_bucket", key)
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(id_col, "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("_own", own - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan
    hit = (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_bins") * F.col("_each"))
    k = F.col("_rank") - F.col("_first")
    return ranked.join(plan, hit).select(
        *[ranked[c] for c in pieces.columns],
        (F.col("_base") + k % F.col("_bins")).alias("sequence_id"),
        (F.col("_offset") + ranked["length"] * F.floor(k / F.col("_bins")).cast("long")).alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, **options) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Every document takes part, empty and null texts with the end id alone. Only documents of more
    than ``capacity`` ids are cut. Repeated rows are packed each. An empty table gives no rows.
    """
    pieces = save(tokenize_pieces(docs, tokenizer, ranks, capacity=capacity, **options), "pieces")
    return assign_sequences(pieces, capacity, options.get("id_col", "doc_id"))

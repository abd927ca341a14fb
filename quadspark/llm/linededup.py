"""Reversible line dedup: exact reference counts of line keys, and sharded cuckoo filters of those
keys that are common.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; it counts if it has
``min_chars`` code points. ``refs`` has a row for each (key, document), ``counts`` each key's number
of documents and largest document, exactly; ``filters`` holds, for each shard of the key space, a
cuckoo filter of the keys found in ``min_docs`` documents or more. Documents are inserted and
deleted in batches, and both touch all three.

Hashes of lines, not texts, are sent to their shard and asked of its filter there; a shard that a
frequent line makes large is dealt over several tasks, each with the filter. Hits are checked with the
exact counts, and name the lines that each document loses. Texts are not shuffled, or, when these lists
are too many to be sent to all tasks, only those that lose a line.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.cuckoo import LOAD, SLOTS, Cuckoo, Full, buckets_for
from quadspark.llm.shared import carried, drop, raw_texts, restored, save, sliced, utf8

#: Keys of a shard, about, shards at least, and references that are asked of a filter at once.
SHARD_KEYS, LEAST_SHARDS, BLOCK_REFS = 100_000, 64, 500_000
#: Lost keys in all (about 100 bytes each) that are sent to every task at most, and ids of documents.
BROADCAST_KEYS, BROADCAST_IDS = 500_000, 2_000_000
WHITE = b" \t\n\v\f\r"
KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def counts_as_key(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def keys_of(raw: bytes, min_chars: int) -> list[bytes]:
    """16-byte hashes of the text's distinct keys."""
    keys = {line_key(x) for x in raw.split(b"\n")} if len(raw) >= min_chars else ()
    return [key_hash(k) for k in keys if counts_as_key(k, min_chars)]


def line_refs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): a row for each key of each row's text. Null ids have none."""
    out = T.StructType([T.StructField(c, T.LongType()) for c in (*KEY, "doc_id")])

    def run(batches):
        for b in sliced(batches):
            raws = b.column(1).to_pylist()
            found = [keys_of(r, min_chars) for r in raws]
            n = np.fromiter(map(len, found), np.int64, len(found))
            pair = np.frombuffer(b"".join(k for f in found for k in f), "<i8").reshape(-1, 2)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, 0])), pa.array(np.ascontiguousarray(pair[:, 1])), pa.array(ids.astype(np.int64))], names=out.names)

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), utf8("text").alias("_raw")).mapInArrow(run, out)


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    buckets: int
    min_docs: int
    min_chars: int
    #: Written tables that only this index and those made from it read.
    owned: tuple[DataFrame, ...] = ()

    # -- building -------------------------------------------------------------------------------
    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> "LineIndex":
        """An index of these documents. Rows that share a doc_id are one document."""
        refs = save(line_refs(docs, min_chars).dropDuplicates(), "line-refs")
        counts = save(count_refs(refs), "line-counts")
        filters, shards, buckets = build_filters(counts, min_docs)
        return cls(refs, counts, filters, shards, buckets, min_docs, min_chars, (refs, counts, filters))

    def discard(self) -> None:
        """Delete the index's tables, which no other index made from or before it may need any more."""
        drop(*self.owned)

    def common(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with these documents too. Lines a document has in it already count once."""
        more = save(line_refs(docs, self.min_chars).dropDuplicates().join(self.refs, [*KEY, "doc_id"], "left_anti"), "line-refs")
        counts = self.counts.unionByName(count_refs(more)).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return self._moved(self.refs.unionByName(more), save(counts, "line-counts"), more)

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents of these ids (column doc_id); unknown ids do nothing."""
        ids = ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
        refs = save(self.refs.join(ids, "doc_id", "left_anti").select(self.refs.columns), "line-refs")
        touched = self.refs.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        again = count_refs(refs.join(touched, KEY, "left_semi"))
        counts = self.counts.join(touched, KEY, "left_anti").unionByName(again)
        return self._moved(refs, save(counts, "line-counts"), refs)

    def _moved(self, refs: DataFrame, counts: DataFrame, written: DataFrame) -> "LineIndex":
        """With these tables, and the filters brought in line with them."""
        now = replace(self, refs=refs, counts=counts, owned=(*self.owned, counts, written))
        was, new = self.common().select(*KEY), now.common().select(*KEY)
        changes = save(new.join(was, KEY, "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(new, KEY, "left_anti").withColumn("add", F.lit(False))), "line-changes")
        if new.count() > LOAD * SLOTS * self.buckets * self.shards:
            return now._rebuilt()
        shards = self.shards

        def update(own: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            for _, f in own.iterrows():
                c = Cuckoo(data=f["cells"])
                add = change["add"].to_numpy(bool)
                h2 = change["h2"].to_numpy(np.int64)
                c.delete(np.ascontiguousarray(h2[~add]))
                try:
                    c.insert(np.ascontiguousarray(h2[add]))
                except Full:
                    return pd.DataFrame({"shard": [f["shard"]], "cells": [None]})
                return pd.DataFrame({"shard": [f["shard"]], "cells": [c.to_bytes()]})
            return pd.DataFrame({"shard": [], "cells": []})

        dealt = changes.withColumn("shard", shard_of(shards))
        filters = save(self.filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(update, "shard int, cells binary"), "line-filters")
        full = filters.where("cells is null").limit(1).count()
        drop(changes)
        if full:
            drop(filters)
            return now._rebuilt()
        return replace(now, filters=filters, owned=(*now.owned, filters))

    def _rebuilt(self) -> "LineIndex":
        filters, shards, buckets = build_filters(self.counts, self.min_docs)
        return replace(self, filters=filters, shards=shards, buckets=buckets, owned=(*self.owned, filters))

    # -- use ------------------------------------------------------------------------------------
    def hits(self) -> DataFrame:
        """(h1, h2, doc_id): the references whose key the filter of its shard knows."""
        # at most a row for each shard: in how many blocks its references are asked
        loads = self.counts.groupBy(shard_of(self.shards).alias("shard")).agg(F.ceil(F.sum("n_docs") / BLOCK_REFS).cast("int").alias("_blocks"))
        loads = F.broadcast(loads)
        asked = self.refs.withColumn("shard", shard_of(self.shards)).join(loads, "shard").withColumn("block", F.pmod(F.xxhash64("doc_id", "h2"), F.col("_blocks")).cast("int"))
        each = self.filters.join(loads, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

        def ask(refs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(refs) or not len(own):
                return refs.iloc[:0]
            return refs[Cuckoo(data=own["cells"].iloc[0]).contains(np.ascontiguousarray(refs["h2"].to_numpy(np.int64)))]

        key = ["shard", "block"]
        left = asked.select(*key, *KEY, "doc_id").groupBy(*key)
        found = left.cogroup(each.select(*key, "cells").groupBy(*key)).applyInPandas(lambda r, f: ask(r, f)[[*KEY, "doc_id"]], "h1 long, h2 long, doc_id long")
        return found

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document of the index loses."""
        lost = self.hits().join(self.common(), KEY).where(F.col("doc_id") != F.col("max_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs``, which are in the index, with n_lines, n_dropped and kept_text.

        A key found in ``min_docs`` documents loses its lines in all but the largest doc_id that
        holds it. A null or empty text is one empty line and stays as it is (null: kept_text is
        empty). Rows of a null doc_id keep all lines. Rows that share a doc_id lose the same keys.
        Columns of the input named like the new ones are dropped.

        What documents lose is found without their texts. It is sent to every task (BROADCAST_KEYS),
        or else the ids of the documents that lose something are (BROADCAST_IDS) and only their texts
        are shuffled to it; of more documents all texts are.
        """
        return without_lines(docs, save(self.drops(), "line-drops"), self.min_chars)


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, without the lines of the keys in ``drops``."""
    new = ["n_lines", "n_dropped", "kept_text"]
    cols = [c for c in docs.columns if c not in new]
    own, fields = carried(docs, cols, "text")
    held = [f.name for f in fields]
    kept = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("_kept", T.BinaryType())])
    size = drops.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("keys")).first()
    drops = drops.select(F.col("doc_id").alias("_doc"), F.col("keys").alias("_keys"))
    of_doc = F.col(held[cols.index("doc_id")]).cast("long") == F.col("_doc")

    def strip(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], *stripped(raw_texts(b, cols, "text"), b.column(b.num_columns - 1), min_chars)], names=kept.names)

    def done(rows: DataFrame, by: DataFrame) -> DataFrame:
        return rows.join(by, of_doc, "left").select(*own.columns, "_keys").mapInArrow(strip, kept)

    if size["keys"] <= BROADCAST_KEYS:
        out = done(own, F.broadcast(drops))
    elif size["docs"] <= BROADCAST_IDS:
        ids = F.broadcast(drops.select("_doc"))
        none = drops.where(F.lit(False))
        out = done(own.join(ids, of_doc, "left_semi"), drops.hint("shuffle_hash")).unionByName(done(own.join(ids, of_doc, "left_anti"), F.broadcast(none)))
    else:
        out = done(own, drops)
    return restored(out.select(*held, "n_lines", "n_dropped", F.col("_kept").cast("string").alias("kept_text")), cols)


def stripped(raws: list[bytes], keys: pa.Array, min_chars: int) -> list[pa.Array]:
    """n_lines, n_dropped and the joined rest of each text without the lines of its keys."""
    pairs = keys.flatten()
    packed = np.stack([pairs.field(i).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1)], 1).tobytes() if len(pairs) else b""
    at, out = 0, ([], [], [])
    for raw, n in zip(raws, keys.value_lengths().fill_null(0).to_pylist()):
        gone = {packed[i : i + 16] for i in range(at, at + 16 * n, 16)}
        at += 16 * n
        lines = raw.split(b"\n") if gone else []
        rest = [x for x in lines if not (len(x) >= min_chars and counts_as_key(k := line_key(x), min_chars) and key_hash(k) in gone)]
        whole = len(rest) == len(lines)
        for to, x in zip(out, (len(lines) if gone else raw.count(b"\n") + 1, len(lines) - len(rest), raw if whole else b"\n".join(rest))):
            to.append(x)
    return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]


def shard_of(shards: int) -> Column:
    return F.col("h1").bitwiseAND(F.lit(shards - 1)).cast("int")


def count_refs(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


def build_filters(counts: DataFrame, min_docs: int) -> tuple[DataFrame, int, int]:
    """(shard, cells) of the common keys, the number of shards and of a shard's buckets."""
    common = counts.where(F.col("n_docs") >= min_docs)
    n = common.count()
    shards = LEAST_SHARDS
    while shards * SHARD_KEYS < n:
        shards *= 2
    spark = counts.sparkSession
    buckets = buckets_for(int(1.3 * n / shards) + 64)
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))

    def fill(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        h2, room = own["h2"].dropna().to_numpy(np.int64), buckets
        while True:  # a shard that finds no place for a key gets a filter of twice the size
            c = Cuckoo(room)
            try:
                c.insert(h2)
                return pd.DataFrame({"shard": [key[0]], "cells": [c.to_bytes()]})
            except Full:
                room *= 2

    keys = common.select(shard_of(shards).alias("shard"), "h2")
    empty = every.withColumn("cells", F.lit(Cuckoo(buckets).to_bytes()))
    full = keys.groupBy("shard").applyInPandas(fill, "shard int, cells binary")
    filters = save(full.unionByName(empty.join(keys.select("shard").distinct(), "shard", "left_anti")), "line-filters")
    return filters, shards, buckets


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Index ``docs`` and clean them. Of the written tables only what documents lose is left."""
    index = LineIndex.build(docs, min_docs, min_chars)
    out = index.clean(docs)
    index.discard()
    return out

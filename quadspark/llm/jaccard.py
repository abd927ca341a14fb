"""N-gram Jaccard join by universe partitioning.

Sets whose Jaccard similarity is at least t differ in at most K = (a + b)(1 - t)/(1 + t) elements,
a and b their sizes. Sizes fall into bands of ratio 1/t, so linked sets lie in one band or in
neighbours; for each pair of neighbouring bands the hash space is cut into m segments. The K
differences are spread over the segments, so if segment i may have e_i of them and the sum of
(e_i + 1) exceeds K, some segment has no more than e_i. Segments with e = 0 are indexed by the
subset of the set that falls into them, those with e = 1 also by that subset without each one of
its elements. How many get e = 1 is chosen by the cost of signatures and expected false candidates.

Two unlike sets agree where both have nothing, so empty subsets of e = 0 segments are not indexed,
and m is larger by the number of them that a set has nearly always. A set with more is indexed with
its empty subsets: of two linked sets either one is not such a set, and they share a subset that is
not empty, or both are, and all segments count. No link is lost either way.

Signatures are counted before they are joined, slice by slice; only those of two different sets
survive. Each bucket is tried as a star around one member; pairs pass an exact lower bound on their
difference, are verified on the sets of 64-bit shingle hashes, and components are formed; only then
are members that are still in different components compared with each other. So a group of thousands
of near copies costs about one verification a member. Sketches of fixed length say nothing of large sets, whose
unlike pairs in common buckets grow with the square of the table: before any hashes are fetched, pairs
pass the same bound on sketches as long as the sets are large. A large bucket of unlike sets, which share no more
than a frequent shingle, is not compared pair by pair but joined on its rarest shingles: of n shingles so
many stand first, in an order by frequency within the bucket, that linked sets must have one in common.

Sets are told apart by 128 bits: ids have 63, and the sets of an id that 64 more bits tell apart get others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quadspark.llm.components import components, merged
from quadspark.llm.shared import drop, release, save, sliced, utf8

U = np.uint64
#: Ids of documents that are broadcast at most, to fetch the texts of candidates.
BROADCAST_IDS = 2_000_000
#: Longs of the sketch whose bits bound the difference of two sets from below.
SKETCH = 8
#: Share of the sets in a band, and the cost of a false candidate in signatures, for the allocation.
BAND_SHARE, FALSE_COST = 0.05, 0.1
SKETCHED = [f"s{i}" for i in range(SKETCH)]
#: Members of a bucket that are compared pair by pair at most, by sizes and sketches. A larger bucket's
#: join on rare shingles costs more a member, but no more the larger it is.
PAIRED = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible structure."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, A-Z lower-cased; of all words as one,
    if they are fewer; none without words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, U)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words)))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, U)
    for i in range(min(width, len(h))):
        out = mix(out + h[i : i + n])
    return np.unique(out)


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """63 bits that name a set, and 64 (signed) that tell it from others of that name."""
    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return both >> 65, (both & (1 << 64) - 1) - (1 << 63)


class Bands:
    """Size bands, and the segments of each pair of neighbours, for similarity percent/100."""

    def __init__(self, percent: int, rows: int):
        self.percent, self.rows = percent, max(1, rows)
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    @lru_cache(maxsize=None)
    def segments(self, group: int) -> tuple[int, int, int]:
        """(m, how many of them have e = 1, how many empty ones of the others a set may have) for
        pairs of bands ``group`` and ``group`` + 1; m = 0 if only equal sets can be linked there."""
        while len(self.lows) <= group + 1:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        low, high = self.lows[group], self.lows[group + 1] - 1
        differ = (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        if differ == 0:
            return 0, 0, 0
        best = (np.inf, 0, 0, 0)
        for ones in sorted({round(x) for x in np.linspace(0, (differ + 1) // 2, 33)}):
            m = differ + 1 - ones
            for _ in range(8):
                empty = (m - ones) * np.exp(-low / m)
                spare = int(np.ceil(empty + 3 * np.sqrt(empty)))
                m = differ + 1 - ones + spare
            mean = low / m
            alike = np.exp(-2 * mean)
            false = self.rows * BAND_SHARE * alike * ((m - ones) / m + ones * (1 + 2 * mean))
            cost = m + ones * mean + FALSE_COST * false
            if cost < best[0]:
                best = (cost, m, ones, spare)
        return best[1:]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        """Signatures of the subsets, even, and of the subsets without one element, odd."""
        out = [np.zeros(0, U)]
        if len(hashes):
            own = mix(hashes ^ U(0x6A09E667F3BCC909))
            at = self.band(len(hashes))
            for group in (at, at - 1):
                m, ones, spare = self.segments(group) if group >= 0 else (0, 0, 0)
                if not m:
                    continue
                seg = (((hashes >> U(32)) * U(m)) >> U(32)).astype(np.int64)
                sums = np.zeros(m, U)
                np.add.at(sums, seg, own)
                name = mix((U(group + 1) << U(40)) + np.arange(m, dtype=U))
                empty = np.bincount(seg, minlength=m) == 0
                empty[:ones] = False
                keep = slice(None) if empty.sum() > spare else ~empty
                out.append(mix(sums ^ name)[keep] & ~U(1))
                if ones:
                    some = seg < ones
                    out.append(mix((sums[seg[some]] - own[some]) ^ name[seg[some]]) | U(1))
        return np.concatenate(out)


def sketch(hashes: np.ndarray, cells: int = 64 * SKETCH) -> np.ndarray:
    """Parities of the elements in each of so many cells, a power of two: differing bits never outnumber
    differing elements."""
    odd = np.bincount((hashes & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def wide_sketch(hashes: np.ndarray) -> np.ndarray | None:
    """The sketch with a cell or more for each element; none if the short one has as many."""
    return sketch(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > 64 * SKETCH else None


def signed_sets(docs: DataFrame, width: int, percent: int, rows: int, slices: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, set_lo, the sketch, the wide sketch, and the signatures in ``slices``
    columns). The ids are null for texts without words."""
    longs = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_id", "set_lo", *SKETCHED)]
    wide = T.StructField("wide", T.ArrayType(T.LongType(), False))
    out = T.StructType([docs.schema["doc_id"], *longs, wide, *(T.StructField(f"sigs{k}", T.ArrayType(T.LongType(), False)) for k in range(slices))])

    def run(batches):
        bands = Bands(percent, rows)
        for b in sliced(batches):
            n, ids, sketches, wides, lists = [], [], [], [], [[] for _ in range(slices)]
            for raw in b.column(1).to_pylist():
                h = shingles(raw, width)
                n.append(len(h))
                ids.append(set_ids(h) if len(h) else (None, None))
                sketches.append(sketch(h))
                wides.append(wide_sketch(h))
                sigs = bands.signatures(h)
                part = (sigs >> U(1)) % U(slices)
                for k in range(slices):
                    lists[k].append(sigs[part == k].view(np.int64))
            bits = np.array(sketches, np.int64).reshape(-1, SKETCH)
            arrays = []
            for x in lists:
                ends = np.concatenate(([0], np.cumsum([len(s) for s in x]))).astype(np.int32)
                flat = np.concatenate(x) if x else np.zeros(0, np.int64)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(SKETCH)), pa.array(wides, pa.list_(pa.int64())), *arrays], names=out.names)

    return docs.select("doc_id", utf8("text").alias("_raw")).mapInArrow(run, out)


def hashed_sets(docs: DataFrame, width: int) -> DataFrame:
    """(set_id, set_lo, hashes) of each text."""
    out = T.StructType([T.StructField("set_id", T.LongType()), T.StructField("set_lo", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for b in sliced(batches):
            sets = [shingles(raw, width) for raw in b.column(0).to_pylist()]
            ids = [set_ids(h) for h in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=out.names)

    return docs.select(utf8("text").alias("_raw")).mapInArrow(run, out)


def renamed(rows: DataFrame, twice: DataFrame | None) -> DataFrame:
    """``rows`` (set_id, set_lo, ...) with other ids for sets whose ids name several."""
    if twice is None:
        return rows
    other = F.shiftrightunsigned(F.xxhash64("set_id", "set_lo"), 1)
    got = rows.join(F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice, "set_id", "left")
    return got.withColumn("set_id", F.when(F.col("_twice"), other).otherwise(F.col("set_id"))).select(rows.columns)


def classes_of(signed: DataFrame) -> DataFrame:
    """(set_id, first_doc, n, the sketch, twice): the sets, and whether an id names several."""
    every = signed.where("set_id is not null and doc_id is not null")
    sketches = [F.max(c).alias(c) for c in SKETCHED]
    return save(every.groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.max("n_shingles").alias("n"), *sketches, (F.min("set_lo") != F.max("set_lo")).alias("_twice")), "classes")


def lightly(classes: DataFrame, side: str) -> DataFrame:
    """A set's size and sketch under names of one side of a pair."""
    return classes.select(F.col("set_id").alias(side), F.col("n").alias(f"_n{side}"), *[F.col(c).alias(f"_{c}{side}") for c in SKETCHED])


def may_link(percent: int):
    """What is true of all linked pairs: sizes near enough, and few enough differing parities."""
    differ = sum((F.bit_count(F.col(f"_{c}a").bitwiseXOR(F.col(f"_{c}b"))).cast("int") for c in SKETCHED), F.lit(0))
    near = F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * percent
    return near & (differ * (100 + percent) <= (F.col("_na") + F.col("_nb")) * (100 - percent))


def wide_sketches(signed: DataFrame) -> DataFrame:
    """(set_id, n, wide) of the sets that have a wide sketch."""
    every = signed.where("set_id is not null and doc_id is not null and wide is not null")
    return save(every.select("set_id", F.col("n_shingles").alias("n"), "wide").dropDuplicates(["set_id"]), "wide")


def narrowed(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) without those whose wide sketches differ in more bits than linked sets can. The
    longer sketch of a pair is folded to the cells of the other."""
    cells = F.least(F.array_size("_wa"), F.array_size("_wb"))

    def folded(x: str):
        last = (F.array_size(x) / cells).cast("int") - 1
        zero = F.array_repeat(F.lit(0).cast("long"), cells)
        sums = F.aggregate(F.sequence(F.lit(0), last), zero, lambda s, i: F.zip_with(s, F.slice(x, i * cells + 1, cells), lambda p, q: p.bitwiseXOR(q)))
        return F.when(F.array_size(x) == cells, F.col(x)).otherwise(sums)

    bits = F.zip_with(folded("_wa"), folded("_wb"), lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("long"))
    differ = F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)
    near = differ * (100 + percent) <= (F.col("_na") + F.col("_nb")) * (100 - percent)
    for x in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("set_id").alias(x), F.col("n").alias(f"_n{x}"), F.col("wide").alias(f"_w{x}")), x, "left")
    return pairs.where(F.col("_wa").isNull() | F.col("_wb").isNull() | near).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b) of set ids, by their exact similarity."""
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("_ha"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("_hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_common", F.size(F.array_intersect("_ha", "_hb")))
    union = F.size("_ha") + F.size("_hb") - F.col("_common")
    return both.where(F.col("_common") * 100 >= union * percent).select("a", "b")


def still_apart(members: DataFrame, labels: DataFrame, classes: DataFrame, tried: DataFrame, percent: int, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs of members of one bucket in different components that may be linked and weren't tried.
    ``sets`` gives the hashes of a table of set ids."""
    at = members.join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    mixed = at.groupBy("sig").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count("*").alias("_size")).where("_lo <> _hi").select("sig", "_size")
    both = save(at.join(mixed, "sig").join(classes.drop("first_doc", "_twice"), "set_id"), "open")

    def side(rows: DataFrame, x: str) -> DataFrame:
        more = [c for c in ("_e", "_rank") if c in rows.columns]
        return rows.select(F.col("sig").alias(f"_sig{x}"), F.col("whole").alias(f"_w{x}"), F.col("label").alias(f"_l{x}"), F.col("set_id").alias(x), F.col("n").alias(f"_n{x}"), *[F.col(c).alias(f"_{c}{x}") for c in SKETCHED], *[F.col(c).alias(f"{c}{x}") for c in more])

    apart = (F.col("_siga") == F.col("_sigb")) & (F.col("_la") != F.col("_lb")) & (F.col("_wa") | F.col("_wb")) & may_link(percent)
    few = both.where(F.col("_size") <= PAIRED)
    found = side(few, "a").join(side(few, "b"), apart & (F.col("a") > F.col("b"))).select("a", "b").distinct()
    many = both.where(F.col("_size") > PAIRED)
    if many.limit(1).count():
        own = sets(many.select("set_id").distinct())
        # rows are few and small until they are exploded, so they are dealt out before
        parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = many.join(own, "set_id").repartition(parts, "sig", "set_id").select(*many.columns, F.explode("hashes").alias("_e"))
        often = each.groupBy("sig", "_e").agg(F.countDistinct("set_id").alias("_often"))
        order = W.partitionBy("sig", "set_id", "whole").orderBy("_often", "_e")
        ranked = each.join(often, ["sig", "_e"]).withColumn("_rank", F.row_number().over(order)).where("_often > 1")
        # of two linked sets the larger has a shingle in common with the smaller among these first ones
        larger = F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        smaller = F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
        ranked = save(ranked.where(larger).withColumn("_small", smaller).drop("_often"), "ranked")
        ordered = (F.col("_na") > F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("a") != F.col("b")))
        near = side(ranked, "a").join(side(ranked.where("_small"), "b"), apart & (F.col("_ea") == F.col("_eb")) & ordered)
        found = save(found.unionByName(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "apart")
        drop(own, ranked)
    return found.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")


def ends(pairs: DataFrame) -> DataFrame:
    """The set ids in these pairs."""
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int, twice: DataFrame | None = None) -> DataFrame:
    """The hashes of these sets, from one document of each."""
    ids = save(classes.join(wanted, "set_id").select(F.col("first_doc").alias("doc_id")), "wanted")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    out = save(renamed(hashed_sets(texts, width), twice).join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")
    drop(ids)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, slices: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    ``component_id`` is the smallest doc_id reachable by links, texts whose sets of ``width``-word
    shingles have a Jaccard similarity of ``percent``/100 or more. Texts with fewer words are one
    shingle; texts without words (null, empty, blank) have none, are linked with nothing and are
    components of their own. doc_id is a number that names a row; rows of a null doc_id are in
    components of their own with a null id. An empty table gives no rows; other columns are not read.
    ``slices``: in how many parts the signatures are counted and joined, which bounds the disk.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = save(signed_sets(docs, width, percent, docs.count(), slices), "signed")
    classes, twice = classes_of(signed), None
    if classes.where("_twice").limit(1).count():
        twice = save(classes.where("_twice").select("set_id", "_twice"), "twice")
        was, signed = signed, save(renamed(signed, twice), "signed")
        drop(was, classes)
        classes = classes_of(signed)
        if classes.where("_twice").limit(1).count():
            raise RuntimeError("sets cannot be told apart by 128 bits")
    every = signed.where("set_id is not null and doc_id is not null")
    parts = []
    for k in range(slices):
        one = every.select(F.explode(f"sigs{k}").alias("_x"), "set_id")
        whole, sig = F.col("_x").bitwiseAND(F.lit(1)) == 0, F.shiftright("_x", 1)
        # the largest value names the bucket's hub, another set in each bucket
        name = F.col("set_id").bitwiseXOR(sig.bitwiseAND(F.lit((1 << 62) - 1)))
        sigs = one.select(sig.alias("sig"), F.when(whole, name).otherwise(F.lit(-1) - name).alias("v"))
        shared = sigs.groupBy("sig").agg(F.max("v").alias("rep"), F.min("v").alias("_lo")).where("rep >= 0 and rep <> _lo").select("sig", "rep")
        shared = save(shared, "shared-signatures")
        release(spark)
        whole, mask = F.col("v") >= 0, F.col("sig").bitwiseAND(F.lit((1 << 62) - 1))
        name = F.when(whole, F.col("v")).otherwise(F.lit(-1) - F.col("v")).bitwiseXOR(mask)
        got = sigs.join(shared, "sig").select("sig", whole.alias("whole"), name.alias("set_id"), F.col("rep").bitwiseXOR(mask).alias("rep")).distinct()
        parts.append(save(got, "members"))
        drop(shared)
        release(spark)
    # the signatures have done their work: only what names the rows and the wide sketches are kept
    ids, wide = save(signed.select("doc_id", "n_shingles", "set_id"), "ids"), wide_sketches(signed)
    drop(signed)
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    tried = members.where("set_id <> rep").select(F.col("set_id").alias("a"), F.col("rep").alias("b")).distinct()
    likely = tried.join(lightly(classes, "a"), "a").join(lightly(classes, "b"), "b").where(may_link(percent)).select("a", "b")
    tried = save(likely, "pairs")
    near = save(narrowed(tried, wide, percent), "near")
    sets = sets_of(ends(near), classes, docs, width, twice)
    links = save(verified(near, sets, percent), "links")
    labels = components(links)
    drop(near, sets, links)
    release(spark)
    found = save(still_apart(members, labels, classes, tried, percent, lambda ids: sets_of(ids, classes, docs, width, twice)), "pairs")
    more = save(narrowed(found, wide, percent), "near")
    if more.limit(1).count():
        sets = sets_of(ends(more), classes, docs, width, twice)
        links = save(verified(more, sets, percent), "links")
        labels = merged(labels, links)
        drop(sets, links)
        release(spark)
    named = classes.select("set_id", "first_doc").join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of_set = save(named.join(smallest, "label").select("set_id", "component_id"), "components")
    drop(*parts, classes, wide, tried, found, more, labels)
    release(spark)
    got = ids.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(of_set, "set_id", "left")
    return got.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

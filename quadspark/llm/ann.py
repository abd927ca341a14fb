"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M - |x|^2) with M the
largest squared norm (0 for queries). Centroids, about half as many as the root of the number of vectors, are fitted by
balanced halving on a bounded sample. A graph over them is searched in memory with a bounded beam, by
vectors to find their lists and by queries to find theirs. A vector near a boundary is replicated to every list whose centroid is nearly as near as the
nearest, unless one chosen before is nearer to that centroid than the vector. A bounded number of the
queries is compared with all vectors first: a query visits as many lists, or those within such a ratio
of the nearest, as give these the recall asked for. Lists are searched in blocks of bounded size.

Equal vectors are indexed once, with the k + 1 smallest ids, which is all that any query can return.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quadspark.llm.shared import drop, save

#: The sample that centroids are fitted on, at least and for each list, and the numbers of lists: half the
#: root of the number of vectors, between these.
SAMPLE, SAMPLE_LIST, LEAST_LISTS, MOST_LISTS = 16_384, 8, 64, 65_536
#: Rows of a block of a list, and queries that are compared with it at once.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Links of a centroid to its nearest ones, the least beam of a search, centroids that are expanded at
#: once, centroids that a search starts from, and rows that are searched together.
DEGREE, BEAM, EXPANDED, STARTS, ROWS = 24, 64, 8, 8, 256
#: Queries that are compared with all vectors to fit how many lists are visited, at most.
PROBES = 256


def halve(x: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index arrays of ``parts`` groups of about equal size, by repeated balanced 2-means."""
    todo, done = [(np.arange(len(x)), parts)], []
    while todo:
        own, n = todo.pop()
        if n == 1 or len(own) < 2 * n:
            done.append(own)
            continue
        v = x[own]
        a, b = v[rng.choice(len(own), 2, replace=False)]
        cut = (n // 2) / n
        for _ in range(6):
            side = v @ (b - a)
            left = np.zeros(len(own), bool)
            left[np.argsort(side, kind="stable")[: int(len(own) * cut)]] = True
            a, b = v[left].mean(0), v[~left].mean(0)
        todo += [(own[left], n // 2), (own[~left], n - n // 2)]
    return done


class CentroidGraph:
    """Centroids, links of each to its nearest ones and to some far ones, and pivots, about the root of
    their number, that searches start from."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.norm = (self.c**2).sum(1)
        n, r = len(self.c), np.random.default_rng(seed)
        degree = min(degree, n - 1)
        near = np.empty((n, degree), np.int32)
        for i in range(0, n, 512):
            d = self.norm - 2 * self.c[i : i + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 512] = np.argpartition(d, degree - 1, 1)[:, :degree] if degree else near[i : i + 512]
        self.links = np.concatenate([near, r.integers(0, n, (n, 4), np.int32)], 1)
        self.pivots = np.sort(r.permutation(n)[: max(min(n, STARTS), int(np.ceil(np.sqrt(n))))]).astype(np.int32)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found by best-first search, nearest first, and their squared
        distances (inf and list -1 where fewer were found). All of them, if so many are asked for."""
        x = np.ascontiguousarray(x, np.float32)
        width = min(width, len(self.c))
        parts = [self._search(x[i : i + ROWS], width) for i in range(0, len(x), ROWS)] or [(np.zeros((0, width), np.int32), np.zeros((0, width), np.float32))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        own, rows, n = (x**2).sum(1), np.arange(len(x))[:, None], len(self.c)
        if width == n:
            dist = own[:, None] + self.norm - 2 * x @ self.c.T
            ids = np.broadcast_to(np.arange(n, dtype=np.int32), dist.shape)
        else:
            beam = min(n, max(3 * width // 2, BEAM))
            first = own[:, None] + self.norm[self.pivots] - 2 * x @ self.c[self.pivots].T
            at = np.argpartition(first, min(STARTS, len(self.pivots)) - 1, 1)[:, :STARTS]
            ids, dist = self.pivots[at], np.take_along_axis(first, at, 1)
            seen = np.zeros((len(x), n), bool)
            seen[rows, ids] = True
            open_ = np.ones(ids.shape, bool)
            while True:
                waiting = np.where(open_, dist, np.inf)
                e = np.argpartition(waiting, EXPANDED - 1, 1)[:, :EXPANDED] if waiting.shape[1] > EXPANDED else np.broadcast_to(np.arange(waiting.shape[1]), waiting.shape)
                live = np.isfinite(waiting[rows, e])
                if not live.any():
                    break
                open_[rows, e] = False
                # neighbours of what is expanded, each once, without those seen before
                to = np.where(live[:, :, None], self.links[np.maximum(ids[rows, e], 0)], n).reshape(len(x), -1)
                to.sort(1)
                new = to < n
                new[:, 1:] &= to[:, 1:] != to[:, :-1]
                new &= ~seen[rows, np.minimum(to, n - 1)]
                r, k = np.nonzero(new)
                node = to[r, k]
                seen[r, node] = True
                more = np.full(to.shape, np.inf, np.float32)
                more[r, k] = own[r] + self.norm[node] - 2 * np.einsum("nd,nd->n", x[r], self.c[node])
                ids, dist, open_ = np.concatenate([ids, to], 1), np.concatenate([dist, more], 1), np.concatenate([open_, new], 1)
                if ids.shape[1] > beam:
                    best = np.argpartition(dist, beam - 1, 1)[:, :beam]
                    ids, dist, open_ = (np.take_along_axis(v, best, 1) for v in (ids, dist, open_))
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        ids, dist = np.take_along_axis(ids, order, 1).astype(np.int32), np.take_along_axis(dist, order, 1)
        if ids.shape[1] < width:
            pad = ((0, 0), (0, width - ids.shape[1]))
            ids, dist = np.pad(ids, pad, constant_values=-1), np.pad(dist, pad, constant_values=np.inf)
        return np.where(np.isfinite(dist), ids, -1), np.maximum(dist, 0)


def reach(at: np.ndarray, d: np.ndarray, ratio: float) -> list[np.ndarray]:
    """For each row of lists, nearest first, and their squared distances those within (1 + ratio) of the
    nearest."""
    return [a[m] for a, m in zip(at, (at >= 0) & (d <= (1 + ratio) ** 2 * np.maximum(d[:, :1], 1e-12)))]


def enough(graph: CentroidGraph, x: np.ndarray, lists: list[np.ndarray], sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """``lists`` of each row of x, or, where these hold fewer than ``least`` entries, so many of the
    nearest of all lists as hold them; all, if there are fewer in all."""
    short = [i for i, own in enumerate(lists) if sizes[own].sum() < least]
    for i, every in zip(short, graph.search(x[short], len(graph.c))[0] if short else ()):
        lists[i] = every[: int(np.searchsorted(np.cumsum(sizes[every]), least)) + 1]
    return lists


def fitted(at: np.ndarray, d: np.ndarray, held: list[tuple[int, list[int]]], recall: float) -> tuple[int, float] | None:
    """(visited, ratio) that find the share ``recall`` of ``held``, pairs of a row of ``at`` (lists that
    were found, nearest first, at squared distances d) and the lists that hold one of its neighbours:
    what visits fewer lists, a number of them or all within a ratio. None if too few were found."""
    if not held:
        return at.shape[1], float("inf")
    place = [{int(x): k for k, x in enumerate(row) if x >= 0} for row in at]
    first = np.sort([min((place[i].get(x, np.inf) for x in lists), default=np.inf) for i, lists in held])
    need = int(np.ceil(recall * len(held))) - 1
    if not np.isfinite(first[need]):
        return None
    visited = int(first[need]) + 1
    far = np.sqrt(d / np.maximum(d[:, :1], 1e-12))
    of = [min((far[i, place[i][x]] for x in lists if x in place[i]), default=np.inf) for i, lists in held]
    ratio = float(np.sort(of)[need]) * 1.001 - 1
    within = (far <= 1 + ratio).sum(1)
    if visited <= within.mean():
        return visited, float("inf")
    return min(at.shape[1], 2 * int(within.max())), max(ratio, 0.0)


def own_lists(graph: CentroidGraph, x: np.ndarray, replicas: int, slack: float) -> list[list[int]]:
    """The lists that each vector is put into."""
    at, d = graph.search(x, 3 * replicas)
    out = []
    for lists, dist in zip(at, d):
        chosen: list[int] = []
        for c, far in zip(lists[lists >= 0], dist):
            if len(chosen) == replicas or not far <= (1 + slack) ** 2 * dist[0]:
                break
            if all(((graph.c[c] - graph.c[o]) ** 2).sum() > 0.5 * far for o in chosen):
                chosen.append(int(c))
        out.append(chosen)
    return out


def usable(v: Column) -> Column:
    """Whether a vector takes part: all components finite, one not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec of doubles) of the rows that take part, and their dimension: the commonest."""
    own = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    size = own.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = size[0]["dim"] if size else 0
    return own.where(F.size("vec") == dim), dim


def packed(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the vector as bytes of doubles."""
    out = T.StructType([*(df.schema[c] for c in keep), T.StructField("raw", T.BinaryType())])

    def run(batches):
        for b in batches:
            v = b.column(len(keep))
            flat, n = v.flatten().to_numpy(zero_copy_only=False).astype("<f8"), len(v)
            width = len(flat) // n if n else 0
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([flat[i * width : (i + 1) * width].tobytes() for i in range(n)], pa.binary())], names=out.names)

    return df.select(*keep, "vec").mapInArrow(run, out)


def matrix(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(-1, dim)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], 1)


def aimed(x: np.ndarray, most: float) -> np.ndarray:
    """Queries, scaled to the largest norm, with the added coordinate 0."""
    scale = np.sqrt(most / np.maximum((x**2).sum(1), 1e-300))
    return np.concatenate([x * scale[:, None], np.zeros((len(x), 1))], 1)


def neighbours(posted: DataFrame, probes: list[bytes], dim: int, k: int) -> DataFrame:
    """(probe, lists): the lists of the k vectors of largest inner product with each probe, among all
    but itself; every vector is compared."""
    held = posted.sparkSession.sparkContext.broadcast(probes)

    def run(batches):
        asks, own = matrix(held.value, dim), {raw: i for i, raw in enumerate(held.value)}
        best = np.full((len(asks), k), -np.inf)
        lists = np.empty((len(asks), k), object)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                raws = part.column(0).to_pylist()
                score = asks @ matrix(raws, dim).T
                for j, raw in enumerate(raws):
                    if raw in own:
                        score[own[raw], j] = -np.inf
                both = np.concatenate([best, score], 1)
                at = np.argpartition(both, -k, 1)[:, -k:]
                best = np.take_along_axis(both, at, 1)
                new = np.empty(len(raws), object)
                new[:] = part.column(1).to_pylist()
                lists = np.where(at < k, np.take_along_axis(lists, np.minimum(at, k - 1), 1), new[np.maximum(at - k, 0)]) if raws else lists
        q, n = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[q, n], pa.float64()), pa.array(list(lists[q, n]), pa.list_(pa.int32()))], names=["probe", "score", "lists"])

    top = posted.select("raw", "lists").mapInArrow(run, "probe int, score double, lists array<int>")
    return top.withColumn("_n", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score")))).where(F.col("_n") <= k).select("probe", "lists")


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = 0.95,
    visited: int | None = None,
    ratio: float | None = None,
    replicas: int = 4,
    slack: float = 0.12,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (over the id) holds, its
    k nearest found among all rows but its own, ties to the smaller id; all candidates if fewer.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    those of another length than the commonest. Rows that share an id are candidates each, but not
    of a query of that id. Scores are inner products of the given vectors in double precision.
    ``visited`` lists at most are asked for a query, of those within (1 + ratio) of the nearest. If
    neither is given, they are fitted so that ``recall`` is reached by PROBES of the queries.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own, dim = vectors(rows, id_col, vec_col)
    if not dim:
        return empty
    own = own.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("_h", F.xxhash64("vec"))
    few = own.withColumn("_n", F.row_number().over(W.partitionBy("_h", "vec").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    once = few.groupBy("_h", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    once = save(packed(once.select(F.col("ids")[0].alias("uid"), "ids", "vec"), ["uid", "ids"]), "vectors")
    queries = own.where(is_query).select(F.col("vec_id").alias("query_id"), "_h", "vec")
    asked = save(packed(queries.groupBy("_h", "vec").agg(F.min("query_id").alias("qid")), ["qid"]), "queries")

    n = once.count()
    lists = min(MOST_LISTS, max(min(LEAST_LISTS, n // 64), int(np.ceil(np.sqrt(n) / 2))))
    # about twice the sample passes a cut by hash, so that tasks have few to rank
    wanted, place = max(SAMPLE, SAMPLE_LIST * lists), F.pmod(F.xxhash64("uid"), F.lit(1 << 40))
    near = once.where(place <= int(2 * wanted / n * (1 << 40))) if n > 2 * wanted else once
    fit = matrix(near.orderBy(place, "uid").limit(wanted).select("raw").toPandas()["raw"], dim)

    def norms(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float((matrix(b.column(0).to_pylist(), dim) ** 2).sum(1).max())] if b.num_rows else [], pa.float64())], names=["m"])

    most = once.select("raw").mapInArrow(norms, "m double").agg(F.max("m")).first()[0]
    lists = min(lists, len(fit) // 4)
    points = lifted(fit, most)
    centroids = np.stack([points[g].mean(0) for g in halve(points, max(1, lists), np.random.default_rng(seed))])
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))

    def post(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                found = own_lists(graph.value, lifted(matrix(part.column(1).to_pylist(), dim), most), replicas, slack)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["uid", "raw", "lists"])

    posted = save(once.select("uid", "raw").mapInArrow(post, "uid long, raw binary, lists array<int>"), "posted")
    if visited is None and ratio is None:
        probes = asked.orderBy(F.xxhash64("qid"), "qid").limit(PROBES).select("raw").toPandas()["raw"].tolist()
        held = [(r["probe"], r["lists"]) for r in neighbours(posted, probes, dim, k).collect()]
        asks, width = aimed(matrix(probes, dim), most), BEAM
        while (fit_ := fitted(*graph.value.search(asks, width), held, recall)) is None and width < len(centroids):
            width *= 2
        visited, ratio = fit_ or (len(centroids), float("inf"))
    visited, ratio = visited or len(centroids), float("inf") if ratio is None else ratio

    # a vector is in ``replicas`` lists at most, so so many entries hold k + 1 different ones
    sizes = np.zeros(len(centroids), np.int64)
    for r in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]

    def aim(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                asks = aimed(matrix(part.column(1).to_pylist(), dim), most)
                at = enough(graph.value, asks, reach(*graph.value.search(asks, visited), ratio), sizes, replicas * (k + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32()))], names=["qid", "raw", "lists"])

    written = [once, asked, posted]
    posted = posted.select("uid", "raw", F.explode("lists").alias("list"))
    aims = save(asked.mapInArrow(aim, "qid long, raw binary, lists array<int>"), "aims")
    written.append(aims)
    aims = aims.select("qid", "raw", F.explode("lists").alias("list"))
    # at most MOST_LISTS rows: how many blocks of vectors and of queries each list has
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_vb"))
    loads = aims.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("_qb"))
    blocks = F.broadcast(sizes.join(loads, "list"))
    block = lambda x, m: F.pmod(F.xxhash64(x), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = aims.join(blocks, "list").select("list", "qid", "raw", block("qid", "_qb").alias("qb"), every("_vb").alias("vb"))
    right = posted.join(blocks, "list").select("list", "uid", "raw", block("uid", "_vb").alias("vb"), every("_qb").alias("qb"))

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"qid": [], "uid": [], "score": []})
        v = v.sort_values("uid", kind="stable")
        x, ids, asks, out = matrix(v["raw"], dim), v["uid"].to_numpy(), q["qid"].to_numpy(), []
        keep = min(k + 1, len(v))
        for i in range(0, len(q), 128):
            score = matrix(q["raw"].iloc[i : i + 128], dim) @ x.T
            least = np.partition(score, len(v) - keep, 1)[:, len(v) - keep]
            above, tied = score > least[:, None], score == least[:, None]
            above |= tied & (np.cumsum(tied, 1, dtype=np.int32) <= (keep - above.sum(1))[:, None])
            qi, vi = np.nonzero(above)
            out.append(pd.DataFrame({"qid": asks[i : i + 128][qi], "uid": ids[vi], "score": score[qi, vi]}))
        return pd.concat(out)

    key = ["list", "vb", "qb"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "qid long, uid long, score double")
    best = W.partitionBy("qid").orderBy(F.desc("score"), "uid")
    # a vector that several of a query's lists hold comes once; the first k + 1 vectors hold all that is asked.
    # It is in ``replicas`` lists at most, so that so many times k + 1 hits, ranked before the shuffle, hold them
    hits = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= replicas * (k + 1)).drop("_n")
    first = hits.groupBy("qid", "uid").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    found = first.join(once.select("uid", F.explode("ids").alias("vec_id")), "uid").select("qid", "vec_id", "score")
    found = found.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    found = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("found"))
    of = queries.groupBy("_h", "vec").agg(F.min("query_id").alias("qid"))
    each = queries.join(of, ["_h", "vec"]).select("query_id", "qid")
    got = each.join(found, "qid").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    got = got.select("query_id", F.posexplode("found").alias("_p", "_f"))
    out = save(got.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_f.vec_id").alias("vec_id"), F.col("_f.score").alias("score")), "neighbours")
    drop(*written)
    return out

import random

import pytest
from edges import documents, none

from quadspark.llm import jaccard as jc
from quadspark.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, width, percent):
    def shingles(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((d, len(sets[i]), None if d is None else min(own)))
    return sorted(out, key=str)


def result(df, width, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.jaccard_components(df, width, percent).collect()), key=str)


def corpus(seed):
    """Families of near copies with growing numbers of changed words, of long and short texts."""
    r = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(300)]
    for size in (3, 9, 14, 30, 80, 200, 400):
        for _ in range(3):
            base = [r.choice(words) for _ in range(size)]
            for k in range(6):
                own = list(base)
                for _ in range(r.randint(0, max(1, size // 25)) if k else 0):
                    own[r.randrange(size)] = r.choice(words)
                rows.append((len(rows) * 3 + 1, " ".join(own).upper() if k == 5 else " ".join(own)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent,cost", [(3, 90, 0.1), (3, 80, 0.1), (2, 70, 1e9), (3, 90, 1e12)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, cost):
    """A high cost of false candidates has many segments take one-deletion neighbourhoods."""
    monkeypatch.setattr(jc, "FALSE_COST", cost)
    rows = corpus(percent)
    if cost > 1:
        b = jc.Bands(percent, 10**6)
        assert any(b.segments(g)[1] for g in range(4, 30))
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), width, percent) == brute(rows, width, percent)


def test_candidates_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jc, "BROADCAST_IDS", 0)
    rows = corpus(5)[:60]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80) == brute(rows, 3, 80)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """All mixed buckets are joined on their rarest shingles."""
    monkeypatch.setattr(jc, "PAIRED", 1)
    for width, percent in ((3, 90), (2, 70)):
        rows = corpus(percent + 1)
        assert result(spark.createDataFrame(rows, "doc_id long, text string"), width, percent) == brute(rows, width, percent)


def test_a_large_bucket_of_unlike_sets_is_no_quadratic_work(spark):
    """50,000 sets with one shingle in common, and some linked ones among them, in one bucket."""
    r = random.Random(9)
    texts = ["the same words " + " ".join(str(r.randrange(10**9)) for _ in range(r.randint(10, 20))) for _ in range(50_000)]
    texts += [t + " more" for t in texts[:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    classes = jc.classes_of(jc.signed_sets(docs, 3, 90, len(texts), 1))
    members = classes.select(jc.F.lit(5).cast("long").alias("sig"), jc.F.lit(True).alias("whole"), "set_id")
    labels, tried = spark.createDataFrame([], "node long, label long"), spark.createDataFrame([], "a long, b long")
    more = jc.save(jc.still_apart(members, labels, classes, tried, 90, lambda ids: jc.sets_of(ids, classes, docs, 3)), "pairs")
    links = jc.verified(more, jc.sets_of(jc.ends(more), classes, docs, 3), 90)
    # n shingles, and one more: linked from n = 9 on
    assert more.count() <= 1000 and links.count() == 300


def test_unlike_large_sets_of_a_bucket_are_not_verified(spark, monkeypatch):
    """Long texts with a passage in common share signatures; their hashes are fetched for near copies only."""
    r = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join([passage, *(f"w{r.randrange(10**9)}" for _ in range(r.randint(1300, 2300)))]) for _ in range(60)]
    texts += [t + " and a few words more " * k for k, t in enumerate(texts[:12])]
    rows, asked, verified = list(enumerate(texts)), [], jc.verified

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return verified(pairs, sets, percent)

    monkeypatch.setattr(jc, "verified", counted)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80) == brute(rows, 5, 80)
    assert sum(asked) <= 30


def test_wide_sketches_lose_no_link(spark):
    """Also of sets whose sketches have different lengths; unlike sets differ."""
    import numpy as np

    r, rows, want = np.random.default_rng(5), [], {}
    for k, (n, percent) in enumerate(((500, 80), (600, 80), (1000, 80), (1024, 80), (1100, 90), (4000, 80), (4100, 90), (3000, 30))):
        common = (n * percent + 99) // 100
        h = np.unique(r.integers(0, 2**63, 2 * n).astype(np.uint64))
        for j, s in enumerate((h[:n], h[:common], h[n:])):
            rows.append((10 * k + j, len(s), None if (w := jc.wide_sketch(np.sort(s))) is None else w.tolist()))
        want[10 * k] = percent
    wide = spark.createDataFrame([x for x in rows if x[2]], "set_id long, n long, wide array<long>")
    pairs = spark.createDataFrame([(i + 1, i) for i in want] + [(i + 2, i) for i in want], "a long, b long")
    for percent in (30, 80, 90):
        got = {(x.a, x.b) for x in jc.narrowed(pairs, wide, percent).collect()}
        assert got >= {(i + 1, i) for i, p in want.items() if p >= percent}
        assert percent < 80 or {(x, i) for x, i in got if x == i + 2} == {(2, 0)}


def test_sets_of_one_id_are_told_apart(spark):
    rows = corpus(3)[:60] + [(1000 + i, f"some text number {i} of its own") for i in range(40)]
    want = brute(rows, 3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = jc.signed_sets(docs, 3, 90, 100, 1)
    clash = jc.save(signed.withColumn("set_id", jc.F.col("set_id").bitwiseAND(jc.F.lit(7))), "clash")
    classes = jc.classes_of(clash)
    twice = jc.save(classes.where("_twice").select("set_id", "_twice"), "twice")
    fixed = jc.classes_of(jc.renamed(clash, twice))
    assert classes.count() <= 8 and fixed.count() == signed.select("set_id", "set_lo").distinct().count() and not fixed.where("_twice").count()
    assert result(docs, 3, 90) == want


def test_a_set_with_many_empty_segments_is_still_found():
    """Linked sets share a signature whatever their hashes are."""
    import numpy as np

    r = np.random.default_rng(3)
    for percent in (80, 90):
        bands = jc.Bands(percent, 1000)
        for size in (10, 12, 25, 60, 150):
            for _ in range(200):
                a = r.integers(0, 2**63, size).astype(np.uint64) if r.random() < 0.5 else (r.integers(0, 2**60, size).astype(np.uint64))
                a = np.unique(a)
                b = a.copy()
                n = len(a) * (100 - percent) // (100 + percent)
                b[r.permutation(len(b))[:n]] = r.integers(0, 2**63, n).astype(np.uint64)
                b = np.unique(b)
                common = len(np.intersect1d(a, b))
                if common * 100 < percent * (len(a) + len(b) - common):
                    continue
                x, y = bands.signatures(a), bands.signatures(b)
                one = lambda s, odd: set((s[(s & np.uint64(1)) == odd] >> np.uint64(1)).tolist())
                assert len(np.setxor1d(a, b)) == 0 or one(x, 0) & one(y, 0) or one(x, 0) & one(y, 1) or one(x, 1) & one(y, 0)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(docs, 5, 80) == brute(rows, 5, 80)
    assert jc.jaccard_components(none(docs)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 200), (3, 2), (None, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

import random

import numpy as np
import pytest
from edges import CLASHES, documents, none
from hypothesis import given, settings
from hypothesis import strategies as st

from quadspark.llm import linededup as ld
from quadspark.llm.cuckoo import Cuckoo, buckets_for

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, min_chars):
    def key(x):
        return x.strip(" \t\n\v\f\r").translate(LOWER)

    held = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held.setdefault(key(x), set()).add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or common.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def cleaned(index, docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.clean(docs).collect()), key=str)


def some(seed, n, base=0):
    r = random.Random(seed)
    lines = ["Common line %d is here" % i for i in range(6)] + ["  COMMON line 1 is HERE\t", "É COMMON line ééé", "short", ""]
    return [(base + i, "\n".join(r.choice(lines) if r.random() < 0.6 else f"line of {base + i} number {k}" for k in range(r.randint(0, 6)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400))
def test_cuckoo_holds_what_was_added_and_not_deleted(keys):
    keys = np.array(sorted(keys), np.int64)
    c = Cuckoo(buckets_for(len(keys) + 8))
    c.insert(keys)
    assert c.contains(keys).all()
    before = (c.cells > 0).sum()
    c.delete(keys[::2])
    assert c.contains(keys[1::2]).all() and (c.cells > 0).sum() == before - len(keys[::2])
    c.insert(keys[::2])
    assert Cuckoo(len(c.cells), c.to_bytes()).contains(keys).all()


def test_cuckoo_deletes_displaced_fingerprints():
    keys = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 3000, np.int64)
    c = Cuckoo(1024)
    c.insert(keys)
    c.delete(keys[:2000])
    assert (c.cells > 0).sum() == 1000 and c.contains(keys[2000:]).all()
    c.delete(keys[2000:])
    assert not c.cells.any()


@pytest.mark.parametrize("keys,ids,refs", [(500_000, 2_000_000, 500_000), (0, 2_000_000, 7), (0, 0, 7)])
def test_all_routes_equal_brute_force(spark, monkeypatch, keys, ids, refs):
    monkeypatch.setattr(ld, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(ld, "BROADCAST_IDS", ids)
    monkeypatch.setattr(ld, "BLOCK_REFS", refs)
    monkeypatch.setattr(ld, "LEAST_SHARDS", 1)
    monkeypatch.setattr(ld, "SHARD_KEYS", 2)
    rows = [*some(1, 60), (7, "Common line 0 is here\nagain"), (None, "Common line 1 is here")]
    index = ld.LineIndex.build(frame(spark, rows), 3, 10)
    assert cleaned(index, frame(spark, rows)) == brute(rows, 3, 10)


def test_filters_name_the_common_keys_and_few_others(spark):
    index = ld.LineIndex.build(frame(spark, some(4, 300)), 3, 10)
    hits, common = {(r.h1, r.h2) for r in index.hits().collect()}, {(r.h1, r.h2) for r in index.common().collect()}
    assert common <= hits and len(hits - common) <= 0.01 * index.counts.count()


def test_only_texts_that_lose_a_line_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    rows = [(i, ("Common line that many hold" if i < 9 else f"line of {i} that is its own")) for i in range(400)]
    index = ld.LineIndex.build(frame(spark, rows), 3, 10)
    drops = index.drops()
    assert {r.doc_id for r in drops.collect()} == set(range(8))
    plan = index.clean(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.count("LeftAnti") == 1


def test_a_full_filter_grows_when_it_is_built(spark, monkeypatch):
    monkeypatch.setattr(ld, "buckets_for", lambda n: 1)
    monkeypatch.setattr(ld, "LEAST_SHARDS", 1)
    rows = [(i, "\n".join(f"line number {k} of all" for k in range(60))) for i in range(4)]
    index = ld.LineIndex.build(frame(spark, rows), 3, 10)
    assert cleaned(index, frame(spark, rows)) == brute(rows, 3, 10)


def test_inserts_and_deletions_are_reversible(spark):
    a, b = some(2, 30), some(3, 30, base=100)
    first = ld.LineIndex.build(frame(spark, a), 3, 10)
    both = first.insert(frame(spark, b))
    assert cleaned(both, frame(spark, a + b)) == brute(a + b, 3, 10)
    back = both.delete(frame(spark, b).unionByName(frame(spark, [(999, "unknown")])))
    assert cleaned(back, frame(spark, a)) == brute(a, 3, 10)
    counts = lambda x: sorted(tuple(r) for r in x.counts.collect())
    assert counts(back) == counts(first) and counts(first.insert(frame(spark, a))) == counts(first)
    rest = both.delete(frame(spark, a[:20]))
    assert cleaned(rest, frame(spark, a[20:] + b)) == brute(a[20:] + b, 3, 10)


def test_edges(spark):
    docs = documents(spark)
    got = ld.dedup_lines(docs, 2, 3)
    assert set(got.columns) == {*docs.columns, "n_lines", "kept_text"} and "n_dropped" in CLASHES
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == brute(rows, 2, 3)
    assert ld.dedup_lines(none(docs), 5, 40).count() == 0

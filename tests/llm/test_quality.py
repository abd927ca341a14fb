import random
import re
from collections import Counter

import numpy as np
import pytest
from edges import documents, none

from quadspark.llm import quality as ql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def some(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", "cé", "日本", "#x", "%%", "\n", "\t", "one two three four five six seven eight nine\n", "z z z z z z z z z z "]
    return ["".join(r.choice(parts) + " " for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_stats_equal_brute_force():
    texts = ["", "x", *some(1, 400)]
    got = ql.text_stats([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(x[i]) for x in got[:5]) == brute(t)


def test_edges(spark):
    docs = documents(spark).drop("n_words")
    rows = ql.judge(docs, spark.createDataFrame([(1, 1, 0), (None, None, None), (5, None, 1)], "doc_id long, quality int, toxic int"), keep=["doc_id", "text", "_raw"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
        assert r._raw == "own _raw"
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ql.judge(none(docs), empty, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        ql.with_stats(documents(spark), keep=["n_words"])


def test_rules_find_conjunctions_and_keep_their_order():
    r = np.random.default_rng(1)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["c"] > 0.5))
    rules = ql.learn_rules(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= ql.covers(rule, x, 3000)
    assert 2 <= len(rules) and (hit & ~bad).mean() < 0.005 and (bad & ~hit).mean() < 0.02
    assert ql.learn_rules(x, np.zeros(3000, bool)) == [] and ql.learn_rules(x, r.random(3000) < 0.1) == []


def test_rules_are_the_same_with_repeated_rows_and_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = ql.fit_rules(docs, labels)
    again = docs.unionByName(docs.where("doc_id % 2 = 0")).repartition(7)
    assert rules and ql.fit_rules(again, labels.unionByName(labels).repartition(3)) == rules
    assert ql.fit_rules(docs, labels, most=150) == ql.fit_rules(again, labels, most=150)


def test_verdict_agrees_with_the_rules(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in ql.judge(docs, labels, keep=["doc_id"]).collect()}
    known = [(got[r.doc_id].kept, r.quality) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert sum(kept == bool(q) for kept, q in known) >= 0.97 * len(known)
    assert sum(not kept for kept, q in known if q) <= 0.01 * len(known)

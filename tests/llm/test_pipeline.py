"""Stages on their own inputs, and run() against a brute-force version of all of them."""

from collections import defaultdict

import corpus_pipeline as cp
import pytest
from edges import documents, none
from test_jaccard import brute as brute_components
from test_langid import brute as brute_language
from test_langid import lg
from test_linededup import brute as brute_lines
from test_packing import check as check_packing
from test_quality import brute as brute_stats

from quadspark.llm import quality as ql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        got = cp.save(stage(spark, docs, SF), "test")
        out.append((name, docs, got))
        docs = got
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _, _ in stages] == ["language ID", "quality rules", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    for _, docs, got in stages[:-1]:
        assert got.schema == docs.schema


def test_language_stage_keeps_clear_texts_untouched(stages):
    _, docs, got = stages[0]
    kept = by_id(got)
    dicts = lg.dictionaries(lg.training_rows(docs))
    for r in docs.collect():
        letters = any(map(str.isalpha, r.text or ""))
        score = brute_language(r.text, dicts)[1] if letters else 0.0
        assert abs(score - 0.02) < 0.003 or (r.doc_id in kept) == (letters and score >= 0.02)
        if r.doc_id in kept:
            assert kept[r.doc_id] == r


def test_quality_stage_follows_base_rules_and_labels(stages, spark):
    _, docs, got = stages[1]
    kept, rows = by_id(got), docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rules = ql.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    wrong = 0
    for r in rows:
        n, _, _, _, again = brute_stats(r.text)
        if n < 20 or 100 * again > 30 * n:
            assert r.doc_id not in kept
        elif r.doc_id in labels:
            wrong += (r.doc_id in kept) != bool(labels[r.doc_id])
    assert rules and wrong <= 2


def test_line_stage_equals_brute_force(stages):
    _, docs, got = stages[2]
    want = {i: (text, dropped) for i, _, dropped, text in brute_lines([(r.doc_id, r.text) for r in docs.collect()], 5, 40)}
    kept = by_id(got)
    for r in docs.collect():
        text, dropped = want[r.doc_id]
        assert (r.doc_id in kept) == (not dropped or bool(text.strip(" \t\n\v\f\r")))
        if r.doc_id in kept:
            assert kept[r.doc_id].text == text and kept[r.doc_id].n_chars == (len(text) if dropped else r.n_chars)


def test_one_document_of_each_group_stays(stages):
    _, docs, got = stages[3]
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if i == c}
    assert set(by_id(got)) == want and len(want) < docs.count()


def test_packing_stage_and_run(stages, spark):
    _, docs, got = stages[4]
    check_packing(got.collect(), docs, 2048)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(cp.run(spark, SF).select(key).collect()) == sorted(got.select(key).collect())


def test_edges(spark, tmp_path):
    docs = documents(spark)
    for name in ("labels",):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        texts = defaultdict(set)
        for r in docs.collect():
            texts[r.doc_id].add(r.text)
        assert all(r.doc_id in texts for r in got.collect())
        assert stage(spark, none(docs), str(tmp_path)).count() == 0
    assert cp.STAGES[-1][1](spark, none(docs), str(tmp_path)).count() == 0

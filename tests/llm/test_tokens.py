import random

import public_tokenizers as P
import pytest
from edges import documents, none
from tokenizers import Tokenizer

from quadspark.llm.tokens import Engine, count_tokens, encode_spliced

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def texts(seed, n, size):
    r = random.Random(seed)
    parts = ["a", "b c", " ", "  ", "\n", " \n\t ", "é", "日本", "don't", "1234", "!?", "<|endoftext|>", "<|endof", "text|>", " ", "\x1c", "word ", "x" * 40]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_spliced_ids_are_those_of_the_whole_text(library, ranks):
    engine = Engine(JSON, ranks)
    for t in texts(1, 150, 400):
        for chunk, overlap in ((64, 40), (200, 64)):
            parts, _ = encode_spliced(engine, t, chunk, overlap)
            assert [int(i) for p in parts for i in p] == ids(library, t)


def test_overlap_is_widened_where_nothing_is_stable(library):
    engine = Engine(JSON, RANKS)
    t = "a" * 3000 + " " * 2000 + "b c " * 50
    parts, widened = encode_spliced(engine, t, 100, 40)
    assert widened > 0 and [int(i) for p in parts for i in p] == ids(library, t)


def test_rank_engine_equals_the_library_on_every_code_point(library):
    engine = Engine(JSON, RANKS)
    points = [c for c in range(0, 0x30000, 3) if not 0xD800 <= c < 0xE000]
    lines = [f"a{chr(c)}1{chr(c)}! {chr(c)} x  {chr(c)}\n" for c in points]
    for e, t in zip(library.encode_batch_fast(lines, add_special_tokens=False), lines):
        assert list(engine.ids(t)) == e.ids


def test_edges(spark, library):
    docs = documents(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, JSON, RANKS, chunk=5000).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(ids(library, r.text or "")), len(ids(library, r.text or "")) > 512) for r in docs.collect())
    assert got == want
    assert count_tokens(none(docs), JSON, RANKS).count() == 0


def test_piece_vocabulary_counts_whole_texts(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in count_tokens(documents(spark).where("doc_id in (1, 3, 6)"), path).collect():
        assert r.n_tokens >= 0
    df = spark.createDataFrame([(1, "hello wide world")], "doc_id long, text string")
    assert count_tokens(df, path).first().n_tokens == len(model.encode("hello wide world"))

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from edges import documents, none

from quadspark.llm import bpe
from quadspark.llm.tokens import load_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def raw(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_ids_are_the_librarys(library):
    r = random.Random(1)
    parts = ["a", "b ", " ", "  ", "\n", "é", "日本", "'s", "12", "!?", "<|endoftext|>", "\x1c", " ", "word", "Thing", "x" * 70, "\U0003ea12", "\U00010ee7", "\u088f", "\ua7ce"]
    texts = ["", " ", "a" * 700, "b" * 3000, *("".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(1500))]
    coder = bpe.Coder(PATH)
    got = coder.encode_texts(texts)
    assert got == [raw(library, t) for t in texts] and coder.decoded(got) == [t.encode() for t in texts]


@pytest.mark.parametrize("form", ["{}'s ", "{}a "])
def test_every_code_point_is_split_as_the_library_does(library, form):
    coder = bpe.Coder.get(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(form.format(chr(c)) for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    for i in range(0, len(texts), 16):
        got = coder.encode_texts(texts[i : i + 16])
        assert got == [np.array(x, "<u4").tobytes() for x in library.encode_ordinary_batch(texts[i : i + 16], num_threads=4)]


def test_words_at_the_edges_of_the_pattern(library):
    coder = bpe.Coder.get(PATH)
    texts = [" ", "", ".", ",", " a.", "a,", " .", "é,", " ß.", "a1.", " ab", "\nab", "ab\n", "'s", " don't", "Ωmega", " Ωmega,", "x ,", "'", " ''.", "\u0558's", "1\u0558", "\u0558!"]
    assert coder.encode_texts(texts) == [raw(library, t) for t in texts]


def test_heap_and_query_agree(library):
    coder = bpe.Coder.get(PATH)
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 60))).encode() for _ in range(300)] + [b"=" * 1024, b"ab" * 500]
    for w, ids in zip(words, coder.contracted(words)):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.contract(w, coder.ranks)


def test_small_blocks_and_queries_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 16)
    monkeypatch.setattr(bpe, "QUERY_ROWS", 64)
    texts = ["one two three four five six seven eight nine ten eleven twelve", "", "x" * 90, "six\x1c five  four \n three \u2003 two " * 9]
    assert bpe.parts_of("a" * 40) == ["a" * 40] and len(bpe.parts_of(texts[0])) == 4
    coder = bpe.Coder(PATH)
    coder.recent = bpe.Recent(2000)
    for _ in range(3):
        assert coder.encode_texts(texts) == [raw(library, t) for t in texts]
    assert len(coder.recent.young) + len(coder.recent.old) <= 12


def test_edges(spark, library):
    docs = documents(spark)
    got = bpe.encode(docs, PATH, decode=True)
    rows = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()), key=str)
    assert rows == sorted(((r.doc_id, raw(library, r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=str)
    back = bpe.decode(got.select("doc_id", "ids"), PATH)
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back.collect()), key=str) == sorted(((a, c) for a, _, c in rows), key=str)
    assert bpe.encode(none(docs), PATH).count() == 0

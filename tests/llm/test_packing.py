import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from edges import documents, none
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadspark.llm import packing
from quadspark.llm.packing import cut_pieces, pack, plan_best_fit

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def naive(lengths, capacity):
    """Best-fit-decreasing one piece at a time: the number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_every_rank_once_and_as_best_fit(lengths):
    counts = Counter(lengths)
    runs, total = plan_best_fit(counts, 40)
    ranks, places = defaultdict(set), defaultdict(list)
    for r in runs:
        for k in range(r.bins * r.each):
            assert r.first + k not in ranks[r.length]
            ranks[r.length].add(r.first + k)
            places[r.base + k % r.bins].append((r.offset + r.length * (k // r.bins), r.length))
    assert {n: len(x) for n, x in ranks.items()} == counts and all(x == set(range(len(x))) for x in ranks.values())
    assert set(places) == set(range(total)) and total == naive(lengths, 40)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40


def test_only_long_documents_are_cut_and_the_first_piece_is_short():
    assert cut_pieces(5, 5) == [(0, 5)] and cut_pieces(4, 5) == [(0, 4)] and cut_pieces(12, 5) == [(0, 2), (2, 5), (7, 5)] and cut_pieces(0, 5) == []


def check(rows, docs, capacity):
    library = Tokenizer.from_file(JSON)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut_pieces(len(ids), capacity)):
            want[(r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(by) == naive([k[3] for k, n in want.items() for _ in range(n)], capacity)


def test_edges(spark):
    docs = documents(spark)
    check(pack(docs, JSON, RANKS, capacity=64).collect(), docs, 64)
    assert pack(none(docs), JSON, RANKS).count() == 0


def test_a_long_plan_is_joined_without_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(packing, "BROADCAST_RUNS", 0)
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    check(pack(docs, JSON, RANKS, capacity=512).collect(), docs, 512)

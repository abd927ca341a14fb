"""Byte-level BPE by recursive DuckDB queries, per partition.

A text is split into the pattern's matches, words, exactly as the library splits it. Words that are
tokens themselves are done. The other distinct words of a block become (word, position, token) rows;
one recursive query joins neighbouring rows to the table of merges, takes each word's pair of the
smallest rank, leftmost, contracts it, and goes on with the words that have a pair left until none
has. A document's ids are those of its words in order. Decoding joins a document's ids to their bytes
and aggregates them in order. A worker remembers the ids of the words it saw last, in a bounded number of
bytes, and a text longer than a block is cut at provable boundaries, so memory is bounded whatever the
texts hold.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.shared import sliced, utf8
from quadspark.llm.tokens import load_ranks

#: Bytes of a word that is contracted by query (longer ones by a heap, with the same result): a word of
#: n bytes makes up to n * n / 2 rows in up to n rounds. Twice the rows of one query, at most,
#: characters of text handled together, and bytes of the words remembered by a worker, about.
QUERY_BYTES, QUERY_ROWS, BLOCK, REMEMBERED = 1024, 4 << 20, 1 << 20, 64 << 20

ENCODE = """
WITH RECURSIVE t AS (
  SELECT k, tok, 0 AS step FROM seed
  UNION ALL
  SELECT CASE WHEN t.k > c.k THEN t.k - 1 ELSE t.k END, CASE WHEN t.k = c.k THEN c.merged ELSE t.tok END, t.step + 1
  FROM t JOIN (
    SELECT w, (best & 4294967295) + (w << 32) AS k, (best >> 32)::INT AS merged
    FROM (
      SELECT a.k >> 32 AS w, min((m.merged::BIGINT << 32) | (a.k & 4294967295)) AS best
      FROM t a JOIN t b ON b.k = a.k + 1 JOIN merges m ON m.pair = (a.tok::BIGINT << 32) + b.tok
      GROUP BY 1
    )
  ) c ON t.k >> 32 = c.w
  WHERE t.k <> c.k + 1
), last AS (SELECT k >> 32 AS w, max(step) AS step FROM t GROUP BY 1)
SELECT t.k >> 32 AS w, list(t.tok ORDER BY t.k) AS ids
FROM t JOIN last ON t.k >> 32 = last.w AND t.step = last.step
GROUP BY 1 ORDER BY 1
"""

DECODE = "SELECT i.w, unhex(string_agg(v.hex, '' ORDER BY i.pos)) AS raw FROM ids i JOIN vocabulary v ON v.tok = i.tok GROUP BY 1 ORDER BY 1"

#: A space after something else than white space: no alternative of the pattern crosses it.
BOUNDARY = re.compile(r"(?<=\S)(?= )")
#: The classes of characters that patterns may name, each with a character that has long been in it.
CLASSES = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u2003", r"[^\s\p{L}\p{N}]": "\u00a4"}


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points that the library's Unicode tables put into another class than those of the regex
    module do, and a character of that class in both. The library is asked about every code point:
    whether it takes it into one word with a character of the class before it."""
    import regex
    import tiktoken

    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    single = {bytes([b]): b for b in range(256)}
    out: dict[int, str] = {}
    for name, member in CLASSES.items():
        lead = {r"\p{L}": b"a", r"\p{N}": b"1", r"\s": b"\t"}.get(name, b"!")
        words = tiktoken.Encoding("classes", pat_str=f"{name}+|[^a]|a", mergeable_ranks=single | {lead + bytes([b]): 256 + b for b in range(256)}, special_tokens={})
        theirs = np.zeros(0x110000, bool)
        end = "!" if lead != b"!" else "a"
        for i in range(0, len(points), 65_536):
            own = points[i : i + 65_536]
            ids = np.asarray(words.encode_ordinary("".join(f"{lead.decode()}{chr(c)}{end}" for c in own)))
            starts = ids[(ids == lead[0]) | (ids >= 256)]
            theirs[own] = starts >= 256
        ours = np.zeros(0x110000, bool)
        for m in regex.finditer(f"{name}+", every):
            ours[points[m.start()] : points[m.end() - 1] + 1] = True
        out |= {c: member for c in np.flatnonzero(theirs & ~ours).tolist()}
    return out


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction by a heap over linked parts, for very long words."""
    parts = [word[i : i + 1] for i in range(len(word))]
    after, before, gone = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [False] * len(parts)
    heap: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], gone[j], after[i] = a + b, True, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p, g in zip(parts, gone) if not g]


class Recent:
    """Ids of the words seen last, in about ``most`` bytes: what the younger half lacks and the older
    has moves back to the younger; when that is full, it takes the older one's place."""

    def __init__(self, most: int | None = None):
        self.most = REMEMBERED if most is None else most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def get(self, word: str) -> bytes | None:
        found = self.young.get(word)
        if found is None and (found := self.old.get(word)) is not None:
            self.put(word, found)
        return found

    def put(self, word: str, ids: bytes) -> None:
        if 2 * self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[word] = ids
        self.size += 200 + 2 * len(word) + len(ids)  # objects and places in the table count about 200 bytes


class Coder:
    """Encodes and decodes by one vocabulary; one for each Python worker. A pattern may name the
    classes of CLASSES and characters. ``unlike`` are the library's stand_ins()."""

    _own: dict[tuple[str, str | None], "Coder"] = {}

    def __init__(self, path: str, pattern: str | None = None, unlike: dict[int, str] | None = None):
        import duckdb
        import regex

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        self.words = regex.compile(pattern)
        self.unlike = stand_ins() if unlike is None else unlike
        self.odd = frozenset(map(chr, self.unlike))
        self.ranks = load_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, merged = [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32) + b)
                    merged.append(i)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.recent = Recent()
        self._load("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._load("vocabulary", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))

    @classmethod
    def get(cls, path: str, pattern: str | None = None, unlike: dict[int, str] | None = None) -> "Coder":
        if (path, pattern) not in cls._own:
            cls._own[path, pattern] = cls(path, pattern, unlike)
        return cls._own[path, pattern]

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as little-endian unsigned 32-bit integers, by the recursive query."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        run = np.cumsum(sizes * sizes) // QUERY_ROWS
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(words)] if words else []
        out: list[bytes] = []
        for i, j in zip(cuts, cuts[1:]):
            own = sizes[i:j]
            at = np.repeat(np.arange(j - i), own)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(own) - own, own)
            self.db.register("seed", pa.table({"k": (at << 32) + pos, "tok": self.single[np.frombuffer(b"".join(words[i:j]), np.uint8)]}))
            got = self.db.sql(ENCODE).to_arrow_table()
            self.db.unregister("seed")
            for part in got.column("ids").chunks:
                raw, ends = part.flatten().to_numpy().astype("<u4").tobytes(), ((part.offsets.to_numpy() - part.offsets[0].as_py()) * 4).tolist()
                out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return out

    def decoded(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each run of ids, by ordered aggregation."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.repeat(np.arange(len(ids)), sizes)
        out = [b""] * len(ids)
        if len(at):
            self.db.register("ids", pa.table({"w": at, "pos": np.arange(len(at)), "tok": np.frombuffer(b"".join(ids), "<u4").astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for i, raw in zip(got.column("w").to_pylist(), got.column("raw").to_pylist()):
                out[i] = raw
        return out

    def split(self, text: str) -> list[str]:
        """The pattern's matches in the library's eyes; they make up the whole text."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.unlike))]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers."""
        out = list(map(self.recent.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        raws = [words[i].encode("utf-8", "replace") for i in new]
        ranks = [self.ranks.get(r) for r in raws]
        hard = iter(self.contracted([r for r, rank in zip(raws, ranks) if rank is None and len(r) <= QUERY_BYTES]))
        for i, r, rank in zip(new, raws, ranks):
            out[i] = rank.to_bytes(4, "little") if rank is not None else next(hard) if len(r) <= QUERY_BYTES else np.array(contract(r, self.ranks), "<u4").tobytes()
            self.recent.put(words[i], out[i])
        return out

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self.split(t) for t in texts]
        places = dict(zip(dict.fromkeys(chain.from_iterable(cut)), count()))
        if not places:
            return [b""] * len(texts)
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(cut)), np.int64)
        ends = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
        taken = pa.array(self.of_words(list(places)), pa.binary()).take(pa.array(at))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[ends + taken.offset].tolist()
        data = memoryview(taken.buffers()[2])
        return [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; longer ones than a block are encoded by parts."""
        parts = [p for t in texts for p in parts_of(t)]
        got: list[bytes] = []
        for i, j in _blocks(parts):
            got += self.encode_block(parts[i:j])
        if len(parts) == len(texts):
            return got
        own = iter(got)
        return [b"".join(next(own) for _ in parts_of(t)) for t in texts]


def parts_of(text: str, most: int | None = None) -> list[str]:
    """The text, cut at boundaries into parts of about ``most`` characters (BLOCK); a run without a
    boundary is one part."""
    most = BLOCK if most is None else most
    out, at = [], 0
    while len(text) - at > most and (m := BOUNDARY.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def _blocks(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    most = BLOCK if most is None else most
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, pattern: str | None = None) -> DataFrame:
    """(id, ids[, decoded]): ids of each whole text as little-endian unsigned 32-bit integers, and
    the bytes they decode to. A null or empty text has none. Repeated rows and null ids give a row
    each; other columns are not read. One pass, no shuffle."""
    fields = [docs.schema[id_col], T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.BinaryType())] if decode else [])]
    out = T.StructType(fields)

    unlike = stand_ins()

    def run(batches):
        coder = Coder.get(ranks, pattern, unlike)
        for b in batches:
            texts = [raw.decode("utf-8", "replace") for raw in b.column(1).to_pylist()]
            for i, j in _blocks(texts):
                got = coder.encode_texts(texts[i:j])
                more = [coder.decoded(got)] if decode else []
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x, pa.binary()) for x in (got, *more))], names=out.names)

    return docs.select(F.col(id_col), utf8(text_col).alias("_raw")).mapInArrow(run, out)


def decode(rows: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of ids given as little-endian unsigned 32-bit integers; none for null."""
    out = T.StructType([rows.schema[id_col], T.StructField("decoded", T.BinaryType())])

    unlike = stand_ins()

    def run(batches):
        coder = Coder.get(ranks, None, unlike)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.decoded(b.column(1).to_pylist()), pa.binary())], names=out.names)

    return rows.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias("_ids")).mapInArrow(run, out)

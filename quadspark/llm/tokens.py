"""Token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks. Two neighbouring chunks are spliced at the first
position of their overlap that is (1) a token boundary of both encodings and (2) a boundary that
no context can move: the character before is not white space, the character at it is plain white
space. No alternative of the splitting pattern matches white space after anything else, so a piece
always ends there, whatever stands before or behind. Positions nearer than the longest special
token to either cut are not used, so a special token that a cut divides is never half seen. If an
overlap holds no such position, it is widened, in the end to the whole text.

``Engine`` loads a vocabulary once for each Python worker. For a byte-level vocabulary that exists
both as a tokenizers file and as a rank file the rank library gives the same ids several times
faster; tests compare the two over every code point and every vocabulary entry.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.shared import sliced, utf8

#: White space that every library's pattern takes as such.
PLAIN_SPACE = " \n\t\r"

_engines: dict[tuple, "Engine"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Engine:
    """Ids and byte lengths of tokens. ``path`` is a .json, .model or .tiktoken vocabulary;
    ``ranks`` a rank file with the same ids as the .json, used in its stead."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.kind = "ranks" if ranks or path.endswith(".tiktoken") else "pieces" if path.endswith(".model") else "json"
        self.special: list[str] = []
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(path)
            added = self.json.get_added_tokens_decoder()
            self.special = [t.content for t in added.values()]
        if self.kind == "ranks":
            import tiktoken

            if pattern is None:
                from public_tokenizers import PATTERN as pattern
            table = load_ranks(ranks or path)
            special = {t.content: i for i, t in added.items()} if path.endswith(".json") else {}
            self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
            self.lengths = np.zeros(max([*table.values(), *special.values()]) + 1, np.int64)
            for token, i in [*table.items(), *((t.encode(), i) for t, i in special.items())]:
                self.lengths[i] = len(token)
        elif self.kind == "pieces":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Nothing nearer to a cut than this is trusted.
        self.margin = max([16, *(len(s) for s in self.special)])

    @classmethod
    def get(cls, *args: str | None) -> "Engine":
        if args not in _engines:
            _engines[args] = cls(*args)
        return _engines[args]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text that is short enough to be encoded at once."""
        if self.kind == "ranks":
            try:
                return self.bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except BaseException as e:  # the library's own panic is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)) or not hasattr(self, "json"):
                    raise
        if self.kind == "pieces":
            return np.asarray(self.model.encode(text, num_threads=1), np.uint32)
        return np.asarray(self.json.encode(text, add_special_tokens=False).ids, np.uint32)

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte at which each begins."""
        if self.kind == "ranks":
            ids = self.ids(text)
            n = self.lengths[ids]
            return ids, np.cumsum(n) - n
        if self.kind == "pieces":
            raise ValueError("pieces that fold white space have no offsets to splice by; encode at once")
        e = self.json.encode(text, add_special_tokens=False)
        chars = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        width = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(size)))
        return np.asarray(e.ids, np.uint32), at[chars]


def splice_point(text: str, begin: int, cut: int, end: int, margin: int, left: np.ndarray, right: np.ndarray) -> int | None:
    """The first proven boundary in text[cut:end] at which a token starts both in ``left`` (byte
    starts from ``begin``) and in ``right`` (byte starts from ``cut``)."""
    before = len(text[begin:cut].encode())
    seen, byte = cut, 0
    for p in range(cut + margin, end - margin):
        if text[p] in PLAIN_SPACE and not text[p - 1].isspace():
            byte += len(text[seen:p].encode())
            seen = p
            i, j = np.searchsorted(left, before + byte), np.searchsorted(right, byte)
            if i < len(left) and left[i] == before + byte and j < len(right) and right[j] == byte:
                return p
    return None


def encode_spliced(engine: Engine, text: str, chunk: int, overlap: int) -> tuple[Iterator[np.ndarray] | list[np.ndarray], int]:
    """Ids of the whole text, in parts, and the number of times an overlap was widened."""
    n = len(text)
    if n <= chunk + overlap or engine.kind == "pieces":
        return [engine.ids(text)], 0
    parts: list[np.ndarray] = []
    widened, wide = 0, overlap
    begin, end = 0, chunk + overlap
    ids, left = engine.starts(text[begin:end])
    while end < n:
        cut = end - wide
        if cut <= begin:  # the overlap has outgrown the chunk: take a longer chunk
            end = min(n, end + wide)
            ids, left = engine.starts(text[begin:end])
            continue
        stop = min(n, cut + max(chunk, wide) + wide)
        more, right = engine.starts(text[cut:stop])
        p = splice_point(text, begin, cut, end, engine.margin, left, right)
        if p is None:
            wide *= 2
            widened += 1
            continue
        parts.append(ids[: np.searchsorted(left, len(text[begin:p].encode()))])
        skip = len(text[cut:p].encode())
        k = np.searchsorted(right, skip)
        ids, left = more[k:], right[k:] - skip
        begin, end, wide = p, stop, overlap
    parts.append(ids)
    return parts, widened


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk: int = 65_536,
    overlap: int = 512,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chunks, n_widened), one row for each input row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, null ids and ties give a row
    each; other columns of the input are not read. Works without a shuffle: one pass over the table.
    """
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_chunks", "n_widened"))])

    def run(batches):
        engine = Engine.get(tokenizer, ranks)
        for b in sliced(batches):
            rows: list[tuple[int, int, int, int]] = []
            for raw in b.column(1).to_pylist():
                parts, widened = encode_spliced(engine, raw.decode("utf-8", "replace"), chunk, overlap)
                sizes = [len(p) for p in parts]
                rows.append((len(raw), sum(sizes), len(sizes), widened))
            cols = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in cols)], names=out.names)

    got = docs.select(F.col(id_col), utf8(text_col).alias("_raw")).mapInArrow(run, out)
    return got.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks", "n_widened")

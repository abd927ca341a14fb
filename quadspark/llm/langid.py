"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary of pieces from a bounded sample of labelled
texts. A whole text is compressed piece by piece with every dictionary, so that the text's own
history never outweighs the dictionary; the language of the smallest sum is predicted. The score is
how much smaller that sum is than the next; narrow margins are rejected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.shared import carried, raw_texts, restored, sliced

#: Bounds of the sample: texts of a language, and characters from each, in so many windows from its
#: beginning to its end.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 400
WINDOWS = 4
#: Bytes of a dictionary, at most; whatever other languages have.
DICT_BYTES = 90_000
#: Bytes of a piece of text that is compressed at once.
PIECE = 2048
#: Level of compression, of texts of any length.
LEVEL = 12
UNKNOWN = "und"

#: ASCII characters but letters become spaces before anything is compressed.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-case words of letters (and of all characters beyond ASCII) with single spaces."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def spread(text: str, chars: int) -> Column:
    """About ``chars`` characters in windows all over a text; the whole text if it has no more."""
    n, width = F.length(text), max(1, chars // WINDOWS)
    at = [F.floor((n - width) * i / (WINDOWS - 1)).cast("int") + 1 for i in range(WINDOWS)]
    return F.when(n <= chars, F.col(text)).otherwise(F.concat_ws(" ", *(F.substring(text, i, F.lit(width)) for i in at)))


def training_rows(docs: DataFrame, where: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, pieces of a text) of each language's ``sample_docs`` texts of the smallest hashes,
    in the order of these. What reaches the driver is bounded by the number of languages."""
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0)
    own = docs.where(ok if where is None else ok & where)
    # by the exact counts, hashes are cut so that about four times as many rows as needed are ranked
    counts = own.groupBy("lang").agg(F.count("*").alias("_all")).withColumn("_share", F.lit(4.0 * sample_docs) / F.col("_all"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = own.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(place < F.col("_share"))
    ids = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample_docs).select("doc_id", F.col("lang").alias("_lang"))
    got = own.select("doc_id", "lang", spread("text", sample_chars).alias("_part")).join(F.broadcast(ids), "doc_id").where("lang = _lang")
    got = got.groupBy("lang", "_part").agg(F.min(F.xxhash64("doc_id")).alias("_h"))
    return [(r["lang"], r["_part"]) for r in sorted(got.collect(), key=lambda r: (r["lang"], r["_h"], r["_part"]))]


def dictionaries(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    """A raw-content dictionary for each language that has a letter, of DICT_BYTES or of all that its
    rows hold if that is less. A language of few rows has a short one and takes nothing from others."""
    by: dict[str, list[bytes]] = {}
    for lang, part in rows:
        by.setdefault(lang, []).append(folded(part))
    return {lang: own for lang, p in sorted(by.items()) if (own := b" ".join(filter(None, p))[:DICT_BYTES])}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


Models = list[tuple[str, object]]


def classify(raw: bytes | None, models: Models, piece: int = PIECE) -> tuple[str, float]:
    """(language, score) of a whole text."""
    text = (raw or b"").decode("utf-8", "replace")
    if not models or not has_letter(text):
        return UNKNOWN, 0.0
    own = folded(text)
    sums = [0] * len(models)
    for i in range(0, len(own), piece):
        part = own[i : i + piece]
        for k, (_, compressor) in enumerate(models):
            sums[k] += len(compressor.compress(part))
    best = min(range(len(sums)), key=lambda k: (sums[k], models[k][0]))
    if len(sums) == 1:
        return models[0][0], 1.0
    second = min(s for k, s in enumerate(sums) if k != best)
    return models[best][0], 1 - sums[best] / second


def compressors(dicts: dict[str, bytes]) -> Models:
    import zstandard as z

    def one(data: bytes):
        d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    return [(lang, one(data)) for lang, data in dicts.items()]


def identify(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = 0.02, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with lang_pred, score (0 to 1) and rejected.

    ``und`` is predicted for null texts and texts without a letter, and without any dictionary;
    those, and scores under ``min_margin``, are rejected. One pass, no shuffle. Columns of the input
    that are named like the new ones are dropped.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")] if keep is None else keep
    own, fields = carried(docs, keep, text_col)
    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        models = compressors(dicts)
        for b in sliced(batches):
            got = [classify(raw, models) for raw in raw_texts(b, keep, text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=out.names)

    return restored(own.mapInArrow(run, out), keep).withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin))

"""The corpus pipeline: raw documents to packed token sequences.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir) and returns a
DataFrame; run() writes each result as Parquet to the shared folder and reads it again as the next
one's ``docs``. All but the last return the columns that they were given, those of ``documents``.
Rows that share a doc_id are one document: they stay or go together.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm.jaccard import jaccard_components
from quadspark.llm.langid import dictionaries, identify, training_rows
from quadspark.llm.linededup import dedup_lines
from quadspark.llm.packing import pack
from quadspark.llm.quality import judge
from quadspark.llm.shared import drop, reachable, save, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of removed documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def apart(stage):
    """The stage, with columns that documents don't have kept under other names while it runs."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = {c: f"_extra{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        got = stage(spark, docs.withColumnsRenamed(extra), sf_dir)
        return got.withColumnsRenamed({v: k for k, v in extra.items()}).select(docs.columns)

    return run


@apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin. Null texts, texts without a letter and
    narrow margins go; labels are only learned from."""
    got = identify(docs, dictionaries(training_rows(docs)), keep=docs.columns)
    return got.where(~F.col("rejected")).select(docs.columns)


@apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the rules learned from ``labels`` reject."""
    return judge(docs, table(spark, sf_dir, "labels"), keep=docs.columns).where("kept").select(docs.columns)


@apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of 40 characters or more that are in 5 documents or more, but in
    the largest doc_id. A document that loses all its words with them goes; n_chars follows."""
    got = dedup_lines(docs, min_docs=5, min_chars=40)
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.where(left).withColumns(new).select(docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 5-word shingles that are
    0.8 alike. Texts without words are linked with nothing and stay."""
    gone = save(jaccard_components(docs, width=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack(docs, TOKENIZER, RANKS, capacity=2048)


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


@reachable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the last one's rows. A stage's table is deleted once the next one's is
    written; the last stage's input stays, since its rows are made when they are asked for."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage{k}")
            drop(*before)
            before = [docs]
    return docs

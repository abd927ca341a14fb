"""Tables written to the cluster's shared folder, and helpers common to the operators.

Intermediate results that are read more than once are written as Parquet below the folder
named in ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def reachable(query):
    """The query, for sessions whose Python workers may not find this package: those of a local
    session look where the driver found it. A cluster has the package installed or shipped."""

    @wraps(query)
    def run(spark: SparkSession, *args):
        sc, root = spark.sparkContext, str(Path(__file__).resolve().parents[2])
        known = sc.environment.get("PYTHONPATH", "")
        if sc.master.startswith("local") and root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        return query(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadspark-"))
    return sc.getCheckpointDir().rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that save() wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over, and written, removed now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """The text's bytes, none for null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("binary"), F.lit(b""))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, which bounds what a Python worker holds at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _shared_column(df: DataFrame, keep: list[str], text_col: str) -> bool:
    return text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType)


def carried(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, list[T.StructField]]:
    """``keep`` columns under names of their own, and, where the text isn't one of them, its bytes as
    _raw behind them; the fields of the kept columns. raw_texts() gives the bytes of either."""
    names = [f"_c{i}" for i in range(len(keep))]
    more = [] if _shared_column(df, keep, text_col) else [utf8(f"`{text_col}`").alias("_raw")]
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *more)
    return own, [T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names)]


def raw_texts(b: pa.RecordBatch, keep: list[str], text_col: str) -> list[bytes]:
    """The bytes of the texts of a batch of carried() rows, none for null."""
    at = keep.index(text_col) if "_raw" not in b.schema.names else len(keep)
    column = b.column(at)
    return [x or b"" for x in (column if pa.types.is_binary(column.type) else column.cast(pa.binary())).to_pylist()]


def restored(df: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns under their names again, and the others behind them."""
    new = [c for c in df.columns if c not in {f"_c{i}" for i in range(len(keep))}]
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], *new)

"""Quads from a stream into a dataset, a transaction for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quadspark.dataset import Dataset
from quadspark.txn import Mode


def register_stream(quads: DataFrame, dataset: Dataset, checkpoint: str, **trigger) -> StreamingQuery:
    """Register the quads (g, s, p, o) of a streaming DataFrame. A batch that is delivered again
    after a failure adds nothing, since registering is a set operation."""

    def batch(rows: DataFrame, _: int) -> None:
        with dataset.txn.within(Mode.WRITE):
            dataset.add_all(rows)

    out = quads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()

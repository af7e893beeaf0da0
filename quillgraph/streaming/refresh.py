"""Edges that grow: each micro-batch of parsed references is resolved and appended once.

The reference domain has no streams; this keeps an edge table up to date as records arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def refresh_edges(references: DataFrame, resolve: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Resolve the streaming rows ``references`` batch by batch into ``target``, a folder for each batch, so that a batch
    that is run again overwrites its own and nothing is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        resolve(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return references.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""A stream of query clouds against a fixed index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index
from ..plans.params import SearchParams


def serve(queries: DataFrame, index: Index, params: SearchParams, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answers each micro-batch of a streaming ``queries(query_id, vectors)`` and writes it under its own batch folder.

    A batch that is run again after a failure overwrites its folder, so every query is answered exactly once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        index.search(batch, params).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

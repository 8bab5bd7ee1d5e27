"""Query batches that arrive as a stream, answered against a standing index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import joins
from tessella.operators.index import Index


def stream_counts(queries: DataFrame, index: Index, path: str, checkpoint: str, dense: bool = True) -> StreamingQuery:
    """Writes (qid, cnt, batch) of each micro-batch of queries under path. A batch's folder is written anew if the
    batch is run again, so results stay exact after a failure."""

    def answer(batch: DataFrame, number: int) -> None:
        counts = joins.counts_dense(batch, index) if dense else joins.counts_sparse(batch, index)
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

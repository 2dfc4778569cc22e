"""Questions as a stream against a static index.

Windows per question are not allowed on a stream, so each micro-batch is answered as
a table of its own (``foreachBatch``). Output is written by batch number, so that a
batch that runs again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.index import Embedder
from ..operators.retrieve import retrieve


def retrieve_stream(questions: DataFrame, index: dict[str, DataFrame], embedder: Embedder, path: str, checkpoint: str, k: int | None = None, conf: Config = Config(), **trigger) -> StreamingQuery:
    """Starts a query that writes the passages of each batch of (q_id, question) to
    ``path``/batch=N. ``trigger`` is that of ``writeStream``; by default what is there
    is processed and the query ends."""

    def answer(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        retrieve(batch, index, embedder, k, conf).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

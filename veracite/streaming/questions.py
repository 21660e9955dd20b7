"""Questions that arrive as a stream, answered in micro-batches against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.answer import compose
from ..operators.retrieve import ABSTAIN_BELOW


def answer_stream(questions: DataFrame, index: DataFrame, out: str, checkpoint: str, k: int = 5, threshold: float = ABSTAIN_BELOW, **trigger) -> StreamingQuery:
    """Writes the answers to a stream of questions (query_id, question, embedding) as Parquet below out, a folder for each
    micro-batch, which a repeated micro-batch overwrites: each question is answered exactly once."""

    def answer(batch: DataFrame, number: int) -> None:
        compose(batch, index, k, threshold=threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

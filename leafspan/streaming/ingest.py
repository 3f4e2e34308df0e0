"""Incremental runs: question files are answered as they arrive, and answered questions are skipped on restart.

The batch operators do the work; streaming only decides which rows are new. This is the resume rule of the result sink
applied per micro-batch, not a separate query surface.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leafspan.sources.stores import TableStore, pending_questions


def answer_incrementally(
    questions: DataFrame, results: TableStore, answer: Callable[[DataFrame], DataFrame], keys: Sequence[str], checkpoint: str
) -> StreamingQuery:
    """Append ``answer(batch)`` for the questions of each micro-batch that have no result yet.

    A batch replayed after a failure finds its questions answered and adds nothing.
    """

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(list(keys))
        fresh = pending_questions(batch, results.read(), keys) if results.exists() else batch
        if not fresh.isEmpty():
            results.append(answer(fresh))

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

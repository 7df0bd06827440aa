"""Search of a stream of requests in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(requests: DataFrame, search: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, max_wait: str = "1 seconds", once: bool = False) -> StreamingQuery:
    """Run ``search`` (queries to neighbours) on each micro-batch of ``requests`` and write the results to ``sink``, a Parquet folder.

    max_wait bounds how long a request waits for company; the source's options (such as
    maxFilesPerTrigger) bound the batch. A batch that is run again overwrites its own folder, so each
    request is answered once. once: answer what is there, then stop.
    """
    def answer(batch: DataFrame, batch_id: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=max_wait)).start()

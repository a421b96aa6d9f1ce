"""An incremental job driven by Structured Streaming: each new file of runs starts a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.streaming.incremental import RunLog


def watch_runs(log: RunLog, units: str, relations: str, runs: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of run lists; units, relations and runs are Parquet folders that only grow.

    The stream only says that there is something new. What is processed follows from the log's own watermark, so a batch that the stream
    repeats after a failure finds nothing left to do and publishes nothing twice. With ``once`` it ends when all present files are done.
    """
    spark = log.spark

    def batch(_: DataFrame, __: int) -> None:
        log.process(spark.read.parquet(units), spark.read.parquet(relations), spark.read.parquet(runs))

    schema = spark.read.parquet(runs).schema
    writer = spark.readStream.schema(schema).parquet(runs).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()

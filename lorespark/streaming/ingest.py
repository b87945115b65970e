"""Items as a stream: exact de-duplication against all that is stored, and event-time counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def dedupe_stream(events: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Each key once. State is dropped after ``lateness``; a repetition that comes later than that passes again."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, width: str, lateness: str) -> DataFrame:
    """(start, by, n, total): counts and sums of ``value`` over tumbling windows."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def append_novel(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends rows whose keys are not stored yet, batch by batch, until the source is empty.

    Exact where a watermark is not: every batch is compared with all stored keys by an anti-join. A batch that is run again
    after a failure finds its rows stored and adds nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

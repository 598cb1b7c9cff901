"""The same counters and histograms over records or events that arrive as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.operators.metrics import bucket_counts, bucket_label
from parity.session import scratch_path


def watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a time-zone timestamp (watermarks reject the other kind) with a lateness bound."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup_stream(stream: DataFrame, ids: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each id once; ids are remembered only as long as the watermark needs them."""
    return watermarked(stream, ts, delay).dropDuplicatesWithinWatermark(list(ids))


def window_counts(
    stream: DataFrame, ts: str, labels: Sequence[str], size: str, slide: str | None = None
) -> DataFrame:
    """Counts per label and tumbling (or, with ``slide``, trailing) window of a watermarked stream."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stream.groupBy(window.alias("w"), *labels).agg(F.count(F.lit(1)).alias("value"))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "value"
    )


def window_histogram(
    stream: DataFrame, ts: str, value: str, buckets: Sequence[float], labels: Sequence[str], size: str
) -> DataFrame:
    """Cumulative buckets per label and window."""
    v: Column = F.col(value)
    grouped = stream.groupBy(F.window(ts, size).alias("w"), *labels).agg(
        *bucket_counts(v, buckets), F.sum(v).alias("sum"), F.count(v).alias("count")
    )
    rows = F.array(
        *[
            F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"__b{i}").alias("bucket"))
            for i, b in enumerate(buckets)
        ]
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels,
        F.inline(rows), "sum", "count",
    )


def split_late(stream: DataFrame, ts: str, labels: Sequence[str], size: str, delay: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Counts of a stream by label and window with its rejected rows beside them: (window_start, window_end, labels,
    value), (labels, value).

    A row is late when the watermark had passed the end of its window before the row's batch began: the windows up to
    there are final. One pass reads each batch once, counts the timely rows of every window and the late rows of
    every label, and writes both to a folder of the batch, which a repeated batch replaces. The watermark is the
    greatest event time of the batches before, less ``delay``; it is kept in the folder with each batch, so a restart
    from the checkpoint goes on with it. Nothing but that one time comes to the driver.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    window = F.window(F.col(ts).cast("timestamp"), size)
    marks = T.StructType([T.StructField("top", T.TimestampType()), T.StructField("batch", T.LongType())])

    def keep(rows: DataFrame, batch: int) -> None:
        before = spark.read.schema(marks).parquet(f"{base}/marks") if batch else None
        top = before.filter(F.col("batch") < batch).agg(F.max("top").alias("t")).first()["t"] if before is not None else None
        mark = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        timed = rows.select(window.alias("w"), *labels, F.col(ts).cast("timestamp").alias("__ts"))
        late = F.coalesce(F.col("w.end") <= mark, F.lit(False))
        counts = timed.groupBy("w", late.alias("late"), *labels).agg(
            F.count(F.lit(1)).alias("value"), F.max("__ts").alias("top")
        )
        counts.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        written = spark.read.parquet(f"{base}/out/batch={batch}")
        written.agg(F.max("top").alias("top")).write.mode("overwrite").parquet(f"{base}/marks/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    total = F.sum("value").alias("value")
    counted = rows.filter("not late").groupBy("w", *labels).agg(total)
    counted = counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "value")
    return counted, rows.filter("late").groupBy(*labels).agg(total)


def read_file_stream(
    spark: SparkSession, directory: str, schema: T.StructType, pattern: str, files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a directory that match a pattern, as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run over all available input in append mode into parquet files, and read them back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_to_latest(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Run a windowed aggregation over all available input in update mode and return the last row of each key.

    Every batch writes the rows it changed to a folder of its own, which a repeated batch replaces, so
    nothing is kept on the driver, and the watermark lets finished windows leave the state.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)

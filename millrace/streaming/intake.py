"""Incremental intake: chat records normalized, filtered, deduplicated and assigned to partitions as files arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.quality import pair_reason
from millrace.functions.text import strip
from millrace.operators.decontam import drop_contaminated
from millrace.operators.splits import partition_of


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, files: int | None = None) -> DataFrame:
    """New parquet files under ``path``, a folder or one file; ``files`` bounds how many one step takes."""
    reader = spark.readStream.schema(schema)
    if os.path.isfile(path):
        reader, path = reader.option("pathGlobFilter", os.path.basename(path)), os.path.dirname(path)
    return (reader.option("maxFilesPerTrigger", str(files)) if files else reader).parquet(path)


def accept(pairs: DataFrame, bench: DataFrame | None = None, *, instruction: str = "instruction", response: str = "response", event_time: str | None = None, memory: str | None = None) -> DataFrame:
    """Pairs that pass the filter, match no benchmark prompt and were not seen before, with their partition.

    Instructions are held against prompts as in the batch job: equal, contained either way, or similar by shingles.

    Works alike on a table and on a stream. On a stream seen pairs are kept in the state store; with ``event_time`` and
    ``memory`` they are forgotten once the watermark has passed them by that long, which bounds the state. ``bench`` is
    (item_id, text).
    """
    good = pairs.where(pair_reason(instruction, response).isNull())
    if bench is not None:
        good = drop_contaminated(good, bench, text=instruction)
    hashed = good.withColumn("content_hash", F.sha2(F.concat_ws("::", strip(instruction), strip(response)), 256))
    if event_time and memory and pairs.isStreaming:
        hashed = hashed.withWatermark(event_time, memory).dropDuplicatesWithinWatermark(["content_hash"])
    else:
        hashed = hashed.dropDuplicates(["content_hash"])
    return hashed.withColumn("partition", partition_of(instruction, response))


def run_to(stream: DataFrame, path: str, checkpoint: str, *, partitions: tuple[str, ...] = ("partition",)) -> None:
    """Write all that has arrived to parquet, exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions).trigger(availableNow=True).start()
    query.awaitTermination()


def counts_by_hour(stream: DataFrame, event_time: str, by: str, *, late: str = "1 hour") -> DataFrame:
    """Rows by hour of ``event_time`` and ``by``; rows later than ``late`` are dropped."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, "1 hour").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), by, "n")

"""Incremental conversion: a stream of input files, of which those with an output are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import convert, quality

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def converted(spark: SparkSession, folder: str, converter: Callable[[bytes], str], pattern: str = "*") -> DataFrame:
    """A streaming DataFrame: each new file converted, normalised and judged, failures as data."""
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    rows = convert.converted(files.select(F.col("path").alias("input_path"), "content"), lambda: converter)
    judged = quality.judged(convert.normalised(rows).withColumnRenamed("status", "conversion"), "text")
    return judged.withColumnRenamed("status", "quality").withColumnRenamed("conversion", "status")


def run_available(stream: DataFrame, output: str, checkpoint: str, done: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Process what is there now and stop. done gives the input paths that already have an output."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.join(done(), "input_path", "left_anti") if done else batch
        fresh.write.mode("overwrite").parquet(f"{output}/batch={number}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

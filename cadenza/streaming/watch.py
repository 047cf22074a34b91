"""A folder watched as a stream: new files are analysed as they come, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.functions import paths
from cadenza.plans.library import analyse


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of (ordinal, path, size_bytes, content) of supported files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    s = s.where(paths.is_supported(F.col("path")))
    return s.select(F.lit(None).cast("long").alias("ordinal"), "path", F.col("length").alias("size_bytes"), "content")


def watch(spark: SparkSession, folder: str, output: str, checkpoint: str, detector: str = "spectral", once: bool = False) -> StreamingQuery:
    """Append the analysis of each file to Parquet at `output`; the checkpoint remembers which are done."""
    out = analyse(arriving(spark, folder), detector).withColumn("track_id", paths.track_id(F.col("path")))
    w = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()

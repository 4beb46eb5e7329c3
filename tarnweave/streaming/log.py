"""Streams of chunks as folders of Parquet files: a source with offsets and end marks, and a sink that commits by epoch.

The source is Spark's file stream: what was read is kept in the checkpoint, so a query that stops goes on where it was. A producer
adds files with append() and marks the last chunk of an utterance. The sink writes each epoch to a folder of its own; an epoch that
failed is written again as a whole by the next start, in place of what it left, so no chunk is lost or doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tarnweave.streaming.jitter import CHUNK


def append(chunks: DataFrame, folder: str) -> None:
    """Chunks to the end of the log; a consumer sees each file as a whole."""
    chunks.write.mode("append").parquet(folder)


def source(spark: SparkSession, folder: str, schema: str = CHUNK, files: int | None = None) -> DataFrame:
    """The log as a stream, some files a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def sink(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each epoch into <folder>/epoch=<number>. Start it with a trigger."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What the sink has written, with the epoch."""
    return spark.read.schema(f"{schema}, epoch long").option("basePath", folder).parquet(folder)


def ended(chunks: DataFrame) -> DataFrame:
    """(utt_id, n, complete): the different chunks of each utterance, and whether all up to its end mark are there."""
    end = F.max(F.when(F.col("last"), F.col("seq")))
    counted = chunks.groupBy("utt_id").agg(F.countDistinct("seq").alias("n"), end.alias("_end"))
    return counted.select("utt_id", "n", (F.col("n") == F.col("_end") + 1).alias("complete")).fillna(False, ["complete"])

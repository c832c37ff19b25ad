"""Live progress: the newest checkpoint of every shard as checkpoints arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..schemas import CHECKPOINT


def read_checkpoint_stream(
    spark: SparkSession, path: str, schema: str = CHECKPOINT, *, format: str = "json",
    files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def progress(checkpoints: DataFrame) -> DataFrame:
    """Tokens and chunk per shard; the state is one row per shard."""
    return checkpoints.groupBy("shard_id").agg(
        F.max("tokens_collected").alias("tokens_collected"),
        F.max_by("last_chunk_id", "tokens_collected").alias("last_chunk_id"),
    )


def progress_writer(checkpoints: DataFrame, checkpoint_location: str, *, refresh: str | None = None) -> DataStreamWriter:
    """A writer refreshed every ``refresh``, or run once over what is there.

    The caller picks the sink. Results hold one row per shard, so complete
    mode stays small.
    """
    writer = progress(checkpoints).writeStream.outputMode("complete").option(
        "checkpointLocation", checkpoint_location
    )
    return writer.trigger(processingTime=refresh) if refresh else writer.trigger(availableNow=True)

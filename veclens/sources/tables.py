"""The chunked activation table: partitioned Parquet."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists

LAYOUT = ("shard_id", "chunk_id")


def write_chunks(df: DataFrame, path: str, *, cluster: bool = True) -> None:
    """Writes rows under their shard and chunk; a chunk written again is replaced.

    Rows of a chunk are first brought into one task, so every chunk is one
    file; a chunk is bounded by the chunk size. Skip with ``cluster=False``
    when the rows already are.
    """
    if cluster:
        df = df.repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, "row_in_chunk")
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LAYOUT)
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked table; filters on shard and chunk prune its folders."""
    return spark.read.parquet(path)


def existing_paths(paths: Sequence[str]) -> list[str]:
    """Paths that exist, with a warning for each that does not."""
    kept = []
    for path in paths:
        if not exists(path):
            warnings.warn(f"{path} does not exist, skipping", stacklevel=2)
        else:
            kept.append(path)
    if not kept:
        raise ValueError(f"no data found in {list(paths)}")
    return kept


def read_shards(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Several shard folders as one table; missing folders are skipped.

    ``shard_id`` is the number at the end of the folder name.
    """
    found = existing_paths(paths)
    rows = spark.read.options(ignoreMissingFiles="true", recursiveFileLookup="false", **options)
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"shard(?:_id=)?(\d+)/", 1).cast("int")
    return rows.parquet(*found).withColumn("shard_id", shard)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and shard of every file below ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    shard = F.regexp_extract("path", r"/shard(?:_id=)?(\d+)/", 1)
    return files.select(
        "path", "length", F.when(shard != "", shard.cast("int")).alias("shard_id")
    )

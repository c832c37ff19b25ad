"""Run progress, sizes and recent errors per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_readable_size, thousands
from .ordering import top_k_per_group

# A log line with one of these words, in any case, is a problem.
ERROR_WORDS = ("error", "exception", "warning")
TAIL = 2


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint of each shard, by tokens collected.

    ``max_by`` combines before the shuffle, so long histories cost one row per
    shard and map task.
    """
    others = [name for name in checkpoints.columns if name != "shard_id"]
    order = ["tokens_collected"] + [name for name in ("examples_seen",) if name in others]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("newest")
    return checkpoints.groupBy("shard_id").agg(newest).select("shard_id", "newest.*")


def shard_status(spark: SparkSession, num_shards: int, metadata: DataFrame, latest: DataFrame) -> DataFrame:
    """One line of progress per shard: collecting, starting up, or not started.

    All three inputs have one row per shard.
    """
    shards = spark.range(num_shards).select(F.col("id").cast("int").alias("shard_id"))
    targets = metadata.select("shard_id", F.lit(True).alias("known"), F.col("tokens_per_shard").alias("target"))
    saved = latest.select("shard_id", "tokens_collected", "last_chunk_id")
    joined = shards.join(targets, "shard_id", "left").join(saved, "shard_id", "left")
    pct = F.round(F.lit(100.0) * F.col("tokens_collected") / F.col("target"), 1)
    state = (
        F.when(F.col("tokens_collected").isNotNull() & (F.col("target") > 0), "collecting")
        .when(F.col("tokens_collected").isNotNull(), "collecting, no target")
        .when(F.col("known"), "starting up")
        .otherwise("not started")
    )
    count = thousands(F.col("tokens_collected"))
    chunk = F.coalesce("last_chunk_id", F.lit(0)).cast("string")
    text = (
        F.when(state == "collecting", F.concat(
            count, F.lit(" / "), thousands(F.col("target")), F.lit(" tokens ("),
            F.format_string("%.1f", pct), F.lit("%) - Chunk "), chunk))
        .when(state == "collecting, no target", F.concat(count, F.lit(" tokens - Chunk "), chunk))
        .when(state == "starting up", F.lit("Starting up..."))
        .otherwise(F.lit("Not started"))
    )
    return joined.select(
        "shard_id",
        state.alias("state"),
        "tokens_collected",
        "target",
        F.when(F.col("target") > 0, pct).alias("pct"),
        "last_chunk_id",
        F.concat(F.lit("Shard "), F.col("shard_id").cast("string"), F.lit(": "), text).alias("status"),
    )


def shard_bytes(files: DataFrame) -> DataFrame:
    """Bytes of every shard and, with a null ``shard_id``, of everything.

    ``files`` has ``shard_id`` (null outside any shard) and ``length``.
    """
    per_shard = files.groupBy("shard_id").agg(F.sum("length").alias("n_bytes"), F.count("*").alias("n_files"))
    everything = per_shard.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_files").alias("n_files"))
    shards = per_shard.where(F.col("shard_id").isNotNull()).withColumn("scope", F.lit("shard"))
    total = everything.select(F.lit(None).cast("int").alias("shard_id"), "*", F.lit("total").alias("scope"))
    return shards.unionByName(total).withColumn("size", human_readable_size(F.col("n_bytes")))


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.lower("line").rlike("|".join(ERROR_WORDS)))


def error_tail(lines: DataFrame, limit: int = TAIL) -> DataFrame:
    """The last ``limit`` problem lines of each shard, oldest first."""
    last = top_k_per_group(
        error_lines(lines), ["shard_id"], (F.desc("line_no"),), limit, rank="from_end"
    )
    return last.select("shard_id", "line_no", F.regexp_replace("line", r"\s+$", "").alias("line")).orderBy("shard_id", "line_no")


def any_errors(lines: DataFrame) -> DataFrame:
    """One row: whether any shard logged a problem."""
    words = F.lower("line").rlike("|".join(ERROR_WORDS))
    return lines.agg(F.coalesce(F.bool_or(words), F.lit(False)).alias("any_errors"))

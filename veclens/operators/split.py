"""Row transforms, the exact train/validation split, and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import BUCKET_DIGITS, seeded_rank


def transform_rows(df: DataFrame, function: Callable[[Column], Column], column: str = "activation") -> DataFrame:
    """Applies a column function, built-in or vectorised UDF, to each vector."""
    return df.withColumn(column, function(F.col(column)))


def train_val_split(
    df: DataFrame, train_split: float = 0.98, *, seed: int = 42, id_column: str = "token_idx",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Adds ``split_rank`` from 1 and ``split``; train gets ``int(split * n)`` rows.

    Sizes are exact, unlike ``randomSplit``.
    """
    ranked = seeded_rank(df, id_column, seed, name="split_rank", total="n_rows", digits=digits)
    train_size = (F.lit(train_split) * F.col("n_rows")).cast("bigint")
    return ranked.withColumns({
        "train_size": train_size,
        "split": F.when(F.col("split_rank") <= train_size, "train").otherwise("val"),
    }).drop("order_key", "bucket", "n_rows")


def epoch_batches(
    split_rows: DataFrame, epoch: int, batch_size: int = 8192, *, id_column: str = "token_idx",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Adds ``batch_id`` from 0; the last batch of each split may be short.

    Train rows are reordered for every epoch; validation keeps the split order.
    """
    train = seeded_rank(
        split_rows.where(F.col("split") == "train"), id_column, epoch, name="batch_rank", digits=digits
    ).drop("order_key", "bucket")
    val = split_rows.where(F.col("split") == "val").withColumn(
        "batch_rank", F.col("split_rank") - F.col("train_size")
    )
    both = train.unionByName(val)
    return both.withColumns({
        "epoch": F.lit(epoch),
        "batch_id": F.expr(f"(batch_rank - 1) div {int(batch_size)}"),
    })

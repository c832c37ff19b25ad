"""Seeded order, exact ranks and running totals without one-task windows.

A global window would pull every row into a single task. Rows are instead
bucketed by a prefix of their md5 order key; windows run inside the buckets
and the totals of earlier buckets are added from a table with one row per
bucket. md5 spreads distinct ids evenly, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 16**3 buckets: at 10**10 rows each holds 2.4 million, which one task sorts.
BUCKET_DIGITS = 3

# Largest k that Spark's own group-limit rewrite prunes before the shuffle.
GROUP_LIMIT_THRESHOLD = 1000
SALTS = 64


def order_key(id_column: str | Column, seed: int | str = 42) -> Column:
    """``md5(seed:id)``, which sorts ids into a reproducible random order."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def with_order_key(
    df: DataFrame, id_column: str, seed: int | str = 42, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Adds ``order_key`` and ``bucket``, the key's first ``digits`` characters."""
    return df.withColumn("order_key", order_key(id_column, seed)).withColumn(
        "bucket", F.substring("order_key", 1, digits)
    )


def running(
    df: DataFrame,
    *,
    bucket: str,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums and minima over ``order``, per ``by`` group.

    ``bucket`` must grow with ``order``. ``totals`` maps a running sum to the
    name of a column that receives its grand total. A group that holds a third
    of all rows is still split over all buckets.
    """
    sums, mins, totals = dict(sums or {}), dict(mins or {}), dict(totals or {})
    keys = [bucket, *by]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = (
        Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    per_bucket = df.groupBy(*keys).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()],
        *[F.min(value).alias(name) for name, value in mins.items()],
    )
    carried = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
        *[F.min(name).over(earlier).alias(f"_before_{name}") for name in mins],
        *[F.sum(name).over(Window.partitionBy(*by)).alias(total) for name, total in totals.items()],
    )
    local = df.select(
        "*",
        *[F.sum(value).over(inside).alias(name) for name, value in sums.items()],
        *[F.min(value).over(inside).alias(name) for name, value in mins.items()],
    )
    joined = local.join(carried, keys)
    merged = {name: F.col(name) + F.col(f"_before_{name}") for name in sums}
    merged |= {name: F.least(name, f"_before_{name}") for name in mins}
    return joined.withColumns(merged).drop(*[f"_before_{name}" for name in merged])


def seeded_rank(
    df: DataFrame,
    id_column: str,
    seed: int | str = 42,
    *,
    name: str = "rank",
    total: str | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Exact 1-based rank of each row in the seeded order, ties by id."""
    keyed = with_order_key(df, id_column, seed, digits)
    return running(
        keyed,
        bucket="bucket",
        order=("order_key", id_column),
        sums={name: F.lit(1).cast("bigint")},
        totals={name: total} if total else None,
    )


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, *, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1.

    Up to the threshold Spark prunes every map task to ``k`` rows per group by
    itself. Beyond it a salted first round does the same, so a hot group never
    reaches one task whole; either way the result is exact.
    """
    if k > GROUP_LIMIT_THRESHOLD:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        first = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_local", F.row_number().over(first))
            .where(F.col("_local") <= k)
            .drop("_salt", "_local")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)

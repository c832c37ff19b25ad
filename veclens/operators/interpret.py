"""What single features respond to: statistics, leaderboards, top tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import decode_tokens
from .ordering import top_k_per_group
from .sae import ALL_ROWS, SaeModel

LEADERS = 20
TOP_K = 10


def feature_statistics(
    model: SaeModel, df: DataFrame, n_samples: int | None = None, *, index: str = "token_idx"
) -> DataFrame:
    """Maximum, mean and firing frequency of every feature.

    Looks at all vectors, or at the first ``n_samples`` in index order, a filter
    that reaches the scan. Features that never fire are
    listed with zeros. Sums and counts stay whole until the one division.
    """
    rows = df if n_samples is None else df.where(F.col(index) < n_samples)
    merged = model.feature_partials(rows).groupBy("feature_id").agg(
        F.max("max_act").alias("max_act"),
        F.sum("sum_act").alias("sum_act"),
        F.sum("n_active").alias("n_active"),
    )
    # The range starts at ALL_ROWS, so the row total rides along; the window is
    # over one row per feature, which the model bounds.
    listed = df.sparkSession.range(ALL_ROWS, model.parameters.d_sae).select(
        F.col("id").cast("int").alias("feature_id")
    )
    # Not fillna: it would also turn a NaN statistic into 0.
    full = listed.join(merged, "feature_id", "left").withColumns({
        "max_act": F.coalesce("max_act", F.lit(0.0)),
        "sum_act": F.coalesce("sum_act", F.lit(0.0)),
        "n_active": F.coalesce("n_active", F.lit(0)),
    })
    n_rows = F.sum(F.when(F.col("feature_id") == ALL_ROWS, F.col("n_active"))).over(Window.partitionBy())
    stats = full.withColumn("n_rows", n_rows).where(F.col("feature_id") != ALL_ROWS)
    return stats.select(
        "feature_id",
        "max_act",
        (F.col("sum_act") / F.col("n_rows")).alias("mean_act"),
        (F.col("n_active") / F.col("n_rows")).alias("frequency"),
        F.col("n_rows").alias("n_samples"),
    )


def leaderboard(stats: DataFrame, by: str = "max_act", n: int = LEADERS) -> DataFrame:
    """The ``n`` leading features by a statistic, with their rank from 1."""
    leaders = stats.orderBy(F.desc(by), "feature_id").limit(n)
    return top_k_per_group(leaders, (), (F.desc(by), F.asc("feature_id")), n)


def top_tokens(
    model: SaeModel, df: DataFrame, k: int = TOP_K, *, feature_id: int | None = None,
    index: str = "token_idx", pad: bool = False,
) -> DataFrame:
    """The ``k`` strongest tokens of one feature, or of every feature.

    For one feature only its weights are shipped and multiplied. Ties go to
    the smaller index. ``pad`` lets inactive tokens fill a single feature's
    list when fewer than ``k`` are active.
    """
    order = (F.desc("act"), F.asc(index))
    if feature_id is None:
        # a task sends k rows per feature at most, however many vectors it has
        return top_k_per_group(model.top_cells(df, index, k), ["feature_id"], order, k)
    cells = model.cells(df, [index], feature_ids=[feature_id], top=k)
    if pad:
        encoded = model.encode(df, [index], feature_ids=[feature_id])
        cells = encoded.select(
            index,
            F.lit(feature_id).alias("feature_id"),
            F.coalesce(F.get("features", F.lit(0))["act"], F.lit(0.0)).alias("act"),
        )
    leaders = cells.orderBy(*order).limit(k)
    return top_k_per_group(leaders, ["feature_id"], order, k)


def with_token_ids(top: DataFrame, tokens: DataFrame, k: int, n_features: int, *,
                   index: str = "token_idx") -> DataFrame:
    """Token ids of top rows. The broadcast holds ``k * n_features`` rows at most."""
    small = k * n_features * 40 <= 64 << 20
    ids = tokens.select(index, "token_id")
    return ids.join(F.broadcast(top), index) if small else ids.join(top, index)


def describe_feature(
    model: SaeModel, df: DataFrame, vocabulary: DataFrame, feature_id: int, k: int = TOP_K,
    *, index: str = "token_idx",
) -> DataFrame:
    """Ranked top tokens of a feature with their ids and texts."""
    top = top_tokens(model, df, k, feature_id=feature_id, index=index)
    named = decode_tokens(with_token_ids(top, df, k, 1, index=index), vocabulary)
    return named.select("rank", "feature_id", "act", index, "token_id", "token").orderBy("rank")


def top_stats(top: DataFrame) -> DataFrame:
    """Largest, smallest and mean activation among each feature's top tokens."""
    return top.groupBy("feature_id").agg(
        F.max("act").alias("max_act"), F.min("act").alias("min_act"), F.avg("act").alias("mean_act")
    )

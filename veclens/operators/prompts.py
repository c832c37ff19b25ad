"""Features per prompt, and what prompts have in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import top_k_per_group
from .sae import SaeModel

TOP_FEATURES = 10
SHOWN_FEATURES = 5


def prompt_token_profile(
    model: SaeModel, df: DataFrame, keys: Sequence[str] = ("prompt_id", "pos"), *, tokens: DataFrame | None = None
) -> DataFrame:
    """Per token: number of active features and the largest activation.

    ``tokens`` has the keys and the ``token`` text, which then stands in the
    profile; a place without one has a null.

    Tokens without an active feature are listed with zeros. Computed on each
    row's feature array, so nothing is shuffled.
    """
    encoded = model.encode(df, keys)
    strongest = F.array_max(F.transform("features", lambda f: f["act"]))
    profile = encoded.select(
        *keys,
        F.size("features").cast("bigint").alias("n_active"),
        F.coalesce(strongest, F.lit(0.0)).alias("max_act"),
    )
    return profile if tokens is None else profile.join(tokens.select(*keys, "token"), list(keys), "left")


def feature_totals(model: SaeModel, df: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Summed activation per prompt and feature.

    Sums combine before the shuffle, so a prompt that holds a third of all
    tokens sends at most one row per feature and map task.
    """
    return model.cells(df, [prompt]).groupBy(prompt, "feature_id").agg(F.sum("act").alias("total_act"))


def prompt_summary(model: SaeModel, df: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Mean L0, number of different features, and reconstruction error.

    One pass: a task gives sums and a bitmap of the features it has seen, for
    each of its prompts, and Spark adds the sums and joins the bitmaps. A prompt
    that holds a third of all tokens sends one row per task.
    """
    parts = model.group_partials(df, prompt).groupBy(prompt, "bucket").agg(
        F.bitmap_or_agg("seen").alias("seen"), *[F.sum(name).alias(name) for name in ("n", "l0", "squared_error")]
    )
    return parts.groupBy(prompt).agg(
        (F.sum("l0") / F.sum("n")).alias("mean_l0"),
        (F.sum("squared_error") / F.sum("n") / model.parameters.d_model).alias("recon_mse"),
        F.sum(F.bitmap_count("seen")).alias("n_features"),
    )


def prompt_top_features(model: SaeModel, df: DataFrame, k: int = TOP_FEATURES, prompt: str = "prompt_id") -> DataFrame:
    """The ``k`` features with the largest summed activation in each prompt."""
    totals = feature_totals(model, df, prompt)
    return top_k_per_group(totals, [prompt], (F.desc("total_act"), F.asc("feature_id")), k)


def top_feature_arrays(top: DataFrame, shown: int = SHOWN_FEATURES, prompt: str = "prompt_id") -> DataFrame:
    """One row per prompt: ``top_features`` in rank order and the first few."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "feature_id")))
    listed = top.groupBy(prompt).agg(F.transform(ranked, lambda r: r["feature_id"]).alias("top_features"))
    return listed.withColumn("leading", F.slice("top_features", 1, shown))


def features_union(top: DataFrame) -> DataFrame:
    """How many different features the prompts' top lists hold."""
    return top.select("feature_id").distinct().agg(F.count("*").alias("n_features"))


def features_common(top: DataFrame, n_prompts: int, prompt: str = "prompt_id") -> DataFrame:
    """Features in the top list of every prompt, in id order; may be empty."""
    shared = top.groupBy("feature_id").agg(F.count_distinct(prompt).alias("n_prompts"))
    return shared.where(F.col("n_prompts") == n_prompts).select("feature_id").orderBy("feature_id")


def common_features_report(common: DataFrame) -> DataFrame:
    """One row: the common ids as text, or the message for none."""
    joined = F.array_join(F.array_sort(F.collect_list("feature_id")), ", ")
    return common.agg(
        F.when(F.count("*") > 0, joined).otherwise("no common features").alias("common_features")
    )

"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veclens.operators.ordering import running
from veclens.session import stage

from . import query
from .texts import documents, n_words, seeded, whole

BUCKETS = 4096
#: Quality weights of labelled documents; the others weigh 1.
GOOD, POOR = 2.0, 0.5


def exponential_key(id_column: str, weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with u in (0, 1] from the id: the smallest keys are a weighted sample."""
    u = (F.conv(F.substring(seeded(id_column, seed), 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(totals: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """Target size of every source from ``source, source_size``, one row each.

    Sources in order, null last, take ``weights`` in turn and share ``percent``
    of the sum; no target exceeds ``most`` times its source's size, and the
    excess goes to the others by weight. The level that results is found from
    running sums in order of size per weight. The window has one row per source.
    """
    named = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("w", F.element_at(named, F.pmod(F.row_number().over(order) - 1, len(weights)) + 1))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sums = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("w").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped_w"),
    )
    # in hundredths of a word: what is left for this source and those after it
    left = F.col("total") * percent - F.col("capped") * (100 * most)
    rest_w = F.col("all_w") - F.col("capped_w")
    full = F.col("source_size") * (100 * most) * rest_w <= left * F.col("w")
    tested = sums.select("*", left.alias("left"), rest_w.alias("rest_w"), full.alias("full"))
    # the first source in this order that is not full sets the level for all after it
    open_first = F.min(F.when(~F.col("full"), F.struct("capped", "left", "rest_w"))).over(everything)
    level = tested.withColumn("level", open_first)
    return level.select(
        "source",
        F.col("source_size").alias("source_size"),
        F.when(F.col("full"), F.struct((F.col("source_size") * most).alias("num"), F.lit(1).cast("bigint").alias("den")))
        .otherwise(
            F.struct(
                (F.col("level.left") * F.col("w")).alias("num"), (F.col("level.rest_w") * 100).cast("bigint").alias("den")
            )
        )
        .alias("goal"),
    ).select("source", "source_size", F.col("goal.num").alias("num"), F.col("goal.den").alias("den"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    seed: int = 42,
    quality: DataFrame | None = None,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How many words a mixture takes of every row.

    Whole epochs of a source come first; the rest of its target is a weighted
    sample without replacement: rows in order of ``-ln(u) / quality weight``
    until their words reach the rest, the last row taken if that is nearer.
    ``quality`` has the id and ``weight``; rows without one weigh 1, and of
    several the largest counts.

    Returns the id, size, source_size, target, taken, epochs (times the row is
    taken) and text_hash (xxhash64, to tell rows that repeat an id apart). A null or empty text has size 0 and takes 0, null is a source of
    its own and the last, rows that repeat an id are ordered by size, and an
    empty table gives no rows. Columns other than the three named are not read.

    Prefix sums run inside buckets of the key, so a hot source is spread over
    tasks; only one row per source meets in one task.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"),
        F.xxhash64(whole(text)).alias("text_hash"),
    )
    rows = stage(rows, "mix-rows")
    if quality is None:
        weight = F.lit(1.0)
    else:
        known = quality.groupBy(F.col(id_column).alias("id")).agg(F.max("weight").alias("weight"))
        rows = rows.join(known, "id", "left")
        weight = F.coalesce("weight", F.lit(1.0)).cast("double")
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most
    )
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    keyed = rows.select("id", name.alias("name"), "size", "text_hash", exponential_key("id", weight, seed).alias("key"))
    # grows with the key and spreads the keys of weight 1 evenly
    cell = F.least(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1))
    summed = running(
        keyed.withColumn("cell", cell),
        bucket="cell",
        order=("key", "id", "size", "text_hash"),
        sums={"upto": F.col("size")},
        by=("name",),
    )
    joined = summed.join(targets.withColumn("name", name).drop("source"), "name")
    epochs = F.when(F.col("source_size") > 0, F.expr("num div (den * source_size)")).otherwise(F.lit(0))
    over = F.col("num") - F.col("epochs") * F.col("den") * F.col("source_size")
    chosen = (2 * (F.col("upto") - F.col("size")) + F.col("size")) * F.col("den") <= 2 * over
    times = F.when(F.col("size") > 0, F.col("epochs") + chosen.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return joined.withColumn("epochs", epochs).select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        (F.col("num").cast("double") / F.col("den").cast("double")).alias("target"),
        (times * F.col("size")).alias("taken"),
        times.alias("epochs"),
        "text_hash",
    )


def label_weights(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = F.when(F.col("quality") == 1, F.lit(GOOD)).otherwise(F.when(F.col("quality") == 0, F.lit(POOR)).otherwise(1.0))
    return labels.select("doc_id", good.alias("weight"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(source_size) OVER before, 0) AS capped, coalesce(sum(w) OVER before, 0) AS capped_w
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, total * 150 - capped * 200 AS rest, all_w - capped_w AS rest_w,
         source_size * 200 * (all_w - capped_w) <= (total * 150 - capped * 200) * w AS done FROM c
), l AS (
  SELECT *, arg_min(CASE WHEN NOT done THEN rest END, CASE WHEN NOT done THEN capped END) OVER () AS level,
         arg_min(CASE WHEN NOT done THEN rest_w END, CASE WHEN NOT done THEN capped END) OVER () AS level_w FROM f
), t AS (
  SELECT source, source_size, CAST(CASE WHEN done THEN source_size * 2 ELSE level * w END AS BIGINT) AS num,
         CAST(CASE WHEN done THEN 1 ELSE level_w * 100 END AS BIGINT) AS den FROM l
), k AS (
  SELECT d.doc_id, d.source, size, -ln((CAST(('0x' || substr(md5('42:' || d.doc_id), 1, 13)) AS BIGINT) + 1.0::DOUBLE)
         / 4503599627370496.0::DOUBLE) / (CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {POOR} ELSE 1.0 END)::DOUBLE AS key
  FROM d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
), p AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
         ROWS UNBOUNDED PRECEDING) - size AS before FROM k
), e AS (
  SELECT p.*, source_size, num, den, CASE WHEN source_size > 0 THEN num // (den * source_size) ELSE 0 END AS n
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, CAST(CASE WHEN size > 0 THEN n + CASE WHEN (2 * before + size) * den <= 2 * (num - n * den * source_size)
         THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS epochs FROM e
)
SELECT doc_id, size, source_size, num::DOUBLE / den::DOUBLE AS target, epochs * size AS taken, epochs FROM r
"""


@query("op1_mixing", SQL)
def op1_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir), quality=label_weights(spark, sf_dir)).drop("text_hash")

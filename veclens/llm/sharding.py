"""Shards that all hold the same mixture: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.operators.ordering import running
from veclens.session import stage

from . import query
from .texts import documents, seeded, whole

BUCKETS = 4096
#: A fractional rank in more than this part of all rows, and this number, is spread over buckets of its own by key.
HEAVY_PART, HEAVY_LEAST, HEAVY_DIGITS = 512, 1000, 2


def with_cell(ranks: DataFrame) -> DataFrame:
    """Adds ``cell``, a bucket that grows with share and key.

    Sources with one row all have the share 1/2. Such a share is cut by a prefix
    of the key; what follows it in its 4,096th is a bucket behind them. At most
    ``HEAVY_PART`` shares are heavy, so their table is broadcast.
    """
    counts = ranks.groupBy("share").count().where(F.col("count") > HEAVY_LEAST)
    rows = ranks.agg(F.count(F.lit(1)).alias("rows"))
    step = F.floor(F.col("share") * BUCKETS)
    heavy = counts.crossJoin(F.broadcast(rows)).where(F.col("count") * HEAVY_PART > F.col("rows"))
    heavy = heavy.groupBy(step.alias("step")).agg(F.collect_list("share").alias("heavy"))
    last = F.array_max(F.filter("heavy", lambda x: x <= F.col("share")))
    part = F.when(F.col("share") > F.col("last"), "~").otherwise(F.substring("key", 1, HEAVY_DIGITS))
    return (
        ranks.withColumn("step", step)
        .join(F.broadcast(heavy), "step", "left")
        .withColumn("last", last)
        .withColumn("cell", F.struct("step", F.coalesce("last", F.lit(-1.0)).alias("last"), F.when(F.col("last").isNull(), "").otherwise(part).alias("part")))
        .drop("step", "heavy", "last")
    )


def interleaved_shards(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    seed: int = 42,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Deals rows to ``n_shards`` shards whose row counts are at most one apart.

    Rows of each source are ranked in a seeded shuffle; all rows are sorted by
    fractional rank ``(rank - 1/2) / rows of the source`` and cut into equal
    runs, so each shard has every source in proportion. Returns the id, size
    (bytes and one), text_crc32, shard and slot.

    A null text is empty, null is a source of its own, a null id is shuffled
    like an id; ties in the fractional rank follow the shuffle, then the id,
    size and checksum, so repeated rows get neighbouring slots. An empty table
    gives no rows; columns other than the three named are not read.

    Ranks come from sums over buckets (of the shuffle key, then of the rank),
    so a source with a third of all rows is spread over all tasks, and so are
    rows of many small sources that have one rank.
    """
    rows = stage(
        docs.select(
            F.col(id_column).alias("id"),
            F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("stratum"),
            (F.octet_length(whole(text)) + F.lit(1)).cast("bigint").alias("size"),
            F.crc32(whole(text)).alias("text_crc32"),
        ),
        "shard-rows",
    )
    keyed = rows.withColumn("key", seeded("id", seed)).withColumn("part", F.substring("key", 1, 3))
    one = F.lit(1).cast("bigint")
    ranked = running(
        keyed,
        bucket="part",
        order=("key", "id", "size", "text_crc32"),
        sums={"rank": one},
        by=("stratum",),
        totals={"rank": "of"},
    )
    share = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("of")).cast("double")
    narrow = stage(ranked.select("id", "size", "text_crc32", "key", share.alias("share")), "shard-ranks")
    placed = running(
        with_cell(narrow),
        bucket="cell",
        order=("share", "key", "id", "size", "text_crc32"),
        sums={"place": one},
        totals={"place": "rows"},
    )
    shard = F.expr(f"(place - 1) * {n_shards} div rows")
    slot = F.expr(f"place - 1 - (shard * rows + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias(id_column), "size", "text_crc32", F.col("shard").cast("int"), slot.alias("slot")
    )


@query("op6_sharding")
def op6_sharding(spark, sf_dir):
    shards = interleaved_shards(documents(spark, sf_dir))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

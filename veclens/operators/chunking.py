"""Token budgets, chunk numbers, resume offsets, and the chunk catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ordering import running

CHUNK_SIZE = 100_000
MAX_CHUNK_TOKENS = 1_000_000
LOOKUP_BLOCK = 65_536
BYTES_PER_VALUE = 2  # float16 on disk

RESUME_COLUMNS = ("shard_id", "tokens_collected", "next_chunk", "examples_seen")


def document_counts(df: DataFrame, count: Column) -> DataFrame:
    """Adds ``n_tokens``, the given count, or 0 for null and empty texts."""
    usable = F.col("text").isNotNull() & (F.col("text") != "")
    return df.withColumn("n_tokens", F.when(usable, count).otherwise(0).cast("bigint"))


def running_tokens(sharded: DataFrame) -> DataFrame:
    """Adds ``cum_tokens``: tokens of the shard up to and with each document.

    Runs in the buckets of the seeded order, which is also the order inside
    each shard, so ranking and summing share one partitioning.
    """
    return running(
        sharded,
        bucket="bucket",
        order=("order_key", "doc_id"),
        by=("shard_id",),
        sums={"cum_tokens": F.col("n_tokens")},
    )


def within_budget(counted: DataFrame, tokens_per_shard: int) -> DataFrame:
    """Documents whose shard had not reached the budget before them."""
    return counted.where(F.col("cum_tokens") - F.col("n_tokens") < tokens_per_shard)


def progress_milestones(
    counted: DataFrame, tokens_per_shard: int, *, every: int = 1_000_000, max_length: int = 2048
) -> DataFrame:
    """Documents that report progress, with the percentage of the target."""
    hit = counted.where((F.col("n_tokens") > 0) & (F.col("cum_tokens") % every < max_length))
    return hit.withColumn("pct", F.round(F.lit(100.0) * F.col("cum_tokens") / tokens_per_shard, 1))


def assign_chunks(
    sharded: DataFrame,
    *,
    chunk_size: int = CHUNK_SIZE,
    tokens_per_shard: int | None = None,
    resume: DataFrame | None = None,
) -> DataFrame:
    """Numbers the documents of every shard with the chunk that receives them.

    A chunk closes after the document that brings the shard's total to
    ``(chunk_id + 1) * chunk_size``, and one document closes at most one chunk.
    With i counting usable documents, T the tokens before document i and
    F = floor(T / chunk_size), that greedy rule has the closed form
    ``chunk = i + min over j <= i of (F_j - j)``: a running minimum.

    ``resume`` has the columns ``RESUME_COLUMNS``, one row per shard: documents
    before ``examples_seen`` are left out, totals continue from
    ``tokens_collected`` and numbers from ``next_chunk``.
    """
    if resume is not None:
        # One row per shard bounds this broadcast.
        offsets = F.broadcast(resume.select(*RESUME_COLUMNS))
        sharded = sharded.join(offsets, "shard_id", "left").fillna(
            0, ["tokens_collected", "next_chunk", "examples_seen"]
        )
        sharded = sharded.where(F.col("pos_in_shard") >= F.col("examples_seen"))
        start_tokens, start_chunk = F.col("tokens_collected"), F.col("next_chunk")
    else:
        start_tokens = start_chunk = F.lit(0).cast("bigint")

    # Written once: token counts come from whole texts, and both scans below read narrow rows instead.
    usable = stage(sharded.where(F.col("n_tokens") > 0), "usable")
    keys, order = ("shard_id", "bucket"), ("order_key", "doc_id")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("shard_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = usable.groupBy(*keys).agg(F.sum("n_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_docs"))
    # One row per shard and bucket.
    carried = totals.select(
        *keys,
        F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_tokens_before"),
        F.coalesce(F.sum("_docs").over(earlier), F.lit(0)).alias("_docs_before"),
    )
    before = start_tokens + F.col("_tokens_before") + F.col("_new_tokens") - F.col("n_tokens")
    placed = usable.select(
        "*", F.sum("n_tokens").over(inside).alias("_new_tokens"), F.row_number().over(inside).cast("bigint").alias("_number")
    ).join(carried, list(keys)).withColumns({
        "tokens_before": before, "doc_number": F.col("_docs_before") + F.col("_number") - 1,
    })
    full_chunks = F.greatest(F.floor(F.col("tokens_before") / chunk_size).cast("bigint"), start_chunk)
    # The least slack of a bucket depends on the tokens before it only through the sum that was carried,
    # so one more scan gives it for all buckets at once.
    slack = full_chunks - F.col("doc_number")
    least = placed.groupBy(*keys).agg(F.min(slack).alias("_least"))
    least = least.select(*keys, F.min("_least").over(earlier).alias("_least_before"))
    chunked = placed.withColumn("_slack", F.min(slack).over(inside)).join(least, list(keys)).withColumns({
        "chunk_id": F.col("doc_number") + F.least(start_chunk, "_slack", "_least_before"),
        "cum_tokens": F.col("tokens_before") + F.col("n_tokens"),
    }).drop("_new_tokens", "_number", "_tokens_before", "_docs_before", "_slack", "_least_before")
    if tokens_per_shard is not None:
        chunked = chunked.where(F.col("tokens_before") < tokens_per_shard)
    return chunked.drop(*RESUME_COLUMNS[1:])


def chunk_memory_plan(
    chunked: DataFrame, d_model: int, *, max_chunk_tokens: int = MAX_CHUNK_TOKENS
) -> DataFrame:
    """Tokens and estimated GB per planned chunk, and whether it is too large."""
    planned = chunked.groupBy("shard_id", "chunk_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return planned.withColumns({
        "est_gb": F.col("n_tokens") * d_model * BYTES_PER_VALUE / 1e9,
        "over_limit": F.col("n_tokens") > max_chunk_tokens,
    })


def check_chunk_size(chunk_size: int, d_model: int, limit: int = MAX_CHUNK_TOKENS) -> None:
    if chunk_size > limit:
        gigabytes = chunk_size * d_model * BYTES_PER_VALUE / 1e9
        raise ValueError(
            f"chunk_size={chunk_size:,} needs about {gigabytes:.1f} GB per chunk; use {limit:,} or less"
        )


def chunk_catalog(rows: DataFrame, path: Column | None = None) -> DataFrame:
    """Size and index range of every chunk, shards and chunks in order.

    ``path`` gives the file of a row, such as ``_metadata.file_path``; the
    catalog then has each chunk's, the first one of a chunk in several files.
    ``chunk_number`` counts chunks over all shards. The windows run over one
    row per chunk, per shard first, then over one row per shard.
    """
    named = [] if path is None else [F.min(path).alias("path")]
    sizes = rows.groupBy("shard_id", "chunk_id").agg(F.count("*").alias("size"), *named)
    inside = Window.partitionBy("shard_id").orderBy("chunk_id")
    shard_sizes = sizes.groupBy("shard_id").agg(
        F.sum("size").alias("shard_rows"), F.count("*").alias("shard_chunks")
    )
    earlier = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = shard_sizes.select(
        "shard_id",
        F.coalesce(F.sum("shard_rows").over(earlier), F.lit(0)).alias("shard_start"),
        F.coalesce(F.sum("shard_chunks").over(earlier), F.lit(0)).alias("first_chunk"),
    )
    placed = sizes.select(
        "*",
        F.sum("size").over(inside).alias("upto"),
        (F.row_number().over(inside) - 1).alias("number"),
    ).join(starts, "shard_id")
    return placed.select(
        "shard_id",
        "chunk_id",
        (F.col("first_chunk") + F.col("number")).alias("chunk_number"),
        "size",
        (F.col("shard_start") + F.col("upto") - F.col("size")).alias("start_idx"),
        (F.col("shard_start") + F.col("upto")).alias("end_idx"),
        *([] if path is None else ["path"]),
    )


def global_index(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds ``token_idx``: the chunk's start plus the row's place in the chunk.

    Pass a staged catalog: Catalyst then sees its size and broadcasts it while
    it is small, and otherwise joins on the chunk, never moving on shard alone.
    """
    starts = catalog.select("shard_id", "chunk_id", "start_idx")
    joined = rows.join(starts, ["shard_id", "chunk_id"])
    return joined.withColumn("token_idx", F.col("start_idx") + F.col("row_in_chunk")).drop("start_idx")


def locate(indices: DataFrame, catalog: DataFrame, *, strict: bool = False,
           block: int = LOOKUP_BLOCK) -> DataFrame:
    """Finds the chunk and local row of each ``token_idx``.

    The interval join becomes an equi-join on index blocks: a chunk is listed
    under every block it overlaps, an index looks only into its own block.
    Indices outside the data give null chunks, or an error with ``strict``.
    """
    blocks = catalog.select(
        "shard_id", "chunk_id", "start_idx", "end_idx",
        F.explode(F.sequence(
            F.expr(f"start_idx div {block}"), F.expr(f"(end_idx - 1) div {block}")
        )).alias("_block"),
    )
    keyed = indices.withColumn("_block", F.expr(f"token_idx div {block}"))
    inside = (
        (keyed["_block"] == blocks["_block"])
        & (keyed["token_idx"] >= blocks["start_idx"])
        & (keyed["token_idx"] < blocks["end_idx"])
    )
    found = keyed.join(blocks, inside, "left").select(
        keyed["*"],
        "shard_id",
        "chunk_id",
        (F.col("token_idx") - F.col("start_idx")).alias("row_in_chunk"),
    ).drop("_block")
    if strict:
        message = F.format_string("index %d out of range", F.col("token_idx"))
        checked = F.when(F.col("shard_id").isNull(), F.raise_error(message).cast("int"))
        found = found.withColumn("shard_id", F.coalesce("shard_id", checked))
    return found


def lookup(indices: DataFrame, catalog: DataFrame, tokens: DataFrame, *, strict: bool = True) -> DataFrame:
    """Token ids at the given indices; duplicates and extra columns are kept."""
    located = locate(indices, catalog, strict=strict)
    keys = ["shard_id", "chunk_id", "row_in_chunk"]
    return located.join(tokens.select(*keys, "token_id"), keys, "left")


def lookup_batch(batches: DataFrame, catalog: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token ids for arrays of indices: one row per entry, with its ``pos``."""
    others = [name for name in batches.columns if name != "indices"]
    entries = batches.select(*others, F.posexplode("indices").alias("pos", "token_idx"))
    return lookup(entries, catalog, tokens).orderBy(*others, "pos")


def dataset_size(rows: DataFrame, d_model: int) -> DataFrame:
    """Row count and bytes of the half-precision vectors."""
    counted = rows.agg(F.count("*").alias("n_rows"))
    return counted.withColumn("n_bytes", F.col("n_rows") * (d_model * BYTES_PER_VALUE))


def align_pairs(vectors: DataFrame, token_ids: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Rows that have both a vector and a token id under the same key.

    Tokens of documents without a vector leave before the join moves rows:
    Spark takes that filter below an explode, to the texts.
    """
    document = list(keys[:1])
    known = stage(vectors.select(*document).distinct(), "documents")
    return vectors.join(token_ids.join(known, document, "left_semi"), list(keys))


def align_arrays(vectors: str = "vectors", token_ids: str = "token_ids") -> dict:
    """Columns that cut two arrays of one row to the shorter length."""
    shorter = F.least(F.size(vectors), F.size(token_ids))
    return {vectors: F.slice(vectors, 1, shorter), token_ids: F.slice(token_ids, 1, shorter)}

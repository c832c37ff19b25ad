"""Checks for the chunk table: catalog, lookups, splits, batches, sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions.vectors import to_half
from ..operators import chunking, corpus, split
from ..operators.monitor import latest_checkpoint
from ..session import stage, staging_path
from ..sources import npy, state, tables
from . import check
from . import fixtures as fx

BATCH_SIZE = 64
EPOCHS = (1, 2)
TRAIN_SPLIT = 0.98


@check("activation_scan", f"""
WITH {fx.ROWS_SQL} SELECT shard_id, chunk_id, row_in_chunk, unnest(embedding)::DOUBLE AS value,
                          generate_subscripts(embedding, 1) - 1 AS dim FROM rows
""")
def activation_scan(spark, sf_dir):
    """Vectors of several shard folders, read as one table."""
    path = staging_path(spark, "vectors")
    fx.chunk_rows(spark, sf_dir).select("shard_id", "chunk_id", "row_in_chunk", "activation").write.partitionBy("shard_id").parquet(path)
    rows = tables.read_shards(spark, [f"{path}/shard_id={shard}" for shard in range(fx.NUM_SHARDS)])
    values = rows.select("shard_id", "chunk_id", "row_in_chunk", F.posexplode("activation").alias("dim", "value"))
    return wide(values.withColumn("value", F.col("value").cast("double")))


def wide(df):
    """Integer columns as BIGINT, so both engines print them alike."""
    return df.select(*[
        F.col(name).cast("bigint").alias(name) if kind in ("int", "smallint") else F.col(name)
        for name, kind in df.dtypes
    ])


@check("token_scan", f"WITH {fx.ROWS_SQL} SELECT shard_id, chunk_id, row_in_chunk, token_id FROM rows")
def token_scan(spark, sf_dir):
    return wide(fx.chunk_rows(spark, sf_dir).select("shard_id", "chunk_id", "row_in_chunk", "token_id"))


@check("chunk_sink_roundtrip", f"""
WITH {fx.ROWS_SQL}
SELECT shard_id, chunk_id, row_in_chunk, token_id, list_sum(list_transform(embedding, lambda e: CAST(round(e::DOUBLE * 1000) AS BIGINT)))::BIGINT AS checksum
FROM rows
""")
def chunk_sink_roundtrip(spark, sf_dir):
    """Writes the chunk table, writes half of its chunks again, and reads it."""
    rows = fx.chunk_rows(spark, sf_dir).drop("vec_id", "label")
    path = staging_path(spark, "chunks")
    tables.write_chunks(rows, path)
    tables.write_chunks(rows.where(F.col("shard_id") < fx.NUM_SHARDS // 2), path)
    checksum = F.aggregate(
        "activation", F.lit(0).cast("bigint"),
        lambda total, x: total + F.round(x.cast("double") * 1000).cast("bigint"),
    )
    back = tables.read_chunks(spark, path)
    return wide(back.select("shard_id", "chunk_id", "row_in_chunk", "token_id", checksum.alias("checksum")))


@check("npy_roundtrip", f"""
WITH {fx.ROWS_SQL}
SELECT shard_id, chunk_id, row_in_chunk, token_id, len(embedding) AS width, 'float16' AS dtype,
       list_sum(list_transform(embedding, lambda e: CASE WHEN e = 0 THEN 0 ELSE round_even(
         e::DOUBLE / pow(2.0::DOUBLE, greatest(floor(log2(abs(e::DOUBLE))), -14) - 10), 0)
         * pow(2.0::DOUBLE, greatest(floor(log2(abs(e::DOUBLE))), -14) - 10) END)) AS checksum
FROM rows WHERE shard_id < {fx.NUM_SHARDS}
""")
def npy_roundtrip(spark, sf_dir):
    """Writes the chunks as .npy files and reads both sides back; sums of halves are exact."""
    root = staging_path(spark, "npy")
    npy.write_npy(fx.chunk_rows(spark, sf_dir), root)
    shards = [f"{root}/shard{shard}" for shard in range(fx.NUM_SHARDS)]
    ids = npy.read_npy(spark, shards, "token_ids").drop("dtype", "error")
    both = npy.read_npy(spark, shards).join(ids, ["shard_id", "chunk_id", "row_in_chunk"])
    return wide(both.select(
        "shard_id", "chunk_id", "row_in_chunk", "token_id", F.size("activation").alias("width"), "dtype",
        F.aggregate("activation", F.lit(0.0), lambda total, x: total + x.cast("double")).alias("checksum"),
    ))


@check("half_round", """
WITH v AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
s AS (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(abs(e))), -14) - 10) AS spacing FROM v)
SELECT vec_id, dim, CASE WHEN e = 0 THEN e ELSE round_even(e / spacing, 0) * spacing END AS value FROM s
""")
def half_round(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    values = vectors.select("vec_id", F.posexplode(to_half("embedding")).alias("dim", "value"))
    return wide(values.withColumn("value", F.col("value").cast("double")))


@check("align_pairs", f"""
WITH vectors AS (
  SELECT label AS doc_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, vec_id FROM embeddings),
tokens AS (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT doc_id, {fx.TOKENS_SQL} AS t FROM {fx.DOCS_SQL}))
SELECT CAST(doc_id AS BIGINT) AS doc_id, pos, vec_id, token FROM vectors JOIN tokens USING (doc_id, pos)
""")
def align_pairs(spark, sf_dir):
    """A label's vectors against the words of the document with that id."""
    vectors = fx.prompts(spark, sf_dir).select(
        F.col("prompt_id").cast("bigint").alias("doc_id"), "pos", "vec_id"
    )
    tokens = corpus.flatten_tokens(corpus.tokenize(fx.corpus(spark, sf_dir)))
    return wide(chunking.align_pairs(vectors, tokens))


@check("chunk_catalog", f"""
WITH {fx.ROWS_SQL}, {fx.CATALOG_SQL}
SELECT shard_id, chunk_id, chunk_number, size, CAST(start_idx AS BIGINT) AS start_idx, CAST(end_idx AS BIGINT) AS end_idx
FROM catalog
""")
def chunk_catalog(spark, sf_dir):
    return wide(chunking.chunk_catalog(fx.chunk_rows(spark, sf_dir)))


@check("chunk_catalog_paths", f"""
WITH {fx.ROWS_SQL}, {fx.CATALOG_SQL}
SELECT shard_id, chunk_id, 'shard_id=' || shard_id || '/chunk_id=' || chunk_id AS path, size FROM catalog
""")
def chunk_catalog_paths(spark, sf_dir):
    """The catalog of stored chunks with the file of each."""
    path = staging_path(spark, "chunks")
    tables.write_chunks(fx.chunk_rows(spark, sf_dir).drop("vec_id", "label"), path)
    catalog = chunking.chunk_catalog(tables.read_chunks(spark, path), path=F.col("_metadata.file_path"))
    folder = F.regexp_extract("path", r"(shard_id=\d+/chunk_id=\d+)/[^/]+\.parquet$", 1)
    return wide(catalog.select("shard_id", "chunk_id", folder.alias("path"), "size"))


@check("missing_shards", f"""
WITH {fx.ROWS_SQL} SELECT shard_id, chunk_id, row_in_chunk, token_id FROM rows WHERE shard_id <> 1
""")
def missing_shards(spark, sf_dir):
    """All shards are asked for, one of them was never written; the others are read."""
    path = staging_path(spark, "shards")
    rows = fx.chunk_rows(spark, sf_dir).where("shard_id <> 1").select("shard_id", "chunk_id", "row_in_chunk", "token_id")
    rows.write.partitionBy("shard_id").parquet(path)
    asked = [f"{path}/shard_id={shard}" for shard in range(fx.NUM_SHARDS)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return wide(tables.read_shards(spark, asked).select("shard_id", "chunk_id", "row_in_chunk", "token_id"))


@check("global_index", f"WITH {fx.ROWS_SQL} SELECT vec_id, token_idx FROM rows")
def global_index(spark, sf_dir):
    return fx.activations(spark, sf_dir).select("vec_id", "token_idx")


# Each vector asks for one index; neighbours ask for the same one, the last for none.
ASKED_SQL = "asked AS (SELECT vec_id AS request_id, vec_id // 2 * 37 % (SELECT count(*) + 5 FROM rows) AS token_idx FROM rows)"


def requests(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    n = vectors.count()
    return vectors.select(
        F.col("vec_id").alias("request_id"), F.expr(f"vec_id div 2 * 37 % {n + 5}").alias("token_idx")
    )


@check("lookup_by_index", f"""
WITH {fx.ROWS_SQL}, {ASKED_SQL}
SELECT request_id, token_idx, shard_id, chunk_id, row_in_chunk, token_id FROM asked LEFT JOIN rows USING (token_idx)
""")
def lookup_by_index(spark, sf_dir):
    found = chunking.lookup(
        requests(spark, sf_dir), fx.catalog(spark, sf_dir), fx.chunk_rows(spark, sf_dir), strict=False
    )
    return wide(found)


@check("lookup_batch", f"""
WITH {fx.ROWS_SQL}, asked AS (
  SELECT CAST(label AS BIGINT) AS batch, (vec_id * 31) % (SELECT count(*) FROM rows) AS token_idx,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM rows)
SELECT batch, pos, token_idx, token_id FROM asked JOIN rows USING (token_idx)
""")
def lookup_batch(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings")
    n = vectors.count()
    pairs = F.array_sort(F.collect_list(F.struct("vec_id", F.expr(f"(vec_id * 31) % {n}").alias("idx"))))
    batches = vectors.groupBy(F.col("label").alias("batch")).agg(
        F.transform(pairs, lambda pair: pair["idx"]).alias("indices")
    )
    found = chunking.lookup_batch(batches, fx.catalog(spark, sf_dir), fx.chunk_rows(spark, sf_dir))
    return wide(found.select("batch", "pos", "token_idx", "token_id"))


@check("row_transform", """
SELECT vec_id, list_sum(list_transform(embedding, lambda e: abs(CAST(round(e::DOUBLE * 1000) AS BIGINT))))::BIGINT AS abs_sum
FROM embeddings
""")
def row_transform(spark, sf_dir):
    def scaled(vector):
        return F.transform(vector, lambda x: F.abs(F.round(x.cast("double") * 1000).cast("bigint")))

    rows = split.transform_rows(fx.chunk_rows(spark, sf_dir), scaled)
    return rows.select(
        "vec_id", F.aggregate("activation", F.lit(0).cast("bigint"), lambda t, x: t + x).alias("abs_sum")
    )


@check("dataset_size", f"SELECT count(*) AS n_rows, count(*) * {fx.WIDTH * 2} AS n_bytes FROM embeddings")
def dataset_size(spark, sf_dir):
    return chunking.dataset_size(fx.chunk_rows(spark, sf_dir), fx.WIDTH)


SPLIT_SQL = f"""
{fx.ROWS_SQL},
ranked AS (SELECT token_idx, row_number() OVER (ORDER BY md5('{fx.SEED}:' || token_idx), token_idx) AS split_rank FROM rows),
parts AS (
  SELECT *, CASE WHEN split_rank <= n_train THEN 'train' ELSE 'val' END AS split
  FROM ranked, (SELECT CAST(trunc({TRAIN_SPLIT}::DOUBLE * count(*)) AS BIGINT) AS n_train FROM rows))
"""

BATCHES_SQL = f"""
{SPLIT_SQL},
batches AS (
  SELECT epoch, split, token_idx, split_rank,
         (CASE WHEN split = 'train'
               THEN row_number() OVER (PARTITION BY epoch, split ORDER BY md5(epoch || ':' || token_idx), token_idx)
               ELSE split_rank - n_train END - 1) // {BATCH_SIZE} AS batch_id
  FROM parts, (SELECT unnest({list(EPOCHS)}) AS epoch))
"""


@check("train_val_split", f"WITH {SPLIT_SQL} SELECT token_idx, split_rank, split FROM parts")
def train_val_split(spark, sf_dir):
    rows = fx.activations(spark, sf_dir).select("token_idx")
    return split.train_val_split(rows, TRAIN_SPLIT, seed=fx.SEED).select("token_idx", "split_rank", "split")


@check("epoch_batches", f"WITH {BATCHES_SQL} SELECT CAST(epoch AS BIGINT) AS epoch, split, token_idx, batch_id FROM batches")
def epoch_batches(spark, sf_dir):
    rows = fx.activations(spark, sf_dir).select("token_idx")
    parts = stage(split.train_val_split(rows, TRAIN_SPLIT, seed=fx.SEED), "split")
    first, second = (split.epoch_batches(parts, epoch, BATCH_SIZE) for epoch in EPOCHS)
    return wide(first.unionByName(second).select("epoch", "split", "token_idx", "batch_id"))


# --- run state -----------------------------------------------------------------


@check("metadata_read", f"""
SELECT user_id % {fx.NUM_SHARDS} AS shard_id, CAST({fx.NUM_SHARDS} AS BIGINT) AS num_shards, 1000 * count(*) AS tokens_per_shard,
       CAST(NULL AS BIGINT) AS tokens_collected, 'events' AS dataset
FROM events GROUP BY 1
""")
def metadata_read(spark, sf_dir):
    """Metadata rows written as JSON and read with the fixed schema."""
    events = fx.shard_events(spark, sf_dir)
    rows = events.groupBy("shard_id").agg((F.count("*") * 1000).alias("tokens_per_shard")).select(
        "shard_id",
        F.lit(fx.NUM_SHARDS).alias("num_shards"),
        "tokens_per_shard",
        F.lit("events").alias("dataset"),
    )
    path = staging_path(spark, "metadata")
    state.write_json(rows, path)
    back = state.read_metadata(spark, path)
    return wide(back.select("shard_id", "num_shards", "tokens_per_shard", "tokens_collected", "dataset"))


@check("latest_checkpoint", f"""
WITH {fx.CHECKPOINTS_SQL} SELECT shard_id, tokens_collected, last_chunk_id, examples_seen FROM latest
""")
def latest(spark, sf_dir):
    """Checkpoints appended as JSON; the newest of each shard is read back."""
    path = staging_path(spark, "checkpoints")
    state.append_checkpoints(fx.checkpoints(spark, sf_dir), path)
    newest = latest_checkpoint(state.read_checkpoints(spark, path))
    return wide(newest.select("shard_id", "tokens_collected", "last_chunk_id", "examples_seen"))

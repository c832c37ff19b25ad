"""Inputs derived from the test tables, in Spark and as SQL text.

Integer arithmetic wherever possible, so both engines agree exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_catalog, document_counts, global_index
from ..operators.corpus import shard_documents, shuffle_documents, spread, words
from ..operators.ordering import running
from ..operators.sae import SaeModel, SaeParams
from ..session import stage

NUM_SHARDS = 4
SEED = 42
MAX_LENGTH = 2048
ROWS_PER_CHUNK = 50
WIDTH = 64
VOCABULARY = 5000
LIVE_FEATURES = 256
D_SAE = 260


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpus --------------------------------------------------------------------

# Some texts are blanked: the tables hold no empty text.
DOCS_SQL = "(SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS text FROM documents)"
WORDS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TOKENS_SQL = f"({WORDS_SQL})"
CUT_TOKENS_SQL = f"({WORDS_SQL})[1:{MAX_LENGTH}]"

POSITIONS_SQL = f"""
docs AS MATERIALIZED (
  SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len({TOKENS_SQL}) END AS n_tokens,
         row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS position
  FROM {DOCS_SQL}),
sharded AS MATERIALIZED (
  SELECT doc_id, n_tokens, position, position % {NUM_SHARDS} AS shard_id, position // {NUM_SHARDS} AS pos_in_shard
  FROM docs)
"""

VOCABULARY_SQL = f"""
words AS MATERIALIZED (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos
  FROM (SELECT doc_id, {TOKENS_SQL} AS tokens FROM {DOCS_SQL})),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM words GROUP BY token))
"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.withColumn("text", F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("text")))


def sharded_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with token counts, shuffled and dealt to shards. Text is read once."""
    counted = document_counts(corpus(spark, sf_dir), F.size(words("text")))
    narrow = stage(counted.select("doc_id", "n_tokens"), "counts")
    return shard_documents(shuffle_documents(narrow, seed=SEED), NUM_SHARDS)


# --- activations ---------------------------------------------------------------

ROWS_SQL = f"""
rows AS MATERIALIZED (
  SELECT vec_id, embedding, label, vec_id % {NUM_SHARDS} AS shard_id,
         vec_id // {NUM_SHARDS} // {ROWS_PER_CHUNK} AS chunk_id,
         vec_id // {NUM_SHARDS} % {ROWS_PER_CHUNK} AS row_in_chunk,
         (vec_id * 7919) % {VOCABULARY} AS token_id,
         row_number() OVER (ORDER BY vec_id % {NUM_SHARDS}, vec_id) - 1 AS token_idx
  FROM embeddings)
"""

CATALOG_SQL = """
sizes AS (SELECT shard_id, chunk_id, count(*) AS size FROM rows GROUP BY ALL),
catalog AS (
  SELECT shard_id, chunk_id, row_number() OVER (ORDER BY shard_id, chunk_id) - 1 AS chunk_number, size,
         sum(size) OVER (ORDER BY shard_id, chunk_id) - size AS start_idx,
         sum(size) OVER (ORDER BY shard_id, chunk_id) AS end_idx
  FROM sizes)
"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their shard, chunk, row and token id."""
    row = f"(vec_id div {NUM_SHARDS})"
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding").alias("activation"),
        F.expr(f"CAST(vec_id % {NUM_SHARDS} AS INT)").alias("shard_id"),
        F.expr(f"CAST({row} div {ROWS_PER_CHUNK} AS INT)").alias("chunk_id"),
        F.expr(f"{row} % {ROWS_PER_CHUNK}").alias("row_in_chunk"),
        F.expr(f"CAST((vec_id * 7919) % {VOCABULARY} AS INT)").alias("token_id"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(chunk_catalog(chunk_rows(spark, sf_dir)), "catalog")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows with their global index."""
    return global_index(chunk_rows(spark, sf_dir), catalog(spark, sf_dir))


def quantised(df: DataFrame) -> DataFrame:
    """Vectors scaled to integers, kept as doubles that hold them exactly."""
    scaled = F.transform("activation", lambda x: F.round(x.cast("double") * 1000))
    return df.withColumn("activation", scaled)


def integer_weights(d_sae: int = D_SAE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f, d = np.arange(d_sae)[:, None], np.arange(WIDTH)[None, :]
    w_enc = ((f * 31 + d * 17 + f * d * 13) % 1009) % 97 - 48
    w_dec = ((f * 7 + d * 11 + f * d * 5) % 1009) % 7 - 3
    b_enc = np.where(np.arange(d_sae) < LIVE_FEATURES, -25_000, -1_000_000_000)
    return w_enc.astype(float), b_enc.astype(float), w_dec.astype(float)


def integer_model() -> SaeModel:
    w_enc, b_enc, w_dec = integer_weights()
    return SaeModel(SaeParams(w_enc, b_enc, w_dec, np.zeros(WIDTH), np.zeros(WIDTH), "none"))


def decimal_model(normalize: str = "expected_average_only_in", apply_b_dec: bool = True) -> SaeModel:
    """Small real weights; mean and decoder bias differ from 0."""
    w_enc, _, w_dec = integer_weights(LIVE_FEATURES)
    d = np.arange(WIDTH)
    return SaeModel(SaeParams(
        w_enc / 100, np.full(LIVE_FEATURES, -0.5), w_dec / 10, (d % 5 - 2) / 50, (d % 7 - 3) / 100,
        normalize, apply_b_dec,
    ))


WEIGHTS_SQL = f"""
weights AS MATERIALIZED (
  SELECT f, d, ((f * 31 + d * 17 + f * d * 13) % 1009) % 97 - 48 AS w_enc,
         ((f * 7 + d * 11 + f * d * 5) % 1009) % 7 - 3 AS w_dec
  FROM range({D_SAE}) a(f), range({WIDTH}) b(d))
"""

VALUES_SQL = f"""
vals AS MATERIALIZED (
  SELECT token_idx, label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS d FROM rows),
xs AS MATERIALIZED (SELECT token_idx, label, d, CAST(round(e * 1000) AS BIGINT) AS x FROM vals)
"""

# Every cell of the integer model, zeros included.
CELLS_SQL = f"""
{ROWS_SQL}, {VALUES_SQL}, {WEIGHTS_SQL},
cells AS MATERIALIZED (
  SELECT token_idx, label, f AS feature_id,
         greatest(0, CAST(sum(x * w_enc) AS BIGINT)
                     - CASE WHEN f < {LIVE_FEATURES} THEN 25000 ELSE 1000000000 END) AS act
  FROM xs JOIN weights USING (d) GROUP BY token_idx, label, f)
"""

# Every cell of the decimal model with mean centring and decoder bias.
DECIMAL_SQL = f"""
{ROWS_SQL}, {VALUES_SQL}, {WEIGHTS_SQL},
small AS MATERIALIZED (
  SELECT f, d, w_enc / 100.0::DOUBLE AS w_enc, w_dec / 10.0::DOUBLE AS w_dec FROM weights WHERE f < {LIVE_FEATURES}),
centred AS MATERIALIZED (
  SELECT token_idx, label, d, e, e - (d % 7 - 3) / 100.0::DOUBLE - (d % 5 - 2) / 50.0::DOUBLE AS x FROM vals),
cells AS MATERIALIZED (
  SELECT token_idx, label, f AS feature_id, greatest(0, sum(x * w_enc) - 0.5) AS act
  FROM centred JOIN small USING (d) GROUP BY token_idx, label, f),
rebuilt AS MATERIALIZED (
  SELECT token_idx, d, sum(act * w_dec) + any_value((d % 5 - 2) / 50.0::DOUBLE) AS r
  FROM cells JOIN small ON f = feature_id GROUP BY token_idx, d),
row_metrics AS MATERIALIZED (
  SELECT token_idx, label, l0, act_sum, squared_error
  FROM (SELECT token_idx, label, count(*) FILTER (act > 0) AS l0, sum(act) AS act_sum FROM cells GROUP BY ALL)
  JOIN (SELECT token_idx, sum((r - e) ** 2) AS squared_error FROM rebuilt JOIN vals USING (token_idx, d) GROUP BY ALL)
    USING (token_idx))
"""


# --- run events ----------------------------------------------------------------

CHECKPOINTS_SQL = f"""
checkpoints AS MATERIALIZED (
  SELECT shard_id, 1000 * n AS tokens_collected, n - 1 AS last_chunk_id, ts, n // 5 AS examples_seen
  FROM (SELECT user_id % {NUM_SHARDS} AS shard_id, ts,
               row_number() OVER (PARTITION BY user_id % {NUM_SHARDS} ORDER BY ts, event_id) AS n
        FROM events WHERE event_type = 'purchase')),
latest AS (
  SELECT shard_id, max(tokens_collected) AS tokens_collected, arg_max(last_chunk_id, tokens_collected) AS last_chunk_id,
         arg_max(examples_seen, tokens_collected) AS examples_seen
  FROM checkpoints GROUP BY shard_id)
"""


def shard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumns({
        "shard_id": F.expr(f"CAST(user_id % {NUM_SHARDS} AS INT)"),
        "bucket": F.date_format("ts", "yyyy-MM-dd HH"),
    })


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint per purchase: the n-th of a shard stands for 1,000 n tokens."""
    saves = shard_events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        "shard_id", "ts", "event_id", "bucket"
    )
    counted = running(
        saves, bucket="bucket", order=("ts", "event_id"), by=("shard_id",),
        sums={"n": F.lit(1).cast("bigint")},
    )
    return counted.select(
        "shard_id",
        (F.col("n") * 1000).alias("tokens_collected"),
        (F.col("n") - 1).alias("last_chunk_id"),
        F.col("ts").cast("string").alias("timestamp"),
        F.lit(0).cast("bigint").alias("errors"),
        F.expr("n div 5").alias("examples_seen"),
    )


# --- prompts -------------------------------------------------------------------

PROMPTS_SQL = """
prompts AS (
  SELECT token_idx, CAST(label AS BIGINT) AS prompt_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM rows)
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as prompt tokens: the label is the prompt, places follow ``vec_id``."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("bucket", F.expr("vec_id div 1000"))
    placed = running(
        vectors, bucket="bucket", order=("vec_id",), by=("label",), sums={"pos": F.lit(1).cast("bigint")}
    )
    return placed.select(
        "vec_id",
        F.col("label").alias("prompt_id"),
        (F.col("pos") - 1).alias("pos"),
        F.col("embedding").alias("activation"),
    )

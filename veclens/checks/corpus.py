"""Checks for corpus preparation, token budgets and chunk numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import chunking, corpus, encode
from ..operators.monitor import latest_checkpoint
from ..session import stage
from . import check
from . import fixtures as fx
from .chunks import wide

CHUNK_SIZE = 2500
SMALL_CHUNK = 500
BUDGET = 60_000
MILESTONE = 20_000
RESUME_CHUNK = 1000
ENCODER_WIDTH = 8


@check("corpus_scan", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def corpus_scan(spark, sf_dir):
    docs = corpus.read_corpus(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@check("corpus_shuffle", f"WITH {fx.POSITIONS_SQL} SELECT doc_id, position FROM docs")
def corpus_shuffle(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    return corpus.shuffle_documents(docs, seed=fx.SEED).select("doc_id", "position")


@check("corpus_shard", f"WITH {fx.POSITIONS_SQL} SELECT doc_id, shard_id, pos_in_shard FROM sharded")
def corpus_shard(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    sharded = corpus.shard_documents(corpus.shuffle_documents(docs, seed=fx.SEED), fx.NUM_SHARDS)
    return wide(sharded.select("doc_id", "shard_id", "pos_in_shard"))


@check("corpus_skip", f"""
WITH {fx.POSITIONS_SQL}, {fx.CHECKPOINTS_SQL}
SELECT doc_id, shard_id, pos_in_shard FROM sharded LEFT JOIN latest USING (shard_id)
WHERE pos_in_shard >= coalesce(examples_seen, 0)
""")
def corpus_skip(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    sharded = corpus.shard_documents(corpus.shuffle_documents(docs, seed=fx.SEED), fx.NUM_SHARDS)
    seen = latest_checkpoint(fx.checkpoints(spark, sf_dir))
    return wide(corpus.skip_seen(sharded, seen).select("doc_id", "shard_id", "pos_in_shard"))


@check("text_fallback", "SELECT page_id, length(html) AS n_chars, md5(html) AS text_md5 FROM pages")
def text_fallback(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").withColumnRenamed("html", "content")
    return corpus.with_text(pages).select(
        "page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@check("nonempty_text", f"SELECT doc_id, md5(text) AS text_md5 FROM {fx.DOCS_SQL} WHERE text IS NOT NULL AND text <> ''")
def nonempty_text(spark, sf_dir):
    return corpus.nonempty(fx.corpus(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


@check("tokenize_truncate", f"""
SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5
FROM (SELECT doc_id, {fx.CUT_TOKENS_SQL} AS tokens FROM {fx.DOCS_SQL} WHERE text <> '') WHERE len(tokens) > 0
""")
def tokenize_truncate(spark, sf_dir):
    tokenized = corpus.tokenize(fx.corpus(spark, sf_dir), fx.MAX_LENGTH)
    return tokenized.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


def token_rows(spark, sf_dir):
    return corpus.flatten_tokens(corpus.tokenize(fx.corpus(spark, sf_dir)))


@check("vocabulary", f"WITH {fx.VOCABULARY_SQL} SELECT token, token_id FROM vocabulary")
def vocabulary(spark, sf_dir):
    return wide(corpus.build_vocabulary(token_rows(spark, sf_dir)))


@check("token_flatten", f"""
WITH {fx.VOCABULARY_SQL}
SELECT doc_id, pos, token_id FROM words JOIN vocabulary USING (token)
""")
def token_flatten(spark, sf_dir):
    tokens = token_rows(spark, sf_dir)
    known = stage(corpus.build_vocabulary(tokens), "vocabulary")
    coded = corpus.encode_tokens(tokens, known, -1)
    return coded.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint").alias("token_id"))


RUNNING_SQL = f"""
{fx.POSITIONS_SQL},
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY shard_id ORDER BY pos_in_shard) AS cum_tokens FROM sharded)
"""


@check("running_tokens", f"""
WITH {RUNNING_SQL} SELECT doc_id, shard_id, n_tokens, CAST(cum_tokens AS BIGINT) AS cum_tokens FROM summed
""")
def running_tokens(spark, sf_dir):
    counted = chunking.running_tokens(fx.sharded_corpus(spark, sf_dir))
    return wide(counted.select("doc_id", "shard_id", "n_tokens", "cum_tokens"))


@check("token_budget", f"""
WITH {RUNNING_SQL}
SELECT doc_id, shard_id, CAST(cum_tokens AS BIGINT) AS cum_tokens FROM summed WHERE cum_tokens - n_tokens < {BUDGET}
""")
def token_budget(spark, sf_dir):
    counted = chunking.running_tokens(fx.sharded_corpus(spark, sf_dir))
    return wide(chunking.within_budget(counted, BUDGET).select("doc_id", "shard_id", "cum_tokens"))


@check("progress_milestones", f"""
WITH {RUNNING_SQL}
SELECT doc_id, shard_id, CAST(cum_tokens AS BIGINT) AS cum_tokens,
       round(100.0::DOUBLE * cum_tokens / {BUDGET}, 1) AS pct
FROM summed WHERE n_tokens > 0 AND cum_tokens % {MILESTONE} < {fx.MAX_LENGTH}
""")
def progress_milestones(spark, sf_dir):
    counted = chunking.running_tokens(fx.sharded_corpus(spark, sf_dir))
    hits = chunking.progress_milestones(counted, BUDGET, every=MILESTONE, max_length=fx.MAX_LENGTH)
    return wide(hits.select("doc_id", "shard_id", "cum_tokens", "pct"))


def greedy_sql(chunk_size: int, start: str = "(SELECT NULL::BIGINT AS shard_id, 0 AS tokens_collected, 0 AS next_chunk, 0 AS examples_seen)") -> str:
    """The numbering rule as a walk over the documents, one after the other."""
    return f"""
starts AS (SELECT * FROM {start}),
usable AS MATERIALIZED (
  SELECT sharded.*, coalesce(tokens_collected, 0) AS t0, coalesce(next_chunk, 0) AS c0,
         row_number() OVER (PARTITION BY shard_id ORDER BY pos_in_shard) - 1 AS i
  FROM sharded LEFT JOIN starts USING (shard_id)
  WHERE n_tokens > 0 AND pos_in_shard >= coalesce(examples_seen, 0)),
walk AS (
  SELECT shard_id, i, doc_id, n_tokens, t0 + n_tokens AS total, c0 AS chunk_id FROM usable WHERE i = 0
  UNION ALL
  SELECT u.shard_id, u.i, u.doc_id, u.n_tokens, w.total + u.n_tokens,
         w.chunk_id + CASE WHEN w.total >= (w.chunk_id + 1) * {chunk_size} THEN 1 ELSE 0 END
  FROM walk w JOIN usable u ON u.shard_id = w.shard_id AND u.i = w.i + 1)
"""


def chunk_numbers_sql(chunk_size: int, budget: int | None = None) -> str:
    within = f"WHERE total - n_tokens < {budget}" if budget else ""
    return f"""
WITH RECURSIVE {fx.POSITIONS_SQL}, {greedy_sql(chunk_size)}
SELECT doc_id, shard_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(total AS BIGINT) AS cum_tokens FROM walk {within}
"""


def chunk_numbers(spark, sf_dir, chunk_size, budget=None):
    chunked = chunking.assign_chunks(
        fx.sharded_corpus(spark, sf_dir), chunk_size=chunk_size, tokens_per_shard=budget
    )
    return wide(chunked.select("doc_id", "shard_id", "chunk_id", "cum_tokens"))


@check("assign_chunks", chunk_numbers_sql(CHUNK_SIZE))
def assign_chunks(spark, sf_dir):
    return chunk_numbers(spark, sf_dir, CHUNK_SIZE)


@check("assign_chunks_oversized", chunk_numbers_sql(SMALL_CHUNK))
def assign_chunks_oversized(spark, sf_dir):
    """Documents longer than a chunk leave the numbering behind the totals."""
    return chunk_numbers(spark, sf_dir, SMALL_CHUNK)


@check("resume_plan", f"""
WITH RECURSIVE {fx.POSITIONS_SQL}, {fx.CHECKPOINTS_SQL},
{greedy_sql(RESUME_CHUNK, "(SELECT shard_id, tokens_collected, last_chunk_id + 1 AS next_chunk, examples_seen FROM latest)")}
SELECT doc_id, shard_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(total AS BIGINT) AS cum_tokens FROM walk
""")
def resume_plan(spark, sf_dir):
    latest = latest_checkpoint(fx.checkpoints(spark, sf_dir))
    resume = latest.withColumn("next_chunk", F.col("last_chunk_id") + 1)
    chunked = chunking.assign_chunks(
        fx.sharded_corpus(spark, sf_dir), chunk_size=RESUME_CHUNK, resume=resume
    )
    return wide(chunked.select("doc_id", "shard_id", "chunk_id", "cum_tokens"))


@check("chunk_memory_plan", f"""
WITH RECURSIVE {fx.POSITIONS_SQL}, {greedy_sql(CHUNK_SIZE)}
SELECT shard_id, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
       CAST(sum(n_tokens) AS BIGINT) * {fx.WIDTH} * 2 / 1e9::DOUBLE AS est_gb, sum(n_tokens) > 3000 AS over_limit
FROM walk GROUP BY shard_id, chunk_id
""")
def chunk_memory_plan(spark, sf_dir):
    chunked = chunking.assign_chunks(fx.sharded_corpus(spark, sf_dir), chunk_size=CHUNK_SIZE)
    return wide(chunking.chunk_memory_plan(chunked, fx.WIDTH, max_chunk_tokens=3000))


# --- extraction ----------------------------------------------------------------


def make_encoder():
    """Vectors from token id and place, small integers; some documents fail."""
    import numpy as np

    def encode_documents(documents):
        vectors = []
        for ids in documents:
            if len(ids) % 13 == 0:
                raise ValueError(f"cannot encode {len(ids)} tokens")
            places, dims = np.arange(len(ids))[:, None], np.arange(ENCODER_WIDTH)[None, :]
            vectors.append((ids[:, None].astype(np.int64) * (dims + 3) + places * 7) % 101 - 50)
        return vectors

    return encode_documents


def documents_with_ids(spark, sf_dir):
    tokens = token_rows(spark, sf_dir)
    known = stage(corpus.build_vocabulary(tokens), "vocabulary")
    return stage(corpus.document_ids(tokens, known), "ids")


# The encoder sees windows of MAX_LENGTH tokens.
ENCODER_SUM_SQL = " + ".join(
    f"{d + 1} * ((token_id * {d + 3} + (pos % {fx.MAX_LENGTH}) * 7) % 101 - 50)" for d in range(ENCODER_WIDTH)
)


def weighted_sum():
    """The values of a vector times their places from 1, added in order, as plain sums that Spark compiles."""
    return reduce(
        lambda total, d: total + F.get("activation", F.lit(d)).cast("double") * (d + 1), range(ENCODER_WIDTH), F.lit(0.0)
    )


@check("extract_activations", f"""
WITH {fx.VOCABULARY_SQL},
coded AS (
  SELECT doc_id, pos, token_id, count(*) OVER (PARTITION BY doc_id) % {fx.MAX_LENGTH} AS n
  FROM words JOIN vocabulary USING (token))
SELECT doc_id, pos, token_id, CAST({ENCODER_SUM_SQL} AS DOUBLE) AS weighted_sum FROM coded WHERE n = 0 OR n % 13 <> 0
""")
def extract_activations(spark, sf_dir):
    extracted = encode.extract(documents_with_ids(spark, sf_dir), make_encoder, batch_size=8)
    return encode.encoded_tokens(extracted).select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("token_id").cast("bigint").alias("token_id"),
        weighted_sum().alias("weighted_sum"),
    )


FAILED_SQL = f"""
{fx.POSITIONS_SQL},
failed AS (
  SELECT *, 'cannot encode ' || n_tokens % {fx.MAX_LENGTH} || ' tokens' AS error FROM sharded
  WHERE n_tokens % {fx.MAX_LENGTH} > 0 AND n_tokens % {fx.MAX_LENGTH} % 13 = 0)
"""


@check("error_quarantine", f"WITH {FAILED_SQL} SELECT doc_id, error FROM failed")
def error_quarantine(spark, sf_dir):
    extracted = encode.extract(documents_with_ids(spark, sf_dir), make_encoder, batch_size=8)
    return encode.failed_documents(extracted)


@check("error_warnings", f"""
WITH {FAILED_SQL},
counted AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY pos_in_shard) AS n_errors FROM failed)
SELECT shard_id, doc_id, n_errors, error FROM counted WHERE n_errors % {encode.WARN_EVERY} = 0
""")
def error_warnings(spark, sf_dir):
    extracted = encode.extract(documents_with_ids(spark, sf_dir), make_encoder, batch_size=8)
    places = fx.sharded_corpus(spark, sf_dir).select("doc_id", "shard_id", "bucket", "order_key")
    failed = stage(encode.failed_documents(extracted).join(places, "doc_id"), "failed")
    return wide(encode.error_warnings(failed).select("shard_id", "doc_id", "n_errors", "error"))

"""Checks for the chunk audit and for monitoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import to_half
from ..operators import monitor, verify
from ..session import staging_path
from ..sources import logs, npy, tables
from . import check
from . import fixtures as fx
from .chunks import wide

EXPECTED = 6
NPY_HEADER = 128
WITH_METADATA = (0, 1, 2, 5)
TARGET = 1_000_000

# Faults: (1,0) has no token rows, (2,1) short vectors, (3,1) lacks a token row,
# (3,2) holds a value beyond half precision, (2,0) values that are not rounded;
# shards 4 and 5 have no chunks.
FAULTS_SQL = f"""
{fx.ROWS_SQL},
acts AS (
  SELECT shard_id, chunk_id, count(*) AS act_rows, min(w) AS min_width, max(w) AS max_width,
         bool_and(biggest <= 65504 AND (halves OR NOT (shard_id = 2 AND chunk_id = 0))) AS acts_ok
  FROM (SELECT shard_id, chunk_id, CASE WHEN shard_id = 2 AND chunk_id = 1 THEN 63 ELSE len(embedding) END AS w,
               CASE WHEN shard_id = 3 AND chunk_id = 2 AND row_in_chunk = 0 THEN 70000
                    ELSE list_max(list_transform(embedding, lambda e: abs(e))) END AS biggest,
               len(list_filter(embedding, lambda e: e <> 0 AND e::DOUBLE / pow(2.0::DOUBLE, greatest(floor(log2(abs(e::DOUBLE))), -14) - 10)
                   <> round_even(e::DOUBLE / pow(2.0::DOUBLE, greatest(floor(log2(abs(e::DOUBLE))), -14) - 10), 0))) = 0 AS halves
        FROM rows) GROUP BY ALL),
toks AS (
  SELECT shard_id, chunk_id, count(*) AS tok_rows FROM rows
  WHERE NOT (shard_id = 1 AND chunk_id = 0) AND NOT (shard_id = 3 AND chunk_id = 1 AND row_in_chunk = 7) GROUP BY ALL),
pairs AS (
  SELECT shard_id, chunk_id, act_rows IS NOT NULL AS has_activations, tok_rows IS NOT NULL AS has_token_ids,
         act_rows, tok_rows, min_width, max_width, acts_ok
  FROM acts FULL JOIN toks USING (shard_id, chunk_id)),
checked AS (
  SELECT *, CASE WHEN fatal IS NULL THEN act_rows ELSE 0 END AS n_tokens,
         coalesce(fatal, CASE WHEN NOT acts_ok THEN 'activation values are not half precision' END) AS error
  FROM (SELECT *, CASE WHEN NOT has_activations THEN 'activations missing'
                       WHEN NOT has_token_ids THEN 'token ids missing'
                       WHEN min_width <> {fx.WIDTH} THEN 'width ' || min_width || ', expected {fx.WIDTH}'
                       WHEN act_rows <> tok_rows THEN act_rows || ' vectors, ' || tok_rows || ' token ids' END AS fatal
        FROM pairs)),
known AS (SELECT unnest({list(WITH_METADATA)}) AS shard_id),
presence AS (
  SELECT e.shard_id, k.shard_id IS NOT NULL AS has_metadata,
         count(*) FILTER (has_activations) AS act_chunks, count(*) FILTER (has_token_ids) AS tok_chunks,
         count(error) AS n_errors, CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS total_tokens
  FROM range({EXPECTED}) e(shard_id) LEFT JOIN known k ON k.shard_id = e.shard_id
       LEFT JOIN checked c ON c.shard_id = e.shard_id
  GROUP BY ALL),
report AS (
  SELECT shard_id, problem = '' AS passed, problem, n_errors, total_tokens
  FROM (SELECT *, CASE WHEN NOT has_metadata THEN 'metadata not found' WHEN act_chunks = 0 THEN 'no activation chunks'
                       WHEN act_chunks <> tok_chunks THEN 'chunk counts differ'
                       WHEN n_errors > 0 THEN 'chunk errors' ELSE '' END AS problem FROM presence))
"""


def is_chunk(shard, chunk):
    return (F.col("shard_id") == shard) & (F.col("chunk_id") == chunk)


def faulty(spark, sf_dir):
    """Activation and token rows with the faults above."""
    rows = fx.chunk_rows(spark, sf_dir)
    large = F.transform(F.col("activation"), lambda x: F.lit(70_000.0).cast("float"))
    acts = rows.withColumn(
        "activation",
        F.when(is_chunk(2, 0), F.col("activation"))
        .when(is_chunk(2, 1), F.slice(to_half("activation"), 1, 63))
        .when(is_chunk(3, 2) & (F.col("row_in_chunk") == 0), large)
        .otherwise(to_half("activation")),
    )
    toks = rows.where(~is_chunk(1, 0) & ~(is_chunk(3, 1) & (F.col("row_in_chunk") == 7)))
    return acts, toks


def pairs(spark, sf_dir):
    acts, toks = faulty(spark, sf_dir)
    return verify.pair_chunks(verify.activation_chunks(acts), verify.token_chunks(toks))


def checked(spark, sf_dir):
    return verify.check_chunks(pairs(spark, sf_dir), fx.WIDTH)


def expected(spark):
    return spark.range(EXPECTED).select(F.col("id").cast("int").alias("shard_id"))


def metadata(spark):
    known = expected(spark).where(F.col("shard_id").isin(*WITH_METADATA))
    return known.withColumn("tokens_per_shard", F.lit(TARGET).cast("bigint"))


@check("chunk_pairing", f"WITH {FAULTS_SQL} SELECT shard_id, chunk_id, has_activations, has_token_ids FROM pairs")
def chunk_pairing(spark, sf_dir):
    return wide(pairs(spark, sf_dir).select("shard_id", "chunk_id", "has_activations", "has_token_ids"))


@check("verify_width", f"WITH {FAULTS_SQL} SELECT shard_id, chunk_id, min_width, max_width FROM acts")
def verify_width(spark, sf_dir):
    acts, _ = faulty(spark, sf_dir)
    return wide(verify.activation_chunks(acts).select("shard_id", "chunk_id", "min_width", "max_width"))


@check("verify_row_counts", f"WITH {FAULTS_SQL} SELECT shard_id, chunk_id, act_rows, tok_rows FROM pairs")
def verify_row_counts(spark, sf_dir):
    return wide(pairs(spark, sf_dir).select("shard_id", "chunk_id", "act_rows", "tok_rows"))


@check("verify_types", f"WITH {FAULTS_SQL} SELECT shard_id, chunk_id, acts_ok FROM acts")
def verify_types(spark, sf_dir):
    acts, _ = faulty(spark, sf_dir)
    return wide(verify.activation_chunks(acts).select("shard_id", "chunk_id", "acts_ok"))


@check("verify_errors", f"WITH {FAULTS_SQL} SELECT shard_id, chunk_id, error FROM checked WHERE error IS NOT NULL")
def verify_errors(spark, sf_dir):
    return wide(verify.chunk_errors(checked(spark, sf_dir)))


@check("verify_presence", f"WITH {FAULTS_SQL} SELECT shard_id, has_metadata, act_chunks, tok_chunks FROM presence")
def verify_presence(spark, sf_dir):
    return wide(verify.shard_presence(expected(spark), metadata(spark), checked(spark, sf_dir)))


@check("verify_chunk_counts", f"""
WITH {FAULTS_SQL}
SELECT shard_id, act_chunks, tok_chunks, act_chunks > 0 AS has_chunks, act_chunks = tok_chunks AS counts_match FROM presence
""")
def verify_chunk_counts(spark, sf_dir):
    present = verify.shard_presence(expected(spark), metadata(spark), checked(spark, sf_dir))
    return wide(verify.chunk_counts(present).drop("has_metadata"))


@check("verify_totals", f"""
WITH {FAULTS_SQL}
SELECT shard_id, total_tokens, total_tokens * {fx.WIDTH * 2} / 1e9::DOUBLE AS activation_gb,
       total_tokens * 4 / 1e6::DOUBLE AS token_mb
FROM (SELECT shard_id, CAST(sum(n_tokens) AS BIGINT) AS total_tokens FROM checked GROUP BY shard_id)
""")
def verify_totals(spark, sf_dir):
    return wide(verify.totals(checked(spark, sf_dir), fx.WIDTH))


@check("verify_report", f"WITH {FAULTS_SQL} SELECT shard_id, passed, problem, n_errors, total_tokens FROM report")
def verify_report(spark, sf_dir):
    return wide(verify.report(expected(spark), metadata(spark), checked(spark, sf_dir)))


@check("verify_overall", f"WITH {FAULTS_SQL} SELECT bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS n_failed FROM report")
def verify_overall(spark, sf_dir):
    return verify.overall(verify.report(expected(spark), metadata(spark), checked(spark, sf_dir)))


@check("verify_clean", f"""
WITH {fx.ROWS_SQL}
SELECT shard_id, true AS passed, '' AS problem, CAST(0 AS BIGINT) AS n_errors, count(*) AS total_tokens FROM rows GROUP BY shard_id
""")
def verify_clean(spark, sf_dir):
    """The whole audit on chunks without faults."""
    rows = fx.chunk_rows(spark, sf_dir).withColumn("activation", to_half("activation"))
    shards = rows.select("shard_id").distinct()
    return wide(verify.verify(rows, rows, shards, fx.WIDTH, fx.NUM_SHARDS))


def damaged(spark, sf_dir):
    """Chunk files of the rows, of which shard 1 and 2 have wrong ones on either side."""
    root = staging_path(spark, "npy")
    npy.write_npy(fx.chunk_rows(spark, sf_dir), root)
    for shard, kind, fault in (
        (1, "activations", "type"), (1, "token_ids", "rank"), (2, "activations", "rank"), (2, "token_ids", "type"),
        (3, "activations", "content"), (3, "token_ids", "content"),
    ):
        chunk = 0 if kind == "activations" else 1
        file = npy.local_path(root) / f"shard{shard}" / kind / f"chunk_{chunk:04d}.npy"
        values = np.load(file)
        if fault == "type":
            np.save(file, values.astype(np.float64 if kind == "activations" else np.int64))
        elif fault == "rank":
            np.save(file, values[..., None])
        else:
            file.write_bytes(b"not an array")
    return [f"{root}/shard{shard}" for shard in range(fx.NUM_SHARDS)]


@check("verify_files", f"""
WITH {fx.ROWS_SQL}, chunks AS (
  SELECT shard_id, chunk_id, count(*) AS n, CASE
    WHEN shard_id = 1 AND chunk_id = 0 THEN 'activations are float64, expected float16'
    WHEN shard_id = 1 AND chunk_id = 1 THEN 'error loading: expected 1D, got 2D'
    WHEN shard_id = 2 AND chunk_id = 0 THEN 'error loading: expected 2D, got 3D'
    WHEN shard_id = 2 AND chunk_id = 1 THEN 'token ids are int64, expected int32'
    WHEN shard_id = 3 AND chunk_id <= 1 THEN 'error loading' END AS error
  FROM rows GROUP BY ALL)
SELECT shard_id, chunk_id, coalesce(error, '') AS error,
       CASE WHEN error LIKE 'error loading%' THEN 0 ELSE n END AS n_tokens FROM chunks
""")
def verify_files(spark, sf_dir):
    """The audit on chunk files of wrong type, wrong rank and unreadable content, on both sides."""
    shards = damaged(spark, sf_dir)
    acts = verify.activation_chunks(npy.read_npy(spark, shards), "error", "dtype")
    toks = verify.token_chunks(npy.read_npy(spark, shards, "token_ids"), "error", "dtype")
    found = verify.check_chunks(verify.pair_chunks(acts, toks), fx.WIDTH)
    # what numpy says about content that is no array is its own
    error = F.coalesce(F.when(F.col("shard_id") == 3, F.regexp_extract("error", "^error loading", 0)).otherwise(F.col("error")), F.lit(""))
    return wide(found.select("shard_id", "chunk_id", error.alias("error"), "n_tokens"))


# --- monitoring ----------------------------------------------------------------


@check("shard_status", f"""
WITH {fx.CHECKPOINTS_SQL}, joined AS (
  SELECT s.shard_id, tokens_collected, last_chunk_id, k.shard_id IS NOT NULL AS known,
         CASE WHEN k.shard_id IS NOT NULL THEN CAST({TARGET} AS BIGINT) END AS target
  FROM range({EXPECTED}) s(shard_id) LEFT JOIN latest l ON l.shard_id = s.shard_id
       LEFT JOIN (SELECT unnest({list(WITH_METADATA)}) AS shard_id) k ON k.shard_id = s.shard_id)
SELECT shard_id, tokens_collected, target, last_chunk_id, round(100.0::DOUBLE * tokens_collected / target, 1) AS pct,
       CASE WHEN tokens_collected IS NOT NULL AND known THEN 'collecting'
            WHEN tokens_collected IS NOT NULL THEN 'collecting, no target'
            WHEN known THEN 'starting up' ELSE 'not started' END AS state,
       'Shard ' || shard_id || ': ' || CASE
         WHEN tokens_collected IS NOT NULL AND known
           THEN format('{{:,}}', tokens_collected) || ' / ' || format('{{:,}}', target) || ' tokens ('
                || printf('%.1f', round(100.0::DOUBLE * tokens_collected / target, 1)) || '%) - Chunk ' || last_chunk_id
         WHEN tokens_collected IS NOT NULL THEN format('{{:,}}', tokens_collected) || ' tokens - Chunk ' || last_chunk_id
         WHEN known THEN 'Starting up...' ELSE 'Not started' END AS status
FROM joined
""")
def shard_status(spark, sf_dir):
    latest = monitor.latest_checkpoint(fx.checkpoints(spark, sf_dir))
    return wide(monitor.shard_status(spark, EXPECTED, metadata(spark), latest))


LINES_SQL = f"""
lines AS (SELECT user_id % {fx.NUM_SHARDS} AS shard_id, event_id AS line_no, upper(event_type) || ' ' || event_id || '  ' AS line
          FROM events),
problems AS (SELECT * FROM lines WHERE regexp_matches(lower(line), '{"|".join(monitor.ERROR_WORDS)}'))
"""


def log_lines(spark, sf_dir):
    """Events as log lines; some end in blanks."""
    line = F.concat(F.upper("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit("  "))
    return fx.shard_events(spark, sf_dir).select("shard_id", F.col("event_id").alias("line_no"), line.alias("line"))


@check("error_tail", f"""
WITH {LINES_SQL}
SELECT shard_id, line_no, rtrim(line) AS line FROM problems
QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY line_no DESC) <= {monitor.TAIL}
""")
def error_tail(spark, sf_dir):
    return wide(monitor.error_tail(log_lines(spark, sf_dir)))


TAIL_SQL = f"""
WITH {LINES_SQL}
SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY line_no DESC) AS from_end, rtrim(line) AS line FROM problems
QUALIFY from_end <= {monitor.TAIL}
"""


def log_folder(spark, sf_dir):
    """The events as shard log files."""
    path = staging_path(spark, "shard-logs")
    logs.write_logs(log_lines(spark, sf_dir), path)
    return path


@check("error_tail_logs", TAIL_SQL)
def error_tail_logs(spark, sf_dir):
    """The last problems of shard logs that many tasks read in blocks."""
    tail = monitor.error_tail(logs.read_logs(spark, log_folder(spark, sf_dir), block_bytes=256 << 10))
    newest = Window.partitionBy("shard_id").orderBy(F.desc("line_no"))  # a few lines per shard
    return wide(tail.select("shard_id", F.row_number().over(newest).alias("from_end"), "line"))


@check("log_tail", TAIL_SQL)
def log_tail(spark, sf_dir):
    """The same from the ends of the files, which are read backward until enough is found."""
    return wide(logs.log_tail(spark, log_folder(spark, sf_dir)).select("shard_id", "from_end", "line"))


@check("log_lines", f"""
WITH {LINES_SQL}
SELECT shard_id, row_number() OVER (PARTITION BY shard_id ORDER BY line_no) - 1 AS line_no, line FROM lines
""")
def numbered_log_lines(spark, sf_dir):
    """Every line of the logs with its number in the file."""
    return wide(logs.read_logs(spark, log_folder(spark, sf_dir), block_bytes=256 << 10))


@check("any_errors", f"WITH {LINES_SQL} SELECT count(*) > 0 AS any_errors FROM problems")
def any_errors(spark, sf_dir):
    return monitor.any_errors(log_lines(spark, sf_dir))


@check("shard_bytes", f"""
WITH {fx.ROWS_SQL}, sizes AS (
  SELECT shard_id, CAST(count(*) * {fx.WIDTH * 2 + 4} + count(DISTINCT chunk_id) * {2 * NPY_HEADER} AS BIGINT) AS n_bytes,
         CAST(count(DISTINCT chunk_id) * 2 AS BIGINT) AS n_files, 'shard' AS scope
  FROM rows GROUP BY shard_id),
every AS (
  SELECT * FROM sizes
  UNION ALL SELECT NULL, CAST(sum(n_bytes) AS BIGINT), CAST(sum(n_files) AS BIGINT), 'total' FROM sizes)
SELECT *, CASE WHEN n_bytes < 1024 THEN format('{{:,.2f}} B', n_bytes::DOUBLE)
               WHEN n_bytes < 1048576 THEN format('{{:,.2f}} KB', n_bytes::DOUBLE / 1024)
               WHEN n_bytes < 1073741824 THEN format('{{:,.2f}} MB', n_bytes::DOUBLE / 1048576)
               ELSE format('{{:,.2f}} GB', n_bytes::DOUBLE / 1073741824) END AS size
FROM every
""")
def shard_bytes(spark, sf_dir):
    """Sizes of .npy chunk files: a header, two bytes a value and four an id."""
    root = staging_path(spark, "sizes")
    npy.write_npy(fx.chunk_rows(spark, sf_dir), root)
    return wide(monitor.shard_bytes(tables.file_sizes(spark, root)))


@check("human_readable_size", """
SELECT event_id, CASE WHEN n < 1024 THEN format('{:,.2f} B', n) WHEN n < 1048576 THEN format('{:,.2f} KB', n / 1024)
  WHEN n < 1073741824 THEN format('{:,.2f} MB', n / 1048576) ELSE format('{:,.2f} GB', n / 1073741824) END AS size
FROM (SELECT event_id, (event_id * event_id * 997 % 3000000000)::DOUBLE AS n FROM events)
""")
def human_readable_size(spark, sf_dir):
    from ..functions.text import human_readable_size as shown

    size = F.expr("event_id * event_id * 997 % 3000000000")
    return fx.table(spark, sf_dir, "events").select("event_id", shown(size).alias("size"))


@check("best_epoch", """
WITH history AS (
  SELECT CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) + 1 AS epoch,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS val_loss
  FROM events GROUP BY 1)
SELECT arg_min(epoch, (val_loss, epoch)) AS epoch, min(val_loss) AS val_loss FROM history
""")
def best_epoch(spark, sf_dir):
    """Days as epochs and mean event values as losses."""
    from ..plans.train import best_epoch as best

    events = fx.table(spark, sf_dir, "events")
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    history = events.groupBy(F.datediff(F.to_date("ts"), F.lit(first)).alias("day")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count("*")).alias("recon_loss")
    )
    return wide(best(history.select((F.col("day") + 1).alias("epoch"), F.lit("val").alias("split"), "recon_loss")))

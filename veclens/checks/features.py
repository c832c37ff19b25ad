"""Checks for the sparse autoencoder, feature reports and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import corpus, interpret, prompts, sae
from ..operators.split import epoch_batches, train_val_split
from ..plans.train import gradient_rows
from ..session import stage, staging_path
from . import check
from . import fixtures as fx
from .chunks import BATCH_SIZE, BATCHES_SQL, TRAIN_SPLIT, wide

FEATURE = 17
START_FEATURES = 128
L1_COEFF = 1e-3
MOMENTUM = 0.01


def whole(df, *names):
    """Exact integer results held as doubles, as BIGINT."""
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})


def rounded(df, *names, places=6):
    """Rounded, with -0.0 as 0.0."""
    return df.withColumns({name: F.round(name, places) + F.lit(0.0) for name in names})


def integer_rows(spark, sf_dir):
    return fx.quantised(fx.activations(spark, sf_dir))


def integer_prompts(spark, sf_dir):
    return fx.quantised(fx.prompts(spark, sf_dir))


# --- encode and decode ---------------------------------------------------------


@check("sae_encode", f"WITH {fx.CELLS_SQL} SELECT token_idx, feature_id, act FROM cells WHERE act > 0")
def sae_encode(spark, sf_dir):
    cells = fx.integer_model().cells(integer_rows(spark, sf_dir), ["token_idx"])
    return wide(whole(cells, "act"))


@check("sae_decode", f"""
WITH {fx.CELLS_SQL}
SELECT token_idx, d AS dim, CAST(sum(act // 1000 * w_dec) AS BIGINT) AS value
FROM cells JOIN weights ON f = feature_id GROUP BY token_idx, d
""")
def sae_decode(spark, sf_dir):
    model = fx.integer_model()
    encoded = model.encode(integer_rows(spark, sf_dir), ["token_idx"])
    scaled = encoded.withColumn("features", F.transform("features", lambda f: F.struct(
        f["feature_id"].alias("feature_id"), F.floor(f["act"] / 1000).cast("double").alias("act")
    )))
    rebuilt = model.decode(scaled, ["token_idx"])
    values = rebuilt.select("token_idx", F.posexplode("reconstruction").alias("dim", "value"))
    return wide(whole(values, "value"))


@check("active_features", f"""
WITH {fx.CELLS_SQL}
SELECT token_idx, string_agg(feature_id::VARCHAR, ',' ORDER BY feature_id) AS active, count(*) AS n_active
FROM cells WHERE act > 0 GROUP BY token_idx
""")
def active_features(spark, sf_dir):
    encoded = fx.integer_model().encode(integer_rows(spark, sf_dir), ["token_idx"])
    listed = sae.active_features(encoded).where(F.col("n_active") > 0)
    return wide(listed.select(
        "token_idx", F.array_join(F.col("active").cast("array<string>"), ",").alias("active"), "n_active"
    ))


@check("sae_transform", f"""
WITH {fx.DECIMAL_SQL}
SELECT token_idx, l0 AS n_active, round(act_sum, 6) + 0.0 AS act_sum, round(r_sum, 6) + 0.0 AS r_sum
FROM row_metrics JOIN (SELECT token_idx, sum(r * (d + 1)) AS r_sum FROM rebuilt GROUP BY ALL) USING (token_idx)
""")
def sae_transform(spark, sf_dir):
    rows = fx.activations(spark, sf_dir).select("token_idx", "activation")
    transformed = fx.decimal_model().transform(rows)
    terms = F.zip_with("reconstruction", F.sequence(F.lit(1), F.size("reconstruction")), lambda r, d: r * d)
    result = transformed.select(
        "token_idx",
        F.size("features").alias("n_active"),
        vectors.total(F.transform("features", lambda f: f["act"])).alias("act_sum"),
        vectors.total(terms).alias("r_sum"),
    )
    return wide(rounded(result, "act_sum", "r_sum"))


@check("sae_save_load", f"WITH {fx.CELLS_SQL} SELECT token_idx, feature_id, act FROM cells WHERE act > 0")
def sae_save_load(spark, sf_dir):
    """Cells from a model that was saved, and loaded as a table in shared storage."""
    path = staging_path(spark, "model")
    fx.integer_model().save(path)
    model = sae.SaeModel.load(path, spark, driver_limit=0)
    return wide(whole(model.cells(integer_rows(spark, sf_dir), ["token_idx"]), "act"))


@check("sae_fit_step", f"""
WITH {fx.DECIMAL_SQL},
n AS (SELECT count(*) AS n FROM rows),
errors AS (SELECT token_idx, d, 2 * (r - e) / ((SELECT n FROM n) * {fx.WIDTH}) AS g FROM rebuilt JOIN vals USING (token_idx, d)),
pulls AS (
  SELECT c.token_idx, c.feature_id, any_value(c.act) AS act,
         sum(g * w_dec) + {L1_COEFF}::DOUBLE / ((SELECT n FROM n) * {fx.LIVE_FEATURES}) AS pull
  FROM cells c JOIN small ON f = feature_id JOIN errors USING (token_idx, d)
  WHERE c.act > 0 GROUP BY c.token_idx, c.feature_id)
SELECT feature_id, d AS dim, round(1000 * sum(pull * x), 6) + 0.0 AS w_enc, round(1000 * sum(act * g), 6) + 0.0 AS w_dec,
       round(1000 * sum(pull), 6) + 0.0 AS b_enc
FROM pulls JOIN centred USING (token_idx) JOIN errors USING (token_idx, d) GROUP BY feature_id, d
""")
def sae_fit_step(spark, sf_dir):
    """Gradients of one step with all vectors as its batch, in thousandths."""
    rows = fx.activations(spark, sf_dir)
    params = fx.decimal_model().parameters
    summed = gradient_rows(rows, params, rows.count(), L1_COEFF).where(F.col("feature_id") >= 0)
    thousand = F.transform("gradient", lambda g: g * 1000)
    placed = summed.withColumn("gradient", thousand).select(
        "feature_id",
        F.get("gradient", F.lit(fx.WIDTH)).alias("b_enc"),
        F.posexplode(F.arrays_zip(
            F.slice("gradient", 1, fx.WIDTH).alias("w_enc"), F.slice("gradient", fx.WIDTH + 2, fx.WIDTH).alias("w_dec")
        )).alias("dim", "pair"),
    )
    return wide(rounded(
        placed.select("feature_id", "dim", "pair.w_enc", "pair.w_dec", "b_enc"), "w_enc", "w_dec", "b_enc"
    ))


@check("sparsity_metrics", f"""
WITH {fx.CELLS_SQL}
SELECT count(*) FILTER (act > 0) / count(DISTINCT token_idx) AS l0,
       CAST(sum(act) AS DOUBLE) / (count(DISTINCT token_idx) * {fx.D_SAE}) AS l1_mean,
       count(DISTINCT feature_id) FILTER (act > 0) / {fx.D_SAE} AS frac_active
FROM cells
""")
def sparsity_metrics(spark, sf_dir):
    return sae.sparsity_metrics(fx.integer_model(), integer_rows(spark, sf_dir))


@check("recon_mse", f"WITH {fx.DECIMAL_SQL} SELECT round(sum(squared_error) / (count(*) * {fx.WIDTH}), 6) AS recon_mse FROM row_metrics")
def recon_mse(spark, sf_dir):
    metrics = fx.decimal_model().row_metrics(fx.activations(spark, sf_dir), ["token_idx"])
    return rounded(metrics.agg((F.avg("squared_error") / fx.WIDTH).alias("recon_mse")), "recon_mse")


BATCH_METRICS_SQL = f"""
{fx.DECIMAL_SQL}, {BATCHES_SQL.replace(fx.ROWS_SQL + ",", "")},
per_batch AS (
  SELECT epoch, split, batch_id, avg(squared_error) / {fx.WIDTH} AS recon_loss,
         avg(act_sum) / {fx.LIVE_FEATURES} AS l1_loss, avg(l0) AS l0
  FROM batches JOIN row_metrics USING (token_idx) WHERE epoch = 1 GROUP BY ALL)
"""


def batch_rows(spark, sf_dir):
    """Vectors of one epoch with split and batch."""
    rows = fx.activations(spark, sf_dir)
    index = stage(rows.select("token_idx"), "index")
    batches = epoch_batches(train_val_split(index, TRAIN_SPLIT, seed=fx.SEED), 1, BATCH_SIZE)
    return rows.join(batches.select("token_idx", "split", "batch_id"), "token_idx")


def per_batch(spark, sf_dir):
    metrics = fx.decimal_model().row_metrics(batch_rows(spark, sf_dir), ["split", "batch_id"])
    return sae.batch_metrics(metrics, fx.WIDTH, fx.LIVE_FEATURES, by=("split", "batch_id"))


@check("sae_loss", f"""
WITH {BATCH_METRICS_SQL}
SELECT split, batch_id, round(recon_loss, 6) AS recon_loss, round(l1_loss, 6) AS l1_loss, round(l0, 6) AS l0,
       round(recon_loss + {L1_COEFF}::DOUBLE * l1_loss, 6) AS loss
FROM per_batch
""")
def sae_loss(spark, sf_dir):
    return rounded(sae.with_loss(per_batch(spark, sf_dir), L1_COEFF), "recon_loss", "l1_loss", "l0", "loss")


@check("epoch_metrics", f"""
WITH {BATCH_METRICS_SQL}
SELECT split, round(avg(recon_loss), 6) AS recon_loss, round(avg(l1_loss), 6) AS l1_loss, round(avg(l0), 6) AS l0
FROM per_batch GROUP BY split
""")
def epoch_metrics(spark, sf_dir):
    return rounded(sae.epoch_metrics(per_batch(spark, sf_dir), by=("split",)), "recon_loss", "l1_loss", "l0")


@check("activation_mean_ema", f"""
WITH {BATCHES_SQL}, {fx.VALUES_SQL},
means AS (
  SELECT batch_id, d, avg(e) AS m, max(batch_id) OVER () AS last_batch
  FROM batches JOIN vals USING (token_idx) WHERE epoch = 1 AND split = 'train' GROUP BY batch_id, d)
SELECT d AS dim, round(sum(m * pow(1 - {MOMENTUM}::DOUBLE, last_batch - batch_id)
                           * CASE WHEN batch_id = 0 THEN 1 ELSE {MOMENTUM}::DOUBLE END), 6) + 0.0 AS value
FROM means GROUP BY d
""")
def activation_mean_ema(spark, sf_dir):
    train = batch_rows(spark, sf_dir).where(F.col("split") == "train")
    mean = sae.running_mean(sae.mean_by_batch(train), MOMENTUM)
    values = mean.select(F.posexplode("activation_mean").alias("dim", "value"))
    return wide(rounded(values, "value"))


# --- vector expressions --------------------------------------------------------


def dimensions(df, column):
    """Long form of a vector column, rounded."""
    return wide(rounded(df.select("vec_id", F.posexplode(column).alias("dim", "value")), "value"))


LONG_SQL = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@check("center_mean", f"""
WITH {LONG_SQL}, m AS (SELECT dim, avg(e) AS mean FROM v GROUP BY dim)
SELECT vec_id, dim, round(e - mean, 6) + 0.0 AS value FROM v JOIN m USING (dim)
""")
def center_mean(spark, sf_dir):
    """Centres by the mean of all vectors, given to the model as its running mean."""
    rows = fx.table(spark, sf_dir, "embeddings")
    mean = sae.mean_by_batch(rows.withColumn("batch_id", F.lit(0)), "embedding").first()["batch_mean"]
    centred = vectors.subtract(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, mean)))
    return dimensions(rows.withColumn("centred", centred), "centred")


@check("layer_norm", f"""
WITH {LONG_SQL}, m AS (SELECT vec_id, avg(e) AS mean, var_pop(e) AS var FROM v GROUP BY vec_id)
SELECT vec_id, dim, round((e - mean) / sqrt(var + 1e-5::DOUBLE), 6) + 0.0 AS value FROM v JOIN m USING (vec_id)
""")
def layer_norm(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    return dimensions(rows.withColumn("normed", vectors.layer_norm(F.col("embedding").cast("array<double>"))), "normed")


@check("apply_b_dec", f"WITH {LONG_SQL} SELECT vec_id, dim, round(e - (dim % 5 - 2) / 50.0::DOUBLE, 6) + 0.0 AS value FROM v")
def apply_b_dec(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    bias = F.array(*[F.lit(float(b)) for b in fx.decimal_model().parameters.b_dec])
    return dimensions(
        rows.withColumn("shifted", vectors.subtract(F.col("embedding").cast("array<double>"), bias)), "shifted"
    )


@check("normalize_decoder", f"""
WITH {LONG_SQL}, n AS (SELECT vec_id, sqrt(sum(e * e)) AS norm FROM v GROUP BY vec_id)
SELECT vec_id, dim, round(e / greatest(norm, 1e-12::DOUBLE), 6) + 0.0 AS value FROM v JOIN n USING (vec_id)
""")
def normalize_decoder(spark, sf_dir):
    """Every vector of the table as a decoder row."""
    rows = fx.table(spark, sf_dir, "embeddings")
    return dimensions(rows.withColumn("unit", vectors.unit(F.col("embedding").cast("array<double>"))), "unit")


@check("decoder_norms", """
SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda e: pow(round(e::DOUBLE * 1000), 2)))) AS norm FROM embeddings
""")
def decoder_norms(spark, sf_dir):
    rows = fx.quantised(fx.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "activation"))
    return rows.select("vec_id", vectors.norm("activation").alias("norm"))


@check("sae_init", f"""
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
w AS (
  SELECT f, d, (('0x' || substr(md5('{fx.SEED}:' || f || ':' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1)
               * sqrt(6.0::DOUBLE / {fx.WIDTH}) AS w
  FROM range({START_FEATURES}) a(f), range({fx.WIDTH}) b(d)),
acts AS (SELECT vec_id, f, greatest(0, sum(e * w)) AS act FROM v JOIN w USING (d) GROUP BY vec_id, f),
norms AS (SELECT f, sqrt(sum(w * w)) AS norm FROM w GROUP BY f)
SELECT f AS feature_id, round(sum(act), 6) AS sum_act, round(sum(act) / any_value(norm), 6) AS decoded_act
FROM acts JOIN norms USING (f) GROUP BY f
""")
def sae_init(spark, sf_dir):
    """All vectors through a freshly initialised model."""
    rows = fx.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "activation")
    weights = stage(sae.initial_weights(spark, fx.WIDTH, START_FEATURES, fx.SEED), "weights")
    params = sae.params_from_rows(weights, fx.WIDTH, START_FEATURES, normalize_activations="none")
    sums = sae.SaeModel(params).feature_partials(rows).groupBy("feature_id").agg(F.sum("sum_act").alias("sum_act"))
    lengths = weights.select("feature_id", (F.get("w_dec", F.lit(0)) / F.get("w_enc", F.lit(0))).alias("ratio"))
    joined = sums.join(lengths, "feature_id").select(
        "feature_id", "sum_act", (F.col("sum_act") * F.col("ratio")).alias("decoded_act")
    )
    return wide(rounded(joined, "sum_act", "decoded_act"))


# --- interpretation ------------------------------------------------------------

STATS_SQL = f"""
{fx.CELLS_SQL},
stats AS (
  SELECT feature_id, CAST(max(act) AS BIGINT) AS max_act, CAST(sum(act) AS DOUBLE) / count(*) AS mean_act,
         count(*) FILTER (act > 0) / count(*) AS frequency, count(*) AS n_samples
  FROM cells GROUP BY feature_id)
"""
SAMPLE = 150


def statistics(spark, sf_dir):
    return interpret.feature_statistics(fx.integer_model(), integer_rows(spark, sf_dir))


@check("feature_statistics", f"WITH {STATS_SQL} SELECT feature_id, max_act, mean_act, frequency, n_samples FROM stats")
def feature_statistics(spark, sf_dir):
    return wide(whole(statistics(spark, sf_dir), "max_act"))


@check("feature_statistics_sample", f"""
WITH {STATS_SQL.replace("FROM cells GROUP BY", f"FROM cells WHERE token_idx < {SAMPLE} GROUP BY")}
SELECT feature_id, max_act, mean_act, frequency, n_samples FROM stats
""")
def feature_statistics_sample(spark, sf_dir):
    """The same over the first vectors only, as the caller asks."""
    stats = interpret.feature_statistics(fx.integer_model(), integer_rows(spark, sf_dir), SAMPLE)
    return wide(whole(stats, "max_act"))


def leaders_sql(by: str) -> str:
    return f"""
WITH {STATS_SQL}
SELECT row_number() OVER (ORDER BY {by} DESC, feature_id) AS rank, feature_id, max_act, mean_act, frequency, n_samples
FROM stats ORDER BY rank LIMIT {interpret.LEADERS}
"""


@check("leaderboard_max", leaders_sql("max_act"))
def leaderboard_max(spark, sf_dir):
    return wide(whole(interpret.leaderboard(statistics(spark, sf_dir), "max_act"), "max_act"))


@check("leaderboard_freq", leaders_sql("frequency"))
def leaderboard_freq(spark, sf_dir):
    return wide(whole(interpret.leaderboard(statistics(spark, sf_dir), "frequency"), "max_act"))


VOCAB_SQL = "CASE WHEN token_id < 4000 THEN 'w' || token_id ELSE '<token_id=' || token_id || '>' END"


def known_tokens(spark, sf_dir):
    """Texts of the token ids under 4,000 that occur in the table."""
    ids = fx.chunk_rows(spark, sf_dir).select("token_id").where(F.col("token_id") < 4000).distinct()
    return ids.withColumn("token", F.concat(F.lit("w"), F.col("token_id").cast("string")))


@check("topk_feature", f"""
WITH {fx.CELLS_SQL}, top AS (
  SELECT token_idx, feature_id, act, row_number() OVER (ORDER BY act DESC, token_idx) AS rank
  FROM cells WHERE feature_id = {FEATURE} AND act > 0)
SELECT rank, top.feature_id, act, top.token_idx, token_id, {VOCAB_SQL} AS token
FROM top JOIN rows USING (token_idx) WHERE rank <= {interpret.TOP_K}
""")
def topk_feature(spark, sf_dir):
    described = interpret.describe_feature(
        fx.integer_model(), integer_rows(spark, sf_dir), known_tokens(spark, sf_dir), FEATURE
    )
    return wide(whole(described, "act"))


TOPK_SQL = f"""
{fx.CELLS_SQL}, top AS (
  SELECT feature_id, token_idx, act, row_number() OVER (PARTITION BY feature_id ORDER BY act DESC, token_idx) AS rank
  FROM cells WHERE act > 0 QUALIFY rank <= {interpret.TOP_K})
"""


@check("topk_all_features", f"WITH {TOPK_SQL} SELECT feature_id, rank, token_idx, act FROM top")
def topk_all_features(spark, sf_dir):
    top = interpret.top_tokens(fx.integer_model(), integer_rows(spark, sf_dir))
    return wide(whole(top, "act")).select("feature_id", "rank", "token_idx", "act")


@check("topk_stats", f"""
WITH {TOPK_SQL} SELECT feature_id, max(act) AS max_act, min(act) AS min_act, round(avg(act), 6) AS mean_act FROM top GROUP BY feature_id
""")
def topk_stats(spark, sf_dir):
    top = interpret.top_tokens(fx.integer_model(), integer_rows(spark, sf_dir))
    return wide(whole(rounded(interpret.top_stats(top), "mean_act"), "max_act", "min_act"))


@check("decode_tokens", f"WITH {fx.ROWS_SQL} SELECT vec_id, token_id, {VOCAB_SQL} AS token FROM rows")
def decode_tokens(spark, sf_dir):
    rows = fx.chunk_rows(spark, sf_dir).select("vec_id", "token_id")
    return wide(corpus.decode_tokens(rows, known_tokens(spark, sf_dir)).select("vec_id", "token_id", "token"))


# --- prompts -------------------------------------------------------------------


@check("prompt_token_profile", f"""
WITH {fx.CELLS_SQL}, {fx.PROMPTS_SQL}
SELECT prompt_id, pos, n_active, max_act, {VOCAB_SQL} AS token FROM (
  SELECT prompt_id, pos, token_idx, count(*) FILTER (act > 0) AS n_active, CAST(max(act) AS BIGINT) AS max_act
  FROM cells JOIN prompts USING (token_idx) GROUP BY prompt_id, pos, token_idx)
JOIN (SELECT token_idx, token_id FROM rows) USING (token_idx)
""")
def prompt_token_profile(spark, sf_dir):
    places = fx.prompts(spark, sf_dir).select("prompt_id", "pos", "vec_id").join(
        fx.chunk_rows(spark, sf_dir).select("vec_id", "token_id"), "vec_id"
    )
    tokens = corpus.decode_tokens(places, known_tokens(spark, sf_dir))
    profile = prompts.prompt_token_profile(fx.integer_model(), integer_prompts(spark, sf_dir), tokens=tokens)
    return wide(whole(profile, "max_act"))


@check("prompt_summary", f"""
WITH {fx.DECIMAL_SQL}
SELECT CAST(label AS BIGINT) AS prompt_id, round(avg(l0), 6) AS mean_l0, round(avg(squared_error) / {fx.WIDTH}, 6) AS recon_mse,
       any_value(n_features) AS n_features
FROM row_metrics
JOIN (SELECT label, count(DISTINCT feature_id) FILTER (act > 0) AS n_features FROM cells GROUP BY label) USING (label)
GROUP BY label
""")
def prompt_summary(spark, sf_dir):
    summary = prompts.prompt_summary(fx.decimal_model(), fx.prompts(spark, sf_dir))
    return wide(rounded(summary, "mean_l0", "recon_mse"))


TOP_FEATURES_SQL = f"""
{fx.CELLS_SQL}, top AS (
  SELECT CAST(label AS BIGINT) AS prompt_id, feature_id, CAST(sum(act) AS BIGINT) AS total_act,
         row_number() OVER (PARTITION BY label ORDER BY sum(act) DESC, feature_id) AS rank
  FROM cells WHERE act > 0 GROUP BY label, feature_id QUALIFY rank <= {prompts.TOP_FEATURES})
"""


def top_features(spark, sf_dir):
    return prompts.prompt_top_features(fx.integer_model(), integer_prompts(spark, sf_dir))


@check("prompt_top_features", f"WITH {TOP_FEATURES_SQL} SELECT prompt_id, rank, feature_id, total_act FROM top")
def prompt_top_features(spark, sf_dir):
    return wide(whole(top_features(spark, sf_dir), "total_act"))


@check("prompt_leading_features", f"""
WITH {TOP_FEATURES_SQL}
SELECT prompt_id, string_agg(feature_id::VARCHAR, ',' ORDER BY rank) AS top_features,
       string_agg(feature_id::VARCHAR, ',' ORDER BY rank) FILTER (rank <= {prompts.SHOWN_FEATURES}) AS leading
FROM top GROUP BY prompt_id
""")
def prompt_leading_features(spark, sf_dir):
    listed = prompts.top_feature_arrays(top_features(spark, sf_dir))
    return wide(listed.select("prompt_id", *[
        F.array_join(F.col(name).cast("array<string>"), ",").alias(name) for name in ("top_features", "leading")
    ]))


@check("features_union", f"WITH {TOP_FEATURES_SQL} SELECT count(DISTINCT feature_id) AS n_features FROM top")
def features_union(spark, sf_dir):
    return prompts.features_union(top_features(spark, sf_dir))


# Many labels share few top features; the lists are compared to this depth.
COMMON_DEPTH = 128


@check("features_common", f"""
WITH {TOP_FEATURES_SQL.replace(f"rank <= {prompts.TOP_FEATURES}", f"rank <= {COMMON_DEPTH}")}
SELECT feature_id FROM top GROUP BY feature_id HAVING count(*) = (SELECT count(DISTINCT label) FROM rows)
""")
def features_common(spark, sf_dir):
    n_prompts = fx.table(spark, sf_dir, "embeddings").select("label").distinct().count()
    top = prompts.prompt_top_features(fx.integer_model(), integer_prompts(spark, sf_dir), COMMON_DEPTH)
    return wide(prompts.features_common(top, n_prompts))

"""Fitting a sparse autoencoder with minibatch Adam.

By default each step is one Spark job: tasks turn their rows of the batch into
gradient rows, one per active feature; the rows are summed with partial
aggregation; the driver, which holds the parameters, applies the update. What
travels and what the driver holds is bounded by the model, never by the data;
models above ``DRIVER_LIMIT_BYTES`` are refused.

Steps need the result of the step before, so a step whose arithmetic takes less
time than a job has nothing to gain from more tasks. Such steps run one after
the other in a task that reads a bounded block of whole batches in order, one
job per block; parameters and moments travel between jobs. The same holds for
windows of local steps. Larger steps are jobs of their own.

``steps_per_job`` above 1 trades exactness for fewer jobs and larger models:
every task takes that many local steps on whole batches of its own, and the
parameters are averaged afterwards. There the weights stay a table in shared
storage that tasks read and Spark rewrites; the driver sees no weight matrix.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators.sae import (
    BROADCAST_LIMIT_BYTES, DRIVER_LIMIT_BYTES, SaeModel, SaeParams, SaeTable, batch_metrics, centre,
    epoch_metrics, initial_weights, mean_by_batch, model_bytes, normalize_decoder, params_from_rows, share_arrays,
    to_matrix, to_vectors,
)
from ..operators.split import epoch_batches, train_val_split
from ..session import discard, stage, staging_path

MOMENTUM = 0.01
BETAS = (0.9, 0.999)
EPSILON = 1e-8
COMMON = -1  # feature_id of the row with decoder-bias gradient and batch sums
TRAINED = ("w_enc", "b_enc", "w_dec", "b_dec")
MEAN_BLOCK = 64
#: Work of a step or window, as rows x d_model x d_sae, above which it is a job of its own; the work of a block of smaller ones.
STEP_WORK = 1 << 26
BLOCK_WORK = 1 << 30


class Adam:
    """Adam with bias correction on named arrays."""

    def __init__(self, params: SaeParams, lr: float):
        self.lr, self.step = lr, 0
        self.first = {name: np.zeros_like(getattr(params, name)) for name in TRAINED}
        self.second = {name: np.zeros_like(getattr(params, name)) for name in TRAINED}

    def update(self, params: SaeParams, gradients: dict[str, np.ndarray]) -> SaeParams:
        self.step += 1
        beta1, beta2 = BETAS
        changed = {}
        for name, gradient in gradients.items():
            self.first[name] += (1 - beta1) * (gradient - self.first[name])
            self.second[name] += (1 - beta2) * (gradient**2 - self.second[name])
            mean = self.first[name] / (1 - beta1**self.step)
            spread = np.sqrt(self.second[name] / (1 - beta2**self.step))
            changed[name] = getattr(params, name) - self.lr * mean / (spread + EPSILON)
        return replace(params, **changed)


def batch_gradients(x: np.ndarray, weights: dict, normalize: str, apply_b_dec: bool, n_rows: int, l1_coeff: float):
    """Gradients and loss sums of some rows of a batch of ``n_rows``.

    The loss is the mean squared error over all cells plus ``l1_coeff`` times
    the mean activation over all cells, so rows add up.
    """
    d_sae, d_model = weights["w_enc"].shape
    centred = centre(x, weights, normalize, apply_b_dec)
    acts = np.maximum(centred @ weights["w_enc"].T + weights["b_enc"], 0)
    error = acts @ weights["w_dec"] + weights["b_dec"] - x
    d_recon = 2 * error / (n_rows * d_model)
    d_acts = (d_recon @ weights["w_dec"].T + l1_coeff / (n_rows * d_sae)) * (acts > 0)
    d_bias = d_recon.sum(axis=0)
    if apply_b_dec:
        d_bias = d_bias - (d_acts @ weights["w_enc"]).sum(axis=0)
    gradients = {
        "w_enc": d_acts.T @ centred, "b_enc": d_acts.sum(axis=0), "w_dec": acts.T @ d_recon, "b_dec": d_bias,
    }
    sums = np.array([(error**2).sum(), acts.sum(), np.count_nonzero(acts), len(x)], dtype=float)
    return gradients, sums


def train_one(x: np.ndarray, params: SaeParams, optimizer: Adam, l1_coeff: float) -> tuple[SaeParams, np.ndarray]:
    """One step on a whole batch; the new parameters and the batch's mean figures."""
    mean = next_mean(params, x.mean(axis=0))
    params = replace(params, activation_mean=mean, mean_initialized=True)
    gradients, (squared, acts, active, n) = batch_gradients(
        x, params.arrays(), params.normalize_activations, params.apply_b_dec_to_input, len(x), l1_coeff
    )
    figures = np.array([squared / (n * params.d_model), acts / (n * params.d_sae), active / n])
    return normalize_decoder(optimizer.update(params, gradients)), figures


def whole_batches(batches: Iterator[pa.RecordBatch], width: int, dtype) -> Iterator[tuple[int, np.ndarray]]:
    """Number and matrix of every batch, from rows of ``batch_id, activation`` in batch order."""
    current, parts = None, []
    for rows in batches:
        ids = rows.column(0).to_numpy()
        x = to_matrix(rows.column(1), width, dtype)
        edges = np.flatnonzero(np.diff(ids)) + 1
        for piece in np.split(np.arange(len(ids)), edges):
            if not len(piece):
                continue
            if parts and ids[piece[0]] != current:
                yield current, np.concatenate(parts)
                parts = []
            current = int(ids[piece[0]])
            parts.append(x[piece])
    if parts:
        yield current, np.concatenate(parts)


def in_order(block: DataFrame) -> DataFrame:
    """A bounded block of whole batches, in order, as one task reads it; nothing is shuffled."""
    return block.coalesce(1).sortWithinPartitions("batch_id", "token_idx")


def chained_steps(block: DataFrame, params: SaeParams, optimizer: Adam, l1_coeff: float) -> tuple[SaeParams, np.ndarray, int]:
    """Exact steps over a block of whole batches, one after the other in one task.

    Takes the optimizer along and returns the parameters, the sums of the
    batches' figures and their number. What comes back is three times the model.
    """
    d, state = params.d_model, params.arrays()
    state |= {f"first_{name}": array for name, array in optimizer.first.items()}
    state |= {f"second_{name}": array for name, array in optimizer.second.items()}
    load = share_arrays(block.sparkSession, state, BROADCAST_LIMIT_BYTES)
    bare = replace(params, **{name: np.zeros((0, d)) for name in params.arrays()}, metadata={})
    dtype, lr, done = params.dtype, optimizer.lr, optimizer.step

    def without_nulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.column(1).flatten().null_count:
                raise ValueError("a vector to train on has a null value")
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = load()
        local = replace(bare, **{name: arrays[name] for name in bare.arrays()})
        steps = Adam(local, lr)
        steps.step = done
        for name in TRAINED:  # copies, as moments change in place
            steps.first[name], steps.second[name] = arrays[f"first_{name}"].copy(), arrays[f"second_{name}"].copy()
        figures, n = np.zeros(3), 0
        for _, x in whole_batches(without_nulls(batches), d, dtype):
            local, found = train_one(x, local, steps, l1_coeff)
            figures, n = figures + found, n + 1
        if not n:
            return
        sets = [{name: getattr(local, name) for name in TRAINED}, steps.first, steps.second]
        width = max(1, (8 << 20) // (8 * 3 * (2 * d + 1)))
        for start in range(0, local.d_sae, width):
            own = slice(start, min(start + width, local.d_sae))
            joined = np.hstack([part for x in sets for part in (x["w_enc"][own], x["b_enc"][own, None], x["w_dec"][own])])
            ids = pa.array(np.arange(own.start, own.stop, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, to_vectors(joined)], ["feature_id", "gradient"])
        common = np.concatenate([*(x["b_dec"] for x in sets), local.activation_mean, figures, [n]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([COMMON], pa.int32()), to_vectors(common[None, :])], ["feature_id", "gradient"]
        )

    rows = in_order(block).select("batch_id", "activation").mapInArrow(run, "feature_id INT, gradient ARRAY<DOUBLE>")
    features, matrix, common = feature_matrix(rows, 3 * (2 * d + 1))
    matrix = matrix[np.argsort(features)]
    parts = []
    for k in range(3):
        own = matrix[:, k * (2 * d + 1):(k + 1) * (2 * d + 1)]
        parts.append({
            "w_enc": own[:, :d].astype(dtype), "b_enc": own[:, d].astype(dtype), "w_dec": own[:, d + 1:].astype(dtype),
            "b_dec": common[k * d:(k + 1) * d].astype(dtype),
        })
    n = int(common[-1])
    optimizer.first, optimizer.second, optimizer.step = parts[1], parts[2], done + n
    params = replace(params, **parts[0], activation_mean=common[3 * d:4 * d].astype(dtype), mean_initialized=True)
    return params, common[4 * d:-1], n


def gradient_rows(batch: DataFrame, params: SaeParams, n_rows: int, l1_coeff: float) -> DataFrame:
    """Summed gradients of one batch: ``feature_id`` and ``gradient``.

    A feature's row joins its encoder row, encoder bias and decoder row.
    Features that no row activates have no gradient and no row. The sum is the
    built-in vector aggregate, which combines per task before its shuffle.
    """
    load = params.share(batch.sparkSession, None, True, BROADCAST_LIMIT_BYTES)
    width, dtype = params.d_model, params.dtype
    normalize, apply_b_dec = params.normalize_activations, params.apply_b_dec_to_input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, total, sums = load(), None, np.zeros(4)
        for rows in batches:
            if rows.num_rows:
                x = to_matrix(rows.column(0), width, dtype)
                gradients, counted = batch_gradients(x, weights, normalize, apply_b_dec, n_rows, l1_coeff)
                total = gradients if total is None else {k: total[k] + gradients[k] for k in total}
                sums += counted
        if total is None:
            return
        hit = np.flatnonzero(total["b_enc"].astype(bool) | total["w_dec"].any(axis=1))
        step = max(1, (8 << 20) // (8 * (2 * width + 1)))
        for start in range(0, len(hit), step):
            ids = hit[start:start + step]
            joined = np.hstack([total["w_enc"][ids], total["b_enc"][ids, None], total["w_dec"][ids]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), to_vectors(joined)], ["feature_id", "gradient"]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([COMMON], pa.int32()), to_vectors(np.concatenate([total["b_dec"], sums])[None, :])],
            ["feature_id", "gradient"],
        )

    partial = batch.select("activation").mapInArrow(run, "feature_id INT, gradient ARRAY<DOUBLE>")
    summed = Summarizer.sum(array_to_vector("gradient"))
    return partial.groupBy("feature_id").agg(vector_to_array(summed).alias("gradient"))


def collect_gradients(rows: DataFrame, params: SaeParams) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient rows as arrays; there is at most one row per feature."""
    d = params.d_model
    gradients = {name: np.zeros(getattr(params, name).shape) for name in TRAINED}
    features, matrix, common = feature_matrix(rows, 2 * d + 1)
    gradients["w_enc"][features], gradients["b_enc"][features] = matrix[:, :d], matrix[:, d]
    gradients["w_dec"][features] = matrix[:, d + 1:]
    gradients["b_dec"] = common[:d]
    return gradients, common[d:]


def feature_matrix(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, their vectors, and the vector of the ``COMMON`` row."""
    table = rows.toArrow()
    ids = table.column("feature_id").to_numpy()
    vectors = table.column("gradient").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    at = int(np.flatnonzero(ids == COMMON)[0])
    common = values[offsets[at]:offsets[at + 1]]
    others = np.flatnonzero(ids != COMMON)
    places = offsets[others][:, None] + np.arange(width)[None, :]
    return ids[others], values[places], common


def local_training(
    window: DataFrame, params: SaeTable, lr: float, l1_coeff: float, steps_per_job: int, batches_per_window: int
) -> DataFrame:
    """Weighted sums of parameters that learners trained on whole batches of their own.

    A learner is ``steps_per_job`` consecutive batches. Tasks must hold each of
    their learners whole, in batch order: one of one window, or all of several
    windows, where each window begins with the mean of the one before. A
    learner's weight is its number of batches; sums are those of the last window.
    The ``COMMON`` row sums decoder bias, running mean, batch figures, batches
    and weights.
    """
    load = params.share(window.sparkSession, None, True, 0)
    width, dtype = params.d_model, params.dtype
    normalize, apply_b_dec = params.normalize_activations, params.apply_b_dec_to_input
    initialized = params.mean_initialized
    names = (*TRAINED, "activation_mean")

    def run(batches):
        start = SaeParams(
            **{name: np.array(array, dtype=dtype) for name, array in load().items() if name != "feature_ids"},
            normalize_activations=normalize, apply_b_dec_to_input=apply_b_dec, mean_initialized=initialized,
        )
        local = optimizer = learner = None
        own, held, sums, metrics = 0, 0, {}, []

        def close_learner():
            nonlocal own, held
            for name in names:
                sums[name] = sums.get(name, 0) + getattr(local, name) * float(own)
            own, held = 0, held + own

        for number, x in whole_batches(batches, width, dtype):
            if number // steps_per_job != learner:
                if own:
                    close_learner()
                    if number // batches_per_window != learner * steps_per_job // batches_per_window:
                        mean = {name: sums[name] / held for name in names}
                        start = normalize_decoder(replace(start, **mean, mean_initialized=True))
                        held = 0
                        sums.clear()
                local, optimizer, learner = start, Adam(start, lr), number // steps_per_job
            local, figures = train_one(x, local, optimizer, l1_coeff)
            metrics.append(figures)
            own += 1
        if not metrics:
            return
        close_learner()
        step = max(1, (8 << 20) // (8 * (2 * width + 2)))
        for first in range(0, local.d_sae, step):
            block = slice(first, min(first + step, local.d_sae))
            joined = np.hstack([sums["w_enc"][block], sums["b_enc"][block, None], sums["w_dec"][block]])
            ids = pa.array(np.arange(block.start, block.stop, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, to_vectors(joined)], ["feature_id", "gradient"])
        common = np.concatenate([sums["b_dec"], sums["activation_mean"], np.sum(metrics, axis=0), [len(metrics), held]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([COMMON], pa.int32()), to_vectors(common[None, :])], ["feature_id", "gradient"]
        )

    partial = window.select("batch_id", "activation").mapInArrow(run, "feature_id INT, gradient ARRAY<DOUBLE>")
    summed = Summarizer.sum(array_to_vector("gradient"))
    return partial.groupBy("feature_id").agg(vector_to_array(summed).alias("gradient"))


def averaged(sums: DataFrame, params: SaeTable) -> tuple[SaeTable, np.ndarray, int]:
    """The averaged parameters as a new table, with summed batch figures and their number."""
    d, spark = params.d_model, sums.sparkSession
    staged = staging_path(spark, "sums")
    sums.write.parquet(staged)
    rows = spark.read.schema(sums.schema).parquet(staged)
    common = np.asarray(rows.where(F.col("feature_id") == COMMON).first()["gradient"])
    weight = float(common[-1])
    mean = F.transform("gradient", lambda x: x / weight)
    features = rows.where(F.col("feature_id") != COMMON).select("feature_id", mean.alias("mean"))
    path = staging_path(spark, "weights")
    features.select(
        "feature_id",
        F.slice("mean", 1, d).alias("w_enc"),
        F.get("mean", F.lit(d)).alias("b_enc"),
        unit(F.slice("mean", d + 2, d)).alias("w_dec"),
    ).write.parquet(path)
    discard(staged)
    updated = replace(
        params, path=path, b_dec=common[:d] / weight, activation_mean=common[d:2 * d] / weight,
        mean_initialized=True,
    )
    return updated, common[2 * d:-2], int(common[-2])


def next_mean(params: SaeParams, batch_mean: np.ndarray) -> np.ndarray:
    """The running mean after one more batch; the first batch starts it."""
    if params.normalize_activations != "expected_average_only_in":
        return params.activation_mean
    if not params.mean_initialized:
        return batch_mean
    return (1 - MOMENTUM) * params.activation_mean + MOMENTUM * batch_mean


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the lowest validation loss, as one row."""
    val = history.where((F.col("split") == "val") & F.col("recon_loss").isNotNull())
    return val.agg(
        F.min_by("epoch", F.struct("recon_loss", "epoch")).alias("epoch"), F.min("recon_loss").alias("val_loss")
    )


@contextmanager
def bucketed(rows: DataFrame, key: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """The rows as a table bucketed by ``key``, for as long as the block runs.

    A join on ``key`` then takes each bucket from its files, without a shuffle
    of these rows. The files lie in the shared folder.
    """
    spark = rows.sparkSession
    path, name = staging_path(spark, "bucketed"), f"veclens_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, key)  # as the buckets are: each is one file
    dealt.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(path)


def in_batches(vectors: DataFrame, placed: DataFrame) -> DataFrame:
    """Bucketed vectors with their batch; only the narrow side is shuffled."""
    return vectors.join(placed.select("token_idx", "batch_id"), "token_idx").select(*BATCHED_NAMES)


def in_ranges(joined: DataFrame, placed: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt to consecutive batches, in order, by the only shuffle of vectors.

    The ranges follow from the number of batches, so nothing is sampled and the
    join runs once. The minimum and maximum batch of each file let a scan skip
    the rest.
    """
    n_batches = (placed.agg(F.max("batch_id")).first()[0] or 0) + 1
    n = parts or int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("batch_id") * n / n_batches).cast("int")
    return joined.withColumn("part", part).repartitionById(n, "part").sortWithinPartitions("batch_id", "token_idx").drop("part")


@dataclass
class TrainingConfig:
    d_sae: int
    l1_coeff: float = 1e-3
    lr: float = 3e-4
    batch_size: int = 8192
    epochs: int = 3
    train_split: float = 0.98
    seed: int = 42
    normalize_activations: str = "expected_average_only_in"
    apply_b_dec_to_input: bool = False
    steps_per_job: int = 1
    tasks_per_job: int = 8
    buckets: int | None = None  # of the vectors; the number of shuffle partitions by default

    @property
    def window(self) -> int:
        """Batches between two averages of local steps."""
        return self.steps_per_job * self.tasks_per_job

    def block(self, d_model: int) -> int:
        """Batches of one job that takes its steps or windows one after the other; 0 if each is work for a job."""
        unit = self.window if self.steps_per_job > 1 else 1
        work = unit * self.batch_size * max(d_model * self.d_sae, 1024)
        if work > STEP_WORK or 3 * model_bytes(d_model, self.d_sae) > BROADCAST_LIMIT_BYTES:
            return 0
        return unit * (BLOCK_WORK // work)


class Sae(Estimator):
    """Estimator over rows of ``token_idx`` and ``activation``."""

    def __init__(self, d_sae: int, **options):
        super().__init__()
        self.config = TrainingConfig(d_sae, **options)

    def _fit(self, dataset: DataFrame) -> SaeModel:
        config, spark = self.config, dataset.sparkSession
        rows = dataset.select("token_idx", F.col("activation").cast("array<float>").alias("activation"))
        d_model = rows.agg(F.max(F.size("activation"))).first()[0]
        if d_model is None:
            raise ValueError("no activations to train on")
        params = self.start(spark, d_model)
        split = stage(train_val_split(rows.select("token_idx"), config.train_split, seed=config.seed), "split")
        with bucketed(rows, "token_idx", config.buckets) as vectors:
            return self.train(vectors, split, params, d_model)

    def train(self, rows: DataFrame, split: DataFrame, params: SaeParams | SaeTable, d_model: int) -> SaeModel:
        """All epochs over bucketed vectors; keeps the best parameters."""
        config, spark = self.config, rows.sparkSession
        optimizer = Adam(params, config.lr) if isinstance(params, SaeParams) else None
        history, best = [], None
        block = config.block(d_model)
        for epoch in range(1, config.epochs + 1):
            placed = epoch_batches(split, epoch, config.batch_size)
            path = self.lay_out(rows, placed.where(F.col("split") == "train"), epoch, block)
            train = spark.read.schema(WINDOWED if block or config.steps_per_job > 1 else BATCHED).parquet(path)
            kept = best[2] if best else None
            params, train_figures = self.train_epoch(train, params, optimizer, kept, block)
            discard(path)
            val = in_batches(rows, placed.where(F.col("split") == "val"))
            val_figures = validate(SaeModel(params), val)
            history += [(epoch, "train", *train_figures), (epoch, "val", *val_figures)]
            loss = val_figures[0]
            if loss is not None and (best is None or loss < best[0]):
                best = (loss, epoch, params)
        chosen = best[2] if best else params
        model = SaeModel(replace(chosen, metadata=self.describe(d_model, history, best)))
        model.history = spark.createDataFrame(history, HISTORY)
        return model

    def start(self, spark: SparkSession, d_model: int) -> SaeParams | SaeTable:
        """Start values, in the driver or as a table."""
        config = self.config
        size = model_bytes(d_model, config.d_sae)
        options = {
            "normalize_activations": config.normalize_activations,
            "apply_b_dec_to_input": config.apply_b_dec_to_input,
        }
        weights = initial_weights(spark, d_model, config.d_sae, config.seed)
        if config.steps_per_job > 1:
            path = staging_path(spark, "weights")
            weights.write.parquet(path)
            return SaeTable(path, config.d_sae, d_model, np.zeros(d_model), np.zeros(d_model), **options)
        if size > DRIVER_LIMIT_BYTES:
            raise ValueError(f"the model needs {size:,} bytes on the driver; use steps_per_job above 1")
        return params_from_rows(stage(weights, "start"), d_model, config.d_sae, **options)

    def lay_out(self, rows: DataFrame, placed: DataFrame, epoch: int, block: int) -> str:
        """Writes one epoch's train rows on disk, so that a step reads only its batch, or a job only its window.

        The vectors lie in buckets of ``token_idx``; the narrow batch numbers are
        shuffled to them. Single steps get whole batches in one or two files:
        vectors move once, to ranges of batches. Jobs of local steps shuffle
        their window themselves, so here vectors stay in their buckets and only
        go to the folder of their window. Blocks of small steps or windows are
        ranges of batches as well, in folders of their own.
        """
        path = staging_path(rows.sparkSession, f"epoch{epoch}")
        if block:
            window = F.expr(f"batch_id div {block}").alias("window")
            laid = in_ranges(in_batches(rows, placed), placed, self.config.buckets)
            laid.select(window, *BATCHED_NAMES).write.partitionBy("window").parquet(path)
            return path
        if self.config.steps_per_job > 1:
            window = F.expr(f"batch_id div {self.config.window}").alias("window")
            joined = in_batches(rows, placed).select(window, *BATCHED_NAMES)
            joined.sortWithinPartitions("window", "batch_id", "token_idx").write.partitionBy("window").parquet(path)
            return path
        in_ranges(in_batches(rows, placed), placed, self.config.buckets).write.parquet(path)
        return path

    def train_epoch(self, train: DataFrame, params: SaeParams, optimizer: Adam | None, kept, block: int):
        """All steps of an epoch; returns parameters and mean batch figures.

        ``kept`` are the best parameters so far, which must stay.
        """
        config = self.config
        n_rows, last = train.agg(F.count("*"), F.max("batch_id")).first()
        if not n_rows:
            return params, (None, None, None)
        if config.steps_per_job > 1:
            return self.train_epoch_locally(train, params, last + 1, kept, block)
        figures = np.zeros(3)
        if block:
            for number in range(last // block + 1):
                own = train.where(F.col("window") == number)
                params, sums, _ = chained_steps(own, params, optimizer, config.l1_coeff)
                figures += sums
            return params, tuple((figures / (last + 1)).tolist())
        means: dict[int, tuple[np.ndarray, int]] = {}
        for t in range(last + 1):
            if t not in means:
                block = train.where(F.col("batch_id").between(t, t + MEAN_BLOCK - 1))
                means = {
                    row["batch_id"]: (np.asarray(row["batch_mean"]), row["n_rows"])
                    for row in mean_by_batch(block).collect()
                }
            mean, n = means[t]
            params = replace(params, activation_mean=next_mean(params, mean), mean_initialized=True)
            batch = train.where(F.col("batch_id") == t)
            gradients, sums = collect_gradients(gradient_rows(batch, params, n, config.l1_coeff), params)
            figures += sums[:3] / [n * params.d_model, n * params.d_sae, n]
            params = normalize_decoder(optimizer.update(params, gradients))
        return params, tuple((figures / (last + 1)).tolist())

    def train_epoch_locally(self, train: DataFrame, params: SaeTable, n_batches: int, kept, block: int):
        config = self.config
        figures, counted = np.zeros(3), 0
        for number in range(-(-n_batches // (block or config.window))):
            placed = train.where(F.col("window") == number)
            if block:
                whole = in_order(placed)
            else:
                task = F.expr(f"(batch_id - {number * config.window}) div {config.steps_per_job}").cast("int")
                whole = placed.withColumn("task", task).repartitionById(config.tasks_per_job, "task").sortWithinPartitions("batch_id", "token_idx")
            before = params
            trained = local_training(whole, before, config.lr, config.l1_coeff, config.steps_per_job, config.window)
            params, sums, n = averaged(trained, before)
            if before is not kept:
                discard(before.path)
            figures, counted = figures + sums, counted + n
        return params, tuple((figures / counted).tolist())

    def describe(self, d_model: int, history: list, best) -> dict:
        """The training report."""
        config = self.config
        figures = ("recon_loss", "l1_loss", "l0")
        epochs = [
            {
                "epoch": train[0],
                "train": dict(zip(figures, train[2:])),
                "val": dict(zip(figures, val[2:])),
            }
            for train, val in zip(history[::2], history[1::2])
        ]
        chosen = next((e for e in epochs if best and e["epoch"] == best[1]), None)
        return {
            "model_config": {
                "d_model": d_model, "d_sae": config.d_sae, "expansion_factor": config.d_sae / d_model,
            },
            "training_config": {
                "l1_coeff": config.l1_coeff, "lr": config.lr, "batch_size": config.batch_size,
                "epochs": config.epochs, "train_split": config.train_split,
            },
            "best_results": {
                "epoch": chosen["epoch"] if chosen else None,
                "val_loss": chosen["val"]["recon_loss"] if chosen else None,
                "val_l0": chosen["val"]["l0"] if chosen else None,
            },
            "training_history": epochs,
        }


BATCHED_NAMES = ("token_idx", "batch_id", "activation")
BATCHED = "token_idx BIGINT, batch_id BIGINT, activation ARRAY<FLOAT>"
WINDOWED = f"{BATCHED}, window BIGINT"
HISTORY = "epoch INT, split STRING, recon_loss DOUBLE, l1_loss DOUBLE, l0 DOUBLE"


def validate(model: SaeModel, val: DataFrame) -> tuple:
    """Mean batch figures without an update; nulls for an empty split."""
    metrics = model.row_metrics(val, ["batch_id"])
    per_batch = batch_metrics(metrics, model.parameters.d_model, model.parameters.d_sae)
    row = epoch_metrics(per_batch).first()
    return row["recon_loss"], row["l1_loss"], row["l0"]


def write_report(spark: SparkSession, model: SaeModel, path: str, data_info: dict | None = None) -> None:
    """The history table and the training report as one JSON row."""
    model.history.coalesce(1).write.mode("overwrite").parquet(f"{path}/history")
    body = {**model.parameters.metadata, "data_info": data_info or {}}
    report = spark.createDataFrame([(json.dumps(body),)], "value STRING")
    stamped = report.withColumn("trained_on", F.current_timestamp().cast("string"))
    stamped.coalesce(1).write.mode("overwrite").json(f"{path}/report")

"""Sparse autoencoder: parameters, encoding, decoding and metrics.

Vectors stay in the Spark partitions that hold them and meet the weights in
Arrow batches; only active features leave a task. Weights are bounded by the
model and do not grow with the data. Models in driver memory (``SaeParams``)
are broadcast up to a size and shipped as mapped files beyond it; models too
large for the driver stay tables in shared storage (``SaeTable``), of which
every executor makes one copy that its tasks map into memory.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark import SparkFiles
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import LAYER_NORM_EPS, NORM_FLOOR, unit
from ..session import as_uri, fingerprint, staging_path, task_filesystem
from .copies import mapped

NORMALIZATIONS = ("none", "expected_average_only_in", "layer_norm")
BROADCAST_LIMIT_BYTES = 256 << 20
DRIVER_LIMIT_BYTES = 1 << 30
CELLS_PER_STEP = 4 << 20
ROWS_PER_STEP = 2048
MODEL_BLOCK_BYTES = 64 << 20
ALL_ROWS = -1
MEAN_GROUP = 1024
#: Fixed value: the features of one of Spark's bitmaps.
BITMAP_FEATURES = 32_768
GROUPS_HELD = 512

FEATURES = T.ArrayType(
    T.StructType([T.StructField("feature_id", T.IntegerType()), T.StructField("act", T.DoubleType())])
)
ARROW_FEATURES = pa.list_(pa.struct([("feature_id", pa.int32()), ("act", pa.float64())]))


@dataclass(frozen=True)
class SaeParams:
    """One row per feature in ``w_enc`` and ``w_dec``, both ``[d_sae, d_model]``."""

    w_enc: np.ndarray
    b_enc: np.ndarray
    w_dec: np.ndarray
    b_dec: np.ndarray
    activation_mean: np.ndarray
    normalize_activations: str = "expected_average_only_in"
    apply_b_dec_to_input: bool = False
    mean_initialized: bool = False
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.normalize_activations not in NORMALIZATIONS:
            raise ValueError(f"normalize_activations must be one of {NORMALIZATIONS}")

    @property
    def d_sae(self) -> int:
        return self.w_enc.shape[0]

    @property
    def d_model(self) -> int:
        return self.w_enc.shape[1]

    @property
    def dtype(self):
        return self.w_enc.dtype

    @property
    def stored(self):
        """The type of weights in a saved table: float32 stays float32."""
        return np.float32 if self.dtype == np.float32 else np.float64

    def arrays(self) -> dict[str, np.ndarray]:
        return {
            "w_enc": self.w_enc, "b_enc": self.b_enc, "w_dec": self.w_dec, "b_dec": self.b_dec,
            "activation_mean": self.activation_mean,
        }

    def share(self, spark: SparkSession, feature_ids: Sequence[int] | None, decoder: bool, limit: int):
        """A function that returns the weights inside a task."""
        arrays = self.arrays()
        ids = np.arange(self.d_sae) if feature_ids is None else np.asarray(feature_ids, dtype=np.int64)
        if feature_ids is not None:
            arrays |= {name: arrays[name][ids] for name in ("w_enc", "b_enc", "w_dec")}
        if not decoder:
            del arrays["w_dec"]
        return share_arrays(spark, arrays | {"feature_ids": ids}, limit)

    def rows(self, spark: SparkSession) -> Iterator[DataFrame]:
        """The weight table in blocks of bounded size."""
        width = max(1, MODEL_BLOCK_BYTES // (2 * 8 * self.d_model))
        for start in range(0, self.d_sae, width):
            stop = min(start + width, self.d_sae)
            yield spark.createDataFrame(pa.table({
                "feature_id": pa.array(np.arange(start, stop, dtype=np.int32)),
                "w_enc": to_vectors(self.w_enc[start:stop], self.stored),
                "b_enc": pa.array(self.b_enc[start:stop].astype(self.stored)),
                "w_dec": to_vectors(self.w_dec[start:stop], self.stored),
            })).coalesce(1)


@dataclass(frozen=True)
class SaeTable:
    """Parameters whose feature rows stay a Parquet table at ``path``.

    Only vectors as wide as the model pass through the driver. Each executor
    makes one copy of the columns and features it needs, which its tasks map.
    """

    path: str
    d_sae: int
    d_model: int
    b_dec: np.ndarray
    activation_mean: np.ndarray
    dtype: np.dtype = np.dtype("float64")
    normalize_activations: str = "expected_average_only_in"
    apply_b_dec_to_input: bool = False
    mean_initialized: bool = False
    metadata: dict = field(default_factory=dict)

    def share(self, spark: SparkSession, feature_ids: Sequence[int] | None, decoder: bool, limit: int):
        """A function that returns the weights inside a task, mapped from the executor's copy.

        The table is read once per executor, whatever its number of tasks and
        workers, and once more for the decoder if a later job needs it. The
        function's ``reads`` counts these reads.
        """
        location, d_sae, d_model, dtype = as_uri(self.path), self.d_sae, self.d_model, self.dtype
        common = {"b_dec": self.b_dec.astype(dtype), "activation_mean": self.activation_mean.astype(dtype)}
        found = np.arange(d_sae) if feature_ids is None else np.asarray(feature_ids, dtype=np.int64)
        subset = None if feature_ids is None else found
        key = fingerprint(self.path) + ("" if subset is None else "-" + hashlib.md5(found.tobytes()).hexdigest())
        shapes = {"w_enc": (len(found), d_model), "b_enc": (len(found),)}
        if decoder:
            shapes["w_dec"] = (len(found), d_model)
        reads = spark.sparkContext.accumulator(0)

        def build(arrays: dict[str, np.ndarray]) -> None:
            reads.add(1)
            filesystem, root = task_filesystem(location)
            wanted = None if subset is None else dataset.field("feature_id").isin(subset.tolist())
            place = np.full(d_sae, -1, dtype=np.int64)
            place[found] = np.arange(len(found))
            table = dataset.dataset(root, filesystem=filesystem, format="parquet")
            for batch in table.to_batches(columns=["feature_id", *arrays], filter=wanted, batch_size=ROWS_PER_STEP):
                at = place[batch.column("feature_id").to_numpy()]
                for name, array in arrays.items():
                    if not len(at):
                        continue
                    column = batch.column(name)
                    array[at] = column.to_numpy() if name == "b_enc" else to_matrix(column, d_model, dtype)

        def load():
            return {**mapped(key, shapes, dtype, build), **common, "feature_ids": found}

        load.reads = reads
        return load

    def rows(self, spark: SparkSession) -> Iterator[DataFrame]:
        yield spark.read.parquet(self.path)


def encoder_bound(d_model: int) -> float:
    """Half-width of the uniform start values: sqrt(6 / fan-in)."""
    return math.sqrt(6.0 / d_model)


def initial_weights(spark: SparkSession, d_model: int, d_sae: int, seed: int = 42) -> DataFrame:
    """Start values, one row per feature: ``feature_id, w_enc, b_enc, w_dec``.

    The uniform draws come from 32 bits of ``md5(seed:feature:dimension)``, so
    they are the same on any cluster and in any SQL engine. Decoder rows are
    the encoder rows at unit norm; biases are 0.
    """
    bound = encoder_bound(d_model)

    def draw(d: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("feature_id").cast("string"), d.cast("string")))
        fraction = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
        return (fraction * 2.0 - 1.0) * bound

    features = spark.range(d_sae).select(F.col("id").cast("int").alias("feature_id"))
    encoder = features.withColumn("w_enc", F.transform(F.sequence(F.lit(0), F.lit(d_model - 1)), draw))
    return encoder.select("feature_id", "w_enc", F.lit(0.0).alias("b_enc"), unit("w_enc").alias("w_dec"))


def model_bytes(d_model: int, d_sae: int) -> int:
    return 2 * 8 * d_model * d_sae


def arrays_from_rows(weights: DataFrame, d_model: int, d_sae: int) -> dict[str, np.ndarray]:
    """A weight table as arrays, read a bounded block of features at a time."""
    width = max(1, MODEL_BLOCK_BYTES // (2 * 8 * d_model))
    arrays = {
        "w_enc": np.zeros((d_sae, d_model)), "b_enc": np.zeros(d_sae), "w_dec": np.zeros((d_sae, d_model))
    }
    for start in range(0, d_sae, width):
        block = weights.where((F.col("feature_id") >= start) & (F.col("feature_id") < start + width))
        table = block.select("feature_id", "w_enc", "b_enc", "w_dec").toArrow()
        for batch in table.to_batches():
            ids = batch.column("feature_id").to_numpy()
            arrays["b_enc"][ids] = batch.column("b_enc").to_numpy()
            for name in ("w_enc", "w_dec"):
                arrays[name][ids] = to_matrix(batch.column(name), d_model, float)
    return arrays


def params_from_rows(weights: DataFrame, d_model: int, d_sae: int, **options) -> SaeParams:
    """Driver-held parameters of a fresh model."""
    zeros = {"b_dec": np.zeros(d_model), "activation_mean": np.zeros(d_model)}
    return SaeParams(**arrays_from_rows(weights, d_model, d_sae), **zeros, **options)


def normalize_decoder(params: SaeParams) -> SaeParams:
    norms = np.sqrt((params.w_dec**2).sum(axis=1, keepdims=True))
    return replace(params, w_dec=params.w_dec / np.maximum(norms, NORM_FLOOR))


# --- shipping weights to tasks -------------------------------------------------


def share_arrays(
    spark: SparkSession, arrays: dict[str, np.ndarray], limit: int = BROADCAST_LIMIT_BYTES
) -> Callable[[], dict[str, np.ndarray]]:
    """A function that returns the arrays inside a task.

    Up to ``limit`` bytes they are broadcast. Beyond it they are written once
    to the shared folder and registered as Spark files: each executor fetches
    one copy, and its workers share the mapped pages.
    """
    if sum(array.nbytes for array in arrays.values()) <= limit:
        handle = spark.sparkContext.broadcast(arrays)
        return lambda: handle.value

    location = as_uri(staging_path(spark, "weights"))
    filesystem, root = task_filesystem(location)
    filesystem.create_dir(root, recursive=True)
    tag = uuid.uuid4().hex
    names = {}
    for key, array in arrays.items():
        names[key] = f"{key}-{tag}.npy"
        with filesystem.open_output_stream(f"{root}/{names[key]}") as sink:
            np.lib.format.write_array(sink, np.ascontiguousarray(array), allow_pickle=False)
        spark.sparkContext.addFile(f"{location}/{names[key]}")

    def load():
        return {key: np.load(SparkFiles.get(name), mmap_mode="r") for key, name in names.items()}

    return load


# --- numpy kernels on one Arrow batch ------------------------------------------


def to_matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A list column as a matrix; every row must have ``width`` values."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != width).any():
        raise ValueError(f"every vector must have {width} values")
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def centre(x: np.ndarray, weights: dict, normalize: str, apply_b_dec: bool) -> np.ndarray:
    if normalize == "expected_average_only_in":
        x = x - weights["activation_mean"]
    elif normalize == "layer_norm":
        shifted = x - x.mean(axis=1, keepdims=True)
        x = shifted / np.sqrt((shifted**2).mean(axis=1, keepdims=True) + LAYER_NORM_EPS)
    return x - weights["b_dec"] if apply_b_dec else x


def feature_blocks(centred: np.ndarray, weights: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """Activations of a bounded block of features at a time."""
    d_sae = weights["w_enc"].shape[0]
    width = max(1, CELLS_PER_STEP // max(1, len(centred)))
    for start in range(0, d_sae, width):
        block = slice(start, min(start + width, d_sae))
        acts = centred @ weights["w_enc"][block].T + weights["b_enc"][block]
        yield block, np.maximum(acts, 0, out=acts)


def active_cells(
    centred: np.ndarray, weights: dict, keep: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every positive activation, rows in order.

    With ``keep``, a feature's values below its ``keep``-th largest in these
    rows are left out: they cannot be among its ``keep`` largest overall.
    """
    parts = []
    for block, acts in feature_blocks(centred, weights):
        if keep is not None and len(acts) > keep:
            bar = np.partition(acts, len(acts) - keep, axis=0)[len(acts) - keep]
            rows, features = np.nonzero((acts >= bar) & (acts > 0))
        else:
            rows, features = np.nonzero(acts)
        parts.append((rows, features + block.start, acts[rows, features]))
    rows, features, values = (np.concatenate(column) for column in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(rows, kind="stable")
        rows, features, values = rows[order], features[order], values[order]
    return rows, features, values


class TopCells:
    """The ``k`` largest positive activations of every feature, ties to the smaller index; at most k cells each.

    Cells arrive unordered and are merged into the sorted buffer when as many
    wait as it may hold. A value below its feature's k-th largest so far can't
    be among the largest and isn't taken.
    """

    def __init__(self, d_sae: int, k: int):
        self.k, self.limit = k, max(k * d_sae, 1)
        self.bar = np.zeros(d_sae)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.features, self.values, self.index = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, index: np.ndarray, acts: np.ndarray, begin: int) -> None:
        """Activations of rows (with their indices) for the features from ``begin`` on."""
        bar = self.bar[begin : begin + acts.shape[1]]
        if len(acts) > self.k:
            bar = np.maximum(bar, np.partition(acts, len(acts) - self.k, axis=0)[len(acts) - self.k])
        rows, features = np.nonzero((acts >= bar) & (acts > 0))
        self.take(features + begin, acts[rows, features].astype(float), index[rows])

    def take(self, features: np.ndarray, values: np.ndarray, index: np.ndarray) -> None:
        self.waiting.append((features, values, index))
        self.n_waiting += len(features)
        if self.n_waiting > self.limit:
            self.merge()

    def merge(self) -> None:
        parts = zip((self.features, self.values, self.index), *self.waiting, strict=True)
        features, values, index = (np.concatenate(part) for part in parts)
        order = np.lexsort((index, -values, features))
        features = features[order]
        place = np.arange(len(features)) - np.searchsorted(features, features, side="left")
        order = order[place < self.k]
        self.features, self.values, self.index = features[place < self.k], values[order], index[order]
        full = np.flatnonzero(place == self.k - 1)
        self.bar[features[full]] = np.maximum(self.bar[features[full]], self.values[np.searchsorted(self.features, features[full], side="right") - 1])
        self.waiting, self.n_waiting = [], 0


def to_feature_lists(n_rows: int, rows: np.ndarray, features: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int32)
    cells = pa.StructArray.from_arrays(
        [pa.array(features.astype(np.int32)), pa.array(values.astype(np.float64))],
        fields=list(ARROW_FEATURES.value_type),
    )
    return pa.ListArray.from_arrays(pa.array(offsets), cells)


def to_vectors(matrix: np.ndarray, dtype=np.float64) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=dtype).reshape(-1)))


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_STEP):
            yield batch.slice(start, ROWS_PER_STEP)


# --- the model -----------------------------------------------------------------


class SaeModel(Model):
    """A fitted sparse autoencoder that transforms DataFrames of vectors."""

    def __init__(self, params: SaeParams, broadcast_limit: int = BROADCAST_LIMIT_BYTES):
        super().__init__()
        self.parameters = params
        self.broadcast_limit = broadcast_limit

    def _shared(self, spark: SparkSession, feature_ids: Sequence[int] | None = None, decoder: bool = False):
        return self.parameters.share(spark, feature_ids, decoder, self.broadcast_limit)

    def _run(self, df: DataFrame, keys: Sequence[str], column: str, new_fields, emit,
             feature_ids: Sequence[int] | None = None, decoder: bool = False) -> DataFrame:
        """Maps Arrow batches; ``emit(batch, x, centred, weights)`` yields output batches."""
        load = self._shared(df.sparkSession, feature_ids, decoder)
        width, dtype = self.parameters.d_model, self.parameters.dtype
        normalize, apply_b_dec = self.parameters.normalize_activations, self.parameters.apply_b_dec_to_input
        narrow = df.select(*keys, column)
        schema = T.StructType([narrow.schema[key] for key in keys] + new_fields)

        def run(batches):
            weights = load()
            for batch in steps(batches):
                if batch.num_rows:
                    x = to_matrix(batch.column(len(keys)), width, dtype)
                    yield from emit(batch, x, centre(x, weights, normalize, apply_b_dec), weights)

        return narrow.mapInArrow(run, schema)

    def encode(self, df: DataFrame, keys: Sequence[str], column: str = "activation",
               feature_ids: Sequence[int] | None = None) -> DataFrame:
        """The keys and ``features``, the active features of each vector."""
        n_keys = len(keys)

        def emit(batch, x, centred, weights):
            rows, features, values = active_cells(centred, weights)
            lists = to_feature_lists(len(x), rows, weights["feature_ids"][features], values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], lists], [*batch.schema.names[:n_keys], "features"]
            )

        return self._run(df, keys, column, [T.StructField("features", FEATURES)], emit, feature_ids)

    def cells(self, df: DataFrame, keys: Sequence[str], column: str = "activation",
              feature_ids: Sequence[int] | None = None, top: int | None = None) -> DataFrame:
        """Long form: the keys, ``feature_id`` and ``act``, active features only.

        ``top`` leaves out cells that some ``top`` cells of their feature
        exceed, as far as a task sees; ties stay. A top-k of the result equals
        the top-k of all cells.
        """
        n_keys = len(keys)

        def emit(batch, x, centred, weights):
            rows, features, values = active_cells(centred, weights, top)
            taken = batch.select(list(range(n_keys))).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    *taken.columns,
                    pa.array(weights["feature_ids"][features].astype(np.int32)),
                    pa.array(values.astype(np.float64)),
                ],
                [*taken.schema.names, "feature_id", "act"],
            )

        fields = [T.StructField("feature_id", T.IntegerType()), T.StructField("act", T.DoubleType())]
        return self._run(df, keys, column, fields, emit, feature_ids)

    def top_cells(self, df: DataFrame, index: str, k: int, column: str = "activation") -> DataFrame:
        """``index, feature_id, act`` of each task's ``k`` largest cells per feature, whatever its number of rows.

        A top-k of the result equals the top-k of all cells. ``index`` holds whole numbers.
        """
        load = self._shared(df.sparkSession)
        width, dtype, d_sae = self.parameters.d_model, self.parameters.dtype, self.parameters.d_sae
        normalize, apply_b_dec = self.parameters.normalize_activations, self.parameters.apply_b_dec_to_input
        narrow = df.select(F.col(index).cast("bigint").alias(index), column)

        def run(batches):
            weights, top = load(), TopCells(d_sae, k)
            for batch in steps(batches):
                if batch.num_rows:
                    x = centre(to_matrix(batch.column(1), width, dtype), weights, normalize, apply_b_dec)
                    for block, acts in feature_blocks(x, weights):
                        top.add(batch.column(0).to_numpy(), acts, block.start)
            top.merge()
            for start in range(0, len(top.features), ROWS_PER_STEP * 16):
                part = slice(start, start + ROWS_PER_STEP * 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(top.index[part]), pa.array(top.features[part].astype(np.int32)), pa.array(top.values[part])],
                    [index, "feature_id", "act"],
                )

        return narrow.mapInArrow(run, f"`{index}` BIGINT, feature_id INT, act DOUBLE")

    def feature_partials(self, df: DataFrame, column: str = "activation") -> DataFrame:
        """Per task and active feature: ``max_act, sum_act, n_active``.

        This is the map-side half of a feature aggregate: a task sends at most
        one row per feature, however many tokens activate it. One more row,
        with ``feature_id`` ``ALL_ROWS``, counts the task's vectors.
        """
        load = self._shared(df.sparkSession)
        width, dtype = self.parameters.d_model, self.parameters.dtype
        normalize, apply_b_dec = self.parameters.normalize_activations, self.parameters.apply_b_dec_to_input
        d_sae = self.parameters.d_sae

        def run(batches):
            weights = load()
            top, total, count = np.zeros(d_sae), np.zeros(d_sae), np.zeros(d_sae, dtype=np.int64)
            n_rows = 0
            for batch in steps(batches):
                if not batch.num_rows:
                    continue
                n_rows += batch.num_rows
                x = to_matrix(batch.column(0), width, dtype)
                for block, acts in feature_blocks(centre(x, weights, normalize, apply_b_dec), weights):
                    np.maximum(top[block], acts.max(axis=0), out=top[block])
                    total[block] += acts.sum(axis=0)
                    count[block] += np.count_nonzero(acts, axis=0)
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(hit, ALL_ROWS).astype(np.int32)),
                    pa.array(np.append(top[hit], 0.0)),
                    pa.array(np.append(total[hit], 0.0)),
                    pa.array(np.append(count[hit], n_rows)),
                ],
                ["feature_id", "max_act", "sum_act", "n_active"],
            )

        schema = "feature_id INT, max_act DOUBLE, sum_act DOUBLE, n_active BIGINT"
        return df.select(column).mapInArrow(run, schema)

    def reconstruct(self, df: DataFrame, keys: Sequence[str], column: str = "activation") -> DataFrame:
        """The keys, ``features`` and ``reconstruction``."""
        n_keys = len(keys)

        def emit(batch, x, centred, weights):
            rows, features, values = active_cells(centred, weights)
            built = sparse_decode(len(x), rows, features, values, weights)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keys], to_feature_lists(len(x), rows, features, values), to_vectors(built)],
                [*batch.schema.names[:n_keys], "features", "reconstruction"],
            )

        fields = [T.StructField("features", FEATURES), T.StructField("reconstruction", T.ArrayType(T.DoubleType()))]
        return self._run(df, keys, column, fields, emit, decoder=True)

    def row_metrics(self, df: DataFrame, keys: Sequence[str], column: str = "activation") -> DataFrame:
        """The keys and, per vector, ``l0, act_sum, squared_error``.

        Enough for every sparsity and loss figure, without moving features or
        reconstructions out of the task.
        """
        n_keys = len(keys)

        def emit(batch, x, centred, weights):
            n = len(x)
            rows, features, values = active_cells(centred, weights)
            error = sparse_decode(n, rows, features, values, weights) - x
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:n_keys],
                    pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(rows, weights=values, minlength=n)),
                    pa.array((error.astype(np.float64) ** 2).sum(axis=1)),
                ],
                [*batch.schema.names[:n_keys], "l0", "act_sum", "squared_error"],
            )

        fields = [
            T.StructField("l0", T.LongType()),
            T.StructField("act_sum", T.DoubleType()),
            T.StructField("squared_error", T.DoubleType()),
        ]
        return self._run(df, keys, column, fields, emit, decoder=True)

    def group_partials(self, df: DataFrame, key: str, column: str = "activation") -> DataFrame:
        """Per task, group and bucket of features: ``bucket, seen``, a bitmap of the active ones, and sums.

        ``n, l0, squared_error`` stand in the row of bucket 0 and are 0 in others.
        Bitmaps are those of ``bitmap_or_agg``: 32,768 features each. A task
        hands over what it has after ``GROUPS_HELD`` groups, so it holds a bounded number.
        """
        load = self._shared(df.sparkSession, decoder=True)
        width, dtype, d_sae = self.parameters.d_model, self.parameters.dtype, self.parameters.d_sae
        normalize, apply_b_dec = self.parameters.normalize_activations, self.parameters.apply_b_dec_to_input
        narrow = df.select(F.col(key), column)
        n_buckets = -(-d_sae // BITMAP_FEATURES)

        def emit(groups: dict, key_type) -> pa.RecordBatch:
            keys, buckets, bitmaps, sums = [], [], [], []
            for group, (total, seen) in groups.items():
                bits = np.packbits(seen, bitorder="little").reshape(n_buckets, -1)
                for b in range(n_buckets):
                    if b == 0 or bits[b].any():
                        keys.append(group)
                        buckets.append(b)
                        bitmaps.append(bits[b].tobytes())
                        sums.append(total if b == 0 else np.zeros(3))
            sums = np.array(sums).reshape(-1, 3)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(buckets, pa.int32()), pa.array(bitmaps, pa.binary()),
                 pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)), pa.array(sums[:, 2])],
                [key, "bucket", "seen", "n", "l0", "squared_error"],
            )

        def run(batches):
            weights, groups, key_type = load(), {}, None
            for batch in steps(batches):
                if not batch.num_rows:
                    continue
                key_type = batch.schema.field(0).type
                x = to_matrix(batch.column(1), width, dtype)
                rows, features, values = active_cells(centre(x, weights, normalize, apply_b_dec), weights)
                error = ((sparse_decode(len(x), rows, features, values, weights) - x).astype(np.float64) ** 2).sum(axis=1)
                l0 = np.bincount(rows, minlength=len(x))
                coded = batch.column(0).dictionary_encode("encode")
                owner = coded.indices.to_numpy()
                order = np.argsort(owner[rows], kind="stable")
                ends = np.cumsum(np.bincount(owner[rows], minlength=len(coded.dictionary)))
                figures = np.stack([np.bincount(owner, w, len(coded.dictionary)) for w in (None, l0, error)], axis=1)
                for i, group in enumerate(coded.dictionary.to_pylist()):
                    if group not in groups:
                        if len(groups) == GROUPS_HELD:
                            yield emit(groups, key_type)
                            groups = {}
                        groups[group] = (np.zeros(3), np.zeros(n_buckets * BITMAP_FEATURES, bool))
                    total, seen = groups[group]
                    total += figures[i]
                    seen[features[order[ends[i - 1] if i else 0 : ends[i]]]] = True
            if groups:
                yield emit(groups, key_type)

        schema = T.StructType([narrow.schema[key], *T._parse_datatype_string(
            "bucket INT, seen BINARY, n BIGINT, l0 BIGINT, squared_error DOUBLE").fields])
        return narrow.mapInArrow(run, schema)

    def decode(self, df: DataFrame, keys: Sequence[str], column: str = "features") -> DataFrame:
        """The keys and ``reconstruction`` from sparse ``features``."""
        load = self._shared(df.sparkSession, decoder=True)
        n_keys = len(keys)
        narrow = df.select(*keys, F.col(column).cast(FEATURES).alias(column))

        def run(batches):
            weights = load()
            for batch in steps(batches):
                lists = batch.column(n_keys)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                cells = lists.flatten()
                built = sparse_decode(
                    batch.num_rows, rows, cells.field("feature_id").to_numpy(),
                    cells.field("act").to_numpy(), weights,
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_keys], to_vectors(built)], [*batch.schema.names[:n_keys], "reconstruction"]
                )

        schema = T.StructType(
            [narrow.schema[key] for key in keys] + [T.StructField("reconstruction", T.ArrayType(T.DoubleType()))]
        )
        return narrow.mapInArrow(run, schema)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds ``features`` and ``reconstruction`` for the column ``activation``."""
        return self.reconstruct(dataset, dataset.columns)

    # --- persistence

    def save(self, path: str, metadata: dict | None = None) -> None:
        """Parameter rows as Parquet and the rest as one JSON row."""
        spark = SparkSession.active()
        params = self.parameters
        for number, block in enumerate(params.rows(spark)):
            block.write.mode("append" if number else "overwrite").parquet(f"{path}/weights")
        common = {
            "d_model": params.d_model,
            "d_sae": params.d_sae,
            "dtype": str(params.dtype),
            "b_dec": params.b_dec.astype(float).tolist(),
            "activation_mean": params.activation_mean.astype(float).tolist(),
            "activation_mean_initialized": bool(params.mean_initialized),
            "normalize_activations": params.normalize_activations,
            "apply_b_dec_to_input": bool(params.apply_b_dec_to_input),
            "metadata": {**params.metadata, **(metadata or {})},
        }
        spark.createDataFrame([(json.dumps(common),)], "value STRING").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/model")

    @staticmethod
    def load(path: str, spark: SparkSession | None = None, driver_limit: int = DRIVER_LIMIT_BYTES) -> SaeModel:
        """A saved model; above ``driver_limit`` bytes its weights stay at ``path``."""
        spark = spark or SparkSession.active()
        saved = json.loads(spark.read.text(f"{path}/model").first()["value"])
        d_model, d_sae, dtype = saved["d_model"], saved["d_sae"], np.dtype(saved["dtype"])
        common = {
            "b_dec": np.asarray(saved["b_dec"], dtype=dtype),
            "activation_mean": np.asarray(saved["activation_mean"], dtype=dtype),
            "normalize_activations": saved["normalize_activations"],
            "apply_b_dec_to_input": saved["apply_b_dec_to_input"],
            "mean_initialized": saved["activation_mean_initialized"],
            "metadata": saved["metadata"],
        }
        if model_bytes(d_model, d_sae) > driver_limit:
            return SaeModel(SaeTable(f"{path}/weights", d_sae, d_model, dtype=dtype, **common))
        arrays = arrays_from_rows(spark.read.parquet(f"{path}/weights"), d_model, d_sae)
        return SaeModel(SaeParams(**{name: array.astype(dtype) for name, array in arrays.items()}, **common))


def sparse_decode(n_rows: int, rows, features, values, weights: dict) -> np.ndarray:
    """Rebuilds vectors from active cells, a bounded block of features at a time."""
    w_dec = weights["w_dec"]
    built = np.tile(np.asarray(weights["b_dec"], dtype=w_dec.dtype), (n_rows, 1))
    if not len(rows):
        return built
    width = max(1, CELLS_PER_STEP // max(1, n_rows))
    for start in range(0, len(w_dec), width):
        inside = (features >= start) & (features < start + width)
        if inside.any():
            dense = np.zeros((n_rows, min(width, len(w_dec) - start)), dtype=w_dec.dtype)
            dense[rows[inside], features[inside] - start] = values[inside]
            built += dense @ w_dec[start:start + width]
    return built


# --- metrics -------------------------------------------------------------------


def sparsity_metrics(model: SaeModel, df: DataFrame) -> DataFrame:
    """``l0`` (active per row), ``l1_mean`` (over all cells), ``frac_active``."""
    d_sae = model.parameters.d_sae
    features = model.feature_partials(df).groupBy("feature_id").agg(
        F.sum("sum_act").alias("sum_act"), F.sum("n_active").alias("n_active")
    )
    alive = F.col("feature_id") != ALL_ROWS
    overall = features.agg(
        F.coalesce(F.sum(F.when(alive, F.col("n_active"))), F.lit(0)).alias("cells"),
        F.coalesce(F.sum(F.when(alive, F.col("sum_act"))), F.lit(0.0)).alias("acts"),
        F.count_if(alive).alias("alive"),
        F.sum(F.when(~alive, F.col("n_active"))).alias("n_rows"),
    )
    return overall.select(
        (F.col("cells") / F.col("n_rows")).alias("l0"),
        (F.col("acts") / (F.col("n_rows") * d_sae)).alias("l1_mean"),
        (F.col("alive") / F.lit(d_sae)).alias("frac_active"),
    )


def batch_metrics(metrics: DataFrame, d_model: int, d_sae: int, by: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Loss figures of each batch from per-row metrics."""
    return metrics.groupBy(*by).agg(
        (F.avg("squared_error") / d_model).alias("recon_loss"),
        (F.avg("act_sum") / d_sae).alias("l1_loss"),
        F.avg("l0").alias("l0"),
    )


def epoch_metrics(per_batch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain means of the batch figures: a short last batch weighs the same."""
    return per_batch.groupBy(*by).agg(
        F.avg("recon_loss").alias("recon_loss"), F.avg("l1_loss").alias("l1_loss"), F.avg("l0").alias("l0")
    )


def with_loss(metrics: DataFrame, l1_coeff: float = 1e-3) -> DataFrame:
    return metrics.withColumn("loss", F.col("recon_loss") + F.lit(l1_coeff) * F.col("l1_loss"))


def active_features(encoded: DataFrame) -> DataFrame:
    """Adds the ids of active features and their number."""
    active = F.filter("features", lambda f: f["act"] > 0)
    return encoded.withColumns({
        "active": F.transform(active, lambda f: f["feature_id"]),
        "n_active": F.size(active),
    })


def mean_by_batch(df: DataFrame, column: str = "activation", batch: str = "batch_id") -> DataFrame:
    """Mean vector and row count of each batch, combined before the shuffle."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    return df.groupBy(batch).agg(
        vector_to_array(Summarizer.mean(vector)).alias("batch_mean"), F.count("*").alias("n_rows")
    )


def running_mean(batch_means: DataFrame, momentum: float = 0.01, batch: str = "batch_id") -> DataFrame:
    """The exponentially weighted mean after the last batch, as one row.

    The first batch starts the mean; each later one enters with ``momentum``.
    A run of batches is an affine map of the mean before it: it keeps
    ``(1-m) ** n`` of that and adds its own weighted sum. Maps of batches that
    follow one another compose, so tasks combine what they read and one row
    per group of batches is left: one pass, and no look at the last batch first.
    """
    vector = array_to_vector("batch_mean")
    start = F.col(batch) == 0
    group = F.expr(f"`{batch}` div {MEAN_GROUP}")
    # weights count from the end of the group, so none depends on what comes later
    left = F.lit(MEAN_GROUP - 1) - F.pmod(F.col(batch), F.lit(MEAN_GROUP))
    weight = F.pow(F.lit(1.0 - momentum), left) * F.when(start, 1.0).otherwise(momentum)
    groups = batch_means.groupBy(group.alias("_group")).agg(
        Summarizer.sum(vector, weight).alias("_sum"), F.max(batch).alias("_last")
    )
    # one row per group; only the last may be short, which the last batch of all tells
    last = F.max("_last").over(Window.partitionBy())
    after = (last - (F.col("_group") + 1) * MEAN_GROUP + 1).cast("double")
    scaled = groups.withColumn("_decay", F.pow(F.lit(1.0 - momentum), after))
    return scaled.agg(vector_to_array(Summarizer.sum(F.col("_sum"), F.col("_decay"))).alias("activation_mean"))

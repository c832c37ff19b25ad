"""Quality classifier: naive Bayes support vectors over n-grams of words and of word shapes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclens.session import release, stage

from . import query
from .texts import RUN_BYTES, documents, flat, lowered, mix64, runs, seeded, small_batches, span_hashes, whole, word_bounds

#: Labelled rows that are fitted on at most, and n-grams in them; smallest seeded hashes first, texts whole.
FIT_ROWS = 16_000
FIT_GRAMS = 6_000_000
FEATURES = 1 << 18
ORDER = 3
#: Final bytes of a word that n-grams tell apart; all others are one class.
ENDINGS = ".,;:!?#*$%&|<>\"')]}-_=/"


def word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small number per word: its case, last character, length class, and whether it repeats the word before."""
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122) | (data >= 0x80))])
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    title = (data[starts] >= 65) & (data[starts] <= 90) & (ups == 1)
    case = np.select([(ups == 0) & (lows == 0), ups == 0, title, lows == 0], [0, 1, 2, 3], 4)
    classes = np.zeros(256, np.int64)
    for i, mark in enumerate(ENDINGS):
        classes[ord(mark)] = i + 2
    classes[48:58] = 1
    size = np.searchsorted([2, 4, 8, 16], ends - starts, side="right")
    hashes = span_hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][first[:-1] < len(again)]] = False
    return ((case * 32 + classes[data[ends - 1]]) * 5 + size) * 2 + again


def rolling(numbers: np.ndarray, features: int, salt: int) -> list[np.ndarray]:
    """The n-grams of 1 to ``ORDER`` numbers that begin at each place, as numbers under ``features``."""
    grams = []
    rolled = np.zeros(len(numbers), np.uint64)
    for n in range(ORDER):
        rolled = mix64(rolled[: len(numbers) - n] + numbers[n:] + np.uint64(salt + n))
        grams.append((rolled % np.uint64(features)).astype(np.int32))
    return grams


def gram_features(data: np.ndarray, offsets: np.ndarray, features: int = FEATURES) -> list[np.ndarray]:
    """Each row's distinct n-grams of 1 to 3 words, A-Z lowered, and of 1 to 3 word shapes, as numbers under ``features``."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.int32)] * (len(offsets) - 1)
    shapes = word_shapes(data, starts, ends, first).astype(np.uint64)
    grams = [*rolling(span_hashes(lowered(data), starts, ends), features, 1), *rolling(shapes, features, 1 + ORDER)]
    rows = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        rows.append(np.unique(np.concatenate([gram[a : max(a, b - i % ORDER)] for i, gram in enumerate(grams)])))
    return rows


def log_count_ratios(rows: list[np.ndarray], positive: np.ndarray, features: int) -> np.ndarray:
    """``log (p / |p|) / (q / |q|)`` of the classes' smoothed n-gram counts."""
    sums = []
    for side in (True, False):
        held = [row for row, is_positive in zip(rows, positive, strict=True) if is_positive == side]
        counts = np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=features) + 1.0
        sums.append(np.log(counts / counts.sum()))
    return sums[0] - sums[1]


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, features: int, *, c: float = 1.0,
    rounds: int = 30, tolerance: float = 1e-3, seed: int = 7,
) -> np.ndarray:
    """Weights of the linear hinge-loss model; the last is the bias. ``target`` is 1 or -1."""
    weights = np.zeros(features + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([value @ value + 1.0 for value in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            row, value, y = rows[i], values[i], target[i]
            slope = y * (value @ weights[row] + weights[-1]) - 1.0
            projected = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= c else slope
            if projected == 0.0:
                continue
            worst = max(worst, abs(projected))
            old, alpha[i] = alpha[i], min(max(alpha[i] - slope / norms[i], 0.0), c)
            weights[row] += (alpha[i] - old) * y * value
            weights[-1] += (alpha[i] - old) * y
        if worst < tolerance:
            break
    return weights


def calibration(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margins to chances, by Newton steps with smoothed targets."""
    n_pos, n_neg = positive.sum(), (~positive).sum()
    aim = np.where(positive, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - aim) * margins).sum() + 1e-3 * a, (p - aim).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 2 / max(size, 1e-9)), b - step[1] * min(1, 2 / max(size, 1e-9))
        if size < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


@dataclass
class NbSvm:
    """One weight per n-gram: its log-count ratio times the fitted weight; the same size for any corpus."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], positive: np.ndarray, features: int = FEATURES) -> NbSvm:
        """The logistic curve is set on margins of rows that the weights were not fitted on, in five folds.

        With one class or no rows every score is that class's share.
        """
        if not len(rows) or positive.all() or not positive.any():
            share = (positive.sum() + 1) / (len(rows) + 2)
            return cls(np.zeros(features), 0.0, 1.0, float(np.log(share / (1 - share))))
        fold = np.arange(len(rows)) % 5
        margins = np.zeros(len(rows))
        for k in range(5):
            out = fold == k
            part = cls._weights([row for row, is_out in zip(rows, out, strict=True) if not is_out], positive[~out], features)
            margins[out] = part.margins([row for row, is_out in zip(rows, out, strict=True) if is_out])
        model = cls._weights(rows, positive, features)
        model.slope, model.shift = calibration(margins, positive)
        return model

    @classmethod
    def _weights(cls, rows: list[np.ndarray], positive: np.ndarray, features: int) -> NbSvm:
        ratios = log_count_ratios(rows, positive, features)
        values = [cls.scaled(ratios, row) for row in rows]
        fitted = dual_coordinate_descent(rows, values, np.where(positive, 1.0, -1.0), features)
        return cls(fitted[:-1] * ratios, float(fitted[-1]), 1.0, 0.0)

    @staticmethod
    def scaled(ratios: np.ndarray, row: np.ndarray) -> np.ndarray:
        return ratios[row] / np.sqrt(max(len(row), 1))

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[row].sum() / np.sqrt(max(len(row), 1)) + self.bias for row in rows])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", limit: int = FIT_ROWS,
                grams: int = FIT_GRAMS, id_column: str = "doc_id", text: str = "text") -> NbSvm:
    """Fits on at most ``limit`` labelled rows, those with the smallest seeded hash of the id.

    Of these the first are taken whose n-grams are at most ``grams`` together:
    long texts mean fewer rows, never shorter texts. A row without text or
    label is not fitted on, rows that repeat an id and a text are one, and of
    several labels the largest counts.
    """
    place = ["place", "id", "h"]
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id")).agg(F.max(label).alias("y"))
        .withColumn("place", seeded("id", "fit")).orderBy("place", "id").limit(limit)
    )
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text")).join(F.broadcast(chosen), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for start, end in runs(offsets, RUN_BYTES):
                found = gram_features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_pydict({
                    **{name: part.column(name) for name in (*place, "y")},
                    "n": pa.array([len(row) for row in found], pa.int64()), "row": pa.array(found, pa.list_(pa.int32())),
                })

    kind = docs.schema[id_column].dataType.simpleString()
    read = rows.select("place", "id", F.xxhash64("text").alias("h"), F.col("y").cast("int").alias("y"), "text")
    made = stage(
        small_batches(read).mapInArrow(features, f"place string, id {kind}, h bigint, y int, n bigint, row array<int>")
        .dropDuplicates(place),
        "quality-rows",
    )
    sizes = made.select(*place, "n").orderBy(*place).limit(limit).toArrow()  # three numbers a row
    taken = int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), grams, side="right"))
    if taken == 0:
        release(made)
        return NbSvm.fit([], np.zeros(0, bool))
    last = F.struct(*[F.lit(sizes.column(name)[taken - 1].as_py()).cast(made.schema[name].dataType).alias(name) for name in place])
    # at most ``grams`` numbers, which one task takes in this order; the driver gets the model alone
    taken_rows = made.where(F.struct(*place) <= last).select(*place, "y", "row").repartition(1).sortWithinPartitions(*place)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, y = [], []
        for batch in batches:
            lists = batch.column("row")
            ends = np.cumsum(lists.value_lengths().to_numpy())
            found += np.split(lists.flatten().to_numpy(), ends[:-1]) if len(batch) else []
            y.append(batch.column("y").to_numpy())
        order = np.random.default_rng(3).permutation(len(found))
        model = NbSvm.fit([found[i] for i in order], np.concatenate(y)[order] == 1)
        numbers = {name: [getattr(model, name)] for name in ("bias", "slope", "shift")}
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), **numbers})

    model = taken_rows.mapInArrow(fit, "weights binary, bias double, slope double, shift double").collect()[0]
    release(made)
    return NbSvm(np.frombuffer(bytes(model.weights)), model.bias, model.slope, model.shift)


def score_quality(docs: DataFrame, model: NbSvm, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and score of every row, 0 to 1; higher is likelier good.

    A null or empty text scores by the bias alone, repeated and null ids stay as
    they are, an empty table gives no rows, and other columns are not read. The
    whole text counts. No shuffle; the model goes to each executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``FEATURES`` numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for start, end in runs(offsets, RUN_BYTES):
                found = gram_features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                yield pa.RecordBatch.from_pydict(
                    {"id": batch.column(0).slice(start, end - start), "score": shared.value.scores(found)}
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    return small_batches(rows).mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, model: NbSvm, threshold: float, *, text: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more, all columns as they are; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            for start, end in runs(offsets, RUN_BYTES):
                found = gram_features(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                yield batch.slice(start, end - start).filter(pa.array(shared.value.scores(found) >= threshold))

    return small_batches(docs).mapInArrow(keep, docs.schema)


def id_fold(folds: int, id_column: str = "doc_id") -> Column:
    """``crc32`` of the id as text, modulo ``folds``; of an empty text for a null id."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def train_labels(spark, sf_dir: str) -> DataFrame:
    """The labelled rows outside the held-out fold."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_fold(5) != 0)


@query("op7_nbsvm")
def op7_nbsvm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, train_labels(spark, sf_dir))
    return score_quality(docs, model).select(
        "doc_id", (id_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )

"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding look-alikes."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .nbsvm import id_fold
from .texts import documents, seeded, small_batches, whole

#: Labelled rows of each class that the lexicon is learned from at most; smallest seeded hashes first.
FIT_TOXIC, FIT_CLEAN = 4_000, 6_000
#: Clean rows of the sample that an exception phrase is in at least.
LEAST_CLEAN = 3
#: A term is in so many toxic rows at least, and so many times likelier there.
LEAST_ROWS, LEAST_RATIO = 4, 6.0
SHORTEST, LONGEST = 4, 14

#: Letters of other scripts, digits and signs that pass for Latin letters. l, 1, ! and | are one with i.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "i", "ѵ": "v",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
          "|": "i", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
SEPARATORS = "\t\n\x0b\x0c\r\"#%&'()*+,-./:;<=>?[\\]^_`{}~"


def folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    table |= {ord(c): None for c in INVISIBLE}
    return table | {ord(c): " " for c in SEPARATORS}


def fold(text: str, table: dict[int, str | None]) -> str:
    """Lower-case, look-alikes folded, one space between words and at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {' '.join(text.lower().translate(table).split())} "


def prefixes(words: Iterable[str]) -> set[str]:
    """Beginnings that may be terms; a word too short for one is a term as a whole, with its space."""
    words = set(words)
    return {word[:n] for word in words for n in range(SHORTEST, min(len(word), LONGEST) + 1)} | {
        f"{word} " for word in words if len(word) < SHORTEST
    }


@dataclass
class Lexicon:
    """Terms (beginnings of folded words) with weights, exception phrases, and the curve of the score."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def __post_init__(self):
        self.table = folding()

    def hits(self, folded: str, automaton) -> list[tuple[int, float]]:
        """Begin and weight of the longest term at each place, without those inside exception phrases."""
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or length > best[start][0]:
                best[start] = (length, weight)
        if not spared:
            return [(start, weight) for start, (_, weight) in best.items()]
        spared.sort()
        begins = [a for a, _ in spared]
        reach = list(accumulate((b for _, b in spared), max))  # how far phrases go that begin so early
        found = []
        for start, (length, weight) in best.items():
            before = bisect_right(begins, start)
            if not before or reach[before - 1] < start + length - 1:
                found.append((start, weight))
        return found

    def features(self, text: str, automaton) -> tuple[float, float]:
        """Sum of the weights found and the same per 100 words, both as ``log(1 + x)``."""
        folded = fold(text, self.table)
        found = sum(weight for _, weight in self.hits(folded, automaton))
        if not found:
            return 0.0, 0.0
        return float(np.log1p(found)), float(np.log1p(100.0 * found / max(len(folded.split()), 1)))

    def score(self, features: np.ndarray) -> np.ndarray:
        bias, total, share = self.curve
        return 1 / (1 + np.exp(-np.clip(bias + features[:, 0] * total + features[:, 1] * share, -30, 30)))


def marking(counted: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """``term, toxic, weight``: terms that are ``LEAST_RATIO`` times likelier in toxic rows, by their log ratio.

    ``counted`` has ``term, toxic, clean``, the rows of each class with it. Of
    beginnings that stand for the same words only the longest is taken
    (``trash`` for ``tra``): one that a longer one nearly always follows goes.
    """
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    parent = F.expr("left(term, char_length(term) - 1)")
    followed = counted.groupBy(parent.alias("term")).agg(F.max("toxic").alias("longer"))
    marked = counted.where((F.col("toxic") >= LEAST_ROWS) & (ratio >= LEAST_RATIO))
    alone = F.coalesce(F.col("longer") < 0.95 * F.col("toxic"), F.lit(True))
    return marked.join(followed, "term", "left").where(alone).select("term", "toxic", F.log(ratio).alias("weight"))


def without_longer(weights: dict[str, float]) -> dict[str, float]:
    """Leaves out longer terms if a beginning of theirs marks toxic rows as well."""
    kept: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (len(t), t)):
        shorter = max((kept[term[:n]] for n in range(SHORTEST, len(term)) if term[:n] in kept), default=None)
        if shorter is None or weights[term] > shorter + 0.7:
            kept[term] = weights[term]
    return kept


def fit_curve(features: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Logistic curve on the two features; its shift is set for the share of toxic rows among all labels."""
    x = np.column_stack([np.ones(len(features)), features])
    y = toxic.astype(float)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.05 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    seen = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    return float(w[0] + np.log(prior / (1 - prior)) - np.log(seen / (1 - seen))), float(w[1]), float(w[2])


def _counted(rows: DataFrame, of_text, name: str = "term") -> DataFrame:
    """How many rows have each of ``of_text(text)``; pre-aggregated in tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(of_text(text))
            if counts:
                yield pa.RecordBatch.from_pydict({name: list(counts), "c": pa.array(list(counts.values()), pa.int64())})

    return rows.select("text").mapInArrow(count, f"{name} string, c bigint").groupBy(name).agg(F.sum("c").alias("c"))


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_column: str = "doc_id",
                  text: str = "text") -> Lexicon:
    """Learns terms, exceptions and curve from bounded samples of the labelled rows of each class.

    Rows without label or id are left out; of several labels the largest counts.
    Both classes are counted in Spark and terms and phrases are chosen there by
    how many rows of each have them; none is cut off. What comes to the driver
    marks at least ``LEAST_ROWS`` of the sample's toxic rows, or spares
    ``LEAST_CLEAN`` clean ones, so the sample bounds it.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("id")).agg(F.max(label).alias("y"))
    known = stage(known, "toxic-labels")
    sizes = {row.y: row.c for row in known.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    chosen = known.where("y = 1").orderBy(seeded("id", "fit"), "id").limit(FIT_TOXIC).union(
        known.where("y != 1").orderBy(seeded("id", "fit"), "id").limit(FIT_CLEAN))
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = stage(rows.select("id", "y", "text"), "toxic-sample")
    toxic, clean = rows.where("y = 1"), rows.where("y != 1")
    table = folding()

    def own(body: str) -> set[str]:
        return prefixes(fold(body, table).split())

    both = _counted(toxic, own).withColumnRenamed("c", "toxic").join(
        _counted(clean, own).withColumnRenamed("c", "clean"), "term", "left"
    ).fillna(0, ["clean"])
    n_toxic, n_clean = toxic.count(), clean.count()
    marked = marking(stage(both, "toxic-terms"), n_toxic, n_clean)
    lexicon = Lexicon(without_longer({row.term: row.weight for row in marked.collect()}))

    def phrases(body: str) -> set[str]:
        folded = fold(body, table)
        words, found = folded.split(), set()
        starts = list(accumulate((len(word) + 1 for word in words), initial=0))
        for start, _ in lexicon.hits(folded, automaton_of(lexicon)):
            at = bisect_right(starts, start) - 1  # the word that the term begins
            found.add(" ".join(words[max(at - 1, 0) : at + 1]))
            found.add(" ".join(words[at : at + 2]))
        return {phrase for phrase in found if " " in phrase}

    spared = _counted(clean, phrases).where(F.col("c") >= LEAST_CLEAN)
    against = _counted(toxic, phrases).select("term")
    lexicon.exceptions = sorted(row.term for row in spared.join(against, "term", "left_anti").collect())
    seen = rows.select("id", "y", "text").mapInArrow(measure(lexicon), f"y int, total double, share double").toArrow()
    columns = [seen.column(name).to_numpy() for name in ("total", "share", "y")]
    order = np.lexsort(columns)
    lexicon.curve = fit_curve(np.column_stack(columns[:2])[order], columns[2][order] == 1, prior)
    return lexicon


def automaton_of(lexicon: Lexicon):
    """Built once for every copy of the lexicon that a task has."""
    if "built" not in lexicon.__dict__:
        lexicon.__dict__["built"] = lexicon.automaton()
    return lexicon.__dict__["built"]


def measure(lexicon: Lexicon):
    """A task that gives label and features of rows ``id, y, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = np.array([lexicon.features(text, automaton) for text in batch.column(2).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {"y": batch.column(1).cast(pa.int32()), "total": found[:, 0], "share": found[:, 1]}
            )

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and score of every row, 0 to 1; higher is likelier toxic.

    The whole text is folded and matched. A null or empty text has no match,
    repeated and null ids stay as they are, an empty table gives no rows, and
    other columns are not read. No shuffle; the lexicon, bounded by its limits,
    goes to each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                found = np.array([lexicon.features(body, automaton) for body in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column(0), "score": lexicon.score(found.reshape(-1, 2))}
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text"))
    return small_batches(rows).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(id_fold(3) != 1)
    lexicon = learn_lexicon(docs, labels)
    return score_toxicity(docs, lexicon).select(
        "doc_id", (id_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )

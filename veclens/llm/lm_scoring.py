"""Language-model scores of whole documents, with a recurrent model that Spark trains on the corpus itself."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import gru, query
from .nbsvm import id_fold
from .texts import documents, flat, lowered, packed, runs, small_batches, white_mask, whole, word_bounds

#: Bytes of text whose words are counted together in a task.
RUN = 8 << 20
#: Frequent words that tasks know by heart; the counts of all others are joined.
KNOWN = 1 << 18
#: Words longer than this are known by a space, which no word has, and their hash.
LONG = 64
SMOOTH = 0.1
#: Sixty-fourths of the documents that are read in each round of training; every document once.
ROUNDS = (2, 6, 16, 40)
#: Numbers of the model that are averaged in one task, and the first sums of each.
BLOCK, SPREAD = 1 << 15, 64
#: Tokens of documents that a task trains on or scores at once, beyond the last document.
AT_ONCE = 4_000_000


def word_arrays(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All lower-cased words as a dictionary array, and each row's first word."""
    data = lowered(data)
    starts, ends, first = word_bounds(data, offsets)
    words = packed(data[~white_mask(data)], ends - starts)
    if len(words) and int((ends - starts).max()) > LONG:
        coded = words.dictionary_encode()
        names = [w if len(w) <= LONG else b" " + hashlib.sha256(w).hexdigest().encode() for w in coded.dictionary.to_pylist()]
        return pa.DictionaryArray.from_arrays(coded.indices, pa.array(names, pa.binary())), first
    return words.dictionary_encode(), first


def tail_class(word: bytes) -> int:
    """Rare words are classed by their ending, which tells languages apart."""
    return zlib.crc32(word[-3:]) % gru.TAIL_CLASSES


def tail_class_of(word: str) -> Column:
    return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(gru.TAIL_CLASSES)).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """``word, c`` of all words of ``text``, and the number of rows as the count of the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for start, end in runs(offsets, RUN):
                words, _ = word_arrays(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([words.dictionary, pa.array([b""], pa.binary())]), pa.array(np.append(counts, end - start))],
                    ["word", "c"],
                )

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with counts and model ids, and what the rest needs of the corpus; of bounded size."""

    def __init__(self, counted: DataFrame):
        """``counted`` has every training word once."""
        total = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(total.n or 0), int(total.v)
        words = counted.where(F.length("word") > 0)
        top = words.orderBy(F.desc("c"), "word").limit(KNOWN).toArrow()
        ends = counted.where(F.length("word") == 0).first()
        self.documents = int(ends.c) if ends else 0
        self.words = top.column("word").combine_chunks()
        self.counts = top.column("c").to_numpy().astype(np.int64)
        n_head = min(len(self.words), gru.HEAD - 1)
        self.head = np.concatenate([[self.documents], self.counts[:n_head]])
        self.ids = np.array([gru.HEAD + tail_class(w) for w in self.words.to_pylist()], np.int64)
        self.ids[:n_head] = np.arange(1, n_head + 1)
        # mass of the rare words of each class: all words, less those that the model knows one by one
        sums = words.groupBy(tail_class_of("word").alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
        self.tail = np.zeros(gru.TAIL_CLASSES)
        kinds = np.zeros(gru.TAIL_CLASSES)
        for row in sums:
            self.tail[row.k], kinds[row.k] = row.c, row.v
        own = [tail_class(w) for w in self.words.slice(0, n_head).to_pylist()]
        np.subtract.at(self.tail, own, self.counts[:n_head])
        np.subtract.at(kinds, own, 1)
        self.tail_total = self.tail + SMOOTH * (kinds + 1)  # one more for words never seen

    def start(self) -> gru.Params:
        return gru.start_model(self.head, self.tail)


def tokenized(docs: DataFrame, vocabulary: Vocabulary, id_column: str, text: str) -> DataFrame:
    """Each row's model ids and what its well-known words give; its other words as a list.

    ``id, held_out, n_tokens, n_known, base, share, ids, rare``: ``base`` sums
    log10 (count + 0.1) of known words, ``share`` what rare words have of their
    class; ``rare`` are the words whose counts are to be joined.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(  # at most KNOWN words
        (vocabulary.words, vocabulary.counts, vocabulary.ids, vocabulary.documents, vocabulary.tail_total)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, model_ids, n_docs, tail_total = shared.value
        log_tail = np.log10(tail_total)
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for start, end in runs(offsets, RUN):
                words, first = word_arrays(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
                found = pc.index_in(names, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                name_ids = np.where(found >= 0, model_ids[found] if len(model_ids) else 0, 0)
                unknown = np.flatnonzero(found < 0)
                name_ids[unknown] = [gru.HEAD + tail_class(w) for w in names.take(pa.array(unknown)).to_pylist()]
                log_count = np.where(found >= 0, np.log10((counts[found] if len(counts) else np.zeros(len(found))) + SMOOTH), 0.0)
                in_tail = name_ids >= gru.HEAD
                share = np.where(in_tail, log_count - log_tail[np.maximum(name_ids - gru.HEAD, 0)], 0.0)
                owner = np.repeat(np.arange(end - start), np.diff(first))

                def per_row(values: np.ndarray) -> np.ndarray:
                    return np.bincount(owner, weights=values[codes], minlength=end - start)

                rare = np.flatnonzero(found[codes] < 0)
                per_doc = np.bincount(owner[rare], minlength=end - start)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), names.take(pa.array(codes[rare]))
                )
                ids = np.insert(name_ids[codes], first[1:], gru.END).astype("<u2")
                sizes = np.diff(first) + 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start),
                    pa.array(sizes, pa.int64()),
                    pa.array(per_row(found >= 0).astype(np.int64) + (n_docs > 0)),
                    pa.array(per_row(log_count) + np.log10(n_docs + SMOOTH)),
                    pa.array(per_row(share)),
                    packed(ids.view(np.uint8), 2 * sizes),
                    lists,
                ], ["id", "held_out", "n_tokens", "n_known", "base", "share", "ids", "rare"])

    kind = docs.schema[id_column].dataType.simpleString()
    return small_batches(docs.select(F.col(id_column).alias("id"), "_held", whole(text).alias("text"))).mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, share double, ids binary, rare array<binary>"
    )


def blocks_of_rows(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Rows in tables of some ``AT_ONCE`` ids, or one longer document."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for start, end in runs(flat(batch.column(column))[1], 2 * AT_ONCE):
            part = batch.slice(start, end - start)
            own = len(flat(part.column(column))[0]) // 2
            if held and size + own > AT_ONCE:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.Table.from_batches(held)


def ids_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(table.column("ids"))
    return np.ascontiguousarray(data).view("<u2"), offsets // 2


def packed_model(*parts: gru.Params) -> np.ndarray:
    return np.concatenate([part[name].reshape(-1) for part in parts for name in sorted(part)]).astype("<f4")


def unpacked_model(flat_values: np.ndarray, like: gru.Params) -> list[gru.Params]:
    out, at = [], 0
    for _ in range(2):
        part = {}
        for name in sorted(like):
            part[name] = flat_values[at : at + like[name].size].reshape(like[name].shape).astype(np.float32)
            at += like[name].size
        out.append(part)
    return out


def train_round(rows: DataFrame, model: gru.Params, squares: gru.Params) -> tuple[gru.Params, gru.Params, int, float]:
    """Every task reads its documents from the same beginning; the models are averaged by tokens read.

    Averages are taken in blocks, first over spread groups of tasks, then over
    the groups, so no task and not the driver holds the models of all tasks.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model, squares))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer(*shared.value)
        for table in blocks_of_rows(batches, 0):
            ids, offsets = ids_of(table)
            fresh = np.zeros(len(ids), bool)
            fresh[offsets[:-1]] = True
            trainer.read(ids, fresh)
        if trainer.tokens:
            values = packed_model(trainer.model, trainer.squares)
            parts = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
            spread = zlib.crc32(values.tobytes()) % SPREAD
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(len(parts)), pa.int32()), "spread": pa.array([spread] * len(parts), pa.int32()),
                "weight": pa.array([float(trainer.tokens)] * len(parts)), "loss": pa.array([trainer.loss] * len(parts)),
                "sums": pa.array([p.tobytes() for p in parts], pa.binary()),
            })

    def add(batches: Iterator[pa.RecordBatch], models: bool = False) -> Iterator[pa.RecordBatch]:
        key, weight, loss, sums = None, 0.0, 0.0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "part": pa.array([key[0]], pa.int32()), "spread": pa.array([key[1]], pa.int32()), "weight": [weight], "loss": [loss],
                "sums": pa.array([sums.tobytes()], pa.binary()),
            })

        for batch in batches:
            for part, spread, w, lost, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (part, spread):
                    if key is not None:
                        yield done()
                    key, weight, loss, sums = (part, spread), 0.0, 0.0, 0.0
                own = np.frombuffer(s, "<f4").astype("<f8") * w if models else np.frombuffer(s, "<f8")
                weight, loss, sums = weight + w, loss + lost, sums + own
        if key is not None:
            yield done()

    schema = "part int, spread int, weight double, loss double, sums binary"
    order = ["part", "spread", "weight", "loss", F.xxhash64("sums")]  # sums in one order, whatever task ended first
    learned = rows.select("ids").mapInArrow(learn, schema)
    first = learned.repartition("part", "spread").sortWithinPartitions(*order).mapInArrow(
        lambda batches: add(batches, models=True), schema
    )
    second = first.withColumn("spread", F.lit(0)).repartition("part").sortWithinPartitions(*order).mapInArrow(add, schema)
    found = sorted(second.collect(), key=lambda row: row.part)  # one row per block of the model
    shared.destroy()
    if not found:
        return model, squares, 0, 0.0
    mean = np.concatenate([np.frombuffer(row.sums, "<f8") / row.weight for row in found])
    model, squares = unpacked_model(mean, model)
    return model, squares, int(found[0].weight), found[0].loss


def train(rows: DataFrame, model: gru.Params) -> gru.Params:
    """One pass over all rows in rounds that grow; each begins with the average of the round before."""
    squares = gru.start_squares(model)
    place = F.pmod(F.xxhash64("row"), F.lit(sum(ROUNDS)))
    begin = 0
    for share in ROUNDS:
        own = rows.where((place >= begin) & (place < begin + share))
        model, squares, _, _ = train_round(own, model, squares)
        begin += share
    return model


def score_documents(docs: DataFrame, held_out: Column, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every document under a model learned from those that are not ``held_out``.

    Returns the id, held_out, n_tokens, n_known, train_tokens, ``base_score``
    (log10 probability under smoothed counts of single words) and ``score``
    (log10 probability under the recurrent model, the end included). Words are
    lower-cased in A-Z only; whole texts are read, a null or empty text is its
    end alone, rows that repeat an id and null ids count one by one, an empty
    table gives no rows, other columns are not read.

    Counts are over all training words. The model has an output for each of the
    most frequent words, in classes; every other word belongs to a class by its
    ending, in which it has its share by counts, one never seen that of a tenth
    of a word. So a score is a probability over all words, as the base is. The
    weights, of a fixed size, are trained on all training documents: tasks read
    their documents, weights are averaged after each round. Words beyond the
    KNOWN most frequent are counted and joined by Spark as strings.
    """
    vocabulary, counted, rows = prepared(docs, held_out, id_column, text)
    model = train(rows.where("NOT held_out"), vocabulary.start())
    return scores(rows, counted, vocabulary, model).withColumnRenamed("id", id_column)


def prepared(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text: str = "text"):
    """Vocabulary and counts of the training words, and all documents as model ids."""
    marked = docs.select(id_column, text, F.coalesce(held_out, F.lit(False)).alias("_held"))
    counted = stage(count_words(small_batches(marked.where("NOT _held").select(whole(text).alias("text")))), "lm-words")
    vocabulary = Vocabulary(counted)
    rows = tokenized(marked, vocabulary, id_column, text).withColumn("row", F.monotonically_increasing_id())
    return vocabulary, counted, stage(rows, "lm-tokens")


def scores(rows: DataFrame, counted: DataFrame, vocabulary: Vocabulary, model: gru.Params) -> DataFrame:
    """Both scores of rows from ``prepared``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # fixed size
    narrow = [name for name in rows.columns if name not in ("ids", "rare")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks_of_rows(batches, 0):
            logs = gru.document_logs(shared.value, *ids_of(table)) / np.log(10)
            yield from table.drop_columns(["ids"]).append_column("log", pa.array(logs)).combine_chunks().to_batches()

    schema = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in narrow)
    scored = rows.select("ids", *narrow).mapInArrow(score, f"{schema}, log double")
    rare = rows.select("row", F.explode("rare").alias("word")).join(counted, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.count("c").alias("seen")
    )
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    each = float(np.log10(vocabulary.n + SMOOTH * (vocabulary.v + 1)))
    return scored.join(rare, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"),
        F.lit(vocabulary.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * each).alias("base_score"),
        (F.col("log") + F.col("share") + more).alias("score"),
    )


@query("op12_gru_lm")
def op12_gru_lm(spark, sf_dir):
    return score_documents(documents(spark, sf_dir), id_fold(10) == 0)

"""Spelling variants: a minimised acceptor of words, composed with a one-edit transducer and itself again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .texts import documents, flat, lowered, packed, runs, small_batches, spans, whole

#: Bytes of text whose runs of letters are counted together in a task.
RUN = 8 << 20
#: Longer runs get their checksum one by one.
LONG = 64


# ---- words


def crc_table() -> np.ndarray:
    """The table of the checksum, byte by byte from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def run_checksums(data: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes, which lie one after the other, continued from ``begin``."""
    table = crc_table()
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    at, size = starts[order], lengths[order]
    state = begin[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    n_long = int(np.searchsorted(-size, -LONG, side="left"))  # the longer ones stand first
    for k in range(n_long):
        run = data[at[k] : at[k] + size[k]].tobytes()
        state[k] = zlib.crc32(run, int(begin[order[k]])) ^ 0xFFFFFFFF
    at, rest, size = at[n_long:], state[n_long:], size[n_long:]
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        rest[:n] = table[(rest[:n] ^ data[at[:n] + t]) & np.uint32(255)] ^ (rest[:n] >> np.uint32(8))
    out = np.empty(len(lengths), np.uint32)
    out[order] = np.concatenate([state[:n_long], rest]) ^ np.uint32(0xFFFFFFFF)
    return out


def letter_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which are the two-byte characters that begin with 0xC3."""
    folded = data | 32
    mask = (folded >= 97) & (folded <= 122) & (data < 128)
    wide = data == 0xC3
    mask |= wide
    mask[1:] |= wide[:-1]
    return mask


def letter_runs(data: np.ndarray, offsets: np.ndarray, ids: list, every: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct lower-cased runs of letters with their counts; every ``every``-th by checksum loses a character."""
    mask = letter_mask(data)
    starts, ends, first = spans(mask, offsets)
    bare = lowered(data)[mask]
    lengths = ends - starts
    words = packed(bare, lengths)
    damaged = np.zeros(0, np.int64)
    if every and len(words):
        begin = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        sums = run_checksums(bare, lengths, np.repeat(begin, np.diff(first)))
        damaged = np.flatnonzero(sums % np.uint32(every) == 0)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(coded.dictionary)) - np.bincount(codes[damaged], minlength=len(coded.dictionary))
    texts = coded.dictionary.cast(pa.string())
    if not len(damaged):
        return texts, counts
    harmed = []
    for word, checksum in zip(texts.take(pa.array(codes[damaged])).to_pylist(), sums[damaged].tolist(), strict=True):
        at = checksum % len(word)
        harmed.append(word[:at] + word[at + 1 :])
    return pa.concat_arrays([texts, pa.array(harmed, pa.string())]), np.concatenate([counts, np.ones(len(harmed), np.int64)])


def vocabulary(docs: DataFrame, *, shortest: int, least: int, every: int, id_column: str, text: str) -> DataFrame:
    """``word, n``: words of at least ``shortest`` characters that occur ``least`` times or more in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            for start, end in runs(offsets, RUN):
                words, counts = letter_runs(
                    data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], ids[start:end], every
                )
                long = pc.greater_equal(pc.utf8_length(words), shortest).to_numpy(zero_copy_only=False) & (counts > 0)
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(long)), pa.array(counts[long])], ["word", "n"])

    rows = docs.select(F.col(id_column).cast("string").alias("id"), whole(text).alias("text"))
    counted = small_batches(rows).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- automata


class Acceptor:
    """The smallest automaton that accepts a sorted list of distinct words; states with one future are one."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states of the last word that may still grow
        last = ""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            self._settle(path, last, same)
            path += [({}, [False]) for _ in word[same:]]
            path[-1][1][0] = True
            last = word
        self._settle(path, last, 0)
        self.start = self._state(*path[0])
        self.shared: dict[tuple[int, int], list[str]] = {}

    def _settle(self, path, last: str, keep: int) -> None:
        while len(path) > keep + 1:
            arcs, final = path.pop()
            path[-1][0][last[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        key = (final[0], *arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return self.known[key]

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept: the composition after its edit, where both sides read the same."""
        if p > q:
            p, q = q, p
        if (p, q) in self.shared:
            return self.shared[p, q]
        found: list[str] = []
        todo = [(p, q, "")]
        while todo:
            a, b, read = todo.pop()
            if self.final[a] and self.final[b]:
                found.append(read)
            few, many = (self.arcs[a], self.arcs[b]) if len(self.arcs[a]) <= len(self.arcs[b]) else (self.arcs[b], self.arcs[a])
            todo += [(to, many[c], read + c) for c, to in few.items() if c in many]
        self.shared[p, q] = found
        return found

    def pairs(self, replace: bool = True) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the acceptor, a transducer of exactly one edit, and the acceptor again.

        Before the edit both sides are in one state. The transducer then reads
        a character on the longer side only, or two different ones. In a run of
        equal characters the first is the one too many, so a pair comes once.
        """
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            arcs = list(self.arcs[state].items())
            for i, (c, to) in enumerate(arcs):
                todo.append((to, read + c))
                if not read.endswith(c):
                    for rest in self.common(to, state):
                        yield read + rest, read + c + rest
                if replace:
                    for d, other in arcs[i + 1 :]:
                        for rest in self.common(to, other):
                            yield read + c + rest, read + d + rest


# ---- the operator


def keyed(words: DataFrame) -> DataFrame:
    """``word, n`` under the halves that a near word shares with it: ``size`` is the shorter length of a pair.

    One edit leaves the first ``size // 2`` characters of both or the last
    ``size - size // 2``, so every pair meets under one of the two halves.
    """
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1))
    sized = words.select("word", "n", sizes.alias("size"))
    half = F.expr("size div 2").cast("int")
    return sized.select("word", "n", "size", F.explode(F.array(
        F.struct(F.lit(True).alias("front"), F.substring("word", F.lit(1), half).alias("half")),
        F.struct(F.lit(False).alias("front"), F.expr("right(word, int(size - size div 2))").alias("half")),
    )).alias("key")).select("size", "key.front", "key.half", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n``: how many words are one edit away, and the one of largest n (then the smallest)."""

    def solve(size: int, front: bool, members: list[tuple[str, int]]) -> list[tuple]:
        half = size // 2 if front else size - size // 2
        numbers = {}
        for word, n in members:
            numbers[word[half:] if front else word[: len(word) - half][::-1]] = (n, word)
        acceptor = Acceptor(sorted(numbers))
        found: dict[str, list] = {}
        rest = size - half
        for left, right in acceptor.pairs():
            if len(left) != rest and len(right) != rest:
                continue  # both are of the longer size: their own key has them
            (n, a), (m, b) = numbers[left], numbers[right]
            if not front and a[: size // 2] == b[: size // 2]:
                continue  # found at the front
            for word, other, count in ((a, b, m), (b, a, n)):
                best = found.setdefault(word, [0, -count, other])
                best[0] += 1
                if (-count, other) < (best[1], best[2]):
                    best[1:] = -count, other
        return [(word, near, form, -count) for word, (near, count, form) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "form", "form_n"])

        for batch in batches:
            for size, front, half, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (size, front, half):
                    if len(members) > 1:
                        out += solve(key[0], key[1], members)
                    key, members = (size, front, half), []
                members.append((word, n))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if len(members) > 1:
            out += solve(key[0], key[1], members)
        yield batch_of(out)

    dealt = keyed(words).repartition("size", "front", "half").sortWithinPartitions("size", "front", "half")
    parts = dealt.mapInArrow(run, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form"))
    merged = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n"))


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms are followed to the last, twice as far in every round.

    A form's n is a multiple of its word's, so chains are short and end.
    """
    known = stage(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = known.join(ahead, "root", "left")
        if moved.where("next IS NOT NULL").isEmpty():
            return known
        known = stage(moved.select("word", F.coalesce("next", "root").alias("root")), "spelling-forms")


def variant_groups(
    docs: DataFrame, *, shortest: int = 6, least: int = 5, factor: int = 5, every: int = 0, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Words of all texts with their usual spelling: ``word, form, root, n, n_near, form_n``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least
    ``shortest`` characters and ``least`` occurrences. Near words differ by one
    inserted, deleted or replaced character. A word's form is its near word of
    largest n, the smallest of equal ones, if that is ``factor`` (2 at least) times the word's n
    or more; ``root`` is the last form of the chain. With ``every`` runs whose
    crc32 of ``id:run`` it divides lose one character first; a null id counts as
    empty there. A null or empty text has no words, rows that repeat count one
    by one, an empty table gives no rows, other columns are not read.

    Words are counted in tasks before they are shuffled. Those that share a half
    meet under it, which is the state both sides of the composition are in after
    reading the half: a task holds the words of one half and length, of which
    there are few, and gives one row per word and half, not one per pair.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = stage(vocabulary(docs, shortest=shortest, least=least, every=every, id_column=id_column, text=text), "spelling-words")
    near = stage(words.join(near_words(words), "word", "left"), "spelling-near")
    usual = F.col("form_n") >= factor * F.col("n")
    roots = followed(near.where(usual))
    known = near.withColumns({"form": F.when(usual, F.col("form")), "form_n": F.when(usual, F.col("form_n"))})
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"
    )


@query("op13_spelling")
def op13_spelling(spark, sf_dir):
    return variant_groups(documents(spark, sf_dir), every=199)

"""Encoding and decoding with SentencePiece models: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .chunks import ChunkEncoder
from .texts import RUN_BYTES, documents, flat, ranges, runs, small_batches, whole, worker_cache

#: The marker that stands for a space, and an unknown character's score below the lowest piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "
#: Rounds of expectation and maximisation that fit scores, and what each piece has before any is counted.
ROUNDS, PRIOR = 4, 0.5
#: Expected counts are whole numbers of this share, so their sum doesn't depend on the order.
SHARE = 1 << 20
#: Bytes of distinct chunks whose segmentations are searched or summed at once.
FIT_BYTES = 1 << 18
#: A chunk of more bytes is walked alone, in stretches of so many.
STRETCH = 1 << 13


def double_array(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value`` of a trie: from state s byte c leads to t = base[s] + c if check[t] == s."""
    root: dict = {}
    for piece, number in pieces:
        node = root
        for byte in piece:
            node = node.setdefault(byte, {})
        node[-1] = number
    size = 1 << 16
    while size < 4 * sum(len(piece) for piece, _ in pieces) + 1024:
        size *= 2
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = -2
    taken = check != -1
    tail, last = 1, 0  # where the search begins, and the last place in use
    waiting = [(root, 0)]
    while waiting:
        node, state = waiting.pop()
        value[state] = node.get(-1, -1)
        kids = np.array(sorted(byte for byte in node if byte >= 0), np.int64)
        if not len(kids):
            continue
        at = max(tail - int(kids[0]), 1)
        while True:
            window = np.arange(at, at + 512)
            fits = np.flatnonzero(~taken[window[:, None] + kids].any(axis=1))
            if len(fits):
                at += int(fits[0])
                break
            at += 512
        base[state] = at
        check[at + kids] = state
        taken[at + kids] = True
        last = max(last, at + int(kids[-1]))
        waiting.extend((node[byte], at + byte) for byte in kids.tolist())
        # move on once the places from here are nearly all in use
        while taken[tail : tail + 64].mean() > 0.9:
            tail += 32
    end = last + 257  # a byte leads at most so far
    return base[:end], check[:end], value[:end]


def log_sum(x: float, y: float) -> float:
    """``log(exp(x) + exp(y))``."""
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


@dataclass
class PieceModel:
    """The tables of a model; the same size for any corpus."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    unknown: int
    unknown_score: float
    byte_ids: np.ndarray  # id of each byte's piece, or -1
    alone: np.ndarray  # ASCII bytes that no longer piece holds
    surface: np.ndarray  # bytes of all pieces as text
    surface_start: np.ndarray
    surface_length: np.ndarray
    splits: bool  # no piece has a space after another character
    stamp: str  # differs with pieces and scores

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids = np.full(256, -1, np.int32)
        trie, scores, surfaces = [], [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            scores.append(model.get_score(i))
            plain = piece.replace(MARK, " ").encode()
            if model.is_byte(i):
                byte = int(piece[3:5], 16)
                byte_ids[byte] = i
                surfaces.append(bytes([byte]))
            elif model.is_unknown(i):
                surfaces.append(UNKNOWN_SURFACE.encode())
            elif model.is_control(i):
                surfaces.append(b"")
            else:
                surfaces.append(plain)
                if not model.is_unused(i):
                    trie.append((plain, i))
        return cls.of(trie, np.array(scores), model.unk_id(), byte_ids, surfaces)

    @classmethod
    def of(cls, trie, scores, unknown: int, byte_ids: np.ndarray, surfaces: list[bytes]) -> PieceModel:
        base, check, value = double_array(trie)
        longer = [piece for piece, _ in trie if len(piece.decode("utf-8", "replace")) > 1]
        inside = np.zeros(256, bool)
        inside[list({byte for piece in longer for byte in piece})] = True
        alone = ~inside
        alone[0x80:] = alone[32] = False
        splits = not any(b" " in piece.lstrip(b" ") for piece, _ in trie)
        sizes = np.array([len(one) for one in surfaces], np.int64)
        usable = [scores[i] for _, i in trie]
        return cls(
            base, check, value, scores, unknown, min(usable, default=0.0) - UNKNOWN_PENALTY, byte_ids, alone,
            np.frombuffer(b"".join(surfaces), np.uint8), np.cumsum(sizes) - sizes, sizes, splits,
            hashlib.sha256(repr(trie).encode() + np.asarray(scores, np.float64).tobytes()).hexdigest(),
        )

    def with_scores(self, scores: np.ndarray) -> PieceModel:
        """The same pieces with other log scores, one for each id."""
        scores = np.asarray(scores, np.float64)
        lowest = float(scores[self.usable()].min(initial=0.0))
        stamp = hashlib.sha256(self.stamp.encode() + scores.tobytes()).hexdigest()
        return replace(self, score=scores, unknown_score=lowest - UNKNOWN_PENALTY, stamp=stamp)

    def usable(self) -> np.ndarray:
        """Ids of the pieces that texts can be cut into."""
        return np.sort(self.value[self.value >= 0])

    # ---- encoding

    def best_path(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of every word, in a row, and their number.

        Of segmentations with equal sums the one whose last piece starts first
        wins. A character that no piece covers takes the unknown score and gives
        its bytes' pieces, or the unknown id if the model has none. Words go step
        by step together, ``FIT_BYTES`` at a time; one of over ``STRETCH`` bytes
        is walked alone, with the same sums and so the same ids.
        """
        parts = []
        for words_, is_long in self._groups(words, FIT_BYTES):
            parts.append(self._long_path(words_[0]) if is_long else self._best_paths(words_))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    @staticmethod
    def _groups(words: list[bytes], limit: int) -> Iterator[tuple[list[bytes], bool]]:
        """The words in their order, in groups of bounded size; a long word is a group of its own."""
        group, size = [], 0
        for word in words:
            if group and (size + len(word) > limit or len(word) > STRETCH):
                yield group, False
                group, size = [], 0
            if len(word) > STRETCH:
                yield [word], True
            else:
                group.append(word)
                size += len(word)
        if group:
            yield group, False

    def _stretch(self, data: np.ndarray, a: int) -> tuple[int, zip]:
        """Bytes of a long word from place ``a`` that pieces from one stretch reach, and these pieces by their start.

        Pieces are ``start, end, id, score``, counted from ``a``.
        """
        part = data[a : a + STRETCH + self.reach()]
        starts = np.flatnonzero((part & 0xC0) != 0x80)
        width = np.diff(np.append(starts, len(part)))
        here = starts < STRETCH
        s, e, ids, gain, _ = self._edges(part, starts[here], width[here], np.full(len(part), len(part)))
        order = np.argsort(s, kind="stable")
        return len(part), zip(s[order].tolist(), e[order].tolist(), ids[order].tolist(), gain[order].tolist(), strict=True)

    def reach(self) -> int:
        """Bytes of the longest piece, and of a character at least."""
        return max(int(self.surface_length[self.usable()].max(initial=1)), 4)

    def _long_path(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``best_path`` of one long word: scores of a stretch, and six bytes for each place, from which the path is read."""
        data = np.frombuffer(word, np.uint8)
        piece, width = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.uint16)
        carried = [0.0]
        for a in range(0, len(data), STRETCH):
            n, edges = self._stretch(data, a)
            best = (carried + [-math.inf] * n)[: n + 1]
            took, long = piece[a : a + n + 1].tolist(), width[a : a + n + 1].tolist()
            for s, e, number, gain in edges:
                score = best[s] + gain
                if score > best[e]:
                    best[e], took[e], long[e] = score, number, e - s
            piece[a : a + n + 1], width[a : a + n + 1] = took, long
            carried = best[STRETCH:]
        out, at = array("i"), len(data)
        in_bytes = self.byte_ids[0] >= 0
        while at > 0:
            # bytes that are no UTF-8 can leave a place that no piece ends at
            number, size = (int(piece[at]), int(width[at])) if width[at] else (self.unknown, 1)
            if number == self.unknown and in_bytes:
                out.extend(self.byte_ids[data[at - size : at]][::-1].tolist())
            else:
                out.append(number)
            at -= size
        ids = np.frombuffer(out, np.int32)[::-1]
        return ids, np.array([len(ids)], np.int64)

    def _best_paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data, word, sizes, ends, char_end, left, right, ids, gain, steps, last = self._lattice(words)
        n_nodes = len(data) + len(words)
        best = np.full(n_nodes, -np.inf)
        roots = ends - sizes + np.arange(len(words))
        best[roots] = 0.0
        came, piece = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int32)
        for lo, hi in zip(steps, last, strict=True):
            score = best[left[lo:hi]] + gain[lo:hi]
            better = np.flatnonzero(score > best[right[lo:hi]])
            to = right[lo:hi][better]
            best[to], came[to], piece[to] = score[better], left[lo:hi][better], ids[lo:hi][better]
        at, live = ends + np.arange(len(words)), np.flatnonzero(sizes > 0)
        at = at[live]
        took, owner, node = [], [], []
        while len(live):
            took.append(piece[at])
            owner.append(live)
            node.append(came[at])
            at = came[at]
            more = at != roots[live]
            at, live = at[more], live[more]
        if not took:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner, node = np.concatenate(took), np.concatenate(owner), np.concatenate(node)
        back = np.lexsort((node, owner))
        ids, owner, at = ids[back], owner[back], node[back] - owner[back]
        n_out = np.ones(len(ids), np.int64)
        if self.byte_ids[0] >= 0:
            unknown = ids == self.unknown
            n_out[unknown] = char_end[at[unknown]] - at[unknown]
            wide = np.repeat(ids, n_out)
            holes = np.repeat(unknown, n_out)
            wide[holes] = self.byte_ids[data[ranges(at[unknown], n_out[unknown])]]
            ids = wide
        return ids, np.bincount(owner, weights=n_out, minlength=len(words)).astype(np.int64)

    def _lattice(self, words: list[bytes]) -> tuple:
        """All pieces in all words, by where they start in their word, as edges between nodes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        begin, stop = (ends - sizes)[word], ends[word]
        first = (data & 0xC0) != 0x80
        starts = np.flatnonzero(first)
        width = np.diff(np.append(starts, len(data)))
        width = np.minimum(width, stop[starts] - starts)  # of each character
        s, e, ids, gain, char_end = self._edges(data, starts, width, stop)
        # nodes: a word of n bytes has n + 1
        depth = s - begin[s]
        order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        s, e, ids, gain, depth = s[order], e[order], ids[order], gain[order], depth[order]
        left, right = s + word[s], e + word[s]
        steps = np.flatnonzero(np.diff(depth, prepend=-1))
        return data, word, sizes, ends, char_end, left, right, ids, gain, steps, np.append(steps[1:], len(depth))

    def _edges(self, data: np.ndarray, starts: np.ndarray, width: np.ndarray, stop: np.ndarray) -> tuple:
        """Start, end, id and score of all pieces from these characters, and of characters that are no piece.

        Also the ends of the characters, by their start.
        """
        found = self._matches(data, starts, stop)
        char_end = np.zeros(len(data) + 1, np.int64)
        char_end[starts] = starts + width
        single = np.zeros(len(data), bool)
        single[found[0][found[1] == char_end[found[0]]]] = True
        lone = starts[~single[starts]]
        s = np.concatenate([found[0], lone])
        e = np.concatenate([found[1], char_end[lone]])
        ids = np.concatenate([found[2], np.full(len(lone), self.unknown)])
        gain = np.concatenate([self.score[found[2]], np.full(len(lone), self.unknown_score)])
        return s, e, ids, gain, char_end

    def expected_counts(self, words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        """How often each piece stands in the words in ``SHARE``-ths, over all segmentations by their probability.

        Also gives the words' log likelihood. ``times`` says how often each word
        occurs. A word of over ``STRETCH`` bytes is walked alone.
        """
        counts, likelihood, at = np.zeros(len(self.score), np.int64), 0.0, 0
        for group, is_long in self._groups(words, FIT_BYTES):
            own = times[at : at + len(group)]
            found, logs = self._long_counts(group[0], int(own[0])) if is_long else self._counts(group, own)
            counts, likelihood, at = counts + found, likelihood + logs, at + len(group)
        return counts, likelihood

    def _long_counts(self, word: bytes, times: int) -> tuple[np.ndarray, float]:
        """``expected_counts`` of one long word: forward with the sums at the borders of stretches kept, then
        backward, each stretch walked forward again from its border."""
        data = np.frombuffer(word, np.uint8)
        places = range(0, len(data), STRETCH)
        borders, carried = [], [0.0]
        for a in places:
            borders.append(carried)
            n, edges = self._stretch(data, a)
            ahead = (carried + [-math.inf] * n)[: n + 1]
            for s, e, _, gain in edges:
                ahead[e] = log_sum(ahead[e], ahead[s] + gain)
            carried = ahead[STRETCH:]
        whole_word = ahead[-1]
        counts, later = np.zeros(len(self.score), np.int64), [0.0]
        for a, border in zip(reversed(places), reversed(borders), strict=True):
            n, edges = self._stretch(data, a)
            edges = list(edges)
            ahead = (border + [-math.inf] * n)[: n + 1]
            for s, e, _, gain in edges:
                ahead[e] = log_sum(ahead[e], ahead[s] + gain)
            behind = [-math.inf] * min(STRETCH, n) + later
            shares = np.zeros(len(edges))
            for i in range(len(edges) - 1, -1, -1):
                s, e, _, gain = edges[i]
                behind[s] = log_sum(behind[s], behind[e] + gain)
                shares[i] = ahead[s] + gain + behind[e] - whole_word
            ids = np.fromiter((edge[2] for edge in edges), np.int64, len(edges))
            np.add.at(counts, ids, np.rint(np.exp(shares) * SHARE).astype(np.int64) * times)
            later = behind[: self.reach() + 1]
        counts[self.unknown] = 0
        return counts, whole_word * times

    def _counts(self, words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, float]:
        data, word, sizes, ends, _, left, right, ids, gain, steps, last = self._lattice(words)
        nodes = np.arange(len(words))
        ahead = np.full(len(data) + len(words), -np.inf)
        behind = ahead.copy()
        ahead[ends - sizes + nodes] = behind[ends + nodes] = 0.0
        for lo, hi in zip(steps, last, strict=True):
            np.logaddexp.at(ahead, right[lo:hi], ahead[left[lo:hi]] + gain[lo:hi])
        for lo, hi in zip(steps[::-1], last[::-1], strict=True):
            np.logaddexp.at(behind, left[lo:hi], behind[right[lo:hi]] + gain[lo:hi])
        whole_word = ahead[ends + nodes]
        owner = np.searchsorted(ends + nodes, left)
        share = np.exp(ahead[left] + gain + behind[right] - whole_word[owner])
        counts = np.zeros(len(self.score), np.int64)
        np.add.at(counts, ids, np.rint(share * SHARE).astype(np.int64) * times[owner])
        counts[self.unknown] = 0
        return counts, float((whole_word * times).sum())

    def _matches(self, data, starts, stop):
        """Start, end and id of every piece in the data that stays inside its word."""
        at, state, begin = starts, np.zeros(len(starts), np.int32), starts
        found: list[list[np.ndarray]] = [[], [], []]
        while len(at):
            to = self.base[state] + data[at]
            known = self.check[to] == state
            begin, state, at = begin[known], to[known], at[known] + 1
            number = self.value[state]
            hit = number >= 0
            for into, part in zip(found, (begin[hit], at[hit], number[hit]), strict=True):
                into.append(part)
            more = at < stop[begin]
            begin, state, at = begin[more], state[more], at[more]
        return [np.concatenate(part) if part else np.zeros(0, np.int64) for part in found]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where no piece reaches across: rows, before runs of spaces, and around bytes that stand alone."""
        cut = np.zeros(len(data) + 1, bool)
        if self.splits:
            space = data == 32
            cut[1:-1] = space[1:] & ~space[:-1]
        lone = np.flatnonzero(self.alone[data])
        cut[lone] = cut[lone + 1] = True
        cut[offsets] = True
        return np.flatnonzero(cut)

    def prepared(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts as pieces see them, their offsets, and the cuts."""
        if b"\xe2\x96\x81" in data.tobytes():
            rows = [data[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
            data = np.frombuffer(b"".join(rows), np.uint8)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(data, offsets[full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        return data, offsets, self.cuts(data, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray, encoder: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, and the rows' offsets. A row that isn't empty gets a space in front."""
        data, offsets, cuts = self.prepared(data, offsets)
        ids, counts = encoder(data, cuts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their offsets: markers become spaces, the one in front goes."""
        sizes = self.surface_length[ids]
        data = self.surface[ranges(self.surface_start[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        full = ends[:-1][np.diff(ends) > 0]
        front = full[data[full] == 32]
        offsets = ends - np.searchsorted(front, ends, side="left")
        return np.delete(data, front), offsets


def encoded(column: pa.Array, model: PieceModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their ids and the rows' offsets in them."""
    kept = worker_cache()
    if kept.get("pieces-of") != model.stamp:
        kept["pieces"], kept["pieces-of"] = ChunkEncoder(model.best_path), model.stamp
    encoder = kept["pieces"]
    encoder.encode = model.best_path
    data, offsets = flat(column)
    for start, end in runs(offsets, RUN_BYTES):
        ids, own = model.encode(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], encoder)
        yield start, end, ids, own


def chunk_counts(docs: DataFrame, model: PieceModel, *, text: str = "text") -> DataFrame:
    """``chunk, n``: the distinct stretches of all texts that no piece reaches out of, and how often each occurs.

    A long text without white space can be one chunk.
    """
    spark = small_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for start, end in runs(offsets, RUN_BYTES):
                own, _, cuts = shared.value.prepared(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                if len(cuts) < 2:
                    continue
                at = pa.py_buffer(np.ascontiguousarray(cuts, np.int32))
                chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(own))])
                found = chunks.value_counts()
                yield pa.RecordBatch.from_pydict({"chunk": found.field("values"), "n": found.field("counts")})

    counted = docs.select(whole(text).alias("text")).mapInArrow(count, "chunk binary, n bigint")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def unigram_scores(docs: DataFrame, model_path: str, *, rounds: int = ROUNDS, text: str = "text") -> np.ndarray:
    """Log probabilities of a model's pieces as a unigram model of all texts, by id.

    For models whose file has merge ranks in place of log scores. Expectation and
    maximisation from equal probabilities: tasks sum how often each piece is
    expected over all segmentations of the distinct chunks, Spark adds the sums,
    the driver has one number per piece. The vocabulary stays as it is; a piece
    that never occurs keeps a low score. Pieces that aren't text score 0.
    """
    model = PieceModel.load(model_path)
    usable = model.usable()
    scores = np.zeros(len(model.score))
    scores[usable] = -np.log(max(len(usable), 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stage(chunk_counts(docs, model, text=text).repartition(parts, "chunk"), "chunks")
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    for _ in range(rounds):
        now = chunks.sparkSession.sparkContext.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            fitted = shared.value.with_scores(now.value)
            sums = np.zeros(len(now.value), np.int64)
            for batch in batches:
                words, times = batch.column(0), batch.column(1).to_numpy()
                for start, end in runs(flat(words)[1], FIT_BYTES):
                    sums += fitted.expected_counts(words.slice(start, end - start).to_pylist(), times[start:end])[0]
            seen = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int32()), "n": sums[seen]})

        table = chunks.mapInArrow(expect, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(scores))
        counts[table.column("id").to_numpy()] = table.column("n").to_numpy() / SHARE
        own = counts[usable] + PRIOR
        scores = np.zeros(len(scores))
        # in SHARE-ths, so sums are exact and equal segmentations tie wherever texts are cut
        scores[usable] = np.rint((np.log(own) - np.log(own.sum())) * SHARE) / SHARE
    return scores


def encode_documents(
    docs: DataFrame, model_path: str, *, scores: np.ndarray | None = None, with_ids: bool = True,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Piece ids of every text, and what they decode to.

    ``scores`` are the pieces' log scores, those in the model file if left out.
    The file of a BPE model has merge ranks there; ``unigram_scores`` fits scores.

    Returns the id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit
    numbers), decoded_sha256 and round_trip (the decoded bytes are the text's),
    and ``ids`` unless ``with_ids`` is false. A null or empty text has no ids; a
    marker character in a text decodes to a space, so such a text does not
    round-trip. Rows are independent: repeated and null ids stay as they are, an
    empty table gives no rows, and other columns are not read.

    No shuffle. The model's tables go to each executor once; texts are handled
    in runs of bounded size, and a text is cut where no piece reaches across.
    Where nothing cuts it, a long text is walked in stretches: its search needs
    six bytes for each of its bytes.
    """
    spark = small_batches(docs).sparkSession
    model = PieceModel.load(model_path)
    shared = spark.sparkContext.broadcast(model if scores is None else model.with_scores(scores))  # bounded by the vocabulary

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            raw, at = flat(texts)
            for start, end, ids, offsets in encoded(texts, model):
                plain, spans = model.decode(ids, offsets)
                small, data = memoryview(ids.astype("<u4")).cast("B"), memoryview(np.ascontiguousarray(plain))
                sums, hashes, same = [], [], []
                for i in range(end - start):
                    sums.append(zlib.crc32(small[4 * offsets[i] : 4 * offsets[i + 1]]))
                    text = data[spans[i] : spans[i + 1]]
                    hashes.append(hashlib.sha256(text).hexdigest())
                    same.append(text == memoryview(raw[at[start + i] : at[start + i + 1]]))
                columns = {
                    "doc_id": batch.column(0).slice(start, end - start),
                    "n_tokens": np.diff(offsets),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "decoded_sha256": pa.array(hashes, pa.string()),
                    "round_trip": pa.array(same, pa.bool_()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    rows = docs.select(F.col(id_column).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(digest, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("doc_id", id_column)


@query("op3_pieces")
def op3_pieces(spark, sf_dir):
    import public_tokenizers

    docs, path = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(docs, path, scores=unigram_scores(docs, path), with_ids=False)

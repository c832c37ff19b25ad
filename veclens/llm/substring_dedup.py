"""Removing long byte strings that occur more than once, over suffix arrays of candidate segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclens.session import release, stage

from . import query
from .texts import RUN_BYTES, byte_hashes, documents, flat, mix64, packed, ranges, runs, small_batches, span_hashes, whole

#: Bytes of the anchors that bring equal strings together; at most the length that is looked for.
ANCHOR = 32
#: Bytes of segments that one suffix array holds, beyond its last key.
BLOCK_BYTES = 1 << 20
#: Segments of keys with more distinct ones get finer keys; what is still more is compared by hashes of all strings.
MANY = 20_000
#: Strings of a segment's part at most, where keys are made finer.
PART = 16
#: A key is spread over tasks if a sample of this share of all segments has it in this share of its rows.
SAMPLE, HOT_SHARE, HOT_LEAST = 0.01, 0.0005, 50
SYMBOLS = 7  # of 9 bits, in the first sort key
#: Low bits of an anchor's hash that hold its index in a stretch of the text; stretches are no longer than that.
INDEX_BITS = 24
#: Strings of one segment at most, 8 bits of a place; longer stretches are several segments with the same key.
MOST = 255


# ---- segments: strings of one length that share their anchor, as one stretch of text


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches of strings of ``length`` bytes with the same anchor: row, start, strings, key and content hash.

    A string's anchor is the leftmost of its ``ANCHOR``-byte strings with the
    smallest hash, so equal strings have equal keys wherever they stand. Long
    data is taken piece by piece, each with the first ``length - 1`` bytes of the
    next: a segment that reaches across becomes two with one key.
    """
    bits = max(INDEX_BITS, (2 * length).bit_length())  # the same for all texts, as it decides which hash is smallest
    step = min(1 << bits, max(RUN_BYTES, 2 * length)) - length + 1
    n = len(data) - length + 1
    parts = [
        _piece_segments(data[first : first + step + length - 1], first, offsets, length, bits)
        for first in range(0, max(n, 1), step)
    ]
    return tuple(np.concatenate(part) for part in zip(*parts, strict=True))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``ANCHOR``-byte strings."""
    rolled, width, step = byte_hashes(data), 1, 0x9E3779B97F4A7C15
    while width < ANCHOR:
        rolled = rolled[:-width] * np.uint64(step) + rolled[width:]
        step, width = step * step % (1 << 64), 2 * width
    return mix64(rolled)


def _piece_segments(data: np.ndarray, first: int, offsets: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, ...]:
    """Segments of the strings that start in ``data``, which begins at byte ``first`` of the rows."""
    empty = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    rolled = anchor_hashes(data)
    low = np.uint64((1 << bits) - 1)
    least = (rolled & ~low) | np.arange(len(rolled), dtype=np.uint64)
    span, have = length - ANCHOR + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: have - span], least[span - have :])
    anchor = (least & low).astype(np.int64)
    row = np.searchsorted(offsets, first, side="right") - 1
    last = np.searchsorted(offsets, first + n, side="left")
    edges = np.clip(offsets[row : last + 1] - first, 0, n)
    row = np.repeat(np.arange(row, last), np.diff(edges))
    inside = np.arange(first, first + n) + length <= offsets[1:][row]
    fresh = inside.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~fresh[1:], False)) + 1
    if length - ANCHOR >= MOST:
        cuts = -(-(ends - starts) // MOST)
        owner = np.repeat(np.arange(len(starts)), cuts)
        starts = starts[owner] + MOST * ranges(np.zeros(len(cuts), np.int64), cuts)
        ends = np.minimum(starts + MOST, ends[owner])
    keys = rolled[anchor[starts]]
    content = span_hashes(data, starts, ends + length - 1)
    return row[starts], starts + first - offsets[:-1][row[starts]], ends - starts, keys, content


def segment_parts(
    data: np.ndarray, offsets: np.ndarray, counts: np.ndarray, keys: np.ndarray, length: int, width: int
) -> tuple[np.ndarray, ...]:
    """Parts of at most ``width`` strings of segments: segment, offset in it, strings, finer key and content hash.

    A string is known by its bytes before its anchor, so equal strings have
    equal distances d to it and come under the same d div ``width``. The finer
    key also hashes the bytes that all strings of that quotient would share,
    so segments that differ there come under different keys.
    """
    first = offsets[:-1]
    free = length - ANCHOR + 2 - counts  # places of an anchor that lies in all strings
    at = ranges(first + counts - 1, free)
    owner = np.repeat(np.arange(len(counts)), free)
    hits = np.flatnonzero(anchor_hashes(data)[at] == keys[owner])
    anchor = at[hits[np.searchsorted(owner[hits], np.arange(len(counts)))]]
    string = ranges(first, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    quotient = (anchor[owner] - string) // width
    fresh = np.ones(len(string), bool)
    fresh[1:] = (quotient[1:] != quotient[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    n = np.diff(np.append(starts, len(string)))
    owner, quotient, starts = owner[starts], quotient[starts], string[starts]
    core = anchor[owner] - quotient * width
    shared = span_hashes(data, core, core + length - width + 1)
    finer = mix64(shared ^ mix64(keys[owner] + quotient.astype(np.uint64)))
    return owner, starts - first[owner], n, finer, span_hashes(data, starts, starts + n + length - 1)


# ---- suffix arrays of segments


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols at least, and where the first 7 change."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(SYMBOLS, np.int64)])
    keys = np.zeros(n, np.int64)
    for k in range(SYMBOLS):
        keys = (keys << 9) | padded[k : k + n]
    order = np.argsort(keys)
    changes = np.empty(n, bool)
    changes[0] = True
    changes[1:] = keys[order[1:]] != keys[order[:-1]]
    first = changes.copy()
    have = SYMBOLS
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(changes) - 1
    while have < depth:
        open_ = ~(changes & np.append(changes[1:], True))  # places in groups of several
        at = np.flatnonzero(open_)
        if not len(at):
            break
        who = order[at]
        after = np.where(who + have < n, rank[np.minimum(who + have, n - 1)] + 1, 0)
        keys = rank[who] * (n + 1) + after
        again = np.argsort(keys)
        who, keys = who[again], keys[again]
        order[at] = who
        split = np.empty(len(at), bool)
        split[0] = True
        split[1:] = keys[1:] != keys[:-1]
        changes[at] = split
        rank[order] = np.cumsum(changes) - 1
        have *= 2
    return order, first


def shared_prefixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and at which places a suffix shares ``depth`` symbols with the one before it.

    Intervals of the Burrows-Wheeler transform are extended backward, breadth
    first: strings of l symbols give those of l + 1, and the right border of a
    new interval whose common prefix isn't known yet has exactly l. Each place
    is settled once and only intervals that settle one go on. Borders that are
    still open at ``depth`` have that much in common or more.
    """
    order, first = sorted_suffixes(text, depth)
    n = len(text)
    before = text[order - 1]  # the transform; the suffix at 0 takes the last symbol, a separator
    back = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[back] = np.arange(n)  # place of the suffix one symbol longer
    settled = np.append(first, True)
    left = np.flatnonzero(first)
    right = np.append(left[1:], n)
    for _ in range(SYMBOLS, depth):
        at = ranges(left, right - left)
        owner = np.repeat(np.arange(len(left)), right - left)
        new = to[at]
        turn = np.argsort(new)
        new, owner, symbol = new[turn], owner[turn], before[at[turn]]
        begins = np.empty(len(new), bool)
        begins[:1] = True
        begins[1:] = (new[1:] != new[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(new))
        left, right = new[starts], new[ends - 1] + 1
        fresh = ~settled[right]
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        settled[right] = True
    return order, ~settled[:n]


def repeated_starts(pieces: list[bytes], length: int) -> np.ndarray:
    """For the ``len(piece) - length + 1`` strings of every piece in a row: whether one occurs elsewhere in the pieces."""
    sizes = np.array([len(piece) for piece in pieces], np.int64)
    text = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    text[ranges(starts, sizes)] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    order, same = shared_prefixes(text, length)
    twice = np.zeros(len(text), bool)
    place = np.flatnonzero(same)
    twice[order[place]] = True
    twice[order[place - 1]] = True
    return twice[ranges(starts, sizes - length + 1)]


def true_runs(flags: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags inside each stretch: stretch, offset in it, and length."""
    owner = np.repeat(np.arange(len(counts)), counts)
    start = flags.copy()
    start[1:] &= ~(flags[:-1] & (owner[1:] == owner[:-1]))
    end = flags.copy()
    end[:-1] &= ~(flags[1:] & (owner[1:] == owner[:-1]))
    at, stop = np.flatnonzero(start), np.flatnonzero(end) + 1
    return owner[at], at - begins[owner[at]], stop - at


# ---- the operator

PLACE = "row bigint"


def _unpack(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.expr("sn >> 8"), "n": F.expr("sn & 255")})


def repeated_spans(source: DataFrame, length: int) -> DataFrame:
    """``row, start, n``: runs of n strings from byte ``start`` on that occur elsewhere; ``source`` has ``row, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            rows = batch.column(0).to_numpy()
            for first, last in runs(offsets, RUN_BYTES):
                own = offsets[first : last + 1] - offsets[first]
                row, start, n, keys, content = segments(data[offsets[first] : offsets[last]], own, length)
                yield pa.RecordBatch.from_pydict({
                    "key": keys.view(np.int64), "sh": content.view(np.int64), "row": rows[row + first], "sn": (start << 8) | n,
                })

    found = stage(small_batches(source.select("row", "text")).mapInArrow(cut, "key bigint, sh bigint, row bigint, sn bigint"), "segments")
    # what is frequent in a sample is dealt by content as well, or known to repeat;
    # at most 1 / HOT_SHARE keys and contents pass, so both lists are constants of the plan
    sample = found.where(F.pmod(F.xxhash64("row", "sn"), F.lit(1_000_000)) < int(SAMPLE * 1_000_000))
    pairs = sample.groupBy("key", "sh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "sn")).alias("rep"))
    pairs = stage(pairs, "sampled")
    least = max(HOT_LEAST, (pairs.agg(F.sum("c")).first()[0] or 0) * HOT_SHARE)
    hot_keys = [row.key for row in pairs.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= least).collect()]
    hot_pairs = [tuple(row) for row in pairs.where(F.col("c") >= least).select("key", "sh").collect()]
    # a content has its anchor and so its key within it: both lists together name the pairs
    often = F.col("key").isin(sorted({key for key, _ in hot_pairs})) & F.col("sh").isin(sorted({sh for _, sh in hot_pairs}))
    marked = found.withColumns({"hot": F.col("key").isin(sorted(hot_keys)), "certain": often})
    certain = marked.where("certain")  # seen twice in the sample
    others = marked.where("NOT certain")
    dealt = others.withColumn("deal", F.when(F.col("hot"), F.xxhash64("key", "sh")).otherwise(F.col("key"))).repartition("deal")
    same = Window.partitionBy("deal", "key", "sh")
    group = Window.partitionBy("deal", "key")
    counted = (
        dealt.withColumn("c", F.count(F.lit(1)).over(same))
        .withColumn("rep", F.row_number().over(same.orderBy("row", "sn")) == 1)
        .withColumn("m", F.sum(F.col("rep").cast("int")).over(group))
        .where("c > 1 OR m > 1 OR hot")
        .select("key", "row", "sn", "c", "rep", F.when(F.col("hot"), MANY + 1).otherwise(F.col("m")).alias("m"))
    )
    known = pairs.where(often).select(
        "key", "rep.row", "rep.sn", F.lit(0).cast("bigint").alias("c"), F.lit(True).alias("rep"), F.lit(MANY + 1).alias("m")
    )
    sure = certain.select("key", "row", "sn", F.lit(2).cast("bigint").alias("c"), F.lit(False).alias("rep"), F.lit(0).cast("bigint").alias("m"))
    repeats = stage(_unpack(counted.unionByName(known).unionByName(sure)), "repeats")
    release(found, pairs)
    whole_runs = repeats.where("c > 1").select("row", "start", "n")

    # one segment of each content, where contents with the same key differ
    open_ = repeats.where("rep AND m > 1").select("key", "row", "start", "n", "c", (F.col("m") > MANY).alias("many"))
    places = open_.groupBy("row").agg(F.collect_list(F.struct("key", "start", "n", "c", "many")).alias("places"))
    texts = source.select("row", "text").join(places, "row")
    cut_out = texts.withColumn("bytes", F.col("text").cast("binary")).select(
        "row", F.explode("places").alias("p"), "bytes"
    ).select("row", "p.*", F.expr(f"substring(bytes, int(p.start) + 1, int(p.n) + {length - 1})").alias("piece"))

    out = whole_runs.unionByName(settled(cut_out.where("NOT many"), length))
    if repeats.where(f"rep AND m > {MANY}").isEmpty():
        return out
    return out.unionByName(parts_twice(cut_out.where("many"), length))


def settled(pieces: DataFrame, length: int) -> DataFrame:
    """``row, start, n`` of strings that occur in two places of the pieces of a key, by suffix arrays of whole keys."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column(2).to_numpy()
            at = 0
            while at < len(batch):
                data = flat(batch.column(4))[1]
                stop = int(np.searchsorted(data, data[at] + BLOCK_BYTES - size, side="left"))
                stop = min(max(stop, at + 1), len(batch))
                while stop < len(batch) and keys[stop] == keys[stop - 1]:
                    stop += 1
                # a block ends only where the key changes
                if held and size >= BLOCK_BYTES:
                    last = held[-1].column(2)[len(held[-1]) - 1].as_py()
                    if keys[at] != last:
                        yield solve(held)
                        held, size = [], 0
                        continue
                    stop = int(np.searchsorted(keys[at:], last, side="right")) + at
                held.append(batch.slice(at, stop - at))
                size += int(data[stop] - data[at])
                at = stop
        if held:
            yield solve(held)

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks()
        pieces = block.column("piece").to_pylist()
        twice = repeated_starts(pieces, length)
        counts = block.column("n").to_numpy()
        begins = np.cumsum(counts) - counts
        owner, offset, n = true_runs(twice, begins, counts)
        return pa.RecordBatch.from_pydict({
            "row": block.column("row").to_numpy()[owner],
            "start": block.column("start").to_numpy()[owner] + offset,
            "n": n,
        })

    ordered = pieces.select("row", "start", "key", "n", "piece").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(settle, f"{PLACE}, start bigint, n bigint")


def parts_twice(pieces: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many segments, which are cut into parts with finer keys.

    A part whose content comes again repeats as a whole; one that shares its
    finer key with nothing holds no repeat. Only finer keys with very many
    contents are counted string by string.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                data, offsets = flat(part.column(3))
                keys = part.column(4).to_numpy().view(np.uint64)
                owner, offset, n, finer, content = segment_parts(data, offsets, part.column(2).to_numpy(), keys, length, PART)
                sizes = n + length - 1
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0).to_numpy()[owner], "start": part.column(1).to_numpy()[owner] + offset, "n": n,
                    "piece": packed(data[ranges(offsets[owner] + offset, sizes)], sizes),
                    "key": finer.view(np.int64), "sh": content.view(np.int64),
                })

    rows = pieces.select("row", "start", "n", "piece", "key")
    parts = stage(rows.mapInArrow(cut, f"{PLACE}, start bigint, n bigint, piece binary, key bigint, sh bigint"), "parts")
    contents = parts.groupBy("key", "sh").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start")).alias("rep"), F.first("n").alias("n"), F.first("piece").alias("piece")
    )
    contents = stage(contents.select("key", "sh", "c", "rep.*", "n", "piece"), "contents")
    again = contents.where("c > 1").select("key", "sh")
    out = parts.join(again, ["key", "sh"], "left_semi").select("row", "start", "n")
    sizes = stage(contents.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "sizes")
    out = out.unionByName(settled(contents.join(sizes.where(f"m <= {MANY}"), "key"), length))
    many = sizes.where(f"m > {MANY}")
    return out if many.isEmpty() else out.unionByName(strings_twice(contents.join(many, "key"), length))


def strings_twice(pieces: DataFrame, length: int) -> DataFrame:
    """The same for finer keys with very many contents: strings are hashed one by one and counted by Spark."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                data, offsets = flat(part.column(3))
                counts = part.column(2).to_numpy()
                at = ranges(offsets[:-1], counts)
                owner = pa.array(np.repeat(np.arange(len(part)), counts))
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0).take(owner),
                    "start": np.repeat(part.column(1).to_numpy() - offsets[:-1], counts) + at,
                    "key": part.column(4).take(owner), "wh": span_hashes(data, at, at + length).view(np.int64),
                })

    rows = pieces.select("row", "start", "n", "piece", "key")
    strings = stage(rows.mapInArrow(explode, f"{PLACE}, start bigint, key bigint, wh bigint"), "strings")
    twice = strings.groupBy("key", "wh").count().where("count > 1").select("key", "wh")
    return strings.join(twice, ["key", "wh"], "left_semi").select(
        "row", "start", F.lit(1).cast("bigint").alias("n")
    )


def drop_repeats(
    docs: DataFrame, *, length: int = 200, id_column: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """Removes every byte that is covered by a string of ``length`` bytes that also starts anywhere else.

    Returns the id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, on demand, ``kept``, the remaining bytes. Strings are judged
    on the input and never cross rows; overlapping occurrences count. A null or
    empty text has 0 bytes; each row counts, so rows that repeat an id and a
    text remove each other; a null id is an id; an empty table gives no rows and
    only the two named columns are read. Ids are integers, texts under 2 GB.

    Every string belongs to one segment: a stretch of strings with one anchor.
    Segments move as two hashes and a place. Those with equal contents repeat as
    a whole; where contents under one key differ, one of each is fetched and a
    suffix array of a bounded block finds the strings they share, by backward
    extension up to ``length``. A text of any length is cut into segments
    ``RUN_BYTES`` at a time. Keys that a sample shows to be hot are dealt by
    content, so no task gathers them; theirs and other segments of keys with very
    many contents are cut into parts with finer keys, a few rows each. What still
    has very many contents is counted string by string by Spark, which is exact too.
    """
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), whole(text).alias("text"))
    # a row is known by its number, as ids may repeat; written, so that the number stays
    source = stage(source.withColumn("row", F.monotonically_increasing_id()), "numbered", compression="zstd")
    spans = repeated_spans(source, length)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = source.join(listed, "row", "left").select("id", "text", "spans.start", "spans.n")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            rows: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            starts, counts = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                own = data[offsets[i] : offsets[i + 1]]
                edges = np.zeros(len(own) + 1, np.int32)
                if starts[i].is_valid:
                    at, n = starts[i].values.to_numpy(), counts[i].values.to_numpy()
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n + length - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = own[~gone].tobytes()
                rows["n_bytes"].append(len(own))
                rows["n_removed"].append(int(gone.sum()))
                rows["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                rows["kept"].append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(rows[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")],
                 pa.array(rows["kept_sha256"], pa.string()), pa.array(rows["kept"], pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = joined.mapInArrow(
        strip, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    ).withColumnRenamed("id", id_column)
    return out if with_text else out.drop("kept")


@query("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    return drop_repeats(documents(spark, sf_dir))

"""Near-duplicate groups: min-max hashing, banding, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclens.session import stage

from . import query
from .texts import RUN_BYTES, documents, flat, mix64, runs, small_batches, span_hashes, whole, word_bounds

#: Permutations; each gives its minimum and its maximum, so signatures have twice as many values.
PERMUTATIONS = 64
#: Values of a band. 32 bands of 4 miss a pair of similarity 0.8 with probability 5e-8.
BAND = 4
#: Bits of a set's bitmap, and members of a key that are compared at once.
BITS = 4096
BLOCK = 2048
STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingles as 64-bit hashes.

    A row with fewer words has its whole sequence as one, without words none.
    """
    small = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends, first = word_bounds(small, offsets)
    hashes = span_hashes(small, starts, ends)
    n = np.diff(first)
    rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
    for k in range(1, words):
        rolled = rolled * STEP + hashes[k : len(hashes) - words + 1 + k]
    rolled = mix64(rolled)
    sets = []
    for at, count in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if count >= words:
            sets.append(np.unique(rolled[at : at + count - words + 1]))
        elif count:
            one = np.uint64(count)
            for word in hashes[at : at + count]:
                one = mix64(np.array([one]) * STEP + word)[0]
            sets.append(np.array([one]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def min_max(shingles: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation of 32-bit numbers; one evaluation gives both."""
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 31, permutations, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
    flips = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)[:, None]
    low = np.full(permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(permutations, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 2048):
        seen = (narrow[None, at : at + 2048] ^ flips) * odd
        seen ^= seen >> np.uint32(15)
        np.minimum(low, seen.min(axis=1), out=low)
        np.maximum(high, seen.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key per band; a band has only minima or only maxima."""
    rows = np.concatenate([low, high]).astype(np.uint64).reshape(-1, band)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64) * STEP
    for column in rows.T:
        keys = mix64(keys + column) * STEP
    return keys


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per shingle hash: bitmaps of two sets differ in no more bits than the sets in shingles."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``id, th, n, s1, s2, bands, bits`` of rows ``id, th, text``."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for start, end in runs(offsets, RUN_BYTES):
                sets = shingle_sets(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start], words)
                sums = np.array(
                    [[mix64(s).sum(dtype=np.uint64), mix64(s ^ STEP).sum(dtype=np.uint64)] for s in sets], np.uint64
                ).reshape(-1, 2)
                bands = [band_keys(*min_max(s)) if len(s) else np.zeros(0, np.uint64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                keys = np.concatenate([*bands, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(start, end - start),
                    "th": batch.column(1).slice(start, end - start),
                    "n": np.array([len(s) for s in sets], np.int64),
                    "s1": np.ascontiguousarray(sums[:, 0]).view(np.int64),
                    "s2": np.ascontiguousarray(sums[:, 1]).view(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                    "bits": pa.array([bitmap(s) for s in sets], pa.binary()),
                })

    return small_batches(docs).mapInArrow(sketch, "id bigint, th bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>, bits binary")


def confirmed(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of rows ``a, b, text_a, text_b`` whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                left, right = shingle_sets(*flat(part.column(2)), words), shingle_sets(*flat(part.column(3)), words)
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)])
                sizes = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)])
                linked = pa.array(100 * both >= percent * (sizes - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(linked)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes with an edge ``a, b``: the label is the smallest node that can be reached.

    Labels go to neighbours and then to the label's own label, so the number of
    rounds is about the logarithm of the longest path. Every round is a table in
    the shared folder. A node with many edges is pre-aggregated and split.
    """
    both = stage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")),
        "labels",
    )
    while True:
        # superseded labels are small and stay until the shared folder is cleaned
        heard = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        )
        told = stage(
            labels.join(heard, labels.node == heard.a)
            .select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label")),
            "labels",
        )
        above = told.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = stage(
            told.join(above, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")),
            "labels",
        )
        if jumped.where("was != label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def possible_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` of a key's members with different labels that may be similar enough.

    Rows are ``key, node, label, n, bits, m`` with m the members of the key. A
    key's members are compared in blocks inside tasks, by sizes and bitmaps;
    this leaves out only pairs that surely are below the threshold, and only
    what is left goes on.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        rows.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label", "n", "bits")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks()
            lo, hi, own, node, label, n = (group.column(i).to_numpy() for i in (1, 2, 3, 4, 5, 6))
            if len(node) < 2 or (label == label[0]).all():
                return
            words = np.frombuffer(b"".join(group.column(7).to_pylist()), np.uint64).reshape(len(node), -1)
            left = np.flatnonzero(own == lo[0])
            right = np.flatnonzero(own == hi[0])
            for at in range(0, len(left), 16):
                x = left[at : at + 16]
                wanted = (label[x][:, None] != label[right]) & ((node[x][:, None] < node[right]) | (lo[0] != hi[0]))
                i, j = np.nonzero(wanted & (
                    100 * np.minimum(n[x][:, None], n[right]) >= percent * np.maximum(n[x][:, None], n[right])))
                i, j = x[i], right[j]
                for first in range(0, len(i), 8192):
                    a, b = i[first : first + 8192], j[first : first + 8192]
                    differ = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
                    # similar enough: differing shingles are at most (100 - percent) / (100 + percent) of both sizes
                    near = np.flatnonzero((100 + percent) * differ <= (100 - percent) * (n[a] + n[b]))
                    if len(near):
                        u, v = node[a[near]], node[b[near]]
                        yield pa.RecordBatch.from_pydict({"a": np.minimum(u, v), "b": np.maximum(u, v)})

        for batch in batches:
            places = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if start == end:
                    continue
                if held and tuple(places[start]) != tuple(held[0].column(i)[0].as_py() for i in range(3)):
                    yield from solve()
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield from solve()

    together = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Groups of rows whose shingle sets have a similarity of at least ``percent``, directly or over others.

    Returns the id, n_shingles, component_id (the smallest id of the group),
    kept (the id is its group's) and text_hash (xxhash64, to tell rows that
    repeat an id apart). A null or empty text, or one without words,
    has no shingles and is alone. Rows that repeat an id are rows of their own; a
    null id is never the smallest unless all are null. An empty table gives no
    rows, and columns other than the two named are not read. Ids are integers.

    Rows with the same set are one node. Nodes that share a band key are
    candidates: all of a key are compared with the key's most central node (the
    one whose keys have the most members), and then members of a key that are
    still in different groups with each other, in blocks inside tasks, so that
    no link is lost. A group of thousands of near copies costs about one
    comparison of texts per member.
    Texts move by their id, only for candidates; keys, links and labels are
    narrow tables that Spark joins and splits.
    """
    source = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.xxhash64(whole(text)).alias("th"), whole(text).alias("text")
    )
    rows = stage(sketches(source, words).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = stage(
        rows.where("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("least_id")), "classes"
    )
    nodes = rows.join(classes.select(F.col("node").alias("row")), "row")
    keyed = stage(nodes.select(F.col("row").alias("node"), F.explode("bands").alias("key")), "bands")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = stage(keyed.join(shared, "key"), "several")
    central = several.groupBy("node").agg(F.sum("m").alias("central"))
    pivots = several.join(central, "node").groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("top"))
    pivots = pivots.select("key", (-F.col("top.minus")).alias("pivot"))
    members = stage(several.join(pivots, "key"), "members")
    who = rows.select(F.col("row").alias("node"), "id", "th").join(members.select("node").distinct(), "node", "left_semi")
    texts = source.select("id", "th", "text")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Confirmed pairs of ``a, b``; the texts are joined by id and text hash."""
        left = pairs.join(who.select(F.col("node").alias("b"), F.col("id").alias("id"), F.col("th")), "b")
        with_b = left.join(texts, left.id.eqNullSafe(texts.id) & (left.th == texts.th)).select("a", "b", F.col("text").alias("text_b"))
        ends = pairs.select(F.col("a").alias("node")).distinct().join(who, "node")
        of_a = ends.join(texts, ends.id.eqNullSafe(texts.id) & (ends.th == texts.th)).select(
            F.col("node").alias("a"), F.col("text").alias("text_a")
        )
        return stage(confirmed(with_b.join(of_a, "a"), words, percent), name)

    first = members.where("node != pivot").select(
        F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")
    ).distinct()
    found = links(first, "stars")
    grouped = components(found)
    placed = members.join(grouped, "node", "left").select(
        "key", "pivot", "node", "m", F.coalesce("label", "node").alias("label")
    )
    # members beside the pivot, where they are in different groups
    split = placed.where("node != pivot").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    apart = placed.where("node != pivot").join(split.where("lo != hi").select("key"), "key")
    maps = rows.select(F.col("row").alias("node"), "n", "bits")
    rest = possible_pairs(apart.join(maps, "node"), percent)
    more = links(rest.join(first, ["a", "b"], "left_anti"), "rest")
    if not more.isEmpty():
        grouped = components(found.union(more))
    of_class = classes.join(grouped, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = of_class.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = of_class.join(smallest, "label").select("s1", "s2", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "th")
    grouped_rows = rows.where("n > 0").select("id", "n", "s1", "s2", "th").join(named, ["s1", "s2"])
    grouped_rows = grouped_rows.select("id", "n", "component_id", "th")
    return alone.union(grouped_rows).select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.col("th").alias("text_hash"),
    )


@query("op4_minhash")
def op4_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=4).drop("text_hash")

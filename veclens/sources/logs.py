"""Shard logs: written one file per shard, read in blocks by many tasks, or from the end."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.monitor import ERROR_WORDS, TAIL
from ..session import as_uri, stage, task_filesystem

#: Fixed value: the name of a shard's log.
LOG_NAME = r"shard(\d+)[^/]*\.log"
BLOCK_BYTES = 64 << 20
STEP_BYTES = 1 << 20


def log_files(spark: SparkSession, path: str, name: str = LOG_NAME) -> DataFrame:
    """``path, length, shard_id`` of the logs in a folder and below; a folder that isn't there has none."""
    store, root = task_filesystem(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = as_uri(path).partition("://")[0]
    rows = [
        (f"{prefix}://{file.path}", file.size, int(match.group(1)))
        for file in found if file.type == fs.FileType.File and (match := re.fullmatch(name, file.base_name))
    ]
    return spark.createDataFrame(rows, "path string, length bigint, shard_id int")


def write_logs(lines: DataFrame, path: str) -> DataFrame:
    """Writes ``line`` of every shard to ``shard<n>.log`` in the order of ``line_no``; returns the files.

    A task holds a block of lines of its shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sink, n = None, None, 0

        def done() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"shard_id": pa.array([current], pa.int32()), "n_lines": [n]})

        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(shards)) + 1
            for first, last in zip([0, *edges], [*edges, len(batch)]):
                if first == last:
                    continue
                if shards[first] != current:
                    if sink is not None:
                        yield done()
                    current, n = int(shards[first]), 0
                    store, place = task_filesystem(f"{as_uri(path)}/shard{current}.log")
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place)
                sink.write("".join(f"{line}\n" for line in batch.column(1).slice(first, last - first).to_pylist()).encode())
                n += int(last - first)
        if sink is not None:
            yield done()

    ordered = lines.repartition("shard_id").sortWithinPartitions("shard_id", "line_no")
    narrow = ordered.select(F.col("shard_id").cast("int"), F.coalesce("line", F.lit("")))
    return stage(narrow.mapInArrow(run, "shard_id int, n_lines bigint"), "logs")


@dataclass(frozen=True)
class Block:
    """The lines of a file that begin in ``start <= position < stop``."""

    file: object
    start: int
    stop: int

    def newlines(self) -> int:
        """How many lines begin here: the first of the file, and those after a line end that isn't the file's last byte."""
        n, at = int(self.start == 0 and self.stop > 0), max(self.start - 1, 0)
        self.file.seek(at)
        while at < self.stop - 1:
            step = self.file.read(min(STEP_BYTES, self.stop - 1 - at))
            if not step:
                break
            n += step.count(b"\n")
            at += len(step)
        return n

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """Positions and bytes of the lines, the last one to its end wherever that is."""
        at, held, skip = max(self.start - 1, 0), b"", self.start > 0
        self.file.seek(at)
        while step := self.file.read(STEP_BYTES):
            *whole, held = (held + step).split(b"\n")
            for line in whole:
                if not skip:
                    if at >= self.stop:
                        return
                    yield at, line
                skip, at = False, at + len(line) + 1
            if not skip and at >= self.stop:
                return
        if held and not skip:
            yield at, held


def read_logs(spark: SparkSession, path: str, *, name: str = LOG_NAME, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``shard_id, line_no, line``: all lines of all logs, numbered from 0 in each file.

    Files are cut into blocks that many tasks read; a line belongs to the block
    it begins in. Blocks count their lines first, so numbers have no gaps
    although no task reads a whole file. Bytes that are not UTF-8 are left out.
    """
    files = log_files(spark, path, name)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("bigint")))
    blocks = files.where("length > 0").select("path", "shard_id", starts.alias("start"), "length")
    blocks = blocks.select("path", "shard_id", "start", F.least(F.col("start") + block_bytes, F.col("length")).alias("stop"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = task_filesystem(row["path"])
                with store.open_input_file(place) as file:
                    n = Block(file, row["start"], row["stop"]).newlines()
                yield pa.RecordBatch.from_pylist([row | {"n": n}], batch.schema.append(pa.field("n", pa.int64())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = task_filesystem(row["path"])
                number, lines = row["first"], []
                with store.open_input_file(place) as file:
                    for _, line in Block(file, row["start"], row["stop"]).lines():
                        lines.append(line.decode("utf-8", "ignore"))
                        if len(lines) == 10_000:
                            yield numbered(row["shard_id"], number, lines)
                            number, lines = number + len(lines), []
                yield numbered(row["shard_id"], number, lines)

    def numbered(shard: int, first: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "shard_id": pa.array([shard] * len(lines), pa.int32()), "line_no": pa.array(range(first, first + len(lines)), pa.int64()),
            "line": pa.array(lines, pa.string()),
        })

    spread = blocks.repartition("path", "start")
    schema = "path string, shard_id int, start bigint, stop bigint"
    counted = spread.mapInArrow(count, f"{schema}, n bigint")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    placed = counted.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").repartition("path", "start")
    return placed.mapInArrow(read, "shard_id int, line_no bigint, line string")


def log_tail(
    spark: SparkSession, path: str, *, limit: int = TAIL, words: Sequence[str] = ERROR_WORDS, name: str = LOG_NAME,
    block_bytes: int = STEP_BYTES,
) -> DataFrame:
    """``shard_id, from_end, position, line``: each log's last lines with one of the words, whatever its length.

    Files are read backward, block by block, until ``limit`` lines are found;
    ``position`` is the byte a line begins at. ``from_end`` is 1 for the last.
    """
    wanted = tuple(word.lower() for word in words)

    def last_lines(file) -> Iterator[tuple[int, str]]:
        end, held = file.size(), b""
        while end:
            begin = max(end - block_bytes, 0)
            file.seek(begin)
            held, end = file.read(end - begin) + held, begin
            keep = held.find(b"\n") + 1 if begin else 0
            if begin and not keep:
                continue  # the line begins further ahead
            tail, at = held[keep:], begin + keep + len(held) - keep
            parts = tail.split(b"\n")
            for i, part in enumerate(reversed(parts)):
                at -= len(part) + (i > 0)
                text = part.decode("utf-8", "ignore")
                if any(word in text.lower() for word in wanted):
                    yield at, text
            held = held[:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = task_filesystem(row["path"])
                found = []
                with store.open_input_file(place) as file:
                    for position, line in last_lines(file):
                        found.append((row["shard_id"], len(found) + 1, position, line.rstrip()))
                        if len(found) == limit:
                            break
                if found:
                    columns = zip(*found, strict=True)
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard_id", "from_end", "position", "line"]
                    )

    files = log_files(spark, path, name)
    return files.repartition("path").mapInArrow(run, "shard_id int, from_end int, position bigint, line string")

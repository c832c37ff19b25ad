"""Spark data source for ``.npy`` chunk files.

A shard folder holds ``activations/chunk_NNNN.npy`` (float16 matrices) and
``token_ids/chunk_NNNN.npy`` (int32 vectors). The driver lists files and their
sizes; headers are read by the tasks. Files are mapped, not loaded, and large
ones are split by rows, so a chunk of many GB feeds many tasks. Rows come and
go as Arrow batches.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import NPY_ROWS, NPY_TOKENS, column_names

SLICE_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
FOLDERS = {"activations": NPY_ROWS, "token_ids": NPY_TOKENS}
CHUNK_NAME = re.compile(r"chunk_(\d+)\.npy")
DTYPES = {"activations": "float16", "token_ids": "int32"}


@dataclass
class Slice(InputPartition):
    """Part ``part`` of ``parts`` equal ones of a file; its rows follow from the header, which the task reads."""

    path: str
    shard_id: int
    chunk_id: int
    part: int
    parts: int


@dataclass
class Written(WriterCommitMessage):
    files: list


def local_path(path: str) -> Path:
    """Chunk files are mapped into memory, so they need a mounted file system."""
    plain = re.sub(r"^file:(//)?", "", path)
    if "://" in plain:
        raise ValueError(f"{path}: .npy chunks need a path that every executor has mounted")
    return Path(plain)


def shard_of(folder: str) -> int:
    number = re.search(r"(\d+)/*$", folder)
    return int(number.group(1)) if number else 0


class NpyReader(DataSourceReader):
    def __init__(self, folders: list[str], kind: str):
        self.folders, self.kind = folders, kind

    def partitions(self):
        slices = []
        for folder in self.folders:
            directory = local_path(folder) / self.kind
            if not directory.exists():
                warnings.warn(f"{directory} does not exist, skipping", stacklevel=2)
                continue
            for file in sorted(os.scandir(directory), key=lambda entry: entry.name):
                if CHUNK_NAME.fullmatch(file.name):
                    slices += self.file_slices(file, shard_of(folder))
        if not slices:
            raise ValueError(f"no {self.kind} chunks found in {self.folders}")
        return slices

    def file_slices(self, file: os.DirEntry, shard_id: int) -> list[Slice]:
        """Parts of a file by its size alone; nothing is opened."""
        parts = max(1, -(-file.stat().st_size // SLICE_BYTES))
        chunk_id = int(CHUNK_NAME.fullmatch(file.name).group(1))
        return [Slice(file.path, shard_id, chunk_id, part, parts) for part in range(parts)]

    def opened(self, partition: Slice) -> np.ndarray:
        """The mapped file, if it holds what its folder should."""
        mapped = np.load(partition.path, mmap_mode="r")
        wanted = 2 if self.kind == "activations" else 1
        if mapped.ndim != wanted:
            raise ValueError(f"expected {wanted}D, got {mapped.ndim}D")
        if self.kind == "token_ids" and mapped.dtype.kind not in "iu":
            raise ValueError(f"expected integers, got {mapped.dtype}")
        return mapped

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        names = column_names(FOLDERS[self.kind])
        vector = pa.list_(pa.float32()) if self.kind == "activations" else pa.int64()

        def rows(n, values, start, dtype, error):
            columns = [
                pa.array(np.full(n, partition.shard_id, dtype=np.int32)),
                pa.array(np.full(n, partition.chunk_id, dtype=np.int32)),
                pa.array(np.arange(start, start + n)) if error is None else pa.nulls(n, pa.int64()),
                values,
                pa.array([dtype] * n, pa.string()),
                pa.array([error] * n, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        try:
            mapped = self.opened(partition)
        except Exception as problem:  # noqa: BLE001 - a bad file becomes one error row
            if partition.part == 0:
                yield rows(1, pa.nulls(1, vector), 0, None, str(problem) or type(problem).__name__)
            return
        first, last = (len(mapped) * part // partition.parts for part in (partition.part, partition.part + 1))
        per_row = max(1, mapped.nbytes // max(1, len(mapped)))
        step = max(1, BATCH_BYTES // per_row)
        for start in range(first, last, step):
            block = np.asarray(mapped[start:min(start + step, last)])
            n = len(block)
            if self.kind == "activations":
                width = block.shape[1]
                offsets = pa.array(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1])
                flat = np.ascontiguousarray(block, dtype=np.float32).reshape(-1)
                values = pa.ListArray.from_arrays(offsets, pa.array(flat))
            else:
                values = pa.array(block.astype(np.int64))
            yield rows(n, values, start, str(mapped.dtype), None)


class ChunkFile:
    """One ``.npy`` file that grows by blocks of rows; its name and row count come last."""

    def __init__(self, target: Path, dtype: str):
        target.parent.mkdir(parents=True, exist_ok=True)
        self.target, self.dtype = target, np.dtype(dtype)
        self.partial = target.with_suffix(f".part{os.getpid()}-{os.urandom(4).hex()}")
        self.sink, self.rows, self.shape = open(self.partial, "wb"), 0, None

    def header(self) -> None:
        # numpy leaves room for a longer first axis, so the header can be written again in place
        described = {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": (self.rows, *(self.shape or ()))}
        self.sink.seek(0)
        np.lib.format.write_array_header_1_0(self.sink, described)

    def add(self, block: np.ndarray) -> None:
        if self.shape is None:
            self.shape = block.shape[1:]
            self.header()
        if block.shape[1:] != self.shape:
            raise ValueError(f"{self.target.name}: rows of {block.shape[1:]} after rows of {self.shape}")
        self.sink.write(np.ascontiguousarray(block, dtype=self.dtype).data)
        self.rows += len(block)

    def close(self) -> tuple[str, str]:
        self.header()
        self.sink.close()
        return str(self.partial), str(self.target)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; all its rows have one width."""
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or len(np.unique(widths)) > 1:
        raise ValueError("the vectors of a chunk must have one width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class NpyWriter(DataSourceArrowWriter):
    """Writes both files of each chunk that a task receives, batch by batch; see ``write_npy``."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, str]] = []
        current, files = None, {}
        try:
            for batch in iterator:
                shards, chunks = (batch.column(name).to_numpy() for name in ("shard_id", "chunk_id"))
                edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(chunks) != 0)) + 1
                for first, last in zip([0, *edges], [*edges, len(batch)]):
                    if first == last:
                        continue
                    chunk = (int(shards[first]), int(chunks[first]))
                    if chunk != current:
                        done += [file.close() for file in files.values()]
                        current, files = chunk, {kind: self.file(chunk, kind) for kind in FOLDERS}
                    part = batch.slice(first, last - first)
                    files["activations"].add(matrix_of(part.column("activation")))
                    files["token_ids"].add(part.column("token_id").to_numpy())
            done += [file.close() for file in files.values()]
            files = {}
        finally:
            for file in files.values():
                file.sink.close()
                file.partial.unlink(missing_ok=True)
        return Written(done)

    def file(self, chunk: tuple[int, int], kind: str) -> ChunkFile:
        return ChunkFile(local_path(self.root) / f"shard{chunk[0]}" / kind / f"chunk_{chunk[1]:04d}.npy", DTYPES[kind])

    def commit(self, messages) -> None:
        for message in messages:
            for partial, target in message.files if message else []:
                os.replace(partial, target)

    def abort(self, messages) -> None:
        for message in messages:
            for partial, _ in message.files if message else []:
                Path(partial).unlink(missing_ok=True)


class NpyDataSource(DataSource):
    """Format ``npychunks``; options ``kind`` and, for reading, ``shards``."""

    @classmethod
    def name(cls) -> str:
        return "npychunks"

    def schema(self) -> str:
        return FOLDERS[self.options.get("kind", "activations")]

    def reader(self, schema: StructType) -> NpyReader:
        shards = self.options.get("shards") or self.options["path"]
        return NpyReader(shards.split(","), self.options.get("kind", "activations"))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])


def read_npy(spark: SparkSession, shards: list[str], kind: str = "activations") -> DataFrame:
    """Rows of all chunks of the shard folders; unreadable files give error rows."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npychunks").option("kind", kind).option("shards", ",".join(shards)).load()


def write_npy(df: DataFrame, root: str) -> None:
    """Writes ``activation`` and ``token_id`` as aligned chunk files.

    Both come from one shuffle: a chunk's rows meet in one task in row order,
    are appended to its two files block by block, and the files get their names
    only when the job commits.
    """
    df.sparkSession.dataSource.register(NpyDataSource)
    ordered = df.repartition("shard_id", "chunk_id").sortWithinPartitions("shard_id", "chunk_id", "row_in_chunk")
    columns = [F.col(name).cast("int").alias(name) for name in ("shard_id", "chunk_id", "token_id")]
    vectors = F.col("activation").cast("array<float>").alias("activation")
    ordered.select(*columns, vectors).write.format("npychunks").mode("append").save(root)

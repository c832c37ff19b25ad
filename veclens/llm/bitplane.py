"""Token ids in binary files: byte or bit planes of blocks, each compressed, with a chunk index."""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veclens.session import stage, staging_path, task_filesystem

from . import query
from .chunks import ChunkEncoder
from .texts import documents, flat, ranges, runs, small_batches, white_mask, whole, worker_cache

#: Bytes of text that are cut into chunks at once, and chunks whose ids a worker remembers; few of a corpus' words are rare.
RUN_BYTES, REMEMBERED = 8 << 20, 500_000
MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
TRAILER = "<QQQ8s"


# ---- the file format


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The ids' bytes (``byte``: 4 planes) or bits (``bit``: 32 planes), plane by plane."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        return [plane.tobytes() for plane in np.packbits(bits.T, axis=1, bitorder="little")]
    return [plane.tobytes() for plane in rows.T]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1)
        bits = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little")
    else:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class PlaneWriter:
    """Blocks one after the other, then documents, chunk index and trailer; holds one block."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.kind, self.block = out, kind, block
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting = [], 0
        self.at, self.n_ids = len(MAGIC), 0
        self.index: list[tuple[int, int]] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their lengths, and all their ids in a row."""
        self.docs.append(np.asarray(doc_ids, "<i8"))
        self.lengths.append(np.asarray(lengths, "<i8"))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            joined = np.concatenate(self.waiting)
            full = len(joined) // self.block * self.block
            for start in range(0, full, self.block):
                self._put(joined[start : start + self.block])
            self.waiting, self.n_waiting = [joined[full:]], len(joined) - full

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.packer.compress(plane) for plane in to_planes(ids, self.kind)]
        head = struct.pack(f"<IB{len(planes)}I", len(ids), len(planes), *map(len, planes))
        self.index.append((self.at, len(ids)))
        for part in (head, *planes):
            self.out.write(part)
            self.at += len(part)

    def close(self) -> None:
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        if len(rest):
            self._put(rest)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8")
        listed = self.packer.compress(docs.tobytes() + lengths.tobytes())
        chunks = self.packer.compress(np.asarray(self.index, "<i8").tobytes())
        self.out.write(listed)
        self.out.write(chunks)
        self.out.write(struct.pack(TRAILER, len(docs), len(listed), len(chunks), MAGIC))


class PlaneReader:
    """Documents, chunk index and blocks of an open file with ``seek`` and ``read``."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        size = struct.calcsize(TRAILER)
        file.seek(end - size)
        n_docs, listed, chunks, magic = struct.unpack(TRAILER, file.read(size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        self.unpacker = zstandard.ZstdDecompressor()
        file.seek(end - size - chunks - listed)
        both = np.frombuffer(self.unpacker.decompress(file.read(listed)), "<i8")
        self.docs, self.lengths = both[:n_docs], both[n_docs:]
        self.index = np.frombuffer(self.unpacker.decompress(file.read(chunks)), "<i8").reshape(-1, 2)

    def chunk(self, i: int) -> np.ndarray:
        self.file.seek(int(self.index[i, 0]))
        n, planes = struct.unpack("<IB", self.file.read(5))
        sizes = struct.unpack(f"<{planes}I", self.file.read(4 * planes))
        return from_planes([self.unpacker.decompress(self.file.read(size)) for size in sizes], n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads only the chunks that hold them."""
        ends = np.cumsum(self.index[:, 1])
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, stop, side="left"))
        found = [self.chunk(i) for i in range(first, min(last + 1, len(ends)))]
        base = int(ends[first - 1]) if first else 0
        return np.concatenate([*found, np.zeros(0, np.uint32)])[start - base : stop - base]

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """Each document's number and the bytes of its ids, block by block."""
        held, at, chunk = b"", 0, 0
        for i, length in enumerate(self.lengths.tolist()):
            need = 4 * length
            parts, have = [held[at : at + need]], min(need, len(held) - at)
            at += have
            while have < need:
                held, at = self.chunk(chunk).tobytes(), min(need - have, 4 * int(self.index[chunk, 1]))
                chunk += 1
                parts.append(held[:at])
                have += at
            yield i, b"".join(parts)


# ---- tokenizing


def solid_ends(data: np.ndarray) -> np.ndarray:
    """Bytes that surely end a character which isn't white space."""
    solid = data > 32
    wide = np.flatnonzero(data >= 0x80)
    if len(wide):
        before, ahead = data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
        # white space beyond ASCII: U+0085, U+00A0, U+1680, U+20xx, U+3000
        maybe = (before == 0xC2) & np.isin(data[wide], (0x85, 0xA0))
        maybe |= (ahead == 0xE1) & (before == 0x9A) | (ahead == 0xE2) & np.isin(before, (0x80, 0x81))
        maybe |= (ahead == 0xE3) & (before == 0x80)
        solid[wide[maybe]] = False
    return solid


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where white space follows a solid character: byte-level BPE never joins across it."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = white_mask(data[1:]) & solid_ends(data)[:-1]
    cut[offsets] = True
    return np.flatnonzero(cut)


def library_encoder(path: str, joined: int = 500):
    """Encodes chunks with the tokenizers library, many in one string.

    Chunks that begin with white space and end solid are joined; ids are dealt
    back by the lengths of their bytes, which byte-level BPE keeps exactly.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    length = np.array([len(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())], np.int64)

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum(sizes)
        joins = white_mask(data[ends - sizes]) & solid_ends(data)[ends - 1]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        n = int(joins.sum())
        groups = [order[i : min(i + joined, n)] for i in range(0, n, joined)] + [order[i : i + 1] for i in range(n, len(order))]
        texts = [b"".join([chunks[i] for i in group]).decode("utf-8", "replace") for group in groups]
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(one.ids, np.int32) for one in coded])
        upto = np.searchsorted(np.cumsum(length[ids]), np.cumsum(sizes[order]), side="right")
        found = np.diff(upto, prepend=0)
        counts = np.empty(len(chunks), np.int64)
        counts[order] = found
        starts = np.empty(len(chunks), np.int64)
        starts[order] = upto - found
        return ids[ranges(starts, counts)], counts

    return encode


def encoder_of(path: str) -> ChunkEncoder:
    """One per Python worker, kept from task to task."""
    kept = worker_cache()
    if ("bitplane", path) not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept["bitplane", path] = ChunkEncoder(library_encoder(path), REMEMBERED)
    return kept["bitplane", path]


def encode_rows(column: pa.Array, encoder: ChunkEncoder, end_id: int):
    """Row ranges with the ids and lengths of their documents, each with ``end_id`` at its end."""
    data, offsets = flat(column)
    for start, end in runs(offsets, RUN_BYTES):
        own = offsets[start : end + 1] - offsets[start]
        part = data[offsets[start] : offsets[end]]
        cuts = word_cuts(part, own)
        ids, counts = encoder(part, cuts)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, own)]
        ids = np.insert(ids, upto[1:], end_id).astype(np.uint32)
        yield start, end, ids, np.diff(upto) + 1


# ---- writing and reading as Spark jobs

NONE = -(1 << 63)


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int = 2,
    kind: str = "byte",
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Writes all documents' ids, ascending by id, one file per task; returns the table of files.

    Documents are dealt to tasks by ranges of ids and sorted there (null ids
    first, rows that repeat an id by text; a null text is empty). A file's name
    has its attempt, and only files of attempts that finished are in the table,
    so a lost executor costs its own files only. ``folder`` is on storage that
    all executors share. An empty table gives no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder, writer, out, path, n_docs = encoder_of(tokenizer), None, None, "", 0
        for batch in batches:
            numbers = batch.column(0).fill_null(NONE).to_numpy()
            for start, end, ids, lengths in encode_rows(batch.column(1), encoder, end_id):
                if writer is None:
                    path = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.bin"
                    store, place = task_filesystem(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place)
                    writer = PlaneWriter(out, kind)
                writer.add(numbers[start:end], lengths, ids)
                n_docs += end - start
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([task.partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()),
                 "n_ids": pa.array([writer.n_ids], pa.int64())}
            )

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), whole(text).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return stage(small_batches(dealt).mapInArrow(write, "part bigint, path string, n_docs bigint, n_ids bigint"), "id-files")


def read_documents(files: DataFrame) -> DataFrame:
    """Each document of the files: ``doc_id, start, n_tokens, ids_crc32``; start counts all ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = task_filesystem(path)
                with store.open_input_file(place) as file:
                    reader = PlaneReader(file)
                    sums = np.fromiter((zlib.crc32(ids) for _, ids in reader.documents()), np.int64, len(reader.docs))
                ends = np.cumsum(reader.lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.docs, pa.int64(), mask=reader.docs == NONE),
                    "start": before + ends - reader.lengths,
                    "n_tokens": reader.lengths,
                    "ids_crc32": sums,
                })

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("part", "path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    dealt = placed.repartitionByRange(max(1, files.count()), "part").select("path", "before")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op8_bitplane")
def op8_bitplane(spark, sf_dir):
    import public_tokenizers

    folder = staging_path(spark, "id-planes")
    return read_documents(write_ids(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json")))

"""Column expressions and byte arrays that several operators share."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of all contracts, space and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text), F.lit(""))


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def without_white(text: str = "text") -> Column:
    return F.translate(whole(text), WHITE, "")


def seeded(id_column: str, seed: int | str) -> Column:
    """``md5(seed:id)``; a null id counts as empty."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


#: Bytes of text that tasks handle at once.
RUN_BYTES = 2 << 20


#: Rows that go to a Python worker at once at most; texts are long, so Spark's default is much.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by ``BATCH_ROWS``, for operators whose tasks take texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def white_mask(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes, which end with their row, and each row's first run."""
    n = len(solid)
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = solid[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word number."""
    return spans(~white_mask(data), offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A to Z in lower case."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def packed(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of bytes that lie one after the other."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + length - 1`` of all segments, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_ODD = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def worker_cache() -> dict:
    """What a Python worker keeps from task to task.

    Functions of this package travel by value, so a module's own globals are new
    in every task; the ``sys`` module is not.
    """
    return sys.__dict__.setdefault("_veclens_llm_cache", {})


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    kept = worker_cache()
    if "powers" not in kept or len(kept["powers"][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors))
        kept["powers"] = tuple(both)
    return kept["powers"]


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return _BYTES[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))

"""Tokenizing by distinct chunks: texts repeat words, so each distinct one is encoded once per batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .texts import ranges

#: New chunks that are encoded in one call.
AT_ONCE = 20_000

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class ChunkEncoder:
    """Remembers the ids of chunks; at most ``limit`` and those of one batch.

    ``encode`` gives the ids of a list of chunks, one after the other, and the
    number of ids of each. Chunks must be cut where the tokenizer never joins
    across, so that a text's ids are those of its chunks in a row.
    """

    def __init__(self, encode: Encode, limit: int = 100_000):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks of ``data``, and how many ids each has; ``cuts`` has both ends."""
        if len(self.known) > self.limit:
            self.forget()
        if len(cuts) < 2:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = pa.py_buffer(np.ascontiguousarray(cuts, np.int32))
        chunks = pa.Array.from_buffers(
            pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        get = self.known.get
        at = np.fromiter((get(chunk, -1) for chunk in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing]
            parts = [self.encode(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
            ids, counts = (np.concatenate(part) for part in zip(*parts, strict=True))
            at[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, at[missing].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
        picked = at[chunks.indices.to_numpy()]
        counts = self.counts[picked]
        return self.ids[ranges(self.starts[picked], counts)], counts

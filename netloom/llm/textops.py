"""Vectorised word and n-gram helpers over Arrow string columns (used inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15)
#: Bytes of text handled at once, so that the 64-bit temporaries stay small.
SLICE_BYTES = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


#: How many of the 8 bytes of a word count when that many are left.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
#: Bytes of one span that are hashed with those of all others; the rest of a longer one by itself.
LONG = 1024


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair: 8 bytes at a time through a non-linear mix, so no arrangement of bytes cancels out."""
    import xxhash

    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        left = end - start
        h = mix64((left.astype(U64) + U64(1)) * _BASE + U64(seed) * U64(0xD6E8FEB86659FD93))
        live, at = np.arange(len(start)), start
        for _ in range(LONG // 8):
            h[live] = mix64(h[live] * _BASE ^ (eight[at] & _MASK[np.minimum(left, 8)]))
            more = left > 8
            if not more.any():
                return h
            live, at, left = live[more], at[more] + 8, left[more] - 8
        raw = data.tobytes()
        for i, a, n in zip(live.tolist(), at.tolist(), left.tolist()):
            h[i] ^= U64(xxhash.xxh3_64_intdigest(raw[a : a + n], seed))
        h[live] = mix64(h[live])
    return h


def runs_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` neighbours of h, built from halves."""
    with np.errstate(over="ignore"):
        out, k = h, 1
        for bit in bin(size)[3:]:
            out, k = mix64(out[: max(len(out) - k, 0)] * _BASE + out[k:]), 2 * k
            if bit == "1":
                out, k = mix64(out[: max(len(h) - k, 0)] * _BASE + h[k:]), k + 1
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in runs of rows of about `most` bytes of text each; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts: bounds in the bytes, first word of each text, 64-bit hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.at = utf8(column)
        space = _SPACE[self.data]
        first, last = ~space, ~space
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        begins = self.at[:-1][self.at[:-1] < self.at[1:]]
        first[begins] = ~space[begins]
        last[begins[begins > 0] - 1] = ~space[begins[begins > 0] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, self.at)
        self.space = space
        self._hashes: dict[int, np.ndarray] = {}

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, wherever they stand."""
        return span_hashes(self.data, start, end)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Of each word; other seeds give independent hashes."""
        if seed not in self._hashes:
            self._hashes[seed] = span_hashes(self.data, self.start, self.end, seed)
        return self._hashes[seed]

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of `size` words of one text, and the number of its first word."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        doc = self.doc()
        i = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        return runs_of(self.hashes(seed), size)[i], i


def covered(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words that begins at one of `first`."""
    d = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(first + size, n), minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def per_text(flags: np.ndarray, at: np.ndarray, kind=np.int64) -> np.ndarray:
    """Sum of flags of each text, whose items go from at[k] to at[k + 1]."""
    c = np.concatenate([np.zeros(1, kind), np.cumsum(flags, dtype=kind)])
    return c[at[1:]] - c[at[:-1]]

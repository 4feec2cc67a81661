"""Tokens of UTF-8 texts and their 64-bit hashes, found with numpy over whole buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time.
PIECE = 1 << 20
#: Bytes hashed at a time; a longer token is still hashed whole.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: 0 blank, 1 word character (ASCII letters and digits, all beyond ASCII), 2 other.
KINDS = np.full(256, 2, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, the same wherever the span is. Spans ascend and do not overlap."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        at = starts[lo]
        part = buf[at : ends[hi - 1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = mixed((sums[e] - sums[s]) * down[s])
        lo = hi
    return out


def spans(buf: np.ndarray, by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens: runs without blanks, cut where the kind changes if by_kind."""
    kinds = KINDS[buf] if by_kind else (KINDS[buf] > 0).astype(np.uint8)
    edges = np.flatnonzero(np.diff(kinds, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = edges[:-1], edges[1:]
    on = kinds[starts] > 0 if len(starts) else np.zeros(0, bool)
    return starts[on], ends[on]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts with a blank after each, and where each starts (one more: the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), offsets


def hashed(texts: list[bytes], by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and where each text's begin (one more: the end)."""
    buf, offsets = joined(texts)
    starts, ends = spans(buf, by_kind)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def cut(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs that sum up to about `limit`; a larger item is a run of its own."""
    lo, size, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if i >= lo:
        yield lo, i + 1


def pieces(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `limit` bytes; a longer text is a run of its own."""
    return cut(map(len, texts), limit)


def parts(batch: pa.RecordBatch, column: int, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about `limit` bytes in a text column, and the texts of each; a null is empty. So of a batch only a
    slice is held as Python objects and in the arrays made of them."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in cut(sizes.tolist(), limit):
        part = batch.slice(lo, hi - lo)
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]

"""Words of whole Arrow columns, found on the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time; a longer text is one block.
BLOCK = 4 << 20
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK, BLANK, WORD = 0, 1, 2


def kinds(blank: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte: blanks stand between words, breaks also between pieces, all else is of a word."""
    out = np.full(256, WORD, np.uint8)
    out[list(blank)] = BLANK
    out[list(breaks)] = BREAK
    return out


@dataclass
class Words:
    """words: all words of the texts, in order; doc: the text of each; piece: ascends at each break and text."""

    words: pa.Array
    doc: np.ndarray
    piece: np.ndarray
    n_docs: int


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """The lower-cased words of the texts (null: none), cut at the bytes that are not of kind WORD."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    at = at - at[0]
    got = kind[data]
    inside = got == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    starts[heads] = inside[heads]
    starts = np.flatnonzero(starts)
    before = np.cumsum(inside, dtype=np.int64)
    offsets = np.zeros(len(starts) + 1, np.int64)
    offsets[:-1] = before[starts] - 1
    offsets[-1] = before[-1] if len(before) else 0
    own = LOWER[data[inside]]
    if offsets[-1] < 1 << 31:
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own))
    else:
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own))
    doc = np.searchsorted(at, starts, "right") - 1
    piece = np.cumsum(got == BREAK)[starts] + doc if len(starts) else np.zeros(0, np.int64)
    return Words(words, doc, piece, n)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about so many bytes of text: large batches are cut, small ones joined."""
    held, bytes_ = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + size - bytes_, "right")))
            held.append(batch.slice(lo, hi - lo))
            bytes_ += int(ends[hi - 1] - base)
            lo = hi
            if bytes_ >= size or hi < batch.num_rows:
                yield joined()
                held, bytes_ = [], 0
    if held:
        yield joined()

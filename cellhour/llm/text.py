"""Words and hashes of whole Arrow batches, as arrays.

Texts stay in Arrow's own buffer: one byte array with an offset for each
document. Nothing here looks at more than one slice of a batch at a time, and a
slice holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A worker holds some 130 bytes of arrays for each byte of a slice, so larger slices cost memory and are no faster.
SLICE_BYTES = 1 << 18
MOST_POWERS = 1 << 22
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... of at least `n` entries, modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        fresh = np.full(max(n, 1 << 16), base, dtype=U64)
        fresh[0] = 1
        known = np.multiply.accumulate(fresh)
        if n <= MOST_POWERS:
            _powers[base] = known
    return known[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which `span_hash` gets the hash of any span."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans hash alike wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, document offsets) of parts of a batch; null is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and each document's first word."""
    n = len(data)
    solid = ~WHITE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and each document's first word."""
    starts, ends, firsts = word_spans(data, offsets)
    return span_hash(prefix_hash(data.astype(U64) + U64(1)), starts, ends), firsts


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one document, with the document's number.

    A document of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(firsts)
    short = (counts > 0) & (counts < size)
    n = np.where(short, 1, np.maximum(counts - size + 1, 0))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + firsts[:-1][doc]
    ends = np.where(short[doc], firsts[1:][doc], at + size)
    return span_hash(prefix_hash(words), at, ends), doc


#: Byte classes: 0 white space and controls, 1 letters (all of UTF-8 beyond ASCII too), 2 digits, 3 the rest.
BYTE_CLASS = np.full(256, 3, dtype=np.uint8)
BYTE_CLASS[:0x21] = 0
BYTE_CLASS[ord("0"):ord("9") + 1] = 2
BYTE_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def class_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, classes, documents) of the runs of letters, of digits and of other signs."""
    kind = BYTE_CLASS[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return starts, ends, kind[starts], np.searchsorted(offsets, starts, side="right") - 1


def lower_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans without regard to the case of ASCII and Latin-1 letters."""
    low = LOWER[data]
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[capital] += 32
    return span_hash(prefix_hash(low.astype(U64) + U64(1)), starts, ends)

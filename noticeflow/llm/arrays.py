"""Text columns as byte arrays: words and their hashes for a whole Arrow batch at once.

Bytes from 0x80 up belong to UTF-8 letters, so a set of ASCII bytes decides where words
end and no text needs to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def byte_set(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text.encode("ascii"))] = True
    return table


#: Bytes that a-z, 0-9 and every non-ASCII character are written with (A-Z is lowered first).
WORD_BYTES = byte_set("abcdefghijklmnopqrstuvwxyz0123456789") | (np.arange(256) >= 0x80)
NOT_SPACE = ~byte_set(" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str,
           most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text; one text is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def word_bounds(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Start, end and row of every maximal run of `inside` bytes within a row."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    mask = inside[raw]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0], last[-1] = True, True
    np.logical_not(mask[:-1], out=first[1:])
    np.logical_not(mask[1:], out=last[:-1])
    filled = offs[1:] > offs[:-1]
    first[offs[:-1][filled]] = True
    last[offs[1:][filled] - 1] = True
    starts = np.flatnonzero(mask & first)
    ends = np.flatnonzero(mask & last) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, np.repeat(np.arange(len(offs) - 1), counts)


def power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = BASE if kind == "up" else INVERSE
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:  # one very long text is not remembered
            _powers[kind] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes evenly (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span, equal for equal bytes anywhere."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power("up", n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * power("down", n + 1)[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def hash_of(words: list[bytes]) -> np.ndarray:
    """span_hashes of separate words."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    return span_hashes(raw, ends - [len(w) for w in words], ends)

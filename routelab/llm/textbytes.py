"""Vectorised work on the UTF-8 bytes of a batch of texts: word spans and 64-bit hashes of spans, in numpy inside Arrow tasks.

Hashes are polynomial over random 64-bit values of the bytes, from one running sum per batch, so the hash of any span is one subtraction
and one product whatever its length. Nothing here depends on the batch that a text falls into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CHUNK = 1 << 20


def byte_values(which: int = 0) -> np.ndarray:
    """256 fixed random 64-bit values."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(which * 7919 + 1))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n; kept for the usual sizes only."""
    known = _powers.get(which)
    if known is not None and len(known[0]) > n:
        return known
    base = int(_BASES[which])
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n + 1, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if n <= 4 * CHUNK:
        _powers[which] = (out[0], out[1])
    return out[0], out[1]


class Sums:
    """Running sums of a byte buffer, for hashes of its spans."""

    def __init__(self, buf: np.ndarray, values: np.ndarray, which: int = 0):
        p, self.inverse = powers(max(len(buf), CHUNK + (CHUNK >> 2)), which)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(values[buf] * p[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end, the same wherever they stand."""
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def batches(it: Iterator[pa.RecordBatch], text_at: int = 1, most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have up to ``most`` bytes together (one text at least), with the texts as bytes (null: empty)."""
    for batch in it:
        texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
        start, held = 0, 0
        for i, t in enumerate(texts):
            if i > start and held + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t)
        if texts[start:]:
            yield batch.slice(start), texts[start:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a newline after each text, and where each text starts (one entry more than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of word bytes; the newline must not be one."""
    m = is_word[buf].view(np.int8)
    edge = np.diff(m, prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def white_words() -> np.ndarray:
    """Word bytes: all but ASCII white space."""
    w = np.ones(256, dtype=bool)
    w[[9, 10, 11, 12, 13, 32]] = False
    return w


def letter_words() -> np.ndarray:
    """Word bytes: ASCII letters and digits and everything beyond ASCII."""
    w = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        w[a:b] = True
    return w


def lower_values() -> np.ndarray:
    """Byte values that hash A-Z as a-z."""
    v = byte_values().copy()
    v[65:91] = v[97:123]
    return v

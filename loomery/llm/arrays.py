"""numpy helpers over Arrow string columns: byte views, word hashes, ragged gathers.

A batch is handled in slices of bounded size, so memory follows the slice (or the longest
single text) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER, dtype=np.uint8)

SLICE_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    spots = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return spots, raw


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) whose texts together hold about limit bytes; a longer text comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled, step = filled + more, (step * step) & ((1 << 64) - 1)
    return out


class SpanHasher:
    """64-bit hashes of many byte spans at once, from prefix sums of a polynomial."""

    def __init__(self, seed: int = 1) -> None:
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        self.up = _powers(_MULTIPLIER, 1)
        self.down = _powers(_INVERSE, 1)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(raw) + 1:
            n = max(len(raw) + 1, 1 << 16)
            self.up, self.down = _powers(_MULTIPLIER, n), _powers(_INVERSE, n)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=sums[1:])
        span = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(span + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) of consecutive texts, and n + 1 offsets into them.

    offsets are relative to raw. A text longer than the slice size is hashed piece by piece,
    cut at white space, so that only its word hashes are held together.
    """
    n = len(offsets) - 1
    if n == 1 and len(raw) > 4 * SLICE_BYTES:
        parts, at = [], 0
        while at < len(raw):
            end = min(at + SLICE_BYTES, len(raw))
            while end < len(raw) and not SPACE[raw[end]]:
                end = min(end + 4096, len(raw)) if not SPACE[raw[end : end + 4096]].any() else end + int(np.argmax(SPACE[raw[end : end + 4096]]))
            piece = raw[at:end]
            parts.append(word_hashes(piece, np.array([0, len(piece)]), hasher)[0] if len(piece) <= 4 * SLICE_BYTES else _hash_words(piece, np.array([0, len(piece)]), hasher)[0])
            at = end
        found = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        return found, np.array([0, len(found)])
    return _hash_words(raw, offsets, hasher)


def _hash_words(raw: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    begin, stop = word_spans(raw, offsets)
    return hasher(LOWER_TABLE[raw], begin, stop), np.searchsorted(begin, offsets)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words of consecutive texts begin and end."""
    is_word = ~SPACE[raw]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = is_word[first]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = first_last(offsets)
    ends[last] = is_word[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def first_last(offsets: np.ndarray) -> np.ndarray:
    """Position of the last byte of every text that has one."""
    return offsets[1:][offsets[:-1] < offsets[1:]] - 1


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of runs of k words; of fewer words, their whole sequence; of none, nothing."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    m = len(words) - k + 1
    out = np.full(m, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xA0761D6478BD642F) + words[i : i + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def gather(arena: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of arena[s : s + l] for all pairs."""
    total = int(lens.sum())
    if total == 0:
        return arena[:0]
    before = np.cumsum(lens) - lens
    return arena[np.repeat(starts - before, lens) + np.arange(total)]

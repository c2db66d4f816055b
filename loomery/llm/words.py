"""Words of whole texts as codes of distinct words, slice by slice.

A word is a maximal run of [0-9A-Za-z] and non-ASCII characters, only A-Z lower-cased. Slices hold about
SLICE_BYTES of text; a longer text comes in several slices, cut between words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from loomery.llm import arrays

WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SLICE_BYTES = 1 << 20


@dataclass
class Slice:
    """Words of the rows from first on: codes into distinct, and rows + 1 bounds of each row's codes."""

    first: int
    distinct: pa.Array
    codes: np.ndarray
    bounds: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row in the slice, code, occurrences) of the distinct words of each row, in that order."""
        width = max(len(self.distinct), 1)
        rows = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int64), self.lengths)
        keys, counts = np.unique(rows * width + self.codes, return_counts=True)
        return keys // width, keys % width, counts


def word_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The slices of a string column in order; null has no words. A row's slices follow one another."""
    offsets, raw = arrays.text_buffers(column)
    for lo, hi in arrays.row_slices(offsets, limit):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= 2 * limit or hi - lo > 1:
            yield _slice(lo, raw[begin:end], offsets[lo : hi + 1] - begin)
            continue
        while begin < end:
            stop = _between_words(raw, min(begin + limit, end), end)
            yield _slice(lo, raw[begin:stop], np.array([0, stop - begin]))
            begin = stop


def _between_words(raw: np.ndarray, at: int, end: int) -> int:
    """The first place from at on where no word goes on."""
    while at < end and WORD[raw[at]]:
        ahead = WORD[raw[at : min(at + 4096, end)]]
        at += len(ahead) if ahead.all() else int(np.argmin(ahead))
    return at


def _slice(first: int, raw: np.ndarray, bounds: np.ndarray) -> Slice:
    is_word = WORD[raw]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[heads] = is_word[heads]
    data = arrays.LOWER_TABLE[raw[is_word]]
    spots = np.append(np.flatnonzero(starts[is_word]), len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(spots) - 1, [None, pa.py_buffer(spots), pa.py_buffer(data)]).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Slice(first, found.dictionary, codes, np.searchsorted(np.flatnonzero(starts), bounds))


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a binary array."""
    _, offsets, data = values.buffers()
    spots = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int32)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, spots.astype(np.int64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_spans(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, long: int = 96) -> np.ndarray:
    """Unsigned CRC-32 of many byte spans: one byte of all of them at a time, long ones one by one."""
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-lens, kind="stable")
    n_long = int(np.searchsorted(-lens[order], -long, side="left"))
    for i in order[:n_long]:
        out[i] = zlib.crc32(raw[starts[i] : starts[i] + lens[i]].tobytes())
    order = order[n_long:]
    at, left = starts[order], lens[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -k, side="left"))  # spans with more than k bytes come first
        crc[:m] = _CRC[(crc[:m] ^ raw[at[:m] + k]) & 0xFF] ^ (crc[:m] >> 8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out

"""A table from word hashes to token ids that is looked up for whole arrays at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from loomery.llm.arrays import SpanHasher, gather
from loomery.llm.pretokenize import pieces, token_starts

PIECE_BYTES = 1 << 18


class WordCache:
    """Open addressing over 64-bit hashes of a word's bytes and length.

    encode is asked once for each word not seen before. Past max_words the table starts
    anew, so memory is bounded whatever the vocabulary of the input; texts of more words are
    looked up run by run.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], max_words: int = 1 << 20) -> None:
        self.encode, self.max_words = encode, max_words
        self.bits = (4 * max_words - 1).bit_length()
        self.hasher = SpanHasher(seed=11)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.spots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.used = 0
        self.arena = np.zeros(1 << 16, dtype=np.uint32)
        self.filled = 0
        self.starts = np.zeros(self.max_words + 1, dtype=np.int64)
        self.lens = np.zeros(self.max_words + 1, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 where there is none."""
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.spots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            out[wrong] = self.spots[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != hashes[wrong])]
        return out

    def _add(self, hashes: np.ndarray, words: list[bytes]) -> None:
        made = self.encode(words)
        lens = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
        flat = np.fromiter(chain.from_iterable(made), dtype=np.uint32, count=int(lens.sum()))
        if self.filled + len(flat) > len(self.arena):
            self.arena = np.concatenate((self.arena, np.zeros(max(len(self.arena), len(flat)), dtype=np.uint32)))
        self.arena[self.filled : self.filled + len(flat)] = flat
        new = slice(self.used, self.used + len(made))
        self.starts[new], self.lens[new] = self.filled + np.cumsum(lens) - lens, lens
        entries, mask = np.arange(new.start, new.stop, dtype=np.int32), (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(at):
            # of those that meet at a free place one gets it, the others go on to the next
            _, one = np.unique(at, return_index=True)
            one = one[self.spots[at[one]] < 0]
            self.keys[at[one]], self.spots[at[one]] = hashes[one], entries[one]
            left = np.ones(len(at), dtype=bool)
            left[one] = False
            at, hashes, entries = (at[left] + 1) & mask, hashes[left], entries[left]
        self.used, self.filled = self.used + len(made), self.filled + len(flat)

    def entries(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Entry of every word of raw, at most max_words; words begin at starts and end where the next begins."""
        ends = np.append(starts[1:], len(raw))
        hashes = self.hasher(raw, starts, ends)
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.used + len(new) > self.max_words:
                self.clear()
                new, first, missing = *np.unique(hashes, return_index=True), np.arange(len(hashes))
            data = raw.tobytes()
            at = missing[first]
            self._add(new, [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found = self._find(hashes)
        return found

    def encode_texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and n + 1 offsets into them. offsets are relative to raw."""
        starts = token_starts(raw, offsets)
        ids, lens = [self.arena[:0]], [np.zeros(1, dtype=np.int64)]
        for lo in range(0, len(starts), self.max_words):  # entries hold until the table starts anew
            own = starts[lo : lo + self.max_words]
            end = starts[lo + self.max_words] if lo + self.max_words < len(starts) else len(raw)
            entries = self.entries(raw[own[0] : end], own - own[0])
            lens.append(self.lens[entries].astype(np.int64))
            ids.append(gather(self.arena, self.starts[entries], lens[-1]))
        before = np.cumsum(np.concatenate(lens))
        return np.concatenate(ids), before[np.searchsorted(starts, offsets)]

    def encode_column(self, offsets: np.ndarray, raw: np.ndarray, row_slices) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each row) for slices of a column; a long text is encoded piece by piece."""
        for lo, hi in row_slices(offsets, PIECE_BYTES):
            a, b = int(offsets[lo]), int(offsets[hi])
            part = raw[a:b]
            if hi == lo + 1 and b - a > PIECE_BYTES:
                parts = [self.encode_texts(part[x:y], np.array([0, y - x]))[0] for x, y in pieces(part, PIECE_BYTES)]
                yield lo, [np.concatenate(parts)]
            else:
                ids, cuts = self.encode_texts(part, offsets[lo : hi + 1] - a)
                yield lo, [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

"""An Aho-Corasick automaton over word ids, in flat arrays that all workers of a host map from one file.

Patterns are windows of words. A state is a prefix of a window; states are numbered level by level and the children
of a state follow one another in the order of their words, so a state costs four 32-bit numbers: its word, its first
child, its failure link and the nearest pattern that ends there. Texts are scanned in lanes, one word of all lanes at a
time: a pattern has at most `window` words, so a lane that begins window - 1 words early knows its state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs

from loomery.llm import words

LANE_WORDS = 128


def build(ids: pa.Array, texts: pa.Array, window: int) -> pa.RecordBatch:
    """One row with the arrays of the automaton of all windows of the texts; a text of fewer words is one window."""
    parts = list(words.word_slices(texts))
    vocabulary = pa.concat_arrays([p.distinct for p in parts]).dictionary_encode() if parts else pa.array([], pa.binary()).dictionary_encode()
    code = vocabulary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum([0] + [len(p.distinct) for p in parts])
    own = np.concatenate([code[b + p.codes] for b, p in zip(before, parts, strict=False)] or [np.zeros(0, dtype=np.int64)])
    rows = np.concatenate([p.first + np.repeat(np.arange(len(p.lengths)), p.lengths) for p in parts] or [np.zeros(0, dtype=np.int64)])
    n_words = np.bincount(rows, minlength=len(ids))
    size, end = np.minimum(n_words, window), np.cumsum(n_words)
    at = np.flatnonzero(np.arange(len(own)) + size[rows] <= end[rows])  # where a window begins
    length, item, width = size[rows[at]], rows[at], max(len(vocabulary.dictionary), 1)

    word_of, child_start, levels = [np.zeros(1, dtype=np.int32)], [], [0, 1]
    ended, rank = [], np.zeros(len(at), dtype=np.int64)
    for depth in range(1, int(length.max()) + 1 if len(at) else 1):
        keys, inverse = np.unique(rank * width + own[at + depth - 1], return_inverse=True)
        child_start.append(levels[depth] + np.searchsorted(keys // width, np.arange(levels[depth] - levels[depth - 1])))
        word_of.append((keys % width).astype(np.int32))
        levels.append(levels[depth] + len(keys))
        done = length == depth
        ended.append(np.unique(np.stack([levels[depth] + inverse[done], item[done]]), axis=1))
        at, length, item, rank = at[~done], length[~done], item[~done], inverse[~done]
    n = levels[-1]
    child_start = np.concatenate([*child_start, np.full(n + 1 - sum(map(len, child_start)), n)]).astype(np.int32)
    patterns = np.concatenate(ended, axis=1) if ended else np.zeros((2, 0), dtype=np.int64)
    patterns = patterns[:, np.lexsort(patterns[::-1])]
    made = WordAutomaton(vocabulary.dictionary, np.concatenate(word_of), child_start, np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32), np.array(levels, dtype=np.int64), patterns[0], patterns[1], ids)
    made.out[patterns[0]] = patterns[0]
    for lo, hi in zip(levels[1:-1], levels[2:], strict=True):
        parent = np.searchsorted(child_start, np.arange(lo, hi), side="right") - 1
        made.fail[lo:hi] = 0 if lo == 1 else made.step(made.fail[parent], made.word_of[lo:hi])
        level = made.out[lo:hi]
        level[level == 0] = made.out[made.fail[lo:hi]][level == 0]
    raw, spots = words.binary_parts(vocabulary.dictionary)
    columns = {"words": raw[: spots[-1]], "word_ends": spots.astype(np.int32), "word_of": made.word_of, "child_start": child_start, "fail": made.fail, "out": made.out, "levels": made.levels, "pattern_state": patterns[0].astype(np.int64), "pattern_item": patterns[1].astype(np.int64)}
    arrays = [pa.array([memoryview(np.ascontiguousarray(v)).cast("B")], pa.large_binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([ids.to_pylist()], pa.list_(pa.string()))], names=[*columns, "items"])


def write(batch: pa.RecordBatch, fs: pafs.FileSystem, path: str) -> None:
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, batch.schema) as writer:
        writer.write_batch(batch)


def read(fs: pafs.FileSystem, path: str) -> WordAutomaton:
    """The automaton of a file: mapped where the folder is a path of this host, else read."""
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    part = lambda name, kind: np.frombuffer(batch.column(name)[0].as_buffer(), dtype=kind)
    ends = batch.column("word_ends")[0].as_buffer()
    vocabulary = pa.Array.from_buffers(pa.binary(), ends.size // 4 - 1, [None, ends, batch.column("words")[0].as_buffer()])
    return WordAutomaton(vocabulary, part("word_of", np.int32), part("child_start", np.int32), part("fail", np.int32), part("out", np.int32), part("levels", np.int64), part("pattern_state", np.int64), part("pattern_item", np.int64), batch.column("items")[0].values)


class WordAutomaton:
    """State 0 is the root. levels: the first state of each depth; pattern_state, ascending, and pattern_item: which item
    a pattern that ends in a state is of."""

    def __init__(self, vocabulary, word_of, child_start, fail, out, levels, pattern_state, pattern_item, items) -> None:
        self.vocabulary, self.word_of, self.child_start, self.fail, self.out, self.levels = vocabulary, word_of, child_start, fail, out, levels
        self.pattern_state, self.pattern_item, self.items = pattern_state, pattern_item, items
        self.root = np.zeros(len(vocabulary) + 1, dtype=np.int32)  # the last one stands for unknown words
        first = np.arange(1, levels[2] if len(levels) > 2 else 1)
        self.root[word_of[first]] = first
        depths = np.searchsorted(levels, np.unique(pattern_state), side="right") - 1
        self.shortest, self.longest = (int(depths.min()), int(depths.max())) if len(depths) else (1, 1)

    def known(self, distinct: pa.Array) -> np.ndarray:
        """Ids of words, -1 for those in no pattern."""
        return pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)

    def _child(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child by a word, 0 where there is none."""
        lo, hi = self.child_start[states].astype(np.int64), self.child_start[states + 1].astype(np.int64)
        last = len(self.word_of) - 1
        while (many := np.flatnonzero(hi - lo > 1)).size:  # halve the range of those that have several
            mid = (lo[many] + hi[many]) // 2
            right = self.word_of[mid] <= word[many]
            lo[many] = np.where(right, mid, lo[many])
            hi[many] = np.where(right, hi[many], mid)
        return np.where((hi > lo) & (self.word_of[np.minimum(lo, last)] == word), lo, 0)

    def step(self, states: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each; unknown words (-1) lead to the root."""
        out = self.root[word]
        left = np.flatnonzero((states > 0) & (word >= 0))
        at = states[left]
        while len(left):
            child = self._child(at, word[left])
            found = child > 0
            out[left[found]] = child[found]
            at = self.fail[at[~found]]
            left = left[~found]
            left, at = left[at > 0], at[at > 0]
        return out

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, state) of every pattern in a sequence of word ids; -1 breaks it."""
        none = np.zeros(0, dtype=np.int64)
        edge = np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        some = end - begin >= self.shortest  # shorter runs of known words hold no pattern
        if not some.any() or not len(self.pattern_state):
            return none, none, none
        keep = np.zeros(len(ids) + 1, dtype=np.int8)
        np.add.at(keep, begin[some], 1)
        np.add.at(keep, np.minimum(end[some] + 1, len(ids)), -1)  # with the break after it
        place = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        early = self.longest - 1
        n = -(-len(place) // LANE_WORDS)
        padded = np.full(early + n * LANE_WORDS, -1, dtype=np.int32)
        padded[early : early + len(place)] = ids[place]
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LANE_WORDS + early)[::LANE_WORDS].T)
        states, spots, hits = np.zeros(n, dtype=np.int32), [], []
        for k, word in enumerate(lanes):
            states = self.step(states, word)
            if k >= early and (found := np.flatnonzero(self.out[states])).size:
                spots.append(found * LANE_WORDS + k - early)
                hits.append(self.out[states[found]])
        at, state = (np.concatenate(spots), np.concatenate(hits).astype(np.int64)) if spots else (none, none)
        ends, all_states = [at], [state]
        while len(at):  # shorter patterns that end at the same word
            state = self.out[self.fail[state]].astype(np.int64)
            at, state = at[state > 0], state[state > 0]
            ends.append(at)
            all_states.append(state)
        last, state = place[np.concatenate(ends)] + 1, np.concatenate(all_states)
        return last - (np.searchsorted(self.levels, state, side="right") - 1), last, state

    def items_of(self, state: int) -> list[str]:
        lo, hi = np.searchsorted(self.pattern_state, [state, state + 1])
        return [self.items[int(i)].as_py() for i in self.pattern_item[lo:hi]]


def matches(texts: pa.Array, automaton: WordAutomaton | None) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Words of each text, and by row the (first word, word after the last, state) of its patterns."""
    n_words, found, held = np.zeros(len(texts), dtype=np.int64), {}, (-1, None)
    for part in words.word_slices(texts):
        lengths = part.lengths
        if automaton is not None and len(part.codes):
            ids = automaton.known(part.distinct)[part.codes]
            if held[0] == part.first and len(lengths) == 1:  # a long text goes on: its last words come again
                tail = held[1]
                first, last, state = automaton.scan(np.concatenate([tail, ids]))
                new, shift = last > len(tail), n_words[part.first] - len(tail)
                own = [(part.first, a + shift, b + shift, s) for a, b, s in zip(first[new], last[new], state[new], strict=True)]
            else:
                rows = np.repeat(np.arange(len(lengths)), lengths)
                wide = np.full(len(ids) + len(lengths), -1, dtype=np.int32)
                wide[np.arange(len(ids)) + rows] = ids
                first, last, state = automaton.scan(wide)
                heads = part.bounds[:-1] + np.arange(len(lengths))
                row = np.searchsorted(heads, first, side="right") - 1
                own = [(part.first + r, a - heads[r], b - heads[r], s) for r, a, b, s in zip(row, first, last, state, strict=True)]
                tail = np.zeros(0, dtype=np.int32)
            for r, a, b, s in own:
                found.setdefault(int(r), []).append((int(a), int(b), int(s)))
            keep = automaton.longest - 1
            tail = np.concatenate([tail, ids])[len(tail) + len(ids) - keep if len(tail) + len(ids) > keep else 0 :] if len(lengths) == 1 else tail
            held = (part.first + len(lengths) - 1, tail[-keep:] if keep else tail[:0])
        n_words[part.first : part.first + len(lengths)] += lengths
    return n_words, found

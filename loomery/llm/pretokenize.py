"""Pre-tokenisation without regex: code point classes and a scan of transition functions.

Finds the matches of the public pattern
  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
in whole batches. Every code point becomes one of twelve symbols (its class and what follows
it). A symbol is a function from the eight automaton states to the next state; functions
compose associatively, so blocks of the text are composed independently, four symbols a
step, a scan over the blocks gives the state before each, and one more sweep reads off which
code points begin a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import tiktoken

from loomery.llm.arrays import SPACE

# classes of code points
_LETTER, _NUMBER, _OTHER, _BLANK, _WHITE, _QUOTE = range(6)

# symbols: classes with what follows
LETTER, NUMBER, OTHER, BLANK_LAST, WHITE_LAST, BLANK, WHITE, SHORT, LONG, BREAK = range(10)
SYMBOLS = 12  # a round number for packing; two are unused

# states: at a fresh start, in letters, in numbers, in others, after an attached blank, in
# white space, one or two letters before the end of a contraction
START, IN_LETTER, IN_NUMBER, IN_OTHER, ATTACHED, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _matched(pattern: str) -> np.ndarray:
    """Code points that a pattern of the tokenizers' library matches; it drops what its split pattern leaves out."""
    single = tiktoken.Encoding("code points", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    points = np.arange(0x110000, dtype=np.uint32)
    text = points[(points < 0xD800) | (points > 0xDFFF)].astype("<u4").tobytes().decode("utf-32-le")
    kept = single.decode_bytes(single.encode_ordinary(text)).decode()
    return np.frombuffer(kept.encode("utf-32-le"), dtype="<u4")


@cache
def class_table() -> np.ndarray:
    """Class of every code point, as the installed library knows it, whose Unicode version differs from Python's."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    table[_matched(r"\p{L}+")] = _LETTER
    table[_matched(r"\p{N}+")] = _NUMBER
    table[_matched(r"\s+")] = _WHITE
    table[0x20] = _BLANK
    table[0x27] = _QUOTE
    return table


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """next[state, symbol], begins[state, symbol] and four[packed symbols, state]."""
    after = np.zeros((STATES, SYMBOLS), dtype=np.uint8)
    begins = np.ones((STATES, SYMBOLS), dtype=bool)
    for state in range(STATES):
        for symbol, goal in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            after[state, symbol] = goal
            begins[state, symbol] = state not in (goal, ATTACHED)
        for symbol, goal in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            inside = state in (IN_OTHER, ATTACHED)
            after[state, symbol] = IN_OTHER if inside else goal
            begins[state, symbol] = not inside
        after[state, BLANK_LAST], after[state, WHITE_LAST] = ATTACHED, START
        for symbol in (BLANK, WHITE):
            after[state, symbol] = IN_WHITE
            begins[state, symbol] = state != IN_WHITE
        after[state, BREAK] = START
    after[ONE_LEFT, LETTER], begins[ONE_LEFT, LETTER] = START, False
    after[TWO_LEFT, LETTER], begins[TWO_LEFT, LETTER] = ONE_LEFT, False
    two = after[after[:, :, None], np.arange(SYMBOLS)]  # state, first, second
    four = two[two[:, :, :, None, None], np.arange(SYMBOLS)[:, None], np.arange(SYMBOLS)]
    return after, begins, np.ascontiguousarray(four.reshape(STATES, -1).T)


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Symbol of every code point; breaks holds ascending positions at which a new text begins."""
    kind = class_table()[points]
    n = len(points)
    follows = np.full(n + 3, BREAK, dtype=np.uint8)  # class of the next code point, BREAK at the end of a text
    follows[:n] = kind
    letters = np.zeros(n + 3, dtype=np.uint8)
    np.copyto(letters[:n], points, where=points < 128, casting="unsafe")
    ends = breaks[(breaks > 0) & (breaks < n)]
    out = np.array([LETTER, NUMBER, OTHER, BLANK, WHITE, OTHER], dtype=np.uint8)[kind]
    nxt = follows[1 : n + 1].copy()
    nxt[ends - 1] = BREAK
    last = (nxt != _BLANK) & (nxt != _WHITE) & (nxt != BREAK)
    out[(kind == _BLANK) & last] = BLANK_LAST
    out[(kind == _WHITE) & last] = WHITE_LAST
    at = np.flatnonzero(kind == _QUOTE)
    if len(at):
        limit = np.concatenate((breaks, [n]))[np.searchsorted(breaks, at, side="right")]
        a, b = letters[at + 1], letters[at + 2]
        short = (at + 1 < limit) & np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[short]] = SHORT
        out[at[~short & pair & (at + 2 < limit)]] = LONG
    return out


def begins(sym: np.ndarray, block: int = 256) -> np.ndarray:
    """Which symbols begin a token, the automaton being in START at first."""
    after, start_table, four = tables()
    n = len(sym)
    if n == 0:
        return np.zeros(0, dtype=bool)
    width = -(-n // block)
    padded = np.full(width * block, BREAK, dtype=np.uint8)
    padded[:n] = sym
    grid = np.ascontiguousarray(padded.reshape(width, block).T)  # step, block
    packed = grid[0::4].astype(np.int32)
    for i in (1, 2, 3):
        packed = packed * SYMBOLS + grid[i::4]
    # compose the functions of every block
    flat = four.ravel()
    held = np.repeat(np.arange(STATES, dtype=np.int32)[None], width, axis=0)
    for step in packed:
        held = flat[step[:, None] * STATES + held].astype(np.int32)
    # scan over the blocks: after k rounds a block's function covers 2 ** k blocks
    scan, reach = held, 1
    while reach < width:
        later = scan.copy()
        later[reach:] = np.take_along_axis(scan[reach:], scan[:-reach], axis=1)
        scan, reach = later, 2 * reach
    state = np.zeros(width, dtype=np.int32)
    state[1:] = scan[:-1, START]
    out = np.empty((block, width), dtype=bool)
    flat_after, flat_start = after.ravel(), start_table.ravel()
    for i in range(block):
        spot = state * SYMBOLS + grid[i]
        out[i] = flat_start[spot]
        state = flat_after[spot].astype(np.int32)
    return out.T.ravel()[:n]


def token_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the tokens of consecutive texts (UTF-8 in raw) begin."""
    if len(raw) == 0:
        return np.zeros(0, dtype=np.int64)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    breaks = np.searchsorted(heads, firsts)
    sym = symbols(points, breaks)
    # a text must not see the one before: where one begins, the automaton's state is reset
    return heads[_reset(sym, breaks)]


def _reset(sym: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """begins() with a BREAK put before every text."""
    shift = np.zeros(len(sym), dtype=np.int64)
    shift[breaks] = 1
    spread = np.arange(len(sym)) + np.cumsum(shift)
    wide = np.full(len(sym) + len(breaks), BREAK, dtype=np.uint8)
    wide[spread] = sym
    return np.flatnonzero(begins(wide)[spread])


#: Bytes after a place that the automaton may look at (four code points) to say whether a token begins there.
_AHEAD = 16


def pieces(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of one text that can be tokenised apart, of about limit bytes.

    Cuts stand before ASCII white space that follows something else, where a token begins whatever came before.
    Where no such place comes within 2 * limit bytes, the text is cut at the last token start that the automaton
    finds in them; only a single longer token makes a longer piece.
    """
    at, n = 0, len(raw)
    while at < n:
        end = at + limit
        while end < n:
            window = raw[end - 1 : min(end + 65536, at + 2 * limit)]
            cut = np.flatnonzero(SPACE[window[1:]] & ~_white_end(window)[:-1])
            if len(cut):
                end += int(cut[0])
                break
            end += 65536
            if end >= at + 2 * limit:
                end = _token_cut(raw, at, 2 * limit)
                break
        end = min(end, n)
        yield at, end
        at = end


def _token_cut(raw: np.ndarray, at: int, width: int) -> int:
    """The last token start in raw[at : at + width] that does not depend on what follows; more is read if there is none."""
    while True:
        end = min(at + width, len(raw))
        if end == len(raw):
            return end
        while (raw[end] & 0xC0) == 0x80:  # between code points
            end -= 1
        found = token_starts(raw[at:end], np.array([0, end - at]))
        found = found[(found > 0) & (found < end - at - _AHEAD)]
        if len(found):
            return at + int(found[-1])
        width *= 2


def _white_end(window: np.ndarray) -> np.ndarray:
    """Bytes that may end a white space character (any non-ASCII byte is taken for one)."""
    return SPACE[window] | (window >= 0x80)

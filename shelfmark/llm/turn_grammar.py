"""Cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``, by block tables.

A row is one of nine symbols: it must go, or its role's initial is s, u, a or another, and its text is
whole or truncated. What may follow depends on one of four states: nothing yet, after s, after u,
after a. ``COST[q]`` of a place is what the rest costs from state ``q``; less its minimum, only a
few vectors of these four numbers occur at all (``VECTORS``). So a block of ``BLOCK`` symbols is a table: the
vector on its right gives the one on its left, and with it the state behind the block for each
state before it. Sequences are taken from right to left by looking blocks up; then each block is
expanded again from the vector kept on its right, and its edits are read from left to right. At each
place the first letter, by ASCII, that keeps to the least cost is taken: D, I, K or R. From one state a letter
has one outcome, so this is the least of all cheapest audits.
"""

from functools import lru_cache
from itertools import product

import numpy as np

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
GONE = 0
SYMBOLS = 9
BLOCK = 3
STATES = 4
# The state behind an inserted or reroled row, and its role; the states behind a kept row by initial.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
INITIALS = "suax"
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * INITIALS.index(initial if initial in ("s", "u", "a") else "x") + truncated


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state behind) of what may be done with a row, in the order of the letters."""
    if code == GONE:
        return [("D", DELETE, state)]
    more = TRUNCATED if (code - 1) % 2 else 0
    out = [("D", DELETE, state)]
    kept = KEPT[INITIALS[(code - 1) // 2]].get(state)
    if kept is not None:
        out.append(("K", more, kept))
    return [*out, ("R", REROLE + more, NEXT[state])]


def left_of(code: int, right: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a row, given those behind it."""
    costs = [min(cost + right[to] for _, cost, to in _edits(code, q)) for q in range(STATES)]
    for _ in range(STATES):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(STATES)]
    return tuple(costs)


def normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def trace(code: int, right: tuple[int, ...], state: int) -> tuple[str, int]:
    """The letters for a row, with insertions before it, and the state behind it."""
    left, letters = left_of(code, right), ""
    while True:
        options = {letter: (cost + right[to], to) for letter, cost, to in _edits(code, state)}
        options["I"] = (INSERT + left[NEXT[state]], NEXT[state])
        letter = next(x for x in "DIKR" if x in options and options[x][0] == left[state])
        letters, state = letters + letter, options[letter][1]
        if letter != "I":
            return letters, state


def _vectors() -> list[tuple[int, ...]]:
    found, new = [END], [END]
    while new:
        new = sorted({normal(left_of(code, v)) for v in new for code in range(SYMBOLS)} - set(found))
        found += new
    return found


VECTORS = _vectors()
NUMBER = {v: i for i, v in enumerate(VECTORS)}
AT_END = NUMBER[END]
# By symbol and vector on the right: the vector on the left; and by state: the state behind.
ONE_LEFT = np.array([[NUMBER[normal(left_of(c, v))] for v in VECTORS] for c in range(SYMBOLS)], np.uint16)
ONE_STATE = np.array([[[trace(c, v, q)[1] for q in range(STATES)] for v in VECTORS] for c in range(SYMBOLS)], np.uint8)


def _block_tables() -> tuple[np.ndarray, np.ndarray]:
    """The same for every block of BLOCK symbols, by its code in base SYMBOLS."""
    every = np.arange(len(VECTORS))
    left, state = [], []
    for codes in product(range(SYMBOLS), repeat=BLOCK):
        right = [every]
        for c in reversed(codes):
            right.append(ONE_LEFT[c, right[-1]])
        q = np.broadcast_to(np.arange(STATES), (len(VECTORS), STATES))
        for c, r in zip(codes, right[-2::-1], strict=True):
            q = ONE_STATE[c, r[:, None], q]
        left.append(right[-1])
        state.append(q)
    return np.array(left, np.uint16), np.array(state, np.uint8)


LEFT, STATE = _block_tables()
_LEFT_ROWS, _ONE_ROWS = LEFT.tolist(), ONE_LEFT.tolist()


def _blocks(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """The codes of the whole blocks, and the symbols behind them."""
    whole = len(symbols) // BLOCK * BLOCK
    codes = symbols[:whole].reshape(-1, BLOCK).astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK)[::-1])
    return codes.tolist(), symbols[whole:].tolist()


@lru_cache(maxsize=None)  # bounded by blocks x vectors x states
def expand(codes: tuple[int, ...], right: int, state: int) -> tuple[tuple[str, ...], int]:
    """The letters of each row of a block, and the state behind it."""
    vectors = [VECTORS[right]]
    for c in reversed(codes[1:]):
        vectors.append(normal(left_of(c, vectors[-1])))
    letters = []
    for c, v in zip(codes, reversed(vectors), strict=True):
        letter, state = trace(c, v, state)
        letters.append(letter)
    return tuple(letters), state


_CODES = list(product(range(SYMBOLS), repeat=BLOCK))


def letters_of(symbols: np.ndarray, right: int = AT_END, state: int = 0) -> tuple[list[str], int]:
    """The letters of each row of a stretch with this vector behind it and state before it, and the state behind it."""
    codes, rest = _blocks(symbols)
    kept, vector = [], right
    for c in reversed(rest):
        kept.append(vector)
        vector = _ONE_ROWS[c][vector]
    for c in reversed(codes):
        kept.append(vector)
        vector = _LEFT_ROWS[c][vector]
    out: list[str] = []
    for c in codes:
        letters, state = expand(_CODES[c], kept.pop(), state)
        out += letters
    for c in rest:
        letters, state = expand((c,), kept.pop(), state)
        out += letters
    return out, state


def stretch(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of rows does, whatever is around it: by each vector on its right the one on its left, and the
    state behind it for each state before it."""
    codes, rest = _blocks(symbols)
    kept, vector = [], np.arange(len(VECTORS), dtype=np.uint16)
    for c in reversed(rest):
        kept.append(vector)
        vector = ONE_LEFT[c, vector]
    for c in reversed(codes):
        kept.append(vector)
        vector = LEFT[c, vector]
    state = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(VECTORS), STATES))
    for table, these in ((STATE, codes), (ONE_STATE, rest)):
        for c in these:
            state = table[c, kept.pop()[:, None], state]
    return vector, np.ascontiguousarray(state)

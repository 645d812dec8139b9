"""Block tables for the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?`` (Four-Russians method).

States: nothing said yet, after a system row, after a user row, after an assistant row. ``go[q]`` is the least cost of
all that follows from state q. Its differences are bounded, so only a few normalised vectors (least entry 0) exist.
A symbol takes the vector after a row to the one before it; the tables hold that step for every block of
``BLOCK`` symbols at once. A conversation is read from its last block to its first by lookups, and traced the other way:
each block is expanded with the vector at its right end, which decides every tie for the smallest edit letter first.

Symbols are 2 * role + 1 if truncated for the roles system, user, assistant and other; 8 is a row that must go, 9 pads.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 4
SYSTEM, USER, ASSISTANT, OTHER = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
GONE, PAD = 8, 9
SYMBOLS = 10
DELETE_COST, REROLE_COST, INSERT_COST, CUT_COST = 3, 2, 2, 1
_FAR = 1 << 20
#: What an inserted or rerolled row becomes in each state, and the state after it.
SAYS = (USER, USER, ASSISTANT, USER)
THEN = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)


def _kept(state: int, role: int) -> int | None:
    """The state after a row that stays as it is, or None where it cannot."""
    if role == SYSTEM:
        return AFTER_SYSTEM if state == START else None
    return THEN[state] if role == SAYS[state] else None


def _consume(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of what can be done with one row."""
    if symbol == PAD:
        return [("", 0, state)]
    options = [("D", DELETE_COST, state)]
    if symbol != GONE:
        role, cut = symbol >> 1, (symbol & 1) * CUT_COST
        if (after := _kept(state, role)) is not None:
            options.append(("K", cut, after))
        options.append(("R", REROLE_COST + cut, THEN[state]))
    return options


def _with_inserts(go: list[int]) -> list[int]:
    for _ in range(2):
        go = [min(go[q], INSERT_COST + go[THEN[q]]) for q in range(4)]
    return go


END = tuple(_with_inserts([0, _FAR, _FAR, 0]))
END_EDITS = ("", "II", "I", "")


def _before(symbol: int, go: tuple[int, ...]) -> list[int]:
    if symbol == PAD:
        return list(go)
    return _with_inserts([min(cost + go[after] for _, cost, after in _consume(symbol, q)) for q in range(4)])


class Tables:
    """``next[v, block]`` and ``added[v, block]``: the vector before a block and the cost its normalisation took off."""

    def __init__(self):
        self.vectors = [END]
        known = {END: 0}
        steps: list[list[tuple[int, int]]] = []
        for v in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                go = _before(symbol, v)
                low = min(go)
                normal = tuple(g - low for g in go)
                if normal not in known:
                    known[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((known[normal], low))
            steps.append(row)
        self.step = np.array(steps, dtype=np.int64)
        self.next, self.added = self.step[:, :, 0], self.step[:, :, 1]
        for _ in range(BLOCK - 1):
            # One more symbol on the left: the block so far is read first.
            right, cost = self.next, self.added
            self.next = np.moveaxis(self.step[right, :, 0], 2, 1).reshape(len(self.vectors), -1)
            self.added = (np.moveaxis(self.step[right, :, 1], 2, 1) + cost[:, None, :]).reshape(len(self.vectors), -1)
        self._rows = self.next.tolist(), self.added.tolist()
        self._expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, symbols: np.ndarray) -> list[int]:
        """The block numbers of a row of symbols, padded on the right."""
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, PAD, dtype=np.int64)
        padded[:len(symbols)] = symbols
        return (padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def back(self, blocks: list[int], right: int = 0) -> tuple[list[int], int]:
        """The vectors at the right end of every block and, last, left of the first one; and the cost taken off."""
        steps, costs = self._rows
        vectors, cost = [right], 0
        for b in reversed(blocks):
            cost += costs[right][b]
            right = steps[right][b]
            vectors.append(right)
        return vectors[::-1][1:] + [vectors[-1]], cost

    def summary(self, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The vector left of the blocks and the cost taken off, for every vector at their right end."""
        v = np.arange(len(self.vectors))
        cost = np.zeros(len(v), dtype=np.int64)
        for b in reversed(blocks):
            cost += self.added[v, b]
            v = self.next[v, b]
        return v, cost

    def trace(self, blocks: list[int], vectors: list[int], state: int = START) -> tuple[str, int]:
        """The edits of the blocks from a state on, and the state after them. ``vectors`` as from :meth:`back`."""
        out = []
        for b, v in zip(blocks, vectors):
            edits, state = self._expanded.get((v, b, state)) or self._expand(v, b, state)
            out.append(edits)
        return "".join(out), state

    def _expand(self, vector: int, block: int, state: int) -> tuple[str, int]:
        symbols = [block // SYMBOLS**k % SYMBOLS for k in range(BLOCK - 1, -1, -1)]
        after = [vector]
        for s in reversed(symbols[1:]):
            after.append(int(self.step[after[-1], s, 0]))
        out, q = [], state
        for s, v in zip(symbols, reversed(after)):
            edits, q = _row_edits(s, self.vectors[v], q)
            out.append(edits)
        self._expanded[vector, block, state] = "".join(out), q
        return self._expanded[vector, block, state]


def _row_edits(symbol: int, go: tuple[int, ...], state: int) -> tuple[str, int]:
    """The smallest of the cheapest edits up to and with one row: delete before insert before keep before rerole."""
    before, out = _before(symbol, go), ""
    while True:
        ways = {edit: after for edit, cost, after in _consume(symbol, state) if cost + go[after] == before[state]}
        if INSERT_COST + before[THEN[state]] == before[state] and symbol != PAD:
            ways["I"] = THEN[state]
        edit = min(ways)
        out, state = out + edit, ways[edit]
        if edit != "I":
            return out, state


@cache
def tables() -> Tables:
    return Tables()

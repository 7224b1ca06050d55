"""Suffix order of a shard by induced sorting, with queues that go to disk.

Only leftmost S-type suffixes are sorted; all others are induced from them.
The priority queue is a bucket queue: one first-in-first-out run of suffixes
for each first character, since induction pushes them in order.  A run longer
than its share of memory is kept in a temporary file.  Work goes bucket by
bucket over whole arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Longest common prefix that matters: suffixes are ordered by so many characters at least.
DEPTH = 50
#: Entries that one queue holds in memory.
HELD = 1 << 22


class Queue:
    """Runs of suffix numbers; long ones go to an unnamed temporary file that the system removes."""

    def __init__(self, held: int = HELD):
        self.held, self.n, self.runs, self.file = held, 0, [], None

    def push(self, run: np.ndarray) -> None:
        if not len(run):
            return
        self.runs.append(run)
        self.n += len(run)
        if self.n > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.runs:
                self.file.write(x.astype(np.int64).tobytes())
            self.runs, self.n = [], 0

    def take(self) -> np.ndarray:
        """Everything pushed so far, in order; the queue is empty then."""
        parts = []
        if self.file is not None:
            self.file.seek(0)
            parts.append(np.frombuffer(self.file.read(), np.int64))
            self.file.close()
            self.file = None
        parts += self.runs
        self.runs, self.n = [], 0
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _deal(queues: list[Queue], chars: np.ndarray, suffixes: np.ndarray) -> None:
    """Push suffixes to the queues of their first characters, keeping their order."""
    if not len(suffixes):
        return
    order = np.argsort(chars, kind="stable")
    chars, suffixes = chars[order], suffixes[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, run in zip(chars[np.concatenate([[0], cuts])], np.split(suffixes, cuts), strict=True):
        queues[c].push(run)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes of ``text`` (characters 0 to 256), ordered by ``DEPTH`` characters at least.

    A character 0 ends the text.  Suffixes alike for that long stand together
    in any order.
    """
    t = text.astype(np.int32)
    n = len(t)
    if n < 2:
        return np.arange(n)
    step = np.sign(np.diff(t))
    # equal neighbours take the type of what follows them
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(known[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, 1)[nearest] > 0
    small[n - 1] = True
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    star = star[_star_order(t, star)]
    first = np.searchsorted(t[star], np.arange(258))
    # L-type suffixes, least character first: those pushed for a character, then what its stars induce
    queues = [Queue() for _ in range(257)]
    large: list[np.ndarray] = []
    for c in range(257):
        got = []
        while True:
            run = queues[c].take()
            if not len(run):
                break
            got.append(run)
            before = run[run > 0] - 1
            before = before[~small[before]]
            _deal(queues, t[before], before)
        large.append(np.concatenate(got) if got else np.zeros(0, np.int64))
        stars = star[first[c] : first[c + 1]]
        before = stars[stars > 0] - 1  # L-type, as the star comes after it
        _deal(queues, t[before], before)
    # S-type suffixes, greatest character first and in falling order
    out: list[np.ndarray] = []
    queues[0].push(np.array([n - 1]))  # nothing follows it, so nothing induces it
    for c in range(256, -1, -1):
        got = []
        while True:
            run = queues[c].take()
            if not len(run):
                break
            got.append(run)
            before = run[run > 0] - 1
            before = before[small[before]]
            _deal(queues, t[before], before)
        falling = large[c][::-1]
        out += [*got, falling]
        before = falling[falling > 0] - 1
        before = before[small[before]]
        _deal(queues, t[before], before)
    return np.concatenate(out)[::-1]


def _star_order(t: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Order of the star suffixes by their first ``DEPTH`` characters: stable passes, last characters first."""
    n = len(t)
    order = np.arange(len(star))
    for at in range((DEPTH + 5) // 6 * 6 - 6, -1, -6):  # six characters of nine bits and a half make a word
        word = np.zeros(len(star), np.int64)
        for j in range(6):
            place = np.minimum(star + at + j, n - 1)
            word = word * 257 + np.where(star + at + j < n, t[place], 0)
        order = order[np.argsort(word[order], kind="stable")]
    return order


def equal_runs(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Number of the class of each of the ordered suffixes: those whose first ``DEPTH`` characters are equal.

    Common prefixes of neighbours are compared a character at a time, for the
    pairs that are still alike.
    """
    if not len(suffixes):
        return np.zeros(0, np.int64)
    a, b = suffixes[:-1], suffixes[1:]
    alike = np.arange(len(a))
    for at in range(DEPTH):
        alike = alike[text[a[alike] + at] == text[b[alike] + at]]
    new = np.ones(len(suffixes), bool)
    new[alike + 1] = False
    return np.cumsum(new) - 1

"""Suffix order of a shard by induced sorting with disk-backed queues."""

from __future__ import annotations

import tempfile

import numpy as np

from rastertable.llm.words import hashes


class Queues:
    """A first-in first-out queue of positions for each symbol: a priority queue whose order within a symbol is that of arrival.

    Over ``most`` positions in memory, the queues go on in files of their own, which are gone when the task is.
    """

    def __init__(self, symbols: int, most: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.files: dict[int, object] = {}
        self.held, self.most = 0, most

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for own, s in zip(np.split(positions, cuts), symbols[[0, *cuts]].tolist(), strict=True):
            self.parts[s].append(own)
        self.held += len(positions)
        if self.held > self.most:
            for s, own in enumerate(self.parts):
                for part in own:
                    part.tofile(self.files.setdefault(s, tempfile.TemporaryFile()))
                self.parts[s] = []
            self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All that has come for a symbol, in order."""
        parts, self.parts[symbol] = self.parts[symbol], []
        self.held -= sum(map(len, parts))
        if (file := self.files.pop(symbol, None)) is not None:
            file.seek(0)
            parts.insert(0, np.fromfile(file, np.int64))
            file.close()
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one is not."""
    n = len(t)
    other = np.full(n, n, np.int64)
    change = np.flatnonzero(t[1:] != t[:-1])
    other[change] = change + 1
    other = np.minimum.accumulate(other[::-1])[::-1]
    return np.where(other < n, t[np.minimum(other, n - 1)] > t, False)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int, most: int) -> np.ndarray:
    """All suffixes in order, from those that begin a rising run after a falling one (``lms``) in order."""
    rising = Queues(symbols, most)
    rising.push(t[lms], lms)
    queues, falls, out = Queues(symbols, most), [], []
    queues.push(t[-1:].astype(np.int64), np.array([len(t) - 1]))
    for c in range(symbols):
        own = []
        while len(x := queues.pop(c)):
            own.append(x)
            p = x[x > 0] - 1
            p = p[~small[p]]
            queues.push(t[p], p)
        falls.append(np.concatenate(own) if own else np.zeros(0, np.int64))
        x = rising.pop(c)
        p = x[x > 0] - 1
        queues.push(t[p], p)
    queues = Queues(symbols, most)
    for c in reversed(range(symbols)):
        own = []
        while len(x := queues.pop(c)):
            own.append(x)
            p = x[x > 0] - 1
            p = p[small[p]]
            queues.push(t[p], p)
        out.append((np.concatenate(own) if own else np.zeros(0, np.int64))[::-1])
        x = falls[c][::-1]
        out.append(falls[c])
        p = x[x > 0] - 1
        p = p[small[p]]
        queues.push(t[p], p)
    return np.concatenate(out[::-1])


def suffix_order(t: np.ndarray, depth: int, most: int = 1 << 24) -> np.ndarray:
    """Positions of ``t`` (numbers from 0) in the order of their suffixes, ties beyond ``depth`` numbers as they come.

    Suffixes that begin a rising run are named by their run, which a first induction puts in order. The names form a shorter string,
    whose suffixes are ordered by doubling as far as ``depth`` reaches; a second induction gives all suffixes.
    """
    if len(t) < 2:
        return np.arange(len(t))
    small, symbols = types(t), int(t.max()) + 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        order = induce(t, small, lms, symbols, most)
        starts = np.zeros(len(t), bool)
        starts[lms] = True
        ranked = order[starts[order]]
        stop = np.append(lms[1:] + 1, len(t))
        raw = t.astype("<u2").view(np.uint8)
        h = hashes(raw, 2 * lms, 2 * stop)
        nth = np.zeros(len(t), np.int64)
        nth[lms] = np.arange(len(lms))
        k = nth[ranked]
        name = np.empty(len(lms), np.int64)
        name[k] = np.cumsum(np.concatenate([[0], h[k[1:]] != h[k[:-1]]]))
        reach = 1
        while reach < depth and name.max() + 1 < len(name):
            after = np.concatenate([name[reach:] + 1, np.zeros(min(reach, len(name)), np.int64)])[:len(name)]
            name = np.unique(name * (len(name) + 1) + after, return_inverse=True)[1]
            reach *= 2
        lms = lms[np.argsort(name, kind="stable")]
    return induce(t, small, lms, symbols, most)

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens that are no tokens themselves are merged together, as many as a batch holds, in one linked list of parts.
A queue has a bucket for each merge rank with the list positions whose pair has that rank; a two-level bitmap over the
ranks finds the lowest filled bucket by find-first-set. Positions whose pair has changed meanwhile are stale and are
skipped when their bucket comes up. A bucket's positions are merged at once with NumPy, so long pre-tokens and many short
ones take a few array operations for each rank that occurs.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastertable.llm.tables import documents, map_rows

BITS = 1024
#: Pre-tokens up to this length are remembered, and so many of them, in each Python worker.
REMEMBERED_CHARS, REMEMBERED = 32, 120_000
#: Bytes of text whose new pre-tokens are merged together.
BATCH_BYTES = 2 << 20
#: Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


class RankQueue:
    """Arrays of positions by merge rank; ``pop`` gives all of the lowest rank."""

    def __init__(self, ranks: int):
        self.words = [0] * (ranks // BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        word = rank // BITS
        self.words[word] |= 1 << rank % BITS
        self.top |= 1 << word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            self.push(rank, positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits ^ low
        if bits == low:
            self.top ^= 1 << word
        rank = word * BITS + low.bit_length() - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merges:
    """Which rank two neighbouring parts merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        left, right, to = (np.array(x, np.int64) for x in (left, right, to))
        key = left << 32 | right
        order = np.argsort(key)
        self.key, self.to = key[order], to[order].astype(np.int32)
        #: ranks of parts from which a pair of lower rank may arise
        self.upset = np.zeros(n, bool)
        self.upset[left[to < left]] = True
        self.upset[right[to < right]] = True
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.queue = RankQueue(n)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two do not merge, also for a part -1, which is none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (not empty) as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        starts = np.cumsum([0, *map(len, pieces)])
        part = np.append(self.single[data], np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = n
        after[n] = n
        before[starts[:-1]] = n
        alive = np.ones(n, bool)
        pair = np.append(self.rank(part[:n], part[after[:n]]), np.int32(-1))
        at = np.flatnonzero(pair >= 0)
        if len(at):
            self.queue.push_all(pair[at], at)
        while (entry := self.queue.pop()) is not None:
            rank, at = entry
            at = at[pair[at] == rank]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                at, later = self._apart(at, part, after, before, starts, rank)
                if later is not None and len(later):
                    self.queue.push(rank, later)
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            part[at] = rank
            after[at], before[end] = end, at
            alive[gone] = False
            pair[gone] = -1
            look = np.concatenate([at, before[at]])
            look = look[look < n]
            new = self.rank(part[look], part[after[look]])
            pair[look] = new
            look, new = look[new >= 0], new[new >= 0]
            if len(look):
                self.queue.push_all(new, look)
        ids = part[:n][alive].astype("<u4").tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(alive)])[starts]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _apart(self, at: np.ndarray, part: np.ndarray, after: np.ndarray, before: np.ndarray, starts: np.ndarray, rank: int):
        """Positions that can merge at once as if from left to right, and those that have to wait."""
        touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
        own = np.ones(len(at), bool)
        if touching.any():
            count = np.arange(len(at))
            own = (count - np.maximum.accumulate(np.where(touching, 0, count))) % 2 == 0
        if not self.upset[rank]:
            return at[own], None
        # a merge from which a pair of lower rank arises has to come before what is right of it in its pre-token
        use = at[own]
        left = part[before[use]]
        left[1:][after[after[use[:-1]]] == use[1:]] = rank
        merged = np.full(len(use), rank, np.int32)
        low = np.minimum(self.rank(left, merged).view(np.uint32), self.rank(merged, part[after[after[use]]]).view(np.uint32)) < rank
        if not low.any():
            return use, None
        piece = np.searchsorted(starts, at, "right")
        stop = np.full(len(starts) + 1, len(part))
        np.minimum.at(stop, piece[own][low], use[low])
        late = at > stop[piece]
        return at[own & ~late], at[late]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file has a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


#: Texts are split by the classes of characters below one of these limits; smaller classes match faster.
LIMITS = (0x80, 0x100, 0x10000, sys.maxunicode + 1)


def limit_of(text: str) -> int:
    if text.isascii():
        return LIMITS[0]
    try:
        text.encode("latin-1")
        return LIMITS[1]
    except UnicodeEncodeError:
        return LIMITS[2] if len(text.encode("utf-16-le")) == 2 * len(text) else LIMITS[3]


def _ranges(kind: str, limit: int) -> str:
    """The characters of a general category as the inside of a character class."""
    out, start = [], None
    for code in range(limit + 1):
        inside = code < limit and unicodedata.category(chr(code))[0] == kind
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=8)
def splitter(pattern: str, limit: int) -> re.Pattern:
    r"""The pattern as Python's ``re`` has it, for texts of characters below ``limit``: ``\p{L}``, ``\p{N}`` and ``\s`` become explicit classes."""
    space = "".join(f"\\U{c:08x}" for c in WHITE_SPACE if c < limit)
    inside = {r"\p{L}": _ranges("L", limit), r"\p{N}": _ranges("N", limit), r"\s": space}
    out, depth, i = [], 0, 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            name = pattern[i:i + 5] if pattern[i + 1] == "p" else pattern[i:i + 2]
            if name == r"\S":
                out.append(f"[^{space}]")
            elif name in inside:
                out.append(inside[name] if depth else f"[{inside[name]}]")
            else:
                out.append(name)
            i += len(name)
            continue
        depth += (pattern[i] == "[") - (pattern[i] == "]")
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


class Codec:
    """Ids of texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = pattern
        self.merges = Merges(self.ranks)
        self.known: dict[str, bytes] = {}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [splitter(self.pattern, limit_of(t)).findall(t) for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.known}
        fresh, hard = {}, []
        for p in new:
            rank = self.ranks.get(p.encode())
            if rank is None:
                hard.append(p)
            else:
                fresh[p] = rank.to_bytes(4, "little")
        if hard:
            fresh.update(zip(hard, self.merges.merge([p.encode() for p in hard]), strict=True))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {p: self.known[p] for pieces in split for p in pieces if p in self.known}
        self.known.update(fresh)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for p in fresh:
            if len(p) > REMEMBERED_CHARS:
                del self.known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) of every row of ``docs``.

    Null and empty texts give no ids; null and repeated doc_ids stay as they are; an empty table gives an
    empty table; other columns are not looked at. Special tokens are ordinary text.
    """
    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        return {"doc_id": batch.column(0), "ids": c.encode(batch.column(1).to_pylist())}

    return map_rows(documents(docs), run, "doc_id long, ids binary", BATCH_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids``, ``bytes`` that the ids stand for; null ids give no bytes."""
    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        return {"doc_id": batch.column(0), "ids": batch.column(1),
                "bytes": [c.decode(t or b"") for t in batch.column(1).to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, bytes binary")

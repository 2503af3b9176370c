"""Secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain.
Texts are indexed in segments (one Arrow batch each): for every trigram that some rule asks for, the rows that
hold it. A rule's query intersects and unites these posting lists; only the rows that remain are verified with the
regular expression. Rules without mandatory trigrams scan every row. Segments are indexed where they are read, so
nothing is shuffled, and a lost task indexes its segment again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastertable.llm.tables import documents, map_rows, release, slices
from rastertable.llm.words import lower, utf8

#: Alternatives and characters of a class that are spelled out when a query is derived.
MOST_STRINGS, MOST_CHARS = 32, 4


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 1  # characters of the group; shorter matches are dropped, though they do take up their place


#: Rules whose spans every scan reports (fixed values).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 0, 24),
)
#: Published formats of further credentials (fixed values).
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]{1,100}:[^\s:@/]{1,100}@"),
)

# A query is True (all rows), a trigram (three bytes), ("and", parts) or ("or", parts).


def both(a, b):
    return b if a is True else a if b is True or a == b else ("and", (a, b))


def either(parts):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_string(text: str):
    raw = lower(np.frombuffer(text.encode(), np.uint8)).tobytes()
    return reduce(both, dict.fromkeys(raw[i:i + 3] for i in range(len(raw) - 2)), True)


def trigram_query(pattern: str, flags: int = 0):
    """What trigrams (in lower case) any text with a match of ``pattern`` must hold.

    Runs of literals, small classes, options and alternatives are multiplied out to a few strings; whatever
    else ends the run, and the strings so far add the condition that one of them is there.
    """
    return _walk(_parser.parse(pattern, flags))


def _strings(op, arg) -> set[str] | None:
    """All that a node can match, if that is a few strings."""
    if op is sre.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is sre.RANGE and x[1] - x[0] < 2 * MOST_CHARS:
                chars |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_CHARS else None
    if op is sre.SUBPATTERN:
        return _all(arg[3])
    if op is sre.BRANCH:
        sets = [_all(x) for x in arg[1]]
        out = None if None in sets else set().union(*sets)
        return out if out is not None and len(out) <= MOST_STRINGS else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is sre.AT:
        return {""}
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _walk(nodes):
    query, run = True, {""}
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        query = both(query, either(map(of_string, sorted(run))))
        run = {""} if own is None else own
        if own is None:
            if op is sre.SUBPATTERN:
                query = both(query, _walk(arg[3]))
            elif op is sre.BRANCH:
                query = both(query, either([_walk(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                query = both(query, _walk(arg[2]))
    return both(query, either(map(of_string, sorted(run))))


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Segment:
    """Posting lists of the wanted trigrams over a batch of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: list[bytes], table: np.ndarray):
        self.rows = len(at) - 1
        low = lower(data)
        code = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        own = table[code]
        where = np.flatnonzero(own)
        row = np.searchsorted(at, where, "right") - 1
        inside = where + 3 <= at[row + 1]
        pairs = np.unique(own[where][inside].astype(np.int64) * self.rows + row[inside])
        ends = np.searchsorted(pairs, np.arange(1, len(wanted) + 2) * self.rows)
        self.postings = {t: pairs[ends[i]:ends[i + 1]] % max(1, self.rows) for i, t in enumerate(wanted)}

    def rows_for(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        parts = [self.rows_for(x) for x in query[1]]
        if query[0] == "or":
            return reduce(np.union1d, parts)
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))


@lru_cache(maxsize=4)
def _prepared(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(trigrams, queries)))
    table = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
    for i, t in enumerate(wanted, 1):
        table[int.from_bytes(t)] = i
    # a class repeated without end finds its long runs alike when short ones are left out at once
    compiled = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if r.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern, r.flags)
                for r in rules]
    return queries, wanted, table, compiled


def find(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[dict]]:
    """Spans of each row by start, then by the order of the rules; in code points, end exclusive."""
    queries, wanted, table, compiled = _prepared(rules)
    data, at = utf8(column)
    segment = Segment(data, at, wanted, table)
    found: dict[int, list[tuple[int, int, int]]] = {}
    texts: dict[int, str] = {}
    for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
        for row in segment.rows_for(query).tolist():
            text = texts.get(row)
            if text is None:
                text = bytes(data[at[row]:at[row + 1]]).decode()
                if query is not True:
                    texts[row] = text
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.setdefault(row, []).append((m.start(), k, m.end()))
    return [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(found.get(row, ()))] for row in range(segment.rows)]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end) of every row of ``docs``.

    Within a rule, matches are the leftmost ones that do not overlap; spans of different rules may. Null and empty
    texts have no spans; null and repeated doc_ids stay as they are; an empty table gives an empty table.
    """
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "spans": find(batch.column(1), rules)}

    return map_rows(documents(docs), run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs`` with each maximal run of overlapping spans in ``text`` replaced by ``mark``.

    ``n_chars``, where there is one, is counted again. Rows without a secret, null texts included, stay as they are.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            i = names.index("text")
            spans, texts = find(batch.column(i), rules), batch.column(i).to_pylist()
            sizes = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for row, own in enumerate(spans):
                if own:
                    texts[row] = _without(texts[row], own, mark)
                    if sizes is not None:
                        sizes[row] = len(texts[row])
            columns = list(batch.columns)
            columns[i] = pa.array(texts, columns[i].type)
            if sizes is not None:
                j = names.index("n_chars")
                columns[j] = pa.array(sizes, columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            spans = texts = columns = None
            release()

    return docs.mapInArrow(run, schema)


def _without(text: str, spans: list[dict], mark: str) -> str:
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done:s["start"]], mark]
        done = max(done, s["end"])
    return "".join(out) + text[done:]

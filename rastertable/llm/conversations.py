"""Repair of damaged conversations at the least cost, by rank-convergence parallel Viterbi.

A repair walks four states (nothing yet, after the system, after the user, after the assistant). The cost of finishing from each of them
is a vector of four numbers; a row maps the vector behind it to the one before it. Only differences inside a vector decide, and only a
few vectors can occur once their least number is taken off: ``_cost_vectors`` finds them all, and a row is then a small table from vectors to vectors.

Conversations are cut into chunks of at most ``CHUNK`` rows, which all start at once, each from every speculative vector that may lie
behind it. A chunk has converged when its results differ only by constants, which is when its table holds one vector alone. Fix-up passes tie
a chunk to those behind it, twice as far each time, and rerun until all have converged or reached the end of their conversation: none for chunks
that forget what is behind them, as most do, and a logarithm of the chunks for those that never do. The vectors that are now known behind each
chunk drive the tracing of edits from the front, again from all four states at once, fixed up in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertable.llm.tables import checkpointed, new_folder, release

CHUNK = 256
DELETE, INSERT, REROLE, UNENDED = 4, 3, 3, 3
#: States: 0 nothing yet, 1 after the system, 2 after the user, 3 after the assistant.
STATES, FINAL = 4, (0, 3)
#: Role initials and the states that a kept row of that initial leads from and to.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
#: A written turn (inserted, or a row given another role) goes on with the user, or with the assistant after the user.
WRITTEN = {0: 2, 1: 2, 2: 3, 3: 2}
NAMES = {2: "user", 3: "assistant"}
#: Kinds of rows: to be deleted, or an initial and whether the text breaks off.
KINDS = [None, *((initial, broken) for initial in MOVES for broken in (False, True))]
_FAR = 1 << 20


def edits(kind: tuple | None, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits that take one row in a state: letter, cost and next state."""
    yield "D", DELETE, state
    if kind is not None:
        initial, broken = kind
        if state in MOVES[initial]:
            yield "K", UNENDED * broken, MOVES[initial][state]
        yield "R", REROLE + UNENDED * broken, WRITTEN[state]


def _inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs from each state when turns may be inserted first; three insertions reach all that any number reaches."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[WRITTEN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _before(kind: tuple | None, behind: tuple[int, ...]) -> tuple[int, ...]:
    return _inserts([min(cost + behind[to] for _, cost, to in edits(kind, s)) for s in range(STATES)])


@cache
def _cost_vectors() -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All vectors that can occur, their least number taken off (the first is that of the end), and the table (kind, vector behind) -> vector."""
    found = [_inserts([0 if s in FINAL else _FAR for s in range(STATES)])]
    table: dict[tuple[int, int], int] = {}
    for i, behind in enumerate(found):  # grows meanwhile
        for k, kind in enumerate(KINDS):
            costs = _before(kind, behind)
            costs = tuple(c - min(costs) for c in costs)
            if costs not in found:
                found.append(costs)
            table[k, i] = found.index(costs)
    return found, np.array([[table[k, i] for i in range(len(found))] for k in range(len(KINDS))], np.uint8)


@cache
def _traces() -> tuple[list[list[list[str]]], np.ndarray]:
    """Letters and next state for (kind, vector behind the row, state): the least letter of those that keep the cost least, until the row is taken."""
    vectors, _ = _cost_vectors()
    letters, nexts = [], np.zeros((len(KINDS), len(vectors), STATES), np.uint8)
    for k, kind in enumerate(KINDS):
        letters.append([])
        for i, behind in enumerate(vectors):
            here, own = _before(kind, behind), []
            for start in range(STATES):
                state, text = start, ""
                while True:
                    ways = [(a, to, True) for a, cost, to in edits(kind, state) if cost + behind[to] == here[state]]
                    if INSERT + here[WRITTEN[state]] == here[state]:
                        ways.append(("I", WRITTEN[state], False))
                    letter, state, taken = min(ways)
                    text += letter
                    if taken:
                        break
                own.append(text)
                nexts[k, i, start] = state
            letters[-1].append(own)
    return letters, nexts


@cache
def _closing() -> list[str]:
    """Turns to insert after the last row."""
    out = []
    for state in range(STATES):
        text = ""
        while state not in FINAL:
            state, text = WRITTEN[state], text + "I"
        out.append(text)
    return out


def _kinds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of each chunk as rows of a matrix, set flush right, and the lengths; -1 where there is no row."""
    flat = np.asarray(column.flatten(), np.int8)
    size = np.asarray(column.value_lengths(), np.int64)
    out = np.full((len(size), int(size.max(initial=0))), -1, np.int8)
    row = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, nth + np.repeat(out.shape[1] - size, size)] = flat
    return out, size


def back_tables(column: pa.Array) -> np.ndarray:
    """Vector before each chunk for every vector that may be behind it."""
    kinds, _ = _kinds(column)
    table = np.vstack([_cost_vectors()[1], np.arange(len(_cost_vectors()[0]), dtype=np.uint8)[None]])  # -1: as it is
    state = np.tile(table[-1], (len(kinds), 1))
    for j in range(kinds.shape[1] - 1, -1, -1):
        state = table[kinds[:, j][:, None], state]
    return state


def _behind(kinds: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Vector behind each row, from the one behind the chunk."""
    table = np.vstack([_cost_vectors()[1], np.arange(len(_cost_vectors()[0]), dtype=np.uint8)[None]])
    out, state = np.zeros(kinds.shape, np.uint8), last.astype(np.uint8)
    for j in range(kinds.shape[1] - 1, -1, -1):
        out[:, j] = state
        state = table[kinds[:, j], state]
    return out


def front_tables(column: pa.Array, last: np.ndarray) -> np.ndarray:
    """State after each chunk for each state before it."""
    kinds, _ = _kinds(column)
    behind, nexts = _behind(kinds, last), _traces()[1]
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(kinds), 1))
    for j in range(kinds.shape[1]):
        there = kinds[:, j] >= 0
        state[there] = nexts[kinds[there, j][:, None], behind[there, j][:, None], state[there]]
    return state


def trace(column: pa.Array, last: np.ndarray, first: np.ndarray, ends: np.ndarray) -> list[list[str]]:
    """Letters of each row of each chunk; at the end of a conversation one more entry, the turns to insert there."""
    kinds, size = _kinds(column)
    behind, (letters, nexts) = _behind(kinds, last), _traces()
    out = []
    for c in range(len(kinds)):
        state, own = int(first[c]), []
        for j in range(kinds.shape[1] - size[c], kinds.shape[1]):
            k, v = kinds[c, j], behind[c, j]
            own.append(letters[k][v][state])
            state = int(nexts[k, v, state])
        out.append([*own, _closing()[state]] if ends[c] else own)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv`` (null as empty, else = and the id), ``turn``, ``role`` and ``text`` after the damage that the digest of id and turn names; nulls are one space."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    own = conversations.select(_conv(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                               held("role").alias("role"), held("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _conv(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, ascending over each conversation by turn (null first; rows of one turn by role, then by digest of the text), and what is wrong with each.

    A range sort over all conversations, so a conversation of any size is spread over tasks; written to the shared folder.
    """
    spark = rows.sparkSession
    by = ["conv", "turn", "role", "digest"]
    ranged = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ranged = ranged.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    folder = new_folder(spark, "turns")
    ranged.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _marked(rows: DataFrame) -> DataFrame:
    """``conv``, ``at``, ``fault`` (b: blank, d: duplicate, t: truncated, -: none) and ``kind`` of every row; texts are read, but not moved."""
    ended = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    light = rows.select("conv", "at", "role", "digest", (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("broken"))
    # least places are found per task first; the join of a turn that is said very often can be split by Spark
    seen = light.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("broken"), "t").otherwise("-")
    initial, kind = F.substring("role", 1, 1), F.lit(0)
    for k, (own, broken) in enumerate(KINDS[1:], 1):
        mine = initial == own if own else ~initial.isin(*filter(None, MOVES))
        kind = F.when(mine & (F.col("fault") == ("t" if broken else "-")), k).otherwise(kind)
    return light.join(seen, ["conv", "role", "digest"]).withColumn("fault", fault).select("conv", "at", "fault", kind.cast("byte").alias("kind"))


def _chunks(marked: DataFrame) -> DataFrame:
    """``conv``, ``part`` (rows at / CHUNK), its ``kinds``, faults by row, its number ``k`` in the conversation and their ``count``."""
    chunks = marked.groupBy("conv", F.floor(F.col("at") / CHUNK).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "fault"))).alias("rows"))
    chunks = checkpointed(chunks.select("conv", "part", F.transform("rows", lambda r: r["kind"]).alias("kinds"),
                                        F.array_join(F.transform("rows", lambda r: r["fault"]), "").alias("faults")))
    # chunks of a conversation are numbered through inside a task of the range sort; a conversation has a few rows for each such task
    task = F.shiftright("part", 33 - CHUNK.bit_length() + 1)
    spans = chunks.groupBy("conv", task.alias("task")).agg(F.min("part").alias("low"), (F.max("part") - F.min("part") + 1).alias("n"))
    over = Window.partitionBy("conv")
    spans = spans.select("conv", "task", "low", (F.sum("n").over(over.orderBy("task")) - F.col("n")).alias("earlier"), F.sum("n").over(over).alias("count"))
    numbered = chunks.withColumn("task", task).join(spans, ["conv", "task"])
    return numbered.select("conv", "part", "kinds", "faults", (F.col("earlier") + F.col("part") - F.col("low")).alias("k"), "count")


def settled(tables: DataFrame, towards: int, start: int) -> DataFrame:
    """What enters each chunk, from ``tables`` (``conv, k, count, table``): its neighbour on the side ``towards`` (1: behind, -1: before), and beyond the last one ``start``.

    ``table`` says what leaves a chunk for all that may enter it. In each pass a chunk that has not converged is composed with the one as far
    away as it already reaches, so the reach doubles.
    """
    out_of = (F.col("k") + 1 == F.col("count")) if towards > 0 else (F.col("k") == 0)
    fixed = lambda t: F.array_min(t) == F.array_max(t)
    now = tables.select("conv", "k", "count", F.when(out_of, F.array_repeat(F.element_at("table", start + 1), F.size("table"))).otherwise(F.col("table")).alias("table"))
    now, reach = checkpointed(now), 1
    while now.filter(~fixed(F.col("table"))).limit(1).count():
        beyond = now.select("conv", (F.col("k") - towards * reach).alias("k"), F.col("table").alias("far"))
        open_ = now.filter(~fixed(F.col("table"))).join(beyond, ["conv", "k"])
        tied = open_.select("conv", "k", "count", F.transform("far", lambda v: F.element_at("table", v.cast("int") + 1)).alias("table"))
        now = checkpointed(tied.unionByName(now.filter(fixed(F.col("table")))))
        reach *= 2
    enters = now.select("conv", (F.col("k") - towards).alias("k"), F.element_at("table", 1).cast("int").alias("enters"))
    return tables.select("conv", "k", out_of.alias("edge")).join(enters, ["conv", "k"], "left").select(
        "conv", "k", F.when(F.col("edge"), start).otherwise(F.col("enters")).alias("enters"))


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                yield fn(batch.slice(start, 2000))
            release()

    return df.mapInArrow(run, schema)


def audits(chunks: DataFrame) -> DataFrame:
    """``conv``, ``part``, ``k``, ``faults`` and ``letters``: the cheapest edits of every row, least letters first; the last chunk has one more entry."""
    def backwards(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(back_tables(b.column(3)).tolist(), pa.list_(pa.int16()))], names=["conv", "k", "count", "table"])

    def forwards(b: pa.RecordBatch) -> pa.RecordBatch:
        tables = front_tables(b.column(3), np.asarray(b.column(4)))
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(tables.tolist(), pa.list_(pa.int16()))], names=["conv", "k", "count", "table"])

    def traced(b: pa.RecordBatch) -> pa.RecordBatch:
        last, first, k, count = (np.asarray(b.column(i)) for i in (4, 5, 1, 6))
        letters = trace(b.column(3), last, first, k + 1 == count)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), b.column(7), pa.array(letters, pa.list_(pa.string()))],
                                          names=["conv", "part", "k", "faults", "letters"])

    several = chunks.filter("count > 1")
    tables = "conv string, k long, count long, table array<short>"
    behind = checkpointed(settled(checkpointed(_mapped(several.select("conv", "k", "count", "kinds"), backwards, tables)), 1, 0))
    known = several.join(behind.withColumnRenamed("enters", "last"), ["conv", "k"])
    front = checkpointed(_mapped(known.select("conv", "k", "count", "kinds", "last"), forwards, tables))
    known = known.join(settled(front, -1, 0).withColumnRenamed("enters", "first"), ["conv", "k"])
    order = ["conv", "k", "part", "kinds", "last", "first", "count", "faults"]
    single = chunks.filter("count = 1").withColumns({"last": F.lit(0), "first": F.lit(0)})
    return _mapped(known.select(*order).unionByName(single.select(*order)), traced, "conv string, part long, k long, faults string, letters array<string>")


_FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}
_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Conversation:
    """What is gathered over one conversation; its turns come in order, in pieces of a chunk."""

    def __init__(self, conv: str):
        self.conv, self.digest, self.any, self.state = conv, hashlib.sha256(), False, 0
        self.audit, self.cost, self.illegal = [], 0, 0
        self.faults = dict.fromkeys(_FAULTS.values(), 0)
        self.low = self.high = None
        self.turns, self.role = 0, None
        self.letters: list[str] = []
        self.wrong = ""
        self.next = 0

    def chunk(self, letters: list[str], wrong: str) -> None:
        self.finish()
        self.letters, self.wrong, self.next = letters, wrong, 0
        self.audit.append("".join(letters))

    def finish(self) -> None:
        """Turns inserted behind the last row of a conversation."""
        for entry in self.letters[self.next:]:
            self._inserted(entry)
        self.next = len(self.letters)

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def _inserted(self, entry: str) -> None:
        for _ in entry:
            self.state = WRITTEN[self.state]
            self._write(NAMES[self.state], "")
            self.cost += INSERT

    def row(self, turn: int | None, role: str, text: str) -> None:
        entry, fault = self.letters[self.next], self.wrong[self.next]
        self.next += 1
        if fault in _FAULTS:
            self.faults[_FAULTS[fault]] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        self._inserted(entry[:-1])
        if entry[-1] == "D":
            self.cost += DELETE
            return
        self.cost += UNENDED * (fault == "t")
        if entry[-1] == "R":
            self.cost += REROLE
            self.state = WRITTEN[self.state]
            role = NAMES[self.state]
        else:
            self.state = MOVES[role[:1]][self.state]
        self._write(role, text)

    def result(self) -> tuple:
        self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (int(self.conv[1:]) if self.conv else None, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: each conversation is announced, each chunk's edits come before its rows. One conversation is held at a time, without its texts."""
    target = pa.schema([pa.field("conv_id", pa.int64()), *(pa.field(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])
    now, done = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), target, strict=True)], schema=target)

    for batch in batches:
        for conv, turn, role, text, letters, wrong in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv", "turn", "role", "text", "letters", "faults")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv)
            if letters is not None:
                now.chunk(letters, wrong)
            elif role is not None:
                now.row(turn, role, text)
        if done:
            yield out()
            done = []
        release()
    if now is not None:
        done.append(now.result())
        yield out()


def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, after the damage that ``damaged`` does.

    Columns read: conv_id, turn, role, text; others are ignored. Null roles and texts are one space; rows with a null conv_id are a conversation
    of their own, null turns come first. Rows of one turn are ordered by role, then by digest of the text, so repeated
    rows stand next to each other. A conversation that lost all rows has zeros, an empty audit and the digest of nothing; an empty table gives no rows.
    Texts of any length are read whole. The digest of a conversation is a chain, so its texts pass one after the other through one task,
    which keeps none of them; all else is done in chunks.
    """
    every = conversations.select(_conv(F.col("conv_id")).alias("conv")).distinct()
    rows = ordered(damaged(conversations))
    chunks = checkpointed(_chunks(_marked(rows)))
    none = lambda kind: F.lit(None).cast(kind)
    told = (rows.select("conv", "at", F.lit(1).alias("level"), "turn", "role", "text", none("array<string>").alias("letters"), none("string").alias("faults"))
            .unionByName(audits(chunks).select("conv", (F.col("part") * CHUNK).alias("at"), F.lit(0).alias("level"), none("long").alias("turn"),
                                               none("string").alias("role"), none("string").alias("text"), "letters", "faults"))
            .unionByName(every.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(-1).alias("level"), none("long").alias("turn"),
                                      none("string").alias("role"), none("string").alias("text"), none("array<string>").alias("letters"), none("string").alias("faults"))))
    return told.repartition("conv").sortWithinPartitions("conv", "at", "level").mapInArrow(_told, _RESULT)

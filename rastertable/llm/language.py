"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

A text is lower-cased; every run of 2, 3 or 4 bytes of one word, the spaces around it included, is a subword and is hashed to one of ``BUCKETS``
embeddings. The mean embedding is scored by a linear softmax; embeddings and softmax are learned together by stochastic gradient descent in NumPy on a
bounded sample. As the mean is linear, scoring sums one small row of class scores per subword, over whole texts and block by block, so a text of any length needs
the memory of a block. A temperature, fitted on rows of the sample that were not learned from, makes the scores chances; the lowest score above
which no larger share of those rows than ``ERRORS`` (one row at least) is wrong is the bound of rejection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.llm.tables import documents, map_rows
from rastertable.llm.words import utf8

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
#: Rows that the model is fitted on at most, about as many of each language.
SAMPLE_ROWS = 3000
#: Subwords that a row of the sample gives at most: spread over the whole text, and from one short stretch of it.
BAG, SHORT_BAG = 600, 36
SIZES = (2, 3, 4)
ERRORS = 0.01
UNKNOWN = "und"
BLOCK = 1 << 20
_SPACE = 32
#: Bytes as they count: letters and all bytes of other scripts as they are, all else as a space.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each between two spaces, and where each begins (one more at the end)."""
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    space = pa.scalar(" ", pa.large_string())
    data, at = utf8(pc.binary_join_element_wise(space, column, space, pa.scalar("", pa.large_string())))
    return _FOLD[data], at


def subwords(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the subwords of a size begin, and their buckets; none holds a space inside, so none crosses words or texts."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    letter = data != _SPACE
    inside = letter[0:n] | letter[1:n + 1] if size == 2 else letter[1:n + 1].copy()
    for k in range(2, size - 1):
        inside &= letter[k:n + k]
    start = np.flatnonzero(inside)
    code = np.full(len(start), size, np.uint32)
    for k in range(size):
        code = (code ^ data[start + k]) * np.uint32(0x01000193)
    code ^= code >> np.uint32(15)
    return start, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG2)


@dataclass
class Model:
    """``scores`` of each bucket for each of ``languages``; no languages: nothing to learn from."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        data, at = padded(column)
        rows = len(at) - 1
        total, count = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for begin in range(0, len(data), BLOCK):
            for size in SIZES:
                start, bucket = subwords(data[begin:begin + BLOCK + size - 1], size)
                if not len(start):
                    continue
                row = np.searchsorted(at, start + begin, side="right") - 1
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[first]] += np.add.reduceat(self.scores[bucket], first, axis=0, dtype=np.float64)
                count[row[first]] += np.diff(np.append(first, len(row)))
        return total / np.maximum(1, count)[:, None] + self.bias

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 for null and for texts without a letter."""
        known = np.asarray(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}").fill_null(False), bool)
        if not self.languages or not len(column):
            return [UNKNOWN] * len(column), np.zeros(len(column))
        p = softmax(self.logits(column) / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(table: np.ndarray, weights: np.ndarray, bias: np.ndarray, bags: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log loss of bags and its gradients: by weights, by bias, and by embeddings (one row for each subword of ``np.concatenate(bags)``)."""
    size = np.array([len(b) for b in bags])
    flat, first = np.concatenate(bags), np.cumsum(size) - size
    mean = np.add.reduceat(table[flat], first, axis=0) / size[:, None]
    p = softmax(mean @ weights + bias)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    return loss, mean.T @ p, p.sum(0), np.repeat(p @ weights.T / size[:, None], size, axis=0), flat


def fit(bags: list[np.ndarray], languages: list[str], dim: int = 16, epochs: int = 8, least_steps: int = 2000, batch: int = 16, rate: float = 0.4,
        seed: int = 0) -> Model:
    """Stochastic gradient descent with a falling rate, over more epochs where a small sample gives few steps. Every tenth row of the sample is kept for the temperature and the bound of rejection."""
    names = sorted(set(languages))
    bags = [b if len(b) else np.zeros(1, np.int64) for b in bags]
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)))
    y = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    weights, bias = np.zeros((dim, len(names))), np.zeros(len(names))
    order = rng.permutation(len(bags))
    kept, order = order[::10], np.delete(order, np.s_[::10]) if len(order) >= 20 else order
    each = -(-len(order) // batch)
    epochs, step = max(epochs, -(-least_steps // each)), 0
    steps = epochs * each
    for _ in range(epochs):
        order = rng.permutation(order)
        for start in range(0, len(order), batch):
            own = order[start:start + batch]
            _, dw, db, rows, flat = gradients(table, weights, bias, [bags[i] for i in own], y[own])
            now = rate * (1 - step / steps)
            weights -= now * dw
            bias -= now * db
            # bags are means of many embeddings: each gets the step that it would get alone
            np.subtract.at(table, flat, now * BAG / 8 * rows)
            step += 1
    model = Model(names, (table @ weights).astype(np.float32), bias)
    return calibrated(model, [bags[i] for i in kept], y[kept])


def calibrated(model: Model, bags: list[np.ndarray], y: np.ndarray) -> Model:
    """``model`` with the temperature of least log loss on ``bags`` and the lowest bound that leaves at most ``ERRORS`` of those above it, or one, wrong."""
    logits = np.array([model.scores[b].mean(0, dtype=np.float64) for b in bags]) + model.bias
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    p = softmax(logits / temperature)
    best, order = p.max(1), np.argsort(-p.max(1), kind="stable")
    wrong = np.cumsum((p.argmax(1) != y)[order])
    good = np.flatnonzero(wrong <= np.maximum(1, ERRORS * np.arange(1, len(y) + 1)))
    least = float(best[order[good[-1]]]) if len(good) else 1.0
    return Model(model.languages, model.scores, model.bias, float(temperature), least)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a null id is not held out, but not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bags(column: pa.Array, seeds: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Two bags for each text: subwords spread evenly over all of it, and those of a short stretch at a place that the seed gives."""
    out = []
    for text, seed in zip(column, seeds, strict=True):
        data, _ = padded(pa.array([text.as_py()], pa.large_string()))
        start, bucket = zip(*(subwords(data, s) for s in SIZES), strict=True)
        start, bucket = np.concatenate(start), np.concatenate(bucket)
        bucket = bucket[np.argsort(start, kind="stable")].astype("<u4")
        even = bucket[np.linspace(0, len(bucket) - 1, BAG).astype(np.int64)] if len(bucket) > BAG else bucket
        at = int(seed) % max(1, len(bucket) - SHORT_BAG + 1)
        out.append((even.tobytes(), bucket[at:at + SHORT_BAG].tobytes()))
    return out


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows that are not held out and have a text, a doc_id and a language, about equally many of each language.

    The rows with the least product of a draw (from the digest of the doc_id) and their language's count are taken, so rare languages count
    as much as frequent ones. Only bags of bounded size come to the driver, never texts.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    names = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double")
    # as many rows as languages are broadcast if few, else the join is spread by doc_id; the sample is sample_rows rows of two values
    chosen = (known.select("doc_id", "lang").join(names, "lang").orderBy(draw * F.col("n"), "doc_id", "lang").limit(sample_rows)
              .select("doc_id", "lang").distinct())
    rows = known.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def run(batch: pa.RecordBatch) -> dict:
        bags = _bags(batch.column(2), np.asarray(batch.column(0)).astype(np.int64) * 2654435761 % (1 << 31))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "even": [a for a, _ in bags], "short": [b for _, b in bags]}

    found = map_rows(rows, run, "doc_id long, lang string, even binary, short binary").orderBy("doc_id", "lang", "even").limit(2 * sample_rows).collect()
    bags = [np.frombuffer(x, "<u4").astype(np.int64) for r in found for x in (r.even, r.short)]
    return fit(bags, [r.lang for r in found for _ in range(2)])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``accepted`` of every row, from its whole text alone.

    Null texts and texts without any letter (empty ones too) are ``und`` with score 0 and not accepted, as all are where there was nothing to learn from;
    other texts get the likeliest language that was learned, and ``accepted`` says whether its score reaches the bound. Null and repeated
    doc_ids stay; further columns are ignored. A text of any length is read in blocks.
    """
    def run(batch: pa.RecordBatch) -> dict:
        names, score = model.predict(batch.column(1))
        return {"doc_id": batch.column(0), "lang_pred": names, "score": score,
                "accepted": (score >= model.least) & (np.array(names, object) != UNKNOWN) if names else np.zeros(0, bool)}

    return map_rows(documents(docs), run, "doc_id long, lang_pred string, score double, accepted boolean", 1 << 20)

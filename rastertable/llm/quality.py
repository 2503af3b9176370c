"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages; only the bag has a label. Every passage of the whole text is encoded from counts of
byte-class pairs and a few word statistics; gated attention weighs the passages, and the weighted sum of their
codes is scored. Encoder, attention and score are learned together from document labels, by gradient descent on a bounded
sample of labelled rows; scoring is one pass over the texts with the small model in each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertable.llm.tables import documents, map_rows, release, slices
from rastertable.llm.words import NOT_SPACE, hashes, split, utf8

PASSAGE_WORDS = 64
#: Labelled rows that the model is fitted on at most: those whose doc_ids have the smallest digests.
SAMPLE_ROWS = 3000
#: Passages that a sampled text is learned from at most, evenly spread over it; scoring reads all passages.
SAMPLE_PASSAGES = 64
THRESHOLD = 0.3
BUCKETS = 128
#: Byte classes: each of these sets is one, other bytes are the last one (fixed values).
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"|_~^`", b"#$%&*@+=<>/\\",
           b"'\"()[]{}-", bytes(range(0x80, 0x100)))
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k
PAIRS = (len(CLASSES) + 1) ** 2
WIDTH = PAIRS + 5


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages (rows of ``WIDTH`` numbers) of a batch of texts, and each text's first one; an empty text has one of zeros."""
    data, at = utf8(column)
    words = split(data, at, NOT_SPACE)
    count = np.diff(words.first)
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((first[-1], WIDTH), np.float32)
    # where each passage begins: its first word, for the first one the text
    nth = np.arange(first[-1]) - np.repeat(first[:-1], bags)
    row = np.repeat(np.arange(len(bags)), bags)
    head = words.first[row] + nth * PASSAGE_WORDS
    begin = np.where(nth == 0, at[row], words.start[np.minimum(head, max(0, len(words.start) - 1))] if len(words.start) else at[row])
    sizes = np.diff(np.append(begin, len(data)))
    if len(data) > 1:
        owner = np.repeat(np.arange(first[-1]) * PAIRS, sizes)
        own = _CLASS[data]
        inside = np.ones(len(data) - 1, bool)
        inside[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))] - 1] = False
        code = owner[:-1] + own[:-1] * (len(CLASSES) + 1) + own[1:]
        out[:, :PAIRS] = np.bincount(code[inside], minlength=first[-1] * PAIRS).reshape(-1, PAIRS)
        out[:, :PAIRS] /= np.maximum(1, sizes)[:, None]
    if len(words.start):
        wrow = words.row
        owner = first[wrow] + (np.arange(len(wrow)) - words.first[wrow]) // PASSAGE_WORDS
        held = np.bincount(owner, minlength=first[-1])
        n = np.maximum(1, held)
        h, length = hashes(data, words.start, words.stop), words.stop - words.start
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])])
        seen = np.zeros(first[-1] * BUCKETS, bool)
        seen[owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)] = True
        share = lambda x: np.bincount(owner, x, minlength=first[-1]) / n
        out[:, PAIRS:] = np.stack([share(again), seen.reshape(-1, BUCKETS).sum(1) / n, share(np.minimum(length, 40)) / 10, share(length == 1),
                                   np.minimum(1, held / PASSAGE_WORDS)], 1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """``weights`` None: no labels to learn from, or all alike; then every text scores ``prior``."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """x: scaled passages. h: codes; a: attention, which sums to 1 in each bag; z: weighted codes; p: scores."""
        w, bag = self.weights, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.prior)
        if not len(column):
            return np.zeros(0)
        x, first = encode(column)
        return self.forward((x - self.mean) / self.scale, first)["p"].astype(np.float64)


def fit(bags: list[np.ndarray], labels: np.ndarray, codes: int = 16, attention: int = 8, epochs: int = 40, batch: int = 128, rate: float = 0.01,
        decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the mean log loss of bags."""
    y = np.asarray(labels, np.float32)
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(prior)
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"W": draw(WIDTH, codes), "b": np.zeros(codes, np.float32), "V": draw(codes, attention), "U": draw(codes, attention), "w": draw(attention),
         "c": draw(codes), "d": np.zeros((), np.float32)}
    model = Model(prior, mean, scale, w)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), batch):
            own = order[start:start + batch]
            x = np.concatenate([bags[i] for i in own])
            f = model.forward(x, np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])]))
            grads = _gradients(w, x, f, (f["p"] - y[own]) / len(own))
            step += 1
            for k, g in grads.items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _gradients(w: dict, x: np.ndarray, f: dict, wrong: np.ndarray) -> dict[str, np.ndarray]:
    bag, h, t, g, a, z = (f[k] for k in ("bag", "h", "t", "g", "a", "z"))
    dz = wrong[:, None] * w["c"]
    de = a * np.einsum("ij,ij->i", dz[bag], h - z[bag])
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ wrong, "d": wrong.sum()}


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` that are not held out and have a label 0 or 1, and the texts of their doc_ids.

    The sample, not the corpus, comes to the driver: a matrix of up to SAMPLE_PASSAGES passages for each of its rows. Null labels and doc_ids are left
    out; a doc_id that occurs again gives one text; without labels, or with labels all alike, the model scores every text alike.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
              .orderBy(F.md5(F.col("doc_id").cast("string")), "y").limit(sample_rows))
    # at most sample_rows rows of two integers
    texts = documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id", "y"])

    def run(batch: pa.RecordBatch) -> dict:
        x, first = encode(batch.column(2))
        own = [x[np.unique(np.linspace(a, b - 1, min(b - a, SAMPLE_PASSAGES)).astype(np.int64))] for a, b in zip(first[:-1], first[1:], strict=True)]
        return {"doc_id": batch.column(0), "y": batch.column(1), "bag": [bag.tobytes() for bag in own]}

    rows = sorted(map_rows(texts, run, "doc_id long, y int, bag binary").collect(), key=lambda r: (r.doc_id, r.y))
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, WIDTH) for r in rows], np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, the chance of label 1) of every row of ``docs``.

    Null and empty texts are scored as a bag of one empty passage; null and repeated doc_ids stay; only the text counts.
    """
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": model.scores(batch.column(1))}

    return map_rows(documents(docs), run, "doc_id long, score double", 2 << 20)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``.

    Null and empty texts are scored as one empty passage; repeated rows are decided alike; an empty table stays empty. Texts of any length are scored whole.
    """
    at = docs.columns.index("text")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2 << 20)):
            yield batch.filter(pa.array(model.scores(batch.column(at)) >= threshold))
            release()

    return docs.mapInArrow(run, docs.schema)

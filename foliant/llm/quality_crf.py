"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own statistics and those of the lines before and after it, together with
transition weights; forward-backward gives each line's marginal, and the length-weighted mean of the marginals of
"good" is the document's share of good text, which a fitted logistic curve turns into a score.

Only documents are labelled, so training is in rounds: at first a line has its document's label; then lines of bad
documents that the model itself holds good by a clear margin are relabelled (one line of each stays bad), and the
field is fitted again. Training reads at most MAX_DOCS labelled rows of at most MAX_BYTES in all (a line counting 64
bytes more), chosen by a hash of doc_id, as line statistics; both bounds are parameters, and hold whatever the texts'
lengths and however often an id occurs. Scoring reads every document whole.

Inputs of a score: the text alone. Null or empty text: one line without words. Null doc_id: never labelled, scored.
Very long texts: one
text's lines are held at a time. Ties: equal hashes are in order of doc_id, label and text. Repeated rows: scored alike,
and learnt from once; contradicting labels count each. No labelled rows of either class: every score is the
share of label 1 (0.5 without any). Empty table: no rows. Extra columns: kept by keep_good(), not read by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .features import LINE_FEATURES, Lines, Texts

MAX_DOCS, MAX_BYTES = 6000, 1 << 26
OUT = "doc_id long, held_out boolean, score double, predicted int"
_N = 3 * len(LINE_FEATURES) + 3


class Model(NamedTuple):
    weights: np.ndarray  # of a bad line's observations
    moves: np.ndarray  # 2 x 2, from line to line
    slope: float
    shift: float
    fixed: float | None = None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def observations(t: Lines) -> np.ndarray:
    """Of each line: its own features, those of its neighbours, whether it is first or last, and 1."""
    f, m = t.features, len(t.features)
    first, last = np.zeros(m, bool), np.zeros(m, bool)
    first[t.first_line], last[t.first_line + t.n_lines - 1] = True, True
    before, after = np.roll(f, 1, 0), np.roll(f, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([f, before, after, first[:, None], last[:, None], np.ones((m, 1))], axis=1)


def marginals(unary: np.ndarray, moves: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line, and expected moves (2 x 2) in all, for chains of n lines from first on: each step of the
    forward and backward passes is one array operation over all chains that are as long."""
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    local = np.exp(np.stack([np.zeros_like(unary), np.clip(unary, -30, 30)], 1))
    local /= local.sum(1, keepdims=True)
    step = np.exp(np.clip(moves, -8, 8))
    alpha, beta = np.empty_like(local), np.ones_like(local)
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # chains with more than t lines
    alpha[first] = local[first]
    for t in range(1, longest):
        at = first[: active[t]] + t
        a = (alpha[at - 1] @ step) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = first[: active[t]] + t
        right = local[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * step[None] * right[:, None, :]
        expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = right @ step.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), expected


def _fit_field(x: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray, start: tuple | None, rounds: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood with a small ridge, by Adam on the whole sample."""
    w, moves = start or (np.zeros(x.shape[1]), np.zeros((2, 2)))
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    size, m, v = len(y), np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        p, expected = marginals(x @ w, moves, first, n)
        g = np.concatenate([x.T @ (p - y) / size + 1e-4 * w, ((expected - seen) / size + 1e-4 * moves).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, moves = w - d[:-4], moves - d[-4:].reshape(2, 2)
    return w, moves


def shares(t: Lines, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of "good" of each text."""
    bad, _ = marginals(observations(t) @ weights, moves, t.first_line, t.n_lines)
    return 1 - t.by_text(bad * t.length) / t.by_text(t.length)


def fit(t: Lines | None, quality: list[int]) -> Model:
    label = np.array(quality, int)
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(_N), np.zeros((2, 2)), 0.0, 0.0, float(label.mean()) if len(label) else 0.5)
    x, owner = observations(t), np.repeat(np.arange(len(label)), t.n_lines)
    y = 1 - label[owner]
    w, moves = _fit_field(x, y, t.first_line, t.n_lines, None)
    for _ in range(2):
        bad, _ = marginals(x @ w, moves, t.first_line, t.n_lines)
        worst = np.maximum.reduceat(bad, t.first_line)[owner]
        y = ((label[owner] == 0) & ((bad > 0.35) | (bad >= worst))).astype(int)
        w, moves = _fit_field(x, y, t.first_line, t.n_lines, (w, moves), 60)
    s = shares(t, w, moves)
    slope, shift = 1.0, 0.0
    for k in range(4000):  # logistic curve over the share; classes weigh as they occur
        p = 1 / (1 + np.exp(-np.clip(slope * s + shift, -30, 30)))
        rate = 60 / (1 + k / 500)
        slope, shift = slope - rate * float(((p - label) * s).mean() + 1e-6 * slope), shift - rate * float((p - label).mean())
    return Model(w, moves, slope, shift)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, max_docs: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, label, text of at most max_docs labelled rows outside the held-out third, in a fixed order, as far as
    max_bytes go. The choice is made on labels, ids, and hashes and sizes of texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(~held_out(F.col("doc_id"))).distinct()
    text = F.coalesce("text", F.lit(""))
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), (F.octet_length(text) + 64 * lines).alias("size"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("text_hash")]
    chosen = sizes.join(known, "doc_id").distinct().orderBy(*order).limit(max_docs)
    # max_docs rows of four numbers
    used = F.sum("size").over(Window.orderBy(*order))
    chosen = chosen.withColumn("used", used).filter(F.col("used") <= max_bytes).select("doc_id", "text_hash", "label")
    return rows.join(F.broadcast(chosen), ["doc_id", "text_hash"]).groupBy("doc_id", "label", "text_hash").agg(F.first("text").alias("text")).select("doc_id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Executors turn the sample's texts into line statistics; those alone reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(batch.column("text").to_pylist())
            cut = lambda a: [a[i : i + n].astype("<f4").tobytes() for i, n in zip(t.first_line.tolist(), t.n_lines.tolist(), strict=True)]  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(cut(t.features), pa.binary()), pa.array(cut(t.length), pa.binary())], names=["doc_id", "label", "features", "length"])

    rows = labelled_sample(docs, labels, "quality", max_docs).mapInArrow(run, "doc_id long, label int, features binary, length binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["features"]), bytes(r["length"])))
    if not rows:
        return fit(None, [])
    join = lambda name: np.frombuffer(b"".join(bytes(r[name]) for r in rows), "<f4").astype(float)
    lines = Lines(join("features").reshape(-1, len(LINE_FEATURES)), join("length"), np.array([len(r["length"]) // 4 for r in rows]))
    return fit(lines, [int(r["label"] == 1) for r in rows])


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    if model.fixed is not None:
        return np.full(len(texts), model.fixed)
    s = shares(Texts(texts), model.weights, model.moves)
    return 1 / (1 + np.exp(-np.clip(model.slope * s + model.shift, -30, 30)))


def with_score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a score from 0 to 1 for each row."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = scores(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, name])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` double")


def score(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, max_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text").to_pylist(), model), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of docs."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, name).filter(F.col(name) >= threshold).drop(name)

"""Mixing sources to target weights by soft membership.

A classifier learnt from the labels table gives each document posteriors p_i over the domains clean, junk and toxic.
With n_i the document's words, rates r_i >= 0 are fitted so that the expected domain totals A r = sum n_i r_i p_i meet
targets t: projected gradient on the least squares |A r - t| (weighted by the inverse of the Gram matrix of the
posteriors of the documents whose rate is above 0, which makes the steps well conditioned), from r = 1 on. One step is r_i <- max(0, r_i - p_i . y) with a
three-number y, so the rates after any number of steps are a fold of the y's over a document's own posteriors: each
step is one aggregation over a written table of posteriors and word counts, and nothing but three numbers moves.

The classifier is a softmax regression over line statistics and the presence of the words (hashed to 2^18 places)
that tell the classes apart most, fitted on at most MAX_DOCS labelled rows (a parameter, with quality_crf.MAX_BYTES),
chosen by a hash of doc_id.

Steps end when every total is within ENOUGH (a share of all words) of its goal. Whether they are is told: target_met is
false in every row where a domain's target can't be reached by nonnegative rates, as where no document has a share in
it, and the rates are those that come nearest. A caller may bound how often a domain is repeated (most); its goal is
then what it has times that, and target_met holds the total against the target itself, not against that goal. Posteriors are
never quite 0, so clean documents together hold some of every domain, and a small target for toxic text can only be met
by leaving clean ones out. Where that is not wanted, Bounds puts each document's rate in a box (clean: from 1 on,
others: up to 1): the projection is then onto the box, and the totals come as near as they can.

Null or empty text: no words; it counts for nothing, and has a rate like any other. Null doc_id: kept. Very long texts:
one text's words are held at a time. Ties: documents of equal posteriors have equal rates; resample() rounds each by a
hash of (doc_id, text). Repeated rows: each alike. Empty table: no rows. Extra columns: kept by resample(), whatever
their names, not read by rates().
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, written
from .features import LINE_FEATURES, Texts
from .quality_crf import labelled_sample

DOMAINS = ("clean", "junk", "toxic")
#: Share of all words that each domain is to have in the mix.
TARGETS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}
MAX_DOCS, WORD_BITS, MAX_WORDS, STEPS, ENOUGH = 6000, 18, 512, 40, 1e-6
#: Within bounds, steps also end when one takes off less than this share of the misses; and what is added to the Gram
#: matrix there, so that a domain of next to no words moves nothing.
STALL, RIDGE = 1e-3, 1e-6


class Model(NamedTuple):
    words: np.ndarray  # places of the words used, ascending
    weights: np.ndarray  # features x domains


def _places(t: Texts) -> np.ndarray:
    return (t.word_hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _presence(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every distinct word of each text."""
    keys = np.unique((t.word_text.astype(np.int64) << WORD_BITS) | _places(t))
    return keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)


def _matrix(owner: np.ndarray, place: np.ndarray, words: np.ndarray, means: np.ndarray) -> np.ndarray:
    """One row for each text: which of the words it has, its line statistics, 1."""
    column = np.full(1 << WORD_BITS, -1, np.int32)
    column[words] = np.arange(len(words))
    at = column[place]
    used = at >= 0
    x = np.zeros((len(means), len(words)))
    x[owner[used], at[used]] = 1
    return np.concatenate([x, 4 * means, np.ones((len(means), 1))], axis=1)


def _inputs(texts: list[str | None], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = Texts(texts)
    return _matrix(t.word_text, _places(t), words, t.means()), t.by_text(t.words)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(found: list[np.ndarray], means: np.ndarray, domain: list[int]) -> Model:
    """found: the places of each text's distinct words. means: its line statistics."""
    k = len(DOMAINS)
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros((len(LINE_FEATURES) + 1, k)))
    y = np.eye(k)[np.array(domain, int)]
    owner, place = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found).astype(np.int64)
    df = np.stack([np.bincount(place, y[owner, d], 1 << WORD_BITS) for d in range(k)], 1)
    n = y.sum(0)
    total, share = df.sum(1), df.sum(1) / len(found)
    spread = np.maximum(share * (1 - share), 1e-9)[:, None] * np.maximum(n, 1)
    tells = (((df - share[:, None] * n) ** 2) / spread).max(1) * (total >= 3)
    words = np.sort(np.argsort(-tells, kind="stable")[:MAX_WORDS])
    words = words[tells[words] > 0]
    x = _matrix(owner, place, words, means)
    w, m, v = np.zeros((x.shape[1], k)), 0.0, 0.0
    for step in range(1, 301):
        g = x.T @ (_softmax(x @ w) - y) / len(found) + 2e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(words, w)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Executors turn the sample's texts into word places and line statistics; those alone reach the driver."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    usable = labels.filter("toxic is not null and quality is not null").select("doc_id", domain.alias("domain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(batch.column("text").to_pylist())
            owner, place = _presence(t)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
            places = [place[a:b].astype("<i4").tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(places, pa.binary()), pa.array([m.tobytes() for m in t.means().astype("<f8")], pa.binary())], names=["doc_id", "label", "places", "means"])

    rows = labelled_sample(docs, usable, "domain", max_docs).mapInArrow(run, "doc_id long, label int, places binary, means binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["places"]), bytes(r["means"])))
    means = np.frombuffer(b"".join(bytes(r["means"]) for r in rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 0))
    return fit([np.frombuffer(bytes(r["places"]), "<i4") for r in rows], means, [r["label"] for r in rows])


def with_posteriors(docs: DataFrame, model: Model, words: str = "mix_words", p: str = "mix_p") -> DataFrame:
    """docs with two more columns: words (long) and posteriors (array, in the order of DOMAINS)."""
    columns, kinds = docs.columns, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, n = _inputs(batch.column("text").to_pylist(), model.words)
            shares = _softmax(x @ model.weights)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n.astype(np.int64)), pa.array(list(shares), pa.list_(pa.float64()))], names=[*columns, words, p])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{words}` long, `{p}` array<double>")


class Bounds(NamedTuple):
    """Documents whose clean posterior is at least this have rates from 1 to most, the others from 0 to 1."""

    clean: float = 0.5
    most: float = 1.1


def rate(p: Column, steps: list[list[float]], bounds: Bounds | None = None) -> Column:
    """The rate after the steps so far, from a document's posteriors."""
    if not steps:
        return F.lit(1.0)
    given = F.array(*[F.array(*[F.lit(float(y)) for y in step]) for step in steps])
    low, high = F.lit(0.0), None
    if bounds is not None:
        is_clean = p[0] >= bounds.clean
        low, high = F.when(is_clean, 1.0).otherwise(0.0), F.when(is_clean, float(bounds.most)).otherwise(1.0)

    def moved(r: Column, y: Column) -> Column:
        there = F.greatest(low, r - sum((p[d] * y[d] for d in range(len(DOMAINS))), F.lit(0.0)))
        return there if high is None else F.least(high, there)

    return F.aggregate(given, F.lit(1.0), moved)


class Fit(NamedTuple):
    steps: list[list[float]]
    goal: np.ndarray  # of each domain, over all words
    got: np.ndarray
    met: bool  # whether the totals are the targets


def goals(have: np.ndarray, targets: dict[str, float], budget: float, most: float | None, most_bad: float | None = None) -> np.ndarray:
    """Words of each domain: its target's share of the budget and, if most is given, no more than that many times what
    it has (most_bad for all but clean). What a scarce domain can't give makes the mix smaller; no other is raised for it."""
    want = np.array([targets[d] for d in DOMAINS], float) * budget
    if most is None:
        return want
    limit = np.array([most if d == "clean" or most_bad is None else most_bad for d in DOMAINS])
    return np.minimum(want, np.where(have > 1e-12, have * limit, 0.0))


def fit_rates(scored: DataFrame, targets: dict[str, float], budget: float = 1.0, most: float | None = None, most_bad: float | None = None, words: str = "mix_words", p: str = "mix_p", bounds: Bounds | None = None) -> Fit:
    """Steps whose fold meets the targets over a written table with words and posteriors. budget: words of the mix over
    words there are. most: how often a domain may be repeated on the whole. Within bounds the Gram matrix is that of all
    documents, with which a step never takes the totals further off."""
    k, r = len(DOMAINS), F.col(rate_name := fresh([words, p], "mix_rate"))
    share, n = F.col(p), F.col(words).cast("double")
    sums = [F.sum(n), *[F.sum(n * r * share[a]) for a in range(k)], *[F.sum(F.when(r > 0 if bounds is None else F.lit(True), n * share[a] * share[b])) for a in range(k) for b in range(k)]]

    def totals(steps: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        got = np.array([x or 0.0 for x in scored.withColumn(rate_name, rate(share, steps, bounds)).agg(*sums).first()])
        return got[0], got[1 : 1 + k] / max(got[0], 1), got[1 + k :].reshape(k, k) / max(got[0], 1)

    total, have, gram = totals([])
    if not total:
        return Fit([], np.zeros(k), np.zeros(k), False)
    goal, steps, left = goals(have, targets, budget, most, most_bad), [], np.inf
    ridge = 1e-9 if bounds is None else RIDGE
    while np.abs(miss := have - goal).max() > ENOUGH and len(steps) < STEPS:
        step = np.linalg.pinv(gram + ridge * np.eye(k)) @ miss
        if bounds is not None and miss @ step > (1 - STALL) * left:
            break
        left = miss @ step
        steps.append(step.tolist())
        _, have, gram = totals(steps)
    want = np.array([targets[d] for d in DOMAINS], float) * budget
    return Fit(steps, goal, have, bool(np.abs(have - want).max() <= 10 * ENOUGH))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, n_words, p_clean, p_junk, p_toxic, rate, target_met of every document."""
    model = train(docs, labels, max_docs)
    small = with_posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "mix_words", "mix_p")
    scored = written(small, "posteriors")
    fit_ = fit_rates(scored, targets)
    return scored.select("doc_id", F.col("mix_words").alias("n_words"), *[F.col("mix_p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate(F.col("mix_p"), fit_.steps).alias("rate"), F.lit(fit_.met).alias("target_met"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = 1.0, most: float | None = None, seed: int = 7, most_bad: float | None = None, bounds: Bounds | None = None) -> DataFrame:
    """docs, each row as often as its rate says: floor(rate) times, and once more for those whose hash of (doc_id,
    text) falls below the rest of the rate."""
    columns = docs.columns
    words, p, many, which = (fresh(columns, n) for n in ("mix_words", "mix_p", "mix_copies", "mix_copy"))
    scored = written(with_posteriors(docs, train(docs, labels), words, p), "posteriors")
    r = rate(F.col(p), fit_rates(scored, targets, budget, most, most_bad, words, p, bounds).steps, bounds)
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = F.floor(r) + (uniform < r - F.floor(r)).cast("int")
    dealt = scored.withColumn(many, copies.cast("int")).filter(F.col(many) > 0)
    return dealt.withColumn(which, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*columns)

"""Toxicity scoring by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts of the training fold; the unlabelled sample
is drawn from the fold without its labels.  A linear numpy classifier over word
and word-prefix features minimises the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

and steps back along the negative part when it falls below zero, so the model
cannot overfit by calling every unlabelled text clean.  Scoring is a sum of
per-word weights over the distinct words of the whole text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .shingles import give_back, lean

#: Bounds of the training sample, taken in order of a hash of the id.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 9_000
BITS, PREFIXES, MAX_FEATURES = 20, (4, 5, 6), 4_096
#: A feature is considered if this many positives have it, and this many times the share of unlabelled rows.
MIN_ROWS, RATIO = 3, 2.5
_PUNCTUATION = str.maketrans({c: " " for c in string.punctuation})


def _words(text: str | None) -> set[bytes]:
    return set(text.lower().translate(_PUNCTUATION).encode("utf-8", "surrogatepass").split()) if text else set()


def word_features(word: bytes) -> list[int]:
    """Hashed features: the word itself and its prefixes (inflected forms share these)."""
    text = word.decode("utf-8", "replace")
    keys = [b"w" + word] + [b"p" + text[:n].encode("utf-8", "replace") for n in PREFIXES if len(text) >= n]
    return [xxhash.xxh64_intdigest(k) >> (64 - BITS) for k in keys]


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = []
        for t in batch.column(1):
            out: list[int] = []
            for w in _words(t.as_py()):
                f = memo.get(w)
                if f is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    f = memo[w] = word_features(w)
                out += f
            rows.append(np.asarray(out, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "features"])


@dataclass
class Model:
    """Weights of the selected features, bias and the class prior."""

    weights: dict[int, float]
    bias: float
    prior: float


def _select(feature: np.ndarray, p_rows: np.ndarray, u_rows: np.ndarray, n_pos: int, n_unl: int, tested: int) -> np.ndarray:
    """Features whose document rate among positives exceeds that of the unlabelled sample beyond chance."""
    p, u = p_rows / n_pos, np.clip(u_rows / n_unl, 0.5 / n_unl, 1 - 0.5 / n_unl)
    kl = p * np.log(np.maximum(p, 1e-12) / u) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - u))
    gain = np.where((p_rows >= MIN_ROWS) & (p > RATIO * u), 2 * n_pos * kl, 0)  # likelihood ratio against the unlabelled rate
    best = np.lexsort((feature, -gain))[:MAX_FEATURES]
    return np.sort(feature[best[gain[best] > 2 * np.log(max(tested, 2)) + 4]])


@dataclass
class Sample:
    """Rows of one kind: which chosen feature (col) occurs in which row, one entry an occurrence."""

    row: np.ndarray
    col: np.ndarray
    n: int

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + b

    def gradient(self, d: np.ndarray, size: int) -> np.ndarray:
        return np.append(np.bincount(self.col, d[self.row], size), d.sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pu_risk(w: np.ndarray, b: float, pos: Sample, unl: Sample, prior: float) -> tuple[float, float]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-), under the logistic loss."""
    gp, gu = pos.scores(w, b), unl.scores(w, b)
    return prior * np.logaddexp(0, -gp).mean(), np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()


def pu_gradient(w: np.ndarray, b: float, pos: Sample, unl: Sample, prior: float) -> np.ndarray:
    """Direction of the corrected risk over (w, b): of the whole risk, or away from a negative part below zero."""
    gp, gu = pos.scores(w, b), unl.scores(w, b)
    minus = unl.gradient(_sigmoid(gu) / unl.n, len(w)) - prior * pos.gradient(_sigmoid(gp) / pos.n, len(w))
    if pu_risk(w, b, pos, unl, prior)[1] < 0:
        return -minus
    return prior * pos.gradient(-_sigmoid(-gp) / pos.n, len(w)) + minus


def constant(prior: float) -> Model:
    """What is left without both kinds of labels: nearly 0 where none is toxic, nearly 1 where all are."""
    return Model({}, float(np.clip(np.log(max(prior, 1e-12) / max(1 - prior, 1e-12)), -20, 20)), prior)


def fit(chosen: np.ndarray, pos: Sample, unl: Sample, prior: float, rounds: int = 600, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Non-negative PU fit with logistic loss and full-batch Adam; deterministic."""
    w, b, m, v = np.zeros(len(chosen)), -2.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        g = pu_gradient(w, b, pos, unl, prior)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    b += _shift(pos.scores(w, b), unl.scores(w, b), prior)
    return Model({int(k): float(x) for k, x in zip(chosen, w, strict=True)}, float(b), prior)


def _shift(gp: np.ndarray, gu: np.ndarray, prior: float, precision: float = 0.98, at: float = 0.7) -> float:
    """Calibration from positives, unlabelled rows and the prior alone.

    The precision of a cut c is estimated as prior * share of positives above c
    over share of unlabelled rows above c; the lowest cut from which on it holds
    becomes the log-odds of ``at``.
    """
    cuts = np.unique(gp)[::-1]
    above = lambda g: 1 - np.searchsorted(np.sort(g), cuts - 1e-9) / len(g)
    good = prior * above(gp) >= precision * np.maximum(above(gu), 1 / len(gu))
    n = len(good) if good.all() else int(np.argmin(good))
    while n and above(gp)[n - 1] < 0.02:
        n -= 1
    return float(np.clip(np.log(at / (1 - at)) - cuts[n - 1], -3, 3)) if n else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most max_positive + max_unlabelled rows of the fold crc32(id) mod 3 <> 1.

    The class prior is the share of toxic labels in the whole fold.  Null
    labels and null ids are left out.  With labels of one class only the score
    is constant.
    """
    ship_package(docs.sparkSession)
    fold = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).filter("_id is not null and _toxic is not null and crc32(cast(_id as string)) % 3 <> 1")
    n, toxic = fold.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if not n or not toxic or toxic == n:
        return constant(toxic / n if n else 0.0)
    order = F.xxhash64("_id")
    positive = fold.filter("_toxic = 1").orderBy(order).limit(max_positive).withColumn("_toxic", F.lit(1))
    unlabelled = fold.orderBy(order).limit(max_unlabelled).withColumn("_toxic", F.lit(0))  # drawn from all rows, labels dropped
    sample = F.broadcast(positive.unionByName(unlabelled))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(sample, "_id").select("_toxic", "_t")
    rows = materialise(texts.mapInArrow(lean(_featurise), "toxic int, features array<int>").withColumn("row", F.monotonically_increasing_id()), "tox-features")
    size = {r[0]: r[1] for r in rows.groupBy("toxic").agg(F.count(F.lit(1))).collect()}
    n_pos, n_unl = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_unl:
        return constant(0.0)
    # texts stay on the executors: the driver gets row counts of features (at most 2 ** BITS), then entries of the chosen ones
    seen = rows.select("toxic", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u")).filter(F.col("p") >= MIN_ROWS)
    held = materialise(seen, "tox-counts")
    found = held.filter(F.col("p") * n_unl > RATIO * F.col("u") * n_pos).orderBy("f").collect()
    feature, p_rows, u_rows = (np.array([r[c] for r in found], np.int64) for c in ("f", "p", "u"))
    chosen = _select(feature, p_rows, u_rows, n_pos, n_unl, held.count()) if found else feature
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(f), k) for k, f in enumerate(chosen)], "f int, col int"))
    entries = rows.select("toxic", "row", F.explode("features").alias("f")).join(wanted, "f").select("toxic", "row", "col").toArrow()
    kind, row, col = (entries.column(c).to_numpy() for c in ("toxic", "row", "col"))

    def part(k: int, n: int) -> Sample:
        at = np.lexsort((col[kind == k], row[kind == k]))
        return Sample(np.unique(row[kind == k][at], return_inverse=True)[1], col[kind == k][at], n)

    model = fit(chosen, part(1, n_pos), part(0, n_unl), toxic / n)
    del entries, kind, row, col
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; a null or empty text has the score of no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, memo = sent.value.weights, sent.value.bias, {}
        for batch in batches:
            out = []
            for t in batch.column(1):
                total = bias
                for w in _words(t.as_py()):
                    x = memo.get(w)
                    if x is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        x = memo[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                    total += x
                out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.asarray(out, float), -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(lean(run), "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **names: str) -> DataFrame:
    """Per input row: doc_id, held_out (never learned from), score, predicted (1 if score >= threshold).

    Null ids count as not held out and never take part in training; rows that
    repeat an id share its label.  Label tables that are empty or have no toxic
    row give a constant score close to 0, those with toxic rows only one close
    to 1; empty document tables give no rows.  Ids are integers; further
    columns are ignored.
    """
    scored = score(docs, train(docs, labels, **names), **{k: v for k, v in names.items() if k != "label_col"})
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold.

    A null text scores as an empty one; ids only link labels, so null and
    repeated ids change nothing.  Empty tables stay empty.
    """
    model = train(docs, labels, id_col, text_col)
    spark, schema = docs.sparkSession, docs.schema
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, memo = sent.value.weights, sent.value.bias, {}
        for batch in batches:
            keep = []
            for t in batch.column(at):
                total = bias
                for w in _words(t.as_py()):
                    x = memo.get(w)
                    if x is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        x = memo[w] = sum(weights.get(f, 0.0) for f in word_features(w))
                    total += x
                keep.append(total < limit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), schema)

"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features are indicators of the byte n-grams (n = 1, 2, 3) of the whole text,
letter case kept, hashed into 2**`bits` columns, and of runs of 2, 3 and 4 equal
words. Each indicator is scaled by the
log ratio of its (smoothed) frequencies in the two classes; a linear model with
hinge loss is fitted to the scaled indicators by dual coordinate descent, and a
logistic curve, fitted on margins of held-back training rows, turns margins into
scores from 0 to 1.

Training takes labelled rows only, at most `train_rows` (a bounded sample: those
with the smallest hash of their id), so what reaches the driver is bounded by
train_rows rows of at most 2**bits indices. Scoring is one pass over whole texts, no shuffle.

Cases: a null text counts as empty and is scored; null labels are not learned
from; several labels of one id are averaged and a tie counts as 1; with one class
only, or no label at all, every score is the smoothed share of class 1. Repeated
rows are scored each; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import held_out, text_of, without


#: Runs of 2 to RUNS + 1 equal words have columns of their own, after those of the byte n-grams.
RUNS = 3


def grams(text: str, bits: int = 18) -> np.ndarray:
    """Sorted columns of the n-grams that occur anywhere in the text."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = []
    for n in (1, 2, 3):
        if len(b) >= n:
            code = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(257) + b[k : len(b) - n + 1 + k]
            code *= np.uint32(2654435761)
            out.append(code >> np.uint32(32 - bits))
    seen = np.zeros((1 << bits) + RUNS, bool)
    for c in out:
        seen[c] = True
    w = text.split()
    same = bytes(map(eq, w, w[1:]))
    for n in range(1, RUNS + 1):
        seen[-n] = b"\1" * n in same
    return np.flatnonzero(seen)


@dataclass
class Linear:
    """score = 1 / (1 + exp(-(slope * (bias + sum of weights) + shift)))"""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def score(self, text: str) -> float:
        m = self.bias + float(self.weights[grams(text, self.bits)].sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -500, 500))))


def fit_svm(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty by dual coordinate descent; rows hold the columns whose scaled value is r[column]."""
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    norm = np.array([float((r[x] ** 2).sum()) + 1.0 for x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, s = rows[i], y[i]
            g = s * (float(w[x] @ r[x]) + bias) - 1
            old = alpha[i]
            alpha[i] = min(max(old - g / norm[i], 0.0), c)
            if step := (alpha[i] - old) * s:
                w[x] += step * r[x]
                bias += step
                worst = max(worst, abs(step) * np.sqrt(norm[i]))
        if worst < 1e-3:
            break
    return w, bias


def fit_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int = 18, smooth: float = 1.0, c: float = 0.1) -> Linear:
    """The model from feature columns and 0/1 labels."""
    label = np.asarray(label)
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        return Linear(np.zeros((1 << bits) + RUNS), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    counts = np.full((2, (1 << bits) + RUNS), smooth)
    for x, k in zip(rows, label, strict=True):
        counts[int(k), x] += 1
    p = counts / np.array([[(label == 0).sum() + 2 * smooth], [(label == 1).sum() + 2 * smooth]])
    r = np.log(p[1]) - np.log(p[0])
    y = np.where(label > 0, 1.0, -1.0)
    # the curve is fitted on margins of rows that the model behind them has not seen
    fold = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        own = np.flatnonzero(fold != k)
        if len(set(y[own])) < 2:
            continue
        w, b = fit_svm([rows[i] for i in own], r, y[own], c, epochs=6)
        for i in np.flatnonzero(fold == k):
            margin[i] = b + w[rows[i]] @ r[rows[i]]
    slope, shift = fit_curve(margin, y)
    w, b = fit_svm(rows, r, y, c)
    return Linear(w * r, b, slope, shift, bits)


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, train_rows: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most train_rows labelled rows outside the held-out fold."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.filter(~held_out("id")).withColumn("_qm_r", F.xxhash64("id")).orderBy("_qm_r", "id").limit(train_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series([grams(t, bits).astype("<i4").tobytes() for t in x])

    taken = texts.join(F.broadcast(known.select("id", "label")), "id").dropDuplicates(["id"])  # at most train_rows ids
    got = taken.select("id", "label", F.pandas_udf(run, "binary")("text").alias("x")).toPandas().sort_values("id")
    return [np.frombuffer(x, "<i4").astype(np.int64) for x in got["x"]], got["label"].to_numpy()


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, train_rows: int = 6000, bits: int = 18) -> DataFrame:
    """docs with held_out, score and predicted added."""
    model = fit(*labelled_features(docs, labels, label_col, id_col, text_col, train_rows, bits), bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights

    def run(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield pd.Series([shared.value.score(t) for t in x], dtype="float64")

    return (
        without(docs, ["held_out", "score", "predicted"])
        .withColumn("held_out", held_out(id_col))
        .withColumn("score", F.pandas_udf(run, "double")(text_of(text_col)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )

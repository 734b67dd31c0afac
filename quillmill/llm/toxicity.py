"""Toxicity: non-negative positive-unlabelled learning with numpy classifiers.

Confirmed toxic examples are the positives; all documents outside the held-out
fold, whatever their label, are the unlabelled mixture in which toxic texts hide
with class prior `prior`. A linear model on features of a text minimises the
corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss, by mini-batches; where the bracket of a batch falls below
zero its gradient is turned round, so that the classifier does not fit the positives
hidden in the mixture as negatives. Without a given prior it is the share of toxic
rows among those labelled outside the held-out fold. All weights start at zero; in
the end the bias is set where the corrected risk, with the share of rows on the wrong
side as loss, is least on the training rows.

Features of a whole text, hashed: its words in lower case without outer punctuation,
their beginnings of 3 to 8 and endings of 3 to 6 bytes, each at three levels (it
occurs; twice or more and in 1 of 200 words; in 1 of 60), and pairs of neighbouring
words. The vocabulary are those that two positives have, the `size` most common
at most. A feature's value is the log ratio of the positives that have it and those
expected from its share of the mixture, which is counted over all documents.

Bounded samples: at most `train_rows` positives and as many rows of the mixture for
the gradient steps (smallest hash of the id), and of these at most `cells` features
in all. Scoring is one pass over whole texts with no shuffle.

Cases: a null text counts as empty and is scored by the bias alone; null labels
count as unlabelled; an id labelled toxic anywhere is a positive; without any
positive every score is 0. Repeated rows are scored each; clashing input columns
are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Stash, held_out, least_hashed, text_of, without

OUTER = string.punctuation.encode()
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
BITS = 22
MASK = (1 << BITS) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word's beginnings and endings.
BEGIN, FINISH = (3, 4, 5, 6, 7, 8), (3, 4, 5, 6)
#: A feature that fills at least 1 of so many words of a text, twice or more, is at that level.
LEVELS = (200, 60)
PAIR = len(LEVELS) + 1  # the level of pairs


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_features(words: list[bytes]) -> np.ndarray:
    """Hashes of each word without outer punctuation (first column), of its beginnings and endings; -1 where it is too short."""
    cores = [w.strip(OUTER) or w for w in words]
    size = np.array([len(c) for c in cores], np.int64)
    flat = np.frombuffer(b"".join(cores), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    powers = np.cumprod(np.full(int(size.max(initial=1)), STEP, np.uint64))
    out = np.full((len(words), 1 + len(BEGIN) + len(FINISH)), -1, np.int64)
    place = np.arange(len(flat)) - np.repeat(start, size)
    if len(flat):
        out[:, 0] = _mixed(np.add.reduceat((flat + np.uint64(1)) * powers[place], start))
    for first, lengths, step in ((1, BEGIN, 1), (1 + len(BEGIN), FINISH, -1)):
        h = np.full(len(words), first * 7919, np.uint64)
        for k in range(1, lengths[-1] + 1):
            own = np.flatnonzero(size >= k)
            at = start[own] + k - 1 if step > 0 else end[own] - k
            h[own] = h[own] * STEP + flat[at] + np.uint64(1)
            if k in lengths:
                out[own, first + lengths.index(k)] = _mixed(h[own])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(MASK)).astype(np.int64)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with place for n elements at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


class Vocabulary:
    """Places of features in the sorted `keys` (level << BITS | hash), looked up a batch of texts at a time."""

    def __init__(self, keys: np.ndarray, room: int = 200_000):
        self.keys, self.room = np.sort(keys), room
        level, low = self.keys >> BITS, self.keys & MASK
        base = np.flatnonzero(level == 0)
        self.base = np.full((1 << BITS) + 1, -1, np.int32)  # the last one is what a short word lacks
        self.base[low[base]] = base
        self.raised = []
        for n in range(1, PAIR):
            at = np.full(len(self.keys), -1)
            own = np.flatnonzero(level == n)
            at[self.base[low[own]]] = own
            self.raised.append(at)
        self.pairs = np.full(1 << BITS, -1, np.int32)
        own = np.flatnonzero(level == PAIR)
        self.pairs[low[own]] = own
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash, self.flat, self.ends = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int64), np.zeros((1 << 16) + 1, np.int64)

    def add(self, words: list[bytes]) -> None:
        hashes = word_features(words)
        found = self.base[hashes]
        count, flat = (found >= 0).sum(axis=1), found[found >= 0]
        n, m = len(self.place), len(words)
        used = int(self.ends[n])
        self.hash, self.ends, self.flat = _room(self.hash, n + m), _room(self.ends, n + m + 1), _room(self.flat, used + len(flat))
        self.hash[n : n + m] = hashes[:, 0]
        self.ends[n + 1 : n + m + 1] = used + np.cumsum(count)
        self.flat[used : used + len(flat)] = flat
        self.place.update(zip(words, range(n, n + m), strict=True))

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of every feature that a text has, by text."""
        words = [split_words(t) for t in texts]
        flat = [w for t in words for w in t]
        if len(self.place) > self.room:
            self.forget()
        if new := set(flat).difference(self.place):
            self.add(list(new))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        size = np.array([len(t) for t in words], np.int64)
        text = np.repeat(np.arange(len(texts)), size)
        ends, n = self.ends, max(1, len(self.keys))
        count = ends[at + 1] - ends[at]
        to = np.cumsum(count)
        index = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(ends[at] - to + count, count)
        code, times = np.unique(np.repeat(text, count) * n + self.flat[index], return_counts=True)
        found = [code]
        for least, raised in zip(LEVELS, self.raised, strict=True):
            own = code[(times >= 2) & (times * least >= size[code // n])]
            up = raised[own % n]
            found.append((own // n * n + up)[up >= 0])
        pair = self.pairs[pairs_of(self.hash[at])]
        own = (pair >= 0) & (text[1:] == text[:-1])
        found.append(np.unique(text[1:][own] * n + pair[own]))
        code = np.sort(np.concatenate(found))
        return code // n, code % n


def pairs_of(h: np.ndarray) -> np.ndarray:
    return (h[:-1] * 2654435761 + h[1:]) & MASK


def all_features(text: str) -> np.ndarray:
    """Keys of all features of a text, whatever the vocabulary; slow, for the positives."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.int64)
    own = word_features(words)
    base, times = np.unique(own[own >= 0], return_counts=True)
    raised = [base[(times >= 2) & (times * least >= len(words))] | (n << BITS) for n, least in enumerate(LEVELS, 1)]
    return np.concatenate([base, *raised, np.unique(pairs_of(own[:, 0])) | (PAIR << BITS)])


@dataclass
class Toxic:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the text's features)))"""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, vocabulary: Vocabulary, texts: list[str]) -> np.ndarray:
        text, place = vocabulary.features(texts)
        f = self.bias + np.bincount(text, self.weights[place], len(texts)) if len(place) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def values(positive: np.ndarray, n_positive: int, mixture: np.ndarray, n_mixture: int) -> np.ndarray:
    """How far the positives that have a feature are from those expected by the mixture: half the log ratio, one added to each."""
    expected = (mixture + 0.5) / (n_mixture + 1) * n_positive
    return np.abs(np.log((positive + 1) / (expected + 1))) / 2


def fit(positive: list[np.ndarray], mixture: list[np.ndarray], value: np.ndarray, prior: float, epochs: int = 20, least_steps: int = 400, batch: int = 512, rate: float = 0.05, l2: float = 3e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by non-negative risk descent (Adam over mini-batches of both samples)."""
    k = len(value)
    x, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    batches = max(1, (len(positive) + len(mixture)) // batch)
    steps = max(epochs * batches, least_steps) if epochs and positive and mixture else 0
    rng = np.random.default_rng(seed)

    def deal(n: int) -> Iterator[np.ndarray]:
        """Shuffled rows in parts of a batch's share, 32 at least, over and over."""
        size = min(n, max(32, n // batches))
        while True:
            order = rng.permutation(n)
            for a in range(0, n - size + 1, size):
                yield order[a : a + size]

    def risks(rows: list[np.ndarray]) -> tuple:
        col = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        f = np.bincount(row, (x[:k] * value)[col], len(rows)) + x[k]
        return col, row, np.clip(f, -50, 50)

    own_p, own_u = deal(len(positive)), deal(len(mixture))
    for t in range(1, steps + 1):
        cp, rp, fp = risks([positive[i] for i in next(own_p)])
        cu, ru, fu = risks([mixture[i] for i in next(own_u)])
        up, away, rest = -1 / (1 + np.exp(fp)), 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        if np.logaddexp(0, fu).mean() >= prior * np.logaddexp(0, fp).mean():
            gp, gu = prior * (up - away) / len(fp), rest / len(fu)
        else:  # turned round
            gp, gu = prior * away / len(fp), -rest / len(fu)
        grad = np.append((np.bincount(cp, gp[rp], k) + np.bincount(cu, gu[ru], k)) * value, gp.sum() + gu.sum())
        grad[:k] += l2 * x[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    if not steps:
        return x[:k] * value, 0.0
    weights = x[:k] * value
    margin = lambda rows: np.array([weights[r].sum() for r in rows])
    return weights, best_bias(margin(positive), margin(mixture), prior)


def best_bias(positive: np.ndarray, mixture: np.ndarray, prior: float) -> float:
    """Where the corrected risk is least when a loss is the share of rows on the wrong side (the highest cut of equal ones)."""
    cuts = np.unique(np.concatenate([positive, mixture]))
    lost = np.searchsorted(np.sort(positive), cuts) / len(positive)
    told = 1 - np.searchsorted(np.sort(mixture), cuts) / len(mixture)
    risk = prior * lost + np.maximum(0, told - prior * (1 - lost))
    at = len(cuts) - 1 - int(np.argmin(risk[::-1]))
    return -float((cuts[at] + cuts[max(0, at - 1)]) / 2)


def _within(rows: list[tuple[int, int]], cells: int) -> set[int]:
    """Ids taken in the order given while their features are no more than `cells`."""
    out, n = set(), 0
    for i, size in rows:
        n += size
        if n > cells:
            break
        out.add(i)
    return out


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, prior: float | None, train_rows: int, size: int, cells: int, epochs: int) -> Toxic:
    """The model from labels outside the held-out fold and all documents there."""
    stash = Stash(docs.sparkSession, "toxicity")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = stash.keep(known.filter(~held_out("id")), "known")
    if prior is None:
        share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
        prior = min(max(share or 0.0, 1e-4), 0.9)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).filter(~held_out("id"))

    def sampled(ids: DataFrame, name: str) -> DataFrame:
        own = least_hashed(ids.filter(F.col("id").isNotNull()).select("id"), "id", train_rows)
        return stash.keep(texts.join(F.broadcast(own), "id").dropDuplicates(["id"]), name)  # at most train_rows ids

    positive, mixture = sampled(known.filter("label = 1"), "positive"), sampled(texts, "mixture")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 50):
                key, n = np.unique(np.concatenate([all_features(t) for t in b["text"].iloc[k : k + 50]]), return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

    told = positive.mapInPandas(tell, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 2")
    told = told.orderBy(F.desc("n"), "key").limit(size).toArrow()  # at most `size` numbers
    keys = told["key"].to_numpy().astype(np.int64)
    # levels need the feature they are a level of
    bare = np.isin(keys & MASK, keys[keys <= MASK]) | (keys >> BITS == PAIR)
    keys = np.sort(keys[bare])
    if not len(keys):
        return Toxic(keys, np.zeros(0), -500.0)
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, seen = Vocabulary(shared.value), np.zeros(len(shared.value), np.int64)
        rows = 0
        for b in batches:
            for k in range(0, len(b), 200):
                seen += np.bincount(vocabulary.features(b["text"].iloc[k : k + 200].tolist())[1], minlength=len(seen))
            rows += len(b)
        yield pd.DataFrame({"k": np.append(np.flatnonzero(seen), -1), "n": np.append(seen[seen > 0], rows)})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(shared.value)
        for b in batches:
            for k in range(0, len(b), 200):
                own = b.iloc[k : k + 200]
                text, place = vocabulary.features(own["text"].tolist())
                cut = np.searchsorted(text, np.arange(len(own) + 1))
                x = [place[i:j].astype("<i4").tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pd.DataFrame({"id": own["id"].to_numpy(), "x": x})

    got = texts.select("text").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = got["k"].to_numpy(), got["n"].to_numpy()
    in_mixture, total = np.zeros(len(keys), np.int64), int(n[k < 0].sum())
    in_mixture[k[k >= 0]] = n[k >= 0]

    kind = dict(texts.dtypes)["id"]

    def rows(own: DataFrame, name: str) -> list[np.ndarray]:
        kept = stash.keep(own.select("id", "text").mapInPandas(places, f"id {kind}, x binary"), name).withColumn("_qm_h", F.xxhash64("id"))
        sizes = kept.select("_qm_h", (F.length("x") / 4).cast("long").alias("n")).toPandas().sort_values(["_qm_h"])
        fits = _within(list(zip(sizes["_qm_h"].tolist(), sizes["n"].tolist(), strict=True)), cells)
        if len(fits) < len(sizes):
            kept = kept.filter(F.col("_qm_h") <= max(fits, default=-(1 << 63)))
        return [np.frombuffer(x, "<i4") for x in kept.orderBy("_qm_h").toPandas()["x"]]

    pos, mix = rows(positive, "positive_rows"), rows(mixture, "mixture_rows")
    in_positive = np.bincount(np.concatenate([*pos, np.zeros(0, np.int32)]), minlength=len(keys))
    weights, bias = fit(pos, mix, values(in_positive, len(pos), in_mixture, total), prior, epochs)
    for name in ("known", "positive", "mixture", "positive_rows", "mixture_rows"):
        stash.drop(name)
    return Toxic(keys, weights, bias)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: float | None = None,
    threshold: float = 0.5,
    train_rows: int = 6000,
    size: int = 1 << 16,
    cells: int = 1 << 23,
    epochs: int = 20,
) -> DataFrame:
    """docs with held_out, score and predicted added."""
    model = learn(docs, labels, label_col, id_col, text_col, prior, train_rows, size, cells, epochs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `size` keys and weights

    def score(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        vocabulary = Vocabulary(model.keys)
        for x in s:
            own = [model.scores(vocabulary, x.iloc[k : k + 200].tolist()) for k in range(0, len(x), 200)]
            yield pd.Series(np.concatenate([*own, np.zeros(0)]), dtype="float64")

    return (
        without(docs, ["held_out", "score", "predicted"])
        .withColumn("held_out", held_out(id_col))
        .withColumn("score", F.pandas_udf(score, "double")(text_of(text_col)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )

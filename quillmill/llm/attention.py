"""A small causal self-attention model of token classes, in numpy.

The model predicts the class of the next token from the tokens before it: one
attention layer over overlapping windows of two blocks (the block a token is in and
the one before), whose output is added to the log probabilities of the classes after
the token before (`prior`, from corpus counts). Tokens come in as ids; `Maps` says
which row of the embedding, which row of the prior and which class an id has.
Tokens within a class follow corpus counts (`lm.Tables`), so probabilities of the
tokens sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NAMES = ("embed", "query", "key", "value", "near", "out")


@dataclass
class Shape:
    classes: int
    inputs: int
    width: int = 16
    block: int = 8

    def sizes(self) -> list[tuple[int, ...]]:
        d = self.width
        return [(self.inputs + 2, d), (d, d), (d, d), (d, d), (2 * self.block,), (d, self.classes)]


@dataclass
class Maps:
    """Row of the embedding (`seen`), row of the prior (`after`) and class (`cls`) of each id; two ids more stand for what is before a text and for nothing."""

    seen: np.ndarray
    after: np.ndarray
    cls: np.ndarray

    @classmethod
    def of(cls, seen: np.ndarray, inputs: int, after: np.ndarray, groups: int, classes: np.ndarray) -> Maps:
        return cls(np.append(seen, [inputs, inputs + 1]).astype(np.intp), np.append(after, [groups, groups]).astype(np.int32), np.append(classes, [-1, -1]).astype(np.intp))

    @property
    def start(self) -> int:
        return len(self.cls) - 2

    @property
    def pad(self) -> int:
        return len(self.cls) - 1


def initial(shape: Shape, seed: int = 3) -> np.ndarray:
    """All parameters in one vector; the output layer is zero, so training starts from the prior."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3, s) for s in shape.sizes()[:4]] + [np.zeros(s) for s in shape.sizes()[4:]]
    return np.concatenate([p.ravel() for p in parts])


def split(vector: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, s in zip(NAMES, shape.sizes(), strict=True):
        n = int(np.prod(s))
        out[name] = vector[at : at + n].reshape(s)
        at += n
    return out


def windows(ids: np.ndarray, shape: Shape, maps: Maps, first: int = 0, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of one text as ids, a row a block: the block before it and its own inputs, and what comes after each of those; past the end is pad. Of all rows every `every`-th, from `first` on."""
    s, n = shape.block, len(ids)
    rows = -(-n // s)
    line = np.full((rows + 1) * s, maps.pad, np.int32)
    line[s] = maps.start
    line[s + 1 : s + n] = ids[:-1]
    target = np.full(rows * s, maps.pad, np.int32)
    target[:n] = ids
    blocks = line.reshape(-1, s)
    return np.concatenate([blocks[first:-1:every], blocks[first + 1 :: every]], axis=1), target.reshape(-1, s)[first::every]


def distances(shape: Shape) -> np.ndarray:
    """How far each context place of a window is behind each place of its last block; negative: ahead, masked."""
    s = shape.block
    return (np.arange(s)[:, None] + s) - np.arange(2 * s)[None, :]


class Scorer:
    """log probabilities of classes; every token is scored once, with at least a block of context where there is one."""

    def __init__(self, vector: np.ndarray, prior: np.ndarray, shape: Shape, maps: Maps):
        p = split(vector.astype(np.float32), shape)
        self.shape, self.maps = shape, maps
        scores = (p["embed"] @ p["query"]) @ (p["embed"] @ p["key"]).T / np.float32(np.sqrt(shape.width))
        weights = np.exp(scores)  # a score depends on the two inputs only
        weights[:, shape.inputs + 1] = 0
        self.weights, self.side = weights.ravel(), weights.shape[0]
        dist = distances(shape)
        self.near = np.where(dist >= 0, np.exp(p["near"][np.maximum(dist, 0)]), 0).astype(np.float32)
        self.value = _with_ones(p["embed"] @ p["value"])
        self.out = p["out"]
        self.prior = np.exp(prior).astype(np.float32)

    def log_classes(self, context: np.ndarray, target: np.ndarray, step: int = 256) -> np.ndarray:
        """Natural log probability of the class of each target; 0 at pads."""
        got = np.empty(target.shape, np.float32)
        s, ones = self.shape.block, np.ones(self.shape.classes, np.float32)
        for k in range(0, len(context), step):
            ids = context[k : k + step]
            c, t = np.take(self.maps.seen, ids), np.take(self.maps.cls, target[k : k + step].ravel())
            w = np.take(self.weights, (c[:, s:] * self.side)[:, :, None] + c[:, None, :], mode="clip")
            w *= self.near
            o = np.matmul(w, np.take(self.value, c, axis=0, mode="clip")).reshape(-1, self.shape.width + 1)
            odds = (o[:, :-1] / np.maximum(o[:, -1:], np.float32(1e-30))) @ self.out
            np.exp(odds, out=odds)
            odds *= np.take(self.prior, np.take(self.maps.after, ids[:, s:].ravel()), axis=0, mode="clip")
            real = t >= 0
            hit = odds[np.arange(len(t)), np.where(real, t, 0)]
            got[k : k + step] = np.where(real, np.log(hit / (odds @ ones)), 0).reshape(-1, s)
        return got


def _with_ones(v: np.ndarray) -> np.ndarray:
    """Values with a column of ones, so that a product with weights gives their sum too."""
    return np.concatenate([v, np.ones((len(v), 1), v.dtype)], axis=1)


def _sum_rows(rows: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of each key from 0 to size - 1."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(key.astype(np.uint16) if size <= 1 << 16 else key, kind="stable")  # a radix sort where keys are short
    n = np.bincount(key, minlength=size)
    there = np.flatnonzero(n)
    if len(there):
        out[there] = np.add.reduceat(np.take(rows, order, axis=0), (np.cumsum(n) - n)[there], axis=0)
    return out


def gradient(vector: np.ndarray, prior: np.ndarray, shape: Shape, maps: Maps, context: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the targets' classes and its gradient."""
    p, d, s, kind = split(vector, shape), shape.width, shape.block, vector.dtype.type
    c = np.take(maps.seen, context)
    t = np.take(maps.cls, target)
    dist = distances(shape)
    # scores and values depend on inputs only: they are tables, and so are their gradients
    e, side = p["embed"], len(p["embed"])
    q, k, v = e @ p["query"], e @ p["key"], e @ p["value"]
    scale = kind(np.sqrt(d))
    pair = (c[:, s:] * side)[:, :, None] + c[:, None, :]
    table = np.exp(q @ k.T / scale)
    table[:, shape.inputs + 1] = 0
    w = np.take(table, pair, mode="clip")
    w *= np.where(dist >= 0, np.exp(p["near"][np.maximum(dist, 0)]), 0).astype(kind)
    vc = np.take(_with_ones(v), c, axis=0, mode="clip")
    o = np.matmul(w, vc).reshape(-1, d + 1)
    total = np.maximum(o[:, -1:], kind(1e-30))  # of a place's weights
    o = o[:, :-1] / total
    g = o @ p["out"]
    g += np.take(prior, np.take(maps.after, context[:, s:].ravel()), axis=0, mode="clip")
    np.exp(g, out=g)  # the prior's log probabilities are at most 0 and outputs stay small
    odds = g @ np.ones(shape.classes, kind)
    flat_t = t.ravel()
    rows = np.flatnonzero(flat_t >= 0)
    n, hit = max(1, len(rows)), flat_t[rows]
    loss = -np.log(np.maximum(g[rows, hit] / odds[rows], 1e-30)).sum() / n
    g[rows, hit] -= odds[rows]
    share = np.where(flat_t >= 0, kind(1 / n) / odds, kind(0))[:, None]  # what rows are to be multiplied by, done where they are narrow
    # weights are not divided by their sum: what comes back is, and the last column takes the mean off
    do = g @ p["out"].T
    do *= share / total
    back = np.concatenate([do, -np.einsum("ij,ij->i", o, do)[:, None]], axis=1).reshape(-1, s, d + 1)
    ds = np.matmul(back, vc.transpose(0, 2, 1))
    ds *= w
    dv = np.matmul(w.transpose(0, 2, 1), do.reshape(-1, s, d)).reshape(-1, d)
    near = np.bincount(np.maximum(dist, 0).ravel(), np.where(dist >= 0, ds.sum(axis=0), 0).ravel(), 2 * s)
    scores = (np.bincount(pair.ravel(), ds.ravel(), side * side) / scale).astype(kind).reshape(side, side)
    value = _sum_rows(dv, c.ravel(), side)
    dq, dk = scores @ k, scores.T @ q
    embed = dq @ p["query"].T + dk @ p["key"].T + value @ p["value"].T
    parts = [embed, e.T @ dq, e.T @ dk, e.T @ value, near, (o * share).T @ g]
    return float(loss), np.concatenate([x.ravel() for x in parts])


class Descent:
    """Adam over mini-batches of window rows; its state goes on from one call to the next."""

    def __init__(self, vector: np.ndarray, prior: np.ndarray, shape: Shape, maps: Maps, rate: float, batch: int = 256, seed: int = 1):
        self.x, self.prior, self.shape, self.maps, self.rate, self.batch = vector.copy(), prior.astype(np.float32), shape, maps, rate, batch
        self.m, self.v, self.t = np.zeros(len(vector)), np.zeros(len(vector)), 0
        self.rng = np.random.default_rng(seed)

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        """One pass over the rows, in another order."""
        order = self.rng.permutation(len(context))
        for k in range(0, len(order), self.batch):
            own = order[k : k + self.batch]
            _, g = gradient(self.x.astype(np.float32), self.prior, self.shape, self.maps, context[own], target[own])
            self.t += 1
            self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
            share = len(own) / self.batch  # a small last batch moves little
            self.x -= self.rate * share * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)

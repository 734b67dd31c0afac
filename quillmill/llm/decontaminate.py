"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

Test items go through the corpus in blocks of at most `block_words` words, so what
is broadcast is bounded whatever the size of the benchmark (a stated query set
against all rows). A document leaks an item when the best local alignment (match
+1, mismatch and gap -0.5) scores at least `threshold` of the item's m words.

Nothing that scores as much is lost. It matches at least T = threshold * m places of
the item, so it matches one of any m - T + 1 places: those of the words that fewest
documents hold are the item's seeds (pass one counts documents by word). No longer
n-gram has such a bound, as a word put in after every word leaves none. Pass two
looks the seeds up in the whole text of each document. An item met there must
share T words with the document, and is aligned over the stretches whose words
could score T if they stood in the item's order (+1 for a word of the item, -0.5
for another), all pairs of a batch at once in numpy. Nothing is shuffled but word
counts.

Cases: null texts count as empty. An item with fewer than `n` words is met by chance in
clean text, so it is not looked for unless `short` is set, and then only as it stands,
word by word; `not_checked` names the items that are left out. Items without words can
not leak. Repeated items are reported each; repeated documents too.
Empty tables give empty results. Clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, text_of, without

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MATCH, MISS = 1.0, -0.5


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


@dataclass
class Items:
    """A block of test items over their own vocabulary."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in split_words(text)], np.int64)


def index_items(rows: list[tuple[object, str]], n: int = 3, short: bool = False) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, words = [], []
    for item, text in rows:
        w = split_words(text or "")
        if not w or (len(w) < n and not short):
            continue
        ids.append(item)
        words.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64))
    return Items(ids, words, vocabulary)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same from start[1] on."""
    to = np.cumsum(size)
    return np.arange(int(to[-1]) if len(to) else 0) + np.repeat(start - to + size, size)


class Seeds:
    """Finds the items that a text could leak, given the number of documents that hold each word."""

    def __init__(self, items: Items, seen: np.ndarray, threshold: float, n: int = 3):
        size = len(items.vocabulary)
        self.words = items.words
        self.share = [threshold if len(w) >= n else 1.0 for w in items.words]
        self.least = np.array([max(1, int(np.ceil(t * len(w) - 1e-9))) for t, w in zip(self.share, items.words, strict=True)], np.int64)
        # all words one after the other, each with the number of equal ones before it in its item
        self.sizes = np.array([len(w) for w in items.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(items.words)
        self.again = np.zeros(len(self.flat), np.int64)
        word, item = [], []
        for i, w in enumerate(items.words):
            order = np.argsort(w, kind="stable")
            first = np.searchsorted(w[order], w[order])
            self.again[self.starts[i] + order] = np.arange(len(w)) - first
            own = np.unique(w[np.lexsort((w, seen[w]))[: max(0, len(w) - self.least[i] + 1)]])
            word.append(own)
            item.append(np.full(len(own), i))
        word, item = np.concatenate(word), np.concatenate(item)
        self.met = item[np.argsort(word, kind="stable")]
        self.met_size = np.bincount(word, minlength=size)
        self.met_start = np.cumsum(self.met_size) - self.met_size
        self.count = np.zeros(size, np.int64)
        self.is_word = np.zeros(size + 1, bool)  # the last one stands for words of no item

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Items with a seed in the text and as many words in common as the least score needs."""
        own, n = np.unique(ids[ids >= 0], return_counts=True)
        found = np.unique(self.met[_ranges(self.met_start[own], self.met_size[own])])
        if not len(found):
            return found
        self.count[own] = n
        size = self.sizes[found]
        at = _ranges(self.starts[found], size)
        common = np.add.reduceat((self.count[self.flat[at]] > self.again[at]).astype(np.int64), np.cumsum(size) - size)
        self.count[own] = 0
        return found[common >= self.least[found]]

    def stretches(self, ids: np.ndarray, i: int) -> list[tuple[int, int]]:
        """(start, end) of what holds every alignment that scores enough."""
        self.is_word[self.words[i]] = True
        total = np.append(0.0, np.cumsum(np.where(self.is_word[ids], MATCH, MISS)))
        self.is_word[self.words[i]] = False
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        inside = np.concatenate([[False], best >= self.least[i], [False]])
        cut = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True))


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each (item, window) pair, with start and end of the stretch of the window it covers."""
    score, first, last = (np.zeros(len(items), t) for t in (float, np.int64, np.int64))
    order = np.argsort([len(a) * 4096 + len(b) for a, b in zip(items, windows, strict=True)], kind="stable")
    k = 0
    while k < len(order):
        width = max(len(windows[i]) for i in order[k : k + 64])
        own = order[k : k + max(1, min(1024, 200_000 // max(1, width)))]
        k += len(own)
        m, n = max(len(items[i]) for i in own), max(len(windows[i]) for i in own)
        a, b = np.full((len(own), m), -2), np.full((len(own), n), -3)
        for r, i in enumerate(own):
            a[r, : len(items[i])], b[r, : len(windows[i])] = items[i], windows[i]
        ramp = np.arange(n) * -MISS
        h = np.zeros((len(own), n + 1))
        begin = np.broadcast_to(np.arange(n + 1), h.shape).copy()  # where the alignment that ends here began
        best, lo, hi = np.zeros(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        cols = np.arange(n)
        for row in range(m):
            diagonal = h[:, :-1] + np.where(b == a[:, row : row + 1], MATCH, MISS)
            up = h[:, 1:] + MISS
            t = np.maximum(np.maximum(diagonal, up), 0)
            source = np.where(t == 0, cols + 1, np.where(diagonal >= up, begin[:, :-1], begin[:, 1:]))
            # gaps in the item: the best earlier cell of the row, less the gap
            lifted = np.maximum.accumulate(t + ramp, axis=1)
            from_col = np.maximum.accumulate(np.where(t + ramp == lifted, cols, 0), axis=1)
            t = lifted - ramp
            h[:, 1:], begin[:, 1:] = t, np.take_along_axis(source, from_col, axis=1)
            at = t.argmax(axis=1)
            top = t[np.arange(len(own)), at]
            better = top > best
            best = np.where(better, top, best)
            lo = np.where(better, begin[np.arange(len(own)), at + 1], lo)
            hi = np.where(better, at + 1, hi)
        score[own], first[own], last[own] = best, lo, hi
    return score, first, last


def leaks_in(items: Items, seeds: Seeds, texts: list[str]) -> list[list[tuple]]:
    """Per text: (item id, score, first word, end word) of the best alignment of each leaked item."""
    pairs: list[tuple[int, int, int]] = []
    a, b = [], []
    for d, text in enumerate(texts):
        ids = items.encode(text)
        for i in seeds.candidates(ids).tolist():
            for s, e in seeds.stretches(ids, i):
                pairs.append((d, i, s))
                a.append(items.words[i])
                b.append(ids[s:e])
    out: list[dict] = [{} for _ in texts]
    if pairs:
        for (d, i, s), score, lo, hi in zip(pairs, *align(a, b), strict=True):
            share = float(score) / len(items.words[i])
            if share >= seeds.share[i] and share > out[d].get(i, (0,))[0]:
                out[d][i] = (share, s + int(lo), s + int(hi))
    return [[(items.ids[i], *v) for i, v in sorted(o.items())] for o in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, str]]]:
    own, n = [], 0
    for r in benchmark.select(item_col, text_of(text_col)).toLocalIterator():
        own.append((r[0], r[1]))
        n += len(r[1]) // 4 + 1
        if n >= block_words:
            yield own
            own, n = [], 0
    if own:
        yield own


def _counter(shared):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        seen = np.zeros(len(block.vocabulary) + 1, np.int64)
        for b in batches:
            for t in b["t"]:
                seen[np.unique(block.encode(t))] += 1
        k = np.flatnonzero(seen[:-1])  # the last one counts words of no item
        yield pd.DataFrame({"k": k, "n": seen[k]})

    return count


def _finder(shared, seen, threshold: float, n: int):
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = Seeds(shared.value, seen.value, threshold, n)
        for s in batches:
            texts = list(s)
            yield pd.Series([x for k in range(0, len(texts), 500) for x in leaks_in(shared.value, seeds, texts[k : k + 500])], dtype=object)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, threshold: float = 0.5, block_words: int = 500_000, short: bool = False) -> DataFrame:
    """docs with `leaks` added: array of (item_id, score, first_word, end_word), empty for a clean document."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)[item_col]
    schema = f"array<struct<item_id {kind}, score double, first_word long, end_word long>>"
    out = without(docs, ["leaks"]).withColumn("leaks", F.array().cast(schema))
    for rows in _blocks(benchmark, item_col, item_text, block_words):
        items = index_items(rows, n, short)
        if not items.ids:
            continue
        shared = spark.sparkContext.broadcast(items)

        seen = np.zeros(len(items.vocabulary), np.int64)
        for r in docs.select(text_of(text_col).alias("t")).mapInPandas(_counter(shared), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row per word of the block
            seen[r["k"]] = r["n"]
        told = spark.sparkContext.broadcast(seen)

        out = out.withColumn("leaks", F.concat("leaks", F.pandas_udf(_finder(shared, told, threshold, n), schema)(text_of(text_col))))
    return out


def not_checked(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", n: int = 3) -> DataFrame:
    """(item_id, words) of items that are too short to be looked for."""
    words = F.regexp_count(text_of(item_text), F.lit(WORD)).cast("long")
    return benchmark.select(F.col(item_col).alias("item_id"), words.alias("words")).filter(F.col("words") < n)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each leaked item of each document: (id, item_id, score, first_word, end_word)."""
    marked = with_leaks(docs.select(F.col(id_col), F.col(text_col)), benchmark, text_col, **options)
    return marked.select(F.col(id_col), F.explode("leaks").alias("_qm_l")).select(id_col, "_qm_l.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that leak an item, columns unchanged."""
    marked = with_leaks(docs.select(F.struct("*").alias("_qm_row"), F.col(text_col).alias("_qm_t")), benchmark, "_qm_t", **options)
    return marked.filter(F.size("leaks") == 0).select("_qm_row.*")

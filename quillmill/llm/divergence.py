"""Source divergence audit: how far the sources of a language differ in their words.

Counts come from single-pass in-memory indexing. A task reads its documents once and
builds a block of postings, (lang, source, term) -> occurrences and documents, until
`block_entries` are held; then the block leaves as a run sorted by term and the next
one begins. Runs are dealt by a hash of (lang, source, term) and merged in term order
by Spark's external sort, whose heap over sorted spills needs no memory for a shard as
a whole; equal neighbours add up to frequencies.

With the terms that occur in `least_docs` documents of a language (V of them), a group
(lang, source) and each language give a term p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)),
and two such values differ by f = floor((p - q)**2 / (p + q)). A pair of sources starts
from V times the value of a term that neither has, and every term that one of them has
corrects it. Corrections are streamed: sources of a language are dealt into blocks of
about `block_sources`, terms into hash shards of about `cell_rows` rows, and a cell of
two blocks and a shard corrects all its pairs at once, so that what leaves a cell is
one number a pair, whatever the number of terms. All arithmetic is in integers.

Cases: null texts, languages and sources are ''. A group without terms takes part with
N = 0; where a language keeps no term all pair values are 0. Ids play no part, so
repeated rows count each time. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import Stash

#: Terms in UTF-8 bytes: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LONG_TEXT = 1 << 20
#: Terms that wait to be counted together.
WORDS = 500_000
#: Kept terms that are broadcast; more of them meet their counts by key.
SMALL_TABLE = 500_000
RUN = "lang string, source string, term binary, n long, docs long"
SUMS = "lang string, a string, b string, value long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, long texts in pieces."""
    text = text.lower()  # of bytes: A to Z only
    if len(text) <= LONG_TEXT:
        yield TERM.findall(text)
        return
    found = map(itemgetter(0), TERM.finditer(text))
    while piece := list(islice(found, 1 << 16)):
        yield piece


def _sum_equal(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


class _Block:
    """Postings of the documents read since the last spill: numbers of terms and groups, counts in arrays."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(lambda: len(self.number))
        self.groups: dict[tuple[str, str], int] = {}
        self.words: list[bytes] = []
        self.owners: list[tuple[int, int]] = []  # group and terms of each document
        self.keys, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))

    def read(self, lang: str, source: str, text: bytes) -> None:
        group, before = self.groups.setdefault((lang, source), len(self.groups)), len(self.words)
        for piece in _terms(text):
            self.words += piece
        self.owners.append((group, len(self.words) - before))
        if len(self.words) >= WORDS:
            self.count()

    def count(self) -> None:
        """Adds the waiting documents' terms, first by document, then by group."""
        if not self.words:
            return
        term = np.fromiter(map(self.number.__getitem__, self.words), np.int64, len(self.words))
        group, length = np.array(self.owners, np.int64).T
        own, n = _sum_equal(np.repeat(np.arange(len(length)), length) << 32 | term, np.ones(len(term), np.int64))
        keys = group[own >> 32] << 32 | own & 0xFFFFFFFF
        parts = (self.keys, keys), (self.n, n), (self.docs, np.ones(len(n), np.int64))
        self.keys, self.n, self.docs = _sum_equal(*map(np.concatenate, parts))
        self.words, self.owners = [], []

    def run(self) -> Iterator[pa.RecordBatch]:
        """All postings as a run in the order of terms."""
        self.count()
        terms = np.array(list(self.number), object)
        order = np.argsort(terms)
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        terms = pa.array(terms[order], pa.binary())
        lang, source = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        at = rank[self.keys & 0xFFFFFFFF]
        by_term = np.lexsort((self.keys >> 32, at))
        for k in range(0, len(by_term), 20_000):
            part = by_term[k : k + 20_000]
            group = pa.array(self.keys[part] >> 32)
            yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), terms.take(pa.array(at[part])), pa.array(self.n[part]), pa.array(self.docs[part])], ["lang", "source", "term", "n", "docs"])


def runs(docs: DataFrame, block_entries: int = 1_000_000) -> DataFrame:
    """docs (lang, source, text) to term-sorted runs of (lang, source, term, n, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in zip(*(b.column(c).slice(at, 256).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    block.read(*row)
                    if len(block.keys) >= block_entries:
                        yield from block.run()
                        block = _Block()
        yield from block.run()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, RUN).withColumn("term", F.col("term").cast("string"))


def frequencies(docs: DataFrame, block_entries: int = 1_000_000) -> DataFrame:
    """(lang, source, term, n, docs), runs merged in term order within hash shards."""
    keys = ["lang", "source", "term"]
    return runs(docs, block_entries).repartition(*keys).sortWithinPartitions(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str):
    """p of a term, in exact integers."""
    return F.expr(f"1 + (1000000000BD * (cast({count} as decimal(20, 0)) + 2)) div (cast({total} as decimal(20, 0)) + 2 * {terms})")


def _f(p, q):
    d = p - q
    return d * d // (p + q)


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of a cell's corrections for all pairs of a source of its first and one of its second block."""
    lang, low, high, shard = key
    facts = rows[rows["term"].isna()].sort_values("source")
    rows = rows[rows["term"].notna()]
    source, none, v = facts["source"].to_numpy(), facts["p"].to_numpy(np.int64), int(facts["v"].iloc[0])
    term = pd.factorize(rows["term"])
    p = np.tile(none, (len(term[1]), 1))  # what a source without the term gives it
    p[term[0], np.searchsorted(source, rows["source"].to_numpy())] = rows["p"].to_numpy(np.int64)
    first, second = (np.flatnonzero(facts["block"].to_numpy() == b) for b in (low, high))
    pairs, values = [], []
    for a in first:
        other = second[second > a] if low == high else second
        absent = _f(none[a], none[other]) if v else np.zeros(len(other), np.int64)
        values += ((_f(p[:, [a]], p[:, other]) - absent).sum(0) + (v * absent if shard == 0 else 0)).tolist()
        pairs += [(lang, source[a], source[b]) for b in other]
    return pd.DataFrame([(*k, n) for k, n in zip(pairs, values, strict=True)], columns=["lang", "a", "b", "value"])


def pair_values(terms: DataFrame, groups: DataFrame, block_sources: int = 64, cell_rows: int = 20_000) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, a dealt before b.

    terms: (lang, source, term, p) with p of terms that the source has; groups:
    (lang, source, none, v), none being p of a term that it has not.
    """
    most = groups.groupBy("lang").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-most // block_sources))
    shards = max(1, -(-2 * terms.count() // (blocks * cell_rows)))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    shared = ["lang", "source", "block", "term", "p", "v"]
    own = terms.select("lang", "source", block.alias("block"), "term", "p", F.lit(None).cast("long").alias("v")).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    facts = groups.select("lang", "source", block.alias("block"), F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), "v")
    facts = facts.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    cells = own.unionByName(facts).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select(*shared, "shard", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return cells.groupBy("lang", "low", "high", "shard").applyInPandas(_cell, SUMS).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block_entries: int = 1_000_000, block_sources: int = 64, cell_rows: int = 20_000, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks all other sources of the language by divergence, part `term` the `top` terms a source favours most against its language."""
    stash = Stash(docs.sparkSession, "divergence")
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).alias("text"))
    freq = stash.keep(frequencies(rows, block_entries), "freq")
    kept = freq.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = stash.keep(kept, "kept")
    own = stash.keep(freq.join(F.broadcast(kept) if kept.count() <= SMALL_TABLE else kept, ["lang", "term"]).drop("docs"), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = stash.keep(groups.withColumn("none", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(0)), "groups")
    shares = own.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))

    pairs = pair_values(shares.select("lang", "source", "term", "p"), groups, block_sources, cell_rows)
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    pairs = stash.keep(pairs, "pairs").select("lang", both)
    favoured = shares.withColumn("q", share("lang_n", "lang_total", "v")).filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumns({"part": F.lit("pair"), "rank": rank})
        .select(*columns)
        .unionByName(favoured.withColumns({"part": F.lit("term"), "rank": rank}).filter(F.col("rank") <= top).select(*columns))
    )

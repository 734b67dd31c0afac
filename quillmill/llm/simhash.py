"""SimHash near-dedup with a Gray-order hierarchical index.

A fingerprint bit is set where more than half of the XXH64 hashes (seed 42) of a
text's word shingles have it. Fingerprints link at `most` = 3 or fewer differing
bits, and components of the links are the near-copy groups.

Search. Of four blocks of 16 bits one is equal in any two linked fingerprints, and
of the other 48 bits one of four blocks of 12, so distinct fingerprints meet under
16 keys of 28 exact bits. Under a key they are sorted by Gray rank, so that
neighbours differ little; runs of 16 make a node that factors out the bits all of
them share, 16 nodes make an upper node, and so on. Two nodes are compared by the
differences within the bits both share; over `most` differences prune the whole
pair of groups, else their children are compared. Keys with more than `crowd`
fingerprints are split by two further levels of blocks (44 exact bits, hence at
most 2**20 different fingerprints), which loses no link either.

A task reports its links as one row per fingerprint, to the smallest one it is
joined with there, never as all pairs.

Cases: a null text counts as empty; texts without words share fingerprint zero;
fewer words than a shingle give one shingle. Null ids belong to groups but name
none: a group of null ids only has a null component_id. An empty table gives an
empty result; clashing input columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Stash, join_groups, one_of_each, text_key, text_of, without
from quillmill.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FAN = 16
U = np.uint64


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint of one whole text, as an unsigned integer."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(joined, 42)
    ends = list(accumulate(len(x) + 1 for x in w))
    h = [digest(joined[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[words - 1 :]], strict=False)]
    ones, n = np.zeros(64, np.int64), len(h)
    for k in range(0, n, 65536):
        part = np.array(h[k : k + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, name: str = "fp") -> DataFrame:
    """docs with the fingerprint added as a long."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in s], np.uint64).view(np.int64))

    return docs.withColumn(name, F.pandas_udf(run, "long")(text_of(text_col)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def _cut(rest: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(exact block, remaining bits, remaining width) for each of four blocks of the words in `rest`."""
    out, at = [], 0
    for j in range(4):
        w = (width - at) // (4 - j)
        block = (rest >> U(at)) & U((1 << w) - 1)
        out.append((block, (rest & U((1 << at) - 1)) | ((rest >> U(at + w)) << U(at)), width - w))
        at += w
    return out


def block_keys(fp: np.ndarray, levels: int) -> np.ndarray:
    """One row of 4**levels keys a fingerprint; equal keys have equal bits in the same blocks."""
    state = [(np.zeros(len(fp), U), fp, 64)]
    for _, width in zip(range(levels), (16, 12, 9, 7), strict=False):
        # a block's bits and its place, behind those of the levels before
        state = [((key << U(width + 2)) | (block << U(2)) | U(j), rest, left) for key, r, w in state for j, (block, rest, left) in enumerate(_cut(r, w))]
    return np.stack([key for key, _, _ in state], axis=1).view(np.int64)


def _nodes(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Splits runs (start, size) into runs of FAN: start of every new node, and its first node and node count by run."""
    n = -(-size // FAN)
    first = np.cumsum(n) - n
    run = np.repeat(np.arange(len(size)), n)
    return start[run] + FAN * (np.arange(n.sum()) - first[run]), first, n


def _grid(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a + i, b + j) with i < na and j < nb, a pair of runs at a time."""
    n = na * nb
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    w = np.repeat(nb, n)
    return np.repeat(a, n) + k // w, np.repeat(b, n) + k % w


class Union:
    """Disjoint sets over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while True:
            a, b = up[i], up[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while True:
                again = up[up]
                if (again == up).all():
                    break
                up[:] = again


def link_runs(key: np.ndarray, fp: np.ndarray, most: int = 3, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one joined with it) for rows sorted by key and Gray rank; only rows of equal keys are compared."""
    fp = fp.view(U)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    start, size = start[size > 1], size[size > 1]
    levels = [(np.arange(len(fp)), fp, ~np.zeros(len(fp), U))]  # first child, pattern, shared bits
    children = []
    runs, count = start, size
    while len(count) and (count > 1).any():
        low, first, n = _nodes(runs, count)
        high = np.minimum(low + FAN, np.repeat(runs + count, n))
        both, either = _fold(np.bitwise_and, levels[-1][1] & levels[-1][2], low, high), _fold(np.bitwise_or, levels[-1][1] | ~levels[-1][2], low, high)
        levels.append((low, both, ~(both ^ either)))
        children.append((low, high - low))
        runs, count = first, n
    ids, where = np.unique(fp, return_inverse=True)
    sets = Union(len(ids))
    todo = [(len(levels) - 1, runs, runs)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            sets.join(where[a], where[b])
            continue
        low, width = children[level - 1]
        sizes = width[a] * width[b]
        part = np.cumsum(sizes) // step
        for p in np.unique(part):
            sel = part == p
            x, y = _grid(low[a[sel]], low[b[sel]], width[a[sel]], width[b[sel]])
            keep = x < y if level == 1 else x <= y
            x, y = x[keep], y[keep]
            _, pattern, shared = levels[level - 1]
            near = np.bitwise_count((pattern[x] ^ pattern[y]) & shared[x] & shared[y]) <= most
            x, y = x[near], y[near]
            if level > 1 or len(x):
                todo.append((level - 1, x, y))
    ids = ids.view(np.int64)
    moved = np.flatnonzero(sets.up != np.arange(len(ids)))
    return ids[moved], ids[sets.up[moved]]


def _fold(op: np.ufunc, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    if not len(low):
        return np.zeros(0, U)
    # reduceat folds from low[i] to low[i + 1]; values past a node's end are cut off by a second index
    cuts = np.stack([low, high], axis=1).ravel()
    return op.reduceat(np.append(values, U(0)), cuts)[::2]


def _find(most: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps, n = [], [], 0

        def done(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            order = np.lexsort((gray_rank(f.view(U)), k))
            a, b = link_runs(k[order], f[order], most)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            keys.append(batch["key"].to_numpy(np.int64))
            fps.append(batch["fp"].to_numpy(np.int64))
            n += len(batch)
            if n >= limit:
                k, f = np.concatenate(keys), np.concatenate(fps)
                whole = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
                if whole:
                    yield done(k[:whole], f[:whole])
                keys, fps, n = [k[whole:]], [f[whole:]], len(k) - whole
        if n:
            yield done(np.concatenate(keys), np.concatenate(fps))

    return run


def _keyed(fps: DataFrame, levels: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for part in np.array_split(np.arange(len(fp)), max(1, len(fp) * 4**levels // 200_000)):
                k = block_keys(fp[part].view(U), levels)
                yield pd.DataFrame({"key": k.ravel(), "fp": np.repeat(fp[part], k.shape[1])})

    return fps.select("fp").mapInPandas(run, "key long, fp long")


def near_links(fps: DataFrame, most: int = 3, crowd: int = 4096, buffer_rows: int = 300_000) -> DataFrame:
    """Links (a, b) between different fingerprints of the distinct `fp` column, as stars; their components are exact."""
    if most > 3:
        raise ValueError("the blocks find up to 3 differing bits")
    rows = _keyed(fps, 2)
    size = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    met = rows.join(size, "key")
    find = _find(most, buffer_rows)
    quiet = met.filter(F.col("n") <= crowd).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(find, "a long, b long")
    # Crowded keys: the same fingerprints once more, under four blocks instead of two.
    crowded = _keyed(met.filter(F.col("n") > crowd).select("fp").distinct(), 4)
    loud = crowded.repartition("key").sortWithinPartitions("key").mapInPandas(find, "a long, b long")
    return quiet.union(loud)


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, most: int, crowd: int) -> DataFrame:
    """One row a document: (id, key, fp, group, component_id); key tells texts apart, group is one number a component."""
    stash = Stash(docs.sparkSession, "simhash")
    own = stash.keep(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("key")), "text", words).select("id", "key", "fp"), "own")
    fps = stash.keep(own.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    linked = components(near_links(fps, most, crowd), stash).withColumnRenamed("node", "fp")
    low = stash.keep(linked.join(fps, "fp").groupBy("root").agg(F.min("first").alias("group_first")), "roots")
    named = linked.join(low, "root").select("fp", "root", "group_first")
    table = fps.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("group"), F.coalesce("group_first", "first").alias("component_id"))
    return join_groups(own, stash.keep(table, "table"), "fp", "n", own.count()).drop("n")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, crowd: int = 4096) -> DataFrame:
    """One row a document: (id, fingerprint, component_id), component_id being the smallest id of its group."""
    fingerprint_hex = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, id_col, text_col, words, most, crowd).select(F.col("id").alias(id_col), fingerprint_hex.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, crowd: int = 4096) -> DataFrame:
    """docs with one document of each group, one with the group's smallest id; columns unchanged."""
    groups = Stash(docs.sparkSession, "simhash-groups").keep(_grouped(docs, id_col, text_col, words, most, crowd), "rows")
    return one_of_each(groups, docs, id_col, text_col)


def mark_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """docs with fingerprint and component_id added; ids are taken as keys."""
    groups = near_groups(docs, id_col, text_col, words, most).dropDuplicates([id_col]).withColumnRenamed(id_col, "_qm_id")
    return without(docs, ["fingerprint", "component_id"]).join(groups, F.col(id_col).eqNullSafe(F.col("_qm_id"))).drop("_qm_id")

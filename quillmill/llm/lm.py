"""LM scoring: a unigram base and a causal self-attention model over subword ids.

Texts are lower-cased (A-Z) words and one end token. Rows of one fold in five
(crc32 of the id, remainder 1) are held out; all statistics come from the others.

Base: add-half unigram log probabilities over words. Counts of all words are one
distributed aggregate; the `hot` most frequent ones (a bounded table) are broadcast
and looked up where the text is, words beyond them meet their counts in a join.

Model: words become ids of a public byte-level vocabulary, never trained here. Ids
fall into `classes` classes, frequent ids being classes of their own. Over all
training texts are counted: ids, and ids after each of `groups` groups of ids (again
the frequent ones are their own); from these come the classes after a group and the
ids within a class after a group. The attention layer (`attention`) corrects the
classes by what stands further back. It is trained by all tasks on whole training
texts, every token being a target once: `rounds` rounds take turns at the windows,
and after each the tasks' parameters are averaged. So what is learned grows with the
corpus and what is shared has a fixed size. Then every text is scored whole, each
token once, in overlapping windows.

Cases: null and empty texts are one end token; repeated rows are scored each, rows
being told apart by a number given when ids are first written; with no training
text every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm import attention
from quillmill.llm.common import Stash, held_out, text_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b" "  # no word contains a space
LONG = 64


def split_words(text: bytes) -> list[bytes]:
    return bytes(text).translate(LOWER).split()


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"word": list(seen), "n": np.fromiter(seen.values(), np.int64, len(seen))})

    for b in batches:
        for t in b["text"]:
            w = split_words(t)
            seen.update(w)
            seen[END] += 1
        if len(seen) > 150_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


@lru_cache(maxsize=1)
def _encoding(path: str):
    """A public vocabulary given as ranks (.tiktoken)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Subwords:
    """Ids of words, remembered: a word's ids do not depend on its neighbours. The first words given are never forgotten."""

    def __init__(self, path: str, first: Iterable[bytes] = (), room: int = 150_000):
        self.encoding, self.room = _encoding(path), room
        self.end = self.encoding.n_vocab  # one past the vocabulary
        self.opens = np.array([self._bytes(i)[:1] == b" " for i in range(self.end)])
        self.place: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 20, np.uint16 if self.end < 1 << 16 else np.uint32), np.zeros(1 << 18, np.int64), 0
        self.add(list(first))
        self.kept = len(self.place)

    def _bytes(self, i: int) -> bytes:
        try:
            return self.encoding.decode_single_token_bytes(i)
        except KeyError:
            return b""

    def add(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 5000):
            part = words[k : k + 5000]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(w.decode("utf-8", "replace") for w in part)), np.int64)
            cut = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, np.int64)
            if len(cut) != len(part):  # odd white space inside words: one by one
                each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in part]
                ids, cut = np.array([i for e in each for i in e], np.int64), np.cumsum([0, *[len(e) for e in each[:-1]]])
            n = len(self.place)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[n : n + len(part)] = cut + self.used
            self.used += len(ids)
            self.starts[n + len(part)] = self.used
            self.place.update(zip(part, range(n, n + len(part)), strict=True))

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > self.kept + self.room:
            while len(self.place) > self.kept:
                self.place.popitem()
            self.used = int(self.starts[self.kept])
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if len(unseen := np.flatnonzero(at < 0)):
            others = [words[i] for i in unseen]
            self.add(list(dict.fromkeys(others)))
            at[unseen] = np.fromiter(map(self.place.__getitem__, others), np.int64, len(others))
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after the other, and where each word's ids end."""
        n = self.starts[at + 1] - self.starts[at]
        to = np.cumsum(n)
        index = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(self.starts[at] - to + n, n)
        return self.flat[index], to


_KNOWN: dict = {}


def _known_words(path: str, shared) -> tuple[Subwords, np.ndarray]:
    """The subwords of this worker, hot words first, and the counts of those; kept from task to task."""
    # the broadcast itself is kept, so that no other one can be taken for it
    if _KNOWN.get("of") is not shared or _KNOWN["path"] != path:
        words, counts = shared.value
        _KNOWN.clear()
        _KNOWN.update({"of": shared, "path": path, "own": (Subwords(path, words), counts)})
    return _KNOWN["own"]


def _encode(tokenizer: str, hot, end_count: int, log_n: float):
    schema = ["rid", "id", "held_out", "n_tokens", "known", "base", "ids", "rare"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, counts = _known_words(tokenizer, hot)
        logs, known = np.log10(counts + 0.5) - log_n, counts > 0
        of_end = np.log10(end_count + 0.5) - log_n
        rid, kept = TaskContext.get().partitionId() << 33, len(counts)
        for b in batches:
            for k in range(0, len(b), 400):
                part = b.iloc[k : k + 400]
                words = [split_words(t) for t in part["text"]]
                flat = [w for t in words for w in t]
                at = sub.places(flat)
                ids, to = sub.ids(at)
                cut = np.cumsum([0, *map(len, words)])
                id_cut = np.append(0, to)[cut]
                is_hot = at < kept
                base, have = np.append(0, np.cumsum(np.where(is_hot, logs[np.where(is_hot, at, 0)], 0)))[cut] if kept else np.zeros(len(cut)), np.append(0, np.cumsum(is_hot & known[np.where(is_hot, at, 0)]))[cut] if kept else np.zeros(len(cut), np.int64)
                cold = np.flatnonzero(~is_hot)
                cold_cut = np.searchsorted(cold, cut)
                rare = [b" ".join([flat[i] for i in cold[x:y]]).decode("utf-8", "replace") for x, y in zip(cold_cut[:-1], cold_cut[1:], strict=True)]
                n = len(part)
                out = {"rid": np.arange(rid, rid + n), "id": part["id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "n_tokens": np.diff(cut) + 1, "known": np.diff(have) + (end_count > 0), "base": np.diff(base) + of_end}
                out["ids"] = [ids[x:y].tobytes() for x, y in zip(id_cut[:-1], id_cut[1:], strict=True)]
                out["rare"] = rare
                rid += n
                yield pd.DataFrame(out, columns=schema)

    return run


def _ids(z: bytes, size: int) -> np.ndarray:
    """Ids of a text, the end token last."""
    own = np.frombuffer(z, np.uint16 if size <= 1 << 16 else np.uint32)
    out = np.empty(len(own) + 1, np.int32)
    out[:-1], out[-1] = own, size - 1
    return out


def _sparse(counts: np.ndarray) -> pd.DataFrame:
    k = np.flatnonzero(counts)
    return pd.DataFrame({"k": k.astype(np.int32), "n": counts[k]})


def _summed(df: DataFrame, function, size: int) -> np.ndarray:
    """Adds up sparse count tables of a fixed size from all tasks."""
    out = np.zeros(size, np.int64)
    got = df.mapInPandas(function, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def token_classes(counts: np.ndarray, tokens: list[bytes], classes: int, rest: int = 16) -> np.ndarray:
    """Class of each id: the most frequent are classes of their own, others share `rest` classes by start, length and letters."""
    cls = np.zeros(len(counts), np.int64)
    for i, t in enumerate(tokens):
        body = t.lstrip(b" ")
        cls[i] = (classes - rest) + (t[:1] != b" ") * 8 + min(len(body), 6) // 2 * 2 + (not body.isalpha())
    cls = np.minimum(cls, classes - 1)
    own = np.lexsort((np.arange(len(counts)), -counts))[: classes - rest]
    cls[own] = np.arange(len(own))
    return cls


class Tables:
    """Log probabilities from counts: of a class after a group, and of an id within its class after a group.

    The `tabled` most frequent ids have columns of their own; the others of a class
    share one, within which they follow their counts alone.
    """

    def __init__(self, counts: np.ndarray, after: np.ndarray, cls: np.ndarray, classes: int, column: np.ndarray, weight: float = 20.0):
        columns = after.shape[1]
        of = np.zeros(columns, np.int64)  # the class of a column
        of[column] = cls
        held = np.bincount(column, counts, columns)
        size = np.bincount(column, minlength=columns)
        total = np.zeros((len(after), classes), np.float32)
        np.add.at(total.T, of, after.T.astype(np.float32))
        prior = np.bincount(cls, counts, classes) + 0.5
        prior /= prior.sum()
        self.prior = np.log((total + weight * prior) / (total.sum(axis=1, keepdims=True) + weight)).astype(np.float32)
        alone = (held + 0.5 * size) / (np.bincount(cls, counts, classes) + 0.5 * np.bincount(cls, minlength=classes))[of]
        with np.errstate(divide="ignore"):
            self.within = np.log((after + weight * alone) / (total[:, of] + weight)).astype(np.float32)
        self.share = np.log((counts + 0.5) / (held + 0.5 * size)[column])  # of an id in its column
        self.column = column


def columns_of(counts: np.ndarray, cls: np.ndarray, classes: int, tabled: int) -> np.ndarray:
    """Column of each id: its own for the most frequent, one a class for the others."""
    out = tabled + cls
    own = np.lexsort((np.arange(len(counts)), -counts))[:tabled]
    out[own] = np.arange(len(own))
    return out


def _count_ids(size: int, tokenizer: str, hot):
    """Ids of all training texts, from the counts of their words: a word's ids do not depend on its neighbours."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub, _ = _known_words(tokenizer, hot)
        seen = np.zeros(size, np.int64)
        for b in batches:
            is_end = (b["word"] == END).to_numpy()
            c = b["c"].to_numpy(np.int64)
            seen[-1] += c[is_end].sum()
            ids, to = sub.ids(sub.places([bytes(w) for w in b["word"][~is_end]]))
            np.add.at(seen, ids, np.repeat(c[~is_end], np.diff(to, prepend=0)))
        yield _sparse(seen)

    return run


def _count_after(size: int, shared, groups: int, columns: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, column = shared.value
        seen = np.zeros((groups + 1) * columns, np.int32)
        for b in batches:
            for k in range(0, len(b), 200):
                own = [_ids(z, size) for z in b["ids"].iloc[k : k + 200]]
                x = np.concatenate(own)
                before = np.append(groups, group[x[:-1]]).astype(np.int64)
                before[np.cumsum([0, *map(len, own[:-1])])] = groups
                code, n = np.unique(before * columns + column[x], return_counts=True)
                seen[code] += n.astype(np.int32)
        yield _sparse(seen)

    return run


def _train(size: int, shared, shape: attention.Shape, vector: np.ndarray, turn: int, rounds: int, step: int = 40_000):
    """One round over whole texts: of all windows, one after the other, every `rounds`-th, another one each turn; about `step` windows are held at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, maps = shared.value
        descent = attention.Descent(vector, tables.prior, shape, maps, rate=0.01 / (1 + turn))
        n, rows, held, at = 0, [], 0, turn

        def learn() -> None:
            descent.learn(*(np.concatenate(p) for p in zip(*rows, strict=True)))

        for b in batches:
            for z in b["ids"]:
                x = _ids(z, size)
                rows.append(attention.windows(x, shape, maps, at, rounds))
                at = (at + len(x) // -shape.block) % rounds
                held += len(rows[-1][0])
                if held >= step:
                    learn()
                    n, rows, held = n + held, [], 0
        if held:
            learn()
            n += held
        if n:
            yield pd.DataFrame({"k": np.arange(len(vector)), "x": descent.x, "n": float(n)})

    return run


def _score(size: int, shared, shape: attention.Shape, vector: np.ndarray):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables, maps = shared.value
        scorer = attention.Scorer(vector, tables.prior, shape, maps)
        flat, share = tables.within.ravel(), tables.share.astype(np.float32)
        line = maps.after * np.int32(tables.within.shape[1])  # where a group's row begins
        column = tables.column.astype(np.int32)
        for s in batches:
            out = []
            for k in range(0, len(s), 32):
                own = [_ids(z, size) for z in s.iloc[k : k + 32]]
                x, cut = np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])
                before = np.concatenate([x[:1], x[:-1]])
                before[cut] = maps.start
                inner = np.take(flat, np.take(line, before) + np.take(column, x)) + np.take(share, x)
                rows = [attention.windows(z, shape, maps) for z in own]
                c, t = (np.concatenate(p) for p in zip(*rows, strict=True))
                outer = scorer.log_classes(c, t).sum(axis=1, dtype=np.float64)
                row_cut = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
                out.extend((np.add.reduceat(outer, row_cut) + np.add.reduceat(inner, cut, dtype=np.float64)) / np.log(10))
            yield pd.Series(out, dtype="float64")

    return run


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (word, c), those above a count that a histogram of counts tells."""
    level = F.floor(F.log2("c") * 64)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # 64 a power of two
    room, least = most, None
    for r in sizes:
        room -= r.n
        if room < 0:
            break
        least = r.level
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def score(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", hot: int = 200_000, classes: int = 64, groups: int = 1024, inputs: int = 128, tabled: int = 4096, width: int = 16, block: int = 8, rounds: int = 2) -> DataFrame:
    """One row a document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    stash = Stash(spark, "lm")
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), held_out(id_col, 1).alias("held_out"), text_of(text_col).cast("binary").alias("text"))

    words = own.filter(~F.col("held_out")).select("text").mapInPandas(_tally, "word binary, n long")
    counts = stash.keep(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    log_n = float(np.log10(total + 0.5 * (distinct + 1)))
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    top = frequent(counts.filter((F.length("word") <= LONG) & (F.col("word") != F.lit(END))), hot).toArrow()  # at most `hot` words of 64 bytes
    table = spark.sparkContext.broadcast((top["word"].to_pylist(), top["c"].to_numpy()))
    schema = f"rid long, id {kind}, held_out boolean, n_tokens long, known long, base double, ids binary, rare string"
    rows = stash.keep(own.mapInPandas(_encode(tokenizer, table, end, log_n), schema), "rows")

    # words beyond the hot ones meet their counts by key
    rare = rows.filter("rare <> ''").select("rid", F.explode(F.split("rare", " ")).alias("word")).withColumn("word", F.col("word").cast("binary")).withColumn("n", F.lit(1))
    logp = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(log_n)
    beyond = rare.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("n") * logp).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))

    sub = Subwords(tokenizer)
    size = sub.end + 1  # and the end token
    learn = rows.filter(~F.col("held_out")).select("rid", "ids")
    seen = _summed(counts, _count_ids(size, tokenizer, table), size)
    tokens = [sub._bytes(i) for i in range(size)]
    cls, group, seen_as = (token_classes(seen, tokens, n) for n in (classes, groups, inputs))
    column = columns_of(seen, cls, classes, tabled)
    columns = tabled + classes
    after = _summed(learn.select("ids"), _count_after(size, spark.sparkContext.broadcast((group, column)), groups, columns), (groups + 1) * columns)
    tables = Tables(seen, after.reshape(groups + 1, columns), cls, classes, column)
    maps = attention.Maps.of(seen_as, inputs, group, groups, cls)
    shared = spark.sparkContext.broadcast((tables, maps))  # about (groups + 1) * (tabled + classes) numbers
    shape = attention.Shape(classes, inputs, width, block)
    vector = attention.initial(shape)
    for turn in range(rounds):
        told = learn.select("ids").mapInPandas(_train(size, shared, shape, vector, turn, rounds), "k long, x double, n double")
        mean = told.groupBy("k").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toPandas()  # one row a parameter
        vector[mean["k"].to_numpy()] = mean["x"].to_numpy()

    scored = rows.select("rid", "id", "held_out", "n_tokens", "known", "base", F.pandas_udf(_score(size, shared, shape, vector), T.DoubleType())("ids").alias("score"))
    return scored.join(beyond, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
SCRATCH = "_qm_"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or in local mode a fresh one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Stash:
    """Tables written to the shared folder in order to cut lineage; `drop` frees those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without the columns that an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to their group, a row a key of `groups` with the number `size` of its rows (about `total` in all).

    Keys that own many rows, a thousand at most, are broadcast, so that their rows stay
    where they are; the others meet their rows by key. Where there are none, nothing is
    broadcast: each broadcast is a table in the driver's memory.
    """
    cut = max(500, total // 1000)
    if total <= cut or not groups.filter(F.col(size) > cut).limit(1).count():
        return rows.join(groups, key)
    large = F.broadcast(groups.filter(F.col(size) > cut))
    others = rows.join(F.broadcast(groups.filter(F.col(size) > cut).select(key)), key, "left_anti")
    return rows.join(large, key).unionByName(others.join(groups.filter(F.col(size) <= cut), key))


def text_key(col: str = "text"):
    """A hash of the whole text, which with the id tells rows apart."""
    return F.xxhash64(text_of(col))


def one_of_each(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, few: int = 500_000) -> DataFrame:
    """docs with one row of each group, columns unchanged.

    groups: a row a document (id, key, group), key being its text_key. The row with
    the smallest id stays (null ids last), of those with that id the one with the
    smallest key, of equal rows any one. Texts stay where they are and are not written, as
    what goes is told to all tasks; where that is more than `few` rows, rows meet what
    stays by key, once.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    each = groups.groupBy("group", "id", "key").agg(F.count("*").alias("n"))
    stays = each.groupBy("group").agg(first, F.min_by("n", F.struct(F.col("id").isNull(), "id", "key")).alias("n"))
    stays = stays.select(F.col("first.id").alias("_qm_id"), F.col("first.key").alias("_qm_key"), F.col("n").alias("_qm_n"))
    named = each.select(F.col("id").alias("_qm_id"), F.col("key").alias("_qm_key"))
    stash = Stash(docs.sparkSession, "one-of-each")
    gone = stash.keep(named.join(stays, named["_qm_id"].eqNullSafe(stays["_qm_id"]) & (named["_qm_key"] == stays["_qm_key"]), "left_anti"), "gone")
    own = docs.withColumn("_qm_own", text_key(text_col))
    of = F.col(id_col).eqNullSafe(F.col("_qm_id")) & (F.col("_qm_own") == F.col("_qm_key"))
    small = gone.count() <= few
    kept = own.join(F.broadcast(gone), of, "left_anti") if small else own.join(stays, of)
    if (more := stays.filter("_qm_n > 1")).limit(1).count():  # only rows that are there more than once meet each other
        if small:
            kept = kept.join(more, of, "left")
        kept = kept.filter("_qm_n is null or _qm_n = 1").unionByName(kept.filter("_qm_n > 1").dropDuplicates(["_qm_id", "_qm_key"]))
    kept = kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept if small else stash.keep(kept, "kept")


def held_out(id_col: str = "doc_id", remainder: int = 0, folds: int = 5):
    """True where crc32 of the id as text leaves `remainder`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % folds == remainder


def least_hashed(rows: DataFrame, col: str, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hash of `col`; no more than about twice as many meet in one task."""
    part = F.pmod(F.xxhash64(col), F.lit(1 << 40)) / float(1 << 40)
    total = rows.count()
    if total > 2 * most:
        rows = rows.filter(part < 2.0 * most / total)
    return rows.withColumn("_qm_r", part).orderBy("_qm_r", col).limit(most).drop("_qm_r")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- repeated-key filter

CHUNK_BITS = 16


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of each 64-bit hash, one in either half of the filter."""
    u = h.view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (u & mask).astype(np.int64), ((u >> np.uint64(64 - bits)) & mask).astype(np.int64) + (1 << bits)


def repeat_filter(keys: DataFrame, column: str, rows: int, max_bits: int = 27, times: int = 2, through=None) -> RepeatFilter:
    """Pass one of two-pass Bloom filtering: which hashes may occur `times` (2 or 1) times at least.

    keys: a DataFrame with the 64-bit integer `column` (nulls are skipped). Each
    task reduces its hashes to (slot, once or more often), tasks' slots are added
    up by slot range on the executors, and the driver gets one bit a slot: at most
    2 * 2**max_bits bits, whatever the input. With more keys than that the filter
    only becomes less selective, it never misses a repeated key. through: a
    mapInPandas function that makes the keys from the rows of `keys`, run in the
    same Python process.
    """
    bits = int(min(max_bits, max(CHUNK_BITS, np.ceil(np.log2(max(rows, 1) * 4)))))

    def pack(seen: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        slot, n = np.unique(np.concatenate(seen), return_counts=True)
        chunk = slot >> CHUNK_BITS
        start = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        out = []
        for a, b in zip(start, [*start[1:], len(slot)], strict=True):
            low = (slot[a:b] & 0xFFFF).astype(np.uint16)
            out.append((int(chunk[a]), low.tobytes(), low[n[a:b] > 1].tobytes()))
        yield pd.DataFrame(out, columns=["chunk", "seen", "again"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, size = [], 0
        for b in through(batches) if through else batches:
            h = b[column].dropna().to_numpy(np.int64)
            if len(h):
                seen += _slots(h, bits)
                size += len(h)
            if size > 200_000:
                yield from pack(seen)
                seen, size = [], 0
        if size:
            yield from pack(seen)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for chunk, seen, again in zip(b["chunk"], b["seen"], b["again"], strict=True):
                once, twice = got.setdefault(chunk, (np.zeros(1 << CHUNK_BITS, bool), np.zeros(1 << CHUNK_BITS, bool)))
                s = np.frombuffer(seen, np.uint16)
                twice[s[once[s]]] = True
                once[s] = True
                twice[np.frombuffer(again, np.uint16)] = True
        if got:
            yield pd.DataFrame([(k, np.packbits(t[times - 1]).tobytes()) for k, t in got.items()], columns=["chunk", "bits"])

    marked = (keys if through else keys.select(column)).mapInPandas(mark, "chunk int, seen binary, again binary")
    merged = marked.repartition("chunk").mapInPandas(merge, "chunk int, bits binary")
    table = np.zeros((2 << bits) >> 3, np.uint8)
    width = (1 << CHUNK_BITS) >> 3
    for r in merged.collect():  # at most 2**(max_bits + 1) bits in all
        table[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return RepeatFilter(keys.sparkSession, table, bits)


class RepeatFilter:
    """Pass two: tells hashes that may occur often enough from those that do not."""

    def __init__(self, spark: SparkSession, table: np.ndarray, bits: int):
        self.table, self.bits = spark.sparkContext.broadcast(table), bits

    def look(self, h: np.ndarray) -> np.ndarray:
        a, b = _slots(h, self.bits)
        t = self.table.value
        hit = lambda s: (t[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1
        return (hit(a) & hit(b)).astype(bool)

    def may_repeat(self, column):
        def look(h: pd.Series) -> pd.Series:
            return pd.Series(self.look(h.fillna(0).to_numpy(np.int64)))

        return F.pandas_udf(look, "boolean")(column)

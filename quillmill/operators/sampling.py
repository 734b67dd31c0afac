"""Stratified samples, staged releases, batch packing and stable circular sampling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.shared import keep


def restarts(sizes: list[int]) -> tuple[np.ndarray, ...]:
    """The phases of a cursor that goes round the strata and begins again at the first one when a stratum runs empty.

    A phase ends with the first of the smallest strata that are left: it has gone round
    `turns` times up to that one and once less behind it. Returns, a number a phase, the
    rows taken before it, its turns, the stratum that ends it and the strata it goes round.
    """
    left, index = np.array(sizes, np.int64), np.arange(len(sizes))
    taken, out = 0, []
    for _ in sizes:
        open_ = left > 0
        turns = left[open_].min()
        last = int(np.flatnonzero(left == turns)[0])
        out.append((taken, turns, last, int(open_.sum())))
        taken += int((turns - 1) * open_.sum() + open_[: last + 1].sum())
        left -= np.where(open_, turns - (index > last), 0)
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


def ranks_of(phases: tuple[np.ndarray, ...], stratum: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rank, from 1, of the turn-th row of each stratum, by the closed form of its phase."""
    before, turns, last, open_ = phases
    out = np.zeros(len(stratum), np.int64)
    for g in np.unique(stratum):
        own = stratum == g
        passed = np.concatenate([[0], np.cumsum(last < g)])  # strata before this one that have run empty
        used = np.concatenate([[0], np.cumsum(turns - (g > last))])
        k = turn[own]
        p = np.searchsorted(used[1:], k)
        out[own] = before[p] + (k - used[p] - 1) * open_[p] + g - passed[p] + 1
    return out


def stratified(entries: DataFrame, strata: list[str], seed: str, limit: int | None = None, key: str = "entry_id", most_strata: int = 20_000) -> DataFrame:
    """Rows in round-robin order over the strata, with `turn` and `rank` from 1; inside a stratum the order is a seeded hash.

    The round begins again at the first stratum whenever one runs empty. Balanced,
    deterministic and prefix-stable. The sizes of the strata, `most_strata` at most, give
    the phases of the cursor (`restarts`), and each row finds its rank from them alone.
    """
    spark = entries.sparkSession
    sizes = entries.groupBy(*strata).agg(F.count("*").alias("n")).orderBy(*strata).limit(most_strata + 1).collect()
    if len(sizes) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    hashed = entries.withColumn("_qm_h", h)
    if limit is None:
        turns = with_position(hashed, strata, ["_qm_h", key], "turn").withColumn("turn", (F.col("turn") + 1).cast("int"))
    else:  # no later turn can be reached, and tasks keep no more than `limit` rows of a stratum
        turns = hashed.withColumn("turn", F.row_number().over(W.partitionBy(*strata).orderBy("_qm_h", key))).filter(F.col("turn") <= limit)
    if not sizes:
        return turns.drop("_qm_h").withColumn("rank", F.lit(0).cast("long"))
    names = [f"_qm_g{k}" for k in range(len(strata))]
    kinds = dict(entries.dtypes)
    table = spark.createDataFrame([(*[r[c] for c in strata], k) for k, r in enumerate(sizes)], ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, strata, strict=True)) + ", _qm_s int")
    phases = spark.sparkContext.broadcast(restarts([r["n"] for r in sizes]))

    def find(stratum: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series(ranks_of(phases.value, stratum.to_numpy(np.int64), turn.to_numpy(np.int64)))

    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(strata, names, strict=True)])
    out = turns.drop("_qm_h").join(F.broadcast(table), on).withColumn("rank", F.pandas_udf(find, "long")("_qm_s", "turn")).drop("_qm_s", *names)
    return out if limit is None else out.filter(F.col("rank") <= limit)


def staged_release(ranked: DataFrame, stages: dict[str, int], failed: DataFrame, key: str = "entry_id") -> DataFrame:
    """(stage, wanted, rows, failed_rows, released): each stage is a prefix of the ranks and opens only when those before are clean."""
    parts = None
    for i, (name, n) in enumerate(stages.items()):
        own = ranked.filter(F.col("rank") <= n).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.lit(n).alias("wanted"), key)
        parts = own if parts is None else parts.union(own)
    bad = failed.select(key).distinct().withColumn("bad", F.lit(1))
    sums = parts.join(bad, key, "left").groupBy("step", "stage", "wanted").agg(F.count("*").alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed_rows"))
    earlier = F.sum("failed_rows").over(W.orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("released", F.coalesce(earlier, F.lit(0)) == 0).drop("step")


def _next_batch(chars: list[int], own: int, size: int, budget: int, alone: int) -> list[int]:
    """For each of the first `own` rows, where the batch after one that begins there begins; this hangs on at most `size` rows."""
    out = []
    for i in range(own):
        j, total = i + 1, chars[i]
        if chars[i] <= alone:
            while j < len(chars) and j - i < size and chars[j] <= alone and total + chars[j] <= budget:
                total += chars[j]
                j += 1
        out.append(j)
    return out


def _entries(slices: DataFrame, most: int, size: int, fan: int, kind: str) -> DataFrame:
    """(g, s, entry, base): where the first batch of each slice begins and its number.

    slices: (g, s, exits, counts), for every place where a slice may be entered the place
    at which the next one is, and the batches begun in between. These functions are
    composed `fan` slices at a time until one task has no more than that of any group.
    """
    schema = f"g {kind}, s long, entry int, base long"

    def walk(rows: pd.DataFrame, entry: int, base: int) -> pd.DataFrame:
        rows, out = rows.sort_values("s"), []
        for s, exits, counts in zip(rows["s"], rows["exits"], rows["counts"], strict=True):
            out.append((rows["g"].iloc[0], s, entry, base))
            entry, base = int(exits[entry]), base + int(counts[entry])
        return pd.DataFrame(out, columns=["g", "s", "entry", "base"])

    if most <= fan:
        return slices.groupBy("g").applyInPandas(lambda rows: walk(rows, 0, 0), schema)

    def compose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, n = list(range(size)), [0] * size
        for exits, counts in rows.sort_values("s")[["exits", "counts"]].itertuples(index=False):
            n = [k + int(counts[e]) for k, e in zip(n, at, strict=True)]
            at = [int(exits[e]) for e in at]
        return pd.DataFrame([(key[0], key[1], at, n)], columns=["g", "s", "exits", "counts"])

    block = F.floor(F.col("s") / fan).cast("long").alias("block")
    above = slices.groupBy("g", block).applyInPandas(compose, f"g {kind}, s long, exits array<int>, counts array<long>")
    known = _entries(keep(above, "slices"), -(-most // fan), size, fan, kind)

    def descend(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return walk(rows, int(told["entry"].iloc[0]), int(told["base"].iloc[0]))

    return slices.groupBy("g", block).cogroup(known.groupBy("g", "s")).applyInPandas(descend, schema)


def pack_batches(entries: DataFrame, group: str, order: str, chars: str, size: int = 6, budget: int = 4000, alone: int = 3000, rows_each: int = 8192, fan: int = 1024) -> DataFrame:
    """(group, order, chars, batch): greedy batches within a group, closed when count or characters would overflow; long rows stand alone.

    Where a batch ends hangs on where it begins and on the next `size` rows alone. So a
    group is cut into slices of `rows_each` rows; each tells for the `size` places where a
    batch may enter it at which place the next slice is entered and how many batches are
    begun (small tables that compose); with the entries known all slices are numbered at
    once. No task holds or streams a whole group. Batches never span groups.
    """
    kinds = dict(entries.dtypes)
    kind = kinds[group]
    rows = entries.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(chars).cast("long").alias("c"))
    placed = keep(with_position(rows, ["g"], ["o"], "pos").withColumn("s", F.floor(F.col("pos") / rows_each).cast("long")), "placed")
    ahead = placed.filter((F.col("s") > 0) & (F.col("pos") % rows_each < size)).withColumn("s", F.col("s") - 1)

    def table(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        lengths = own.sort_values("pos")["c"].tolist()
        n = min(rows_each, len(lengths))
        after = _next_batch(lengths, n, size, budget, alone)
        exits, counts = [0] * (n + size), [0] * (n + size)
        for i in range(n - 1, -1, -1):
            j = after[i]
            exits[i], counts[i] = (j - n, 1) if j >= n else (exits[j], counts[j] + 1)
        for i in range(n, n + size):
            exits[i] = i - n
        return pd.DataFrame([(key[0], key[1], exits[:size], counts[:size])], columns=["g", "s", "exits", "counts"])

    slices = keep(placed.unionByName(ahead).groupBy("g", "s").applyInPandas(table, f"g {kind}, s long, exits array<int>, counts array<long>"), "slices")
    most = (slices.agg(F.max("s")).first()[0] or 0) + 1
    entered = _entries(slices, most, size, fan, kind)

    def number(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        after = _next_batch(own["c"].tolist(), len(own), size, budget, alone)
        entry, batch = int(told["entry"].iloc[0]), int(told["base"].iloc[0])
        out, i = [batch - 1] * min(entry, len(own)), entry
        while i < len(own):
            out += [batch] * (min(after[i], len(own)) - i)
            i, batch = after[i], batch + 1
        return own[["g", "o", "c"]].assign(batch=out)

    packed = placed.groupBy("g", "s").cogroup(entered.groupBy("g", "s")).applyInPandas(number, f"g {kind}, o {kinds[order]}, c long, batch long")
    return packed.select(F.col("g").alias(group), F.col("o").alias(order), F.col("c").alias(chars), "batch")


def ordered_index(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with the position of each row in the order of the named columns, counted from `first`.

    Rows are range-partitioned and sorted; a row's position is its place in its
    partition and the rows of the partitions before, one number a partition. The
    partitions are written once, as places and counts must come from the same ones.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_qm_p": F.spark_partition_id(), "_qm_i": place})
    local = keep(cut, "index")
    sizes = local.groupBy("_qm_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_qm_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_qm_p", before.alias("_qm_s"))
    return local.join(F.broadcast(starts), "_qm_p").withColumn(name, F.col("_qm_s") + F.col("_qm_i") + first).drop("_qm_p", "_qm_i", "_qm_s")


def stable_index(ids: DataFrame, key: str) -> DataFrame:
    """(key, idx): position of each id in sorted order."""
    return ordered_index(ids.select(key), [key], "idx")


def circular_sample(ids: DataFrame, queries: DataFrame, key: str, k: int, seed: str, query_key: str, query_text: str) -> DataFrame:
    """(query, key, place): for every query the k ids that follow a hashed offset in sorted order, wrapping round.

    Each query names the k indices it needs, so ids and queries meet by index.
    """
    index = stable_index(ids, key)
    total = ids.count()
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(query_text)).cast("binary"), 256), 1, 15), 16, 10).cast("long")
    wanted = queries.select(query_key, F.pmod(h, F.lit(total)).alias("offset")).select(query_key, "offset", F.explode(F.sequence(F.lit(0), F.lit(min(k, total) - 1))).alias("place"))
    return wanted.withColumn("idx", F.pmod(F.col("offset") + F.col("place"), F.lit(total))).join(index, "idx").select(query_key, key, "place")


def select_by_ids(df: DataFrame, lines: DataFrame, key: str, line: str = "value", position: str = "pos") -> DataFrame:
    """Rows named by an ordered id list, with `pos` and `problem`: unknown ids and repeats are reported, blanks and comments dropped."""
    wanted = lines.select(F.trim(line).alias("id"), F.col(position).alias("pos")).filter((F.col("id") != "") & ~F.startswith("id", F.lit("#")))
    seen = wanted.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    joined = seen.join(df.withColumn("id", F.col(key).cast("string")), "id", "left")
    problem = F.when(F.col(key).isNull(), "unknown").when(F.col("nth") > 1, "duplicate")
    return joined.withColumn("problem", problem).drop("nth")


def running_progress(batches: DataFrame, run: str, order: str, counters: list[str]) -> DataFrame:
    """Counters summed up batch by batch inside each run."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return batches.withColumns({f"total_{c}": F.sum(c).over(w) for c in counters})


def with_position(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the position, from 0, of each row within its group, groups being split over tasks by range."""
    placed = ordered_index(df, [*group, *order], "_qm_at")
    first = placed.groupBy(*[F.col(g).alias(f"_qm_g{k}") for k, g in enumerate(group)]).agg(F.min("_qm_at").alias("_qm_first"))
    on = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_qm_g{k}")) for k, g in enumerate(group)])
    kept = [c for c in df.columns if c != name]
    return placed.join(first, on).select(*kept, (F.col("_qm_at") - F.col("_qm_first")).alias(name))


def with_shard(entries: DataFrame, work: str, order: str, rows: int = 1000, name: str = "shard") -> DataFrame:
    """entries with floor(position / rows) within the work."""
    placed = with_position(entries, [work], [order], name)
    return placed.withColumn(name, F.floor(F.col(name) / rows).cast("int"))

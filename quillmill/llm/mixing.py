"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: sources in code-point order (null last) weigh
3, 1, 2, repeating, and share `budget` times all words; a target stops at `cap`
times its source's words and the excess is shared again by weight. Each document
then has the fractional copy count target / source words. The whole part is taken
as it is; the fractions are rounded by the pivotal method: two fractional
documents of a source meet, words move at random from one to the other (in
expectation none) until one of them is integral, and the other one goes on. The
words of a source are kept by every such step, so a source ends within one
document of its target.

Documents are dealt into buckets of about `bucket_rows` by a hash of id and size,
whatever their source, so that a hot source is spread over all buckets. Each
bucket leaves at most one fractional document a source, and a reduction tree of
fan-in `fan` combines those until none is left.

Cases: a null or empty text has size 0 and takes nothing. Rows are told apart by
nothing but id and size, so repeated rows are rounded as documents of their own.
An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, Stash, text_of

STATE = "id {id}, source string, size long, source_size long, target double, whole long, p double, order long, u double, bucket long, open boolean"


def source_targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (3, 1, 2)) -> DataFrame:
    """(source, source_size) -> with target. One row a source passes the windows, however many documents there are."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("fill", F.col("most") / F.col("w"))
    # Sources that are full at the lowest level of filling come first; the level follows from those before.
    up = W.orderBy("fill", F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open_w"))
        .withColumn("free", F.col("fill") > F.col("level"))
    )
    level = F.min(F.when(F.col("free"), F.struct("fill", "level"))).over(everything)["level"]
    return s.withColumn("target", F.when(F.col("free"), level * F.col("w")).otherwise(F.col("most"))).select("source", "source_size", "target")


def _pivot(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds the open rows of each source of one group until at most one a source is open."""
    rows = rows.sort_values(["source", "order", "id"], na_position="last", kind="stable").reset_index(drop=True)
    p, size, u = rows["p"].to_numpy(copy=True), rows["size"].to_numpy(float), rows["u"].to_numpy()
    source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    left = -1
    for i in np.flatnonzero(rows["open"].to_numpy()):
        if left < 0 or source[left] != source[i]:
            left = i
            continue
        up = min((1 - p[left]) * size[left], p[i] * size[i])
        down = min(p[left] * size[left], (1 - p[i]) * size[i])
        t = up if u[i] * (up + down) < down else -down
        full_left = (t > 0 and up == (1 - p[left]) * size[left]) or (t < 0 and down == p[left] * size[left])
        full_i = (t > 0 and up == p[i] * size[i]) or (t < 0 and down == (1 - p[i]) * size[i])
        p[left] = round(p[left]) if t == 0 else p[left] + t / size[left]
        p[i] = p[i] - t / size[i]
        if full_left:
            p[left] = float(t > 0)
        if full_i:
            p[i] = float(t < 0)
        if full_left and full_i:
            left = -1
        elif full_left:
            left = i
    rows["p"] = p
    rows["open"] = (p > 0) & (p < 1)
    return rows


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float = 1.5,
    cap: float = 2.0,
    weights: Sequence[float] = (3, 1, 2),
    seed: int = 17,
    bucket_rows: int = 8192,
    fan: int = 16,
) -> DataFrame:
    """One row a document: (id, source, size, source_size, target, copies, taken)."""
    spark = docs.sparkSession
    stash = Stash(spark, "mix")
    kind = dict(docs.dtypes)[id_col]
    schema = STATE.format(id=kind)
    sized = stash.keep(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size")), "sized"
    )
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget, cap, weights)
    buckets = max(1, -(-sized.count() // bucket_rows))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    a, t = sized.alias("a"), targets.alias("t")
    start = (
        a.join(t, F.col("a.source").eqNullSafe(F.col("t.source")), "left")
        .select("a.id", "a.source", "a.size", "t.source_size", "t.target", copies.alias("p"))
        .withColumn("whole", F.floor("p").cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("p") - F.col("whole")).otherwise(0.0))
        .withColumn("order", F.xxhash64("id", "size", F.lit(seed)))
        .withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "size", "id"), 11) / F.lit(float(1 << 53)))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), F.lit(buckets)))
        .withColumn("open", (F.col("p") > 0) & (F.col("p") < 1))
        .select("id", "source", "size", "source_size", "target", "whole", "p", "order", "u", "bucket", "open")
    )
    level = stash.keep(start.groupBy("bucket").applyInPandas(_pivot, schema), "level0")
    done, n, k = [level.filter(~F.col("open"))], buckets, 0
    while n > 1:
        n, k = -(-n // fan), k + 1
        up = level.filter("open").withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        level = stash.keep(up.groupBy("source", "bucket").applyInPandas(_pivot, schema), f"level{k}")
        done.append(level.filter(~F.col("open")))
    last = level.filter("open").withColumn("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0))
    out = last
    for d in done:
        out = out.unionByName(d)
    chosen = F.col("whole") + F.round("p").cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", chosen.alias("copies"), (chosen * F.col("size")).alias("taken"))

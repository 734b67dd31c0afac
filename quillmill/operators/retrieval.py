"""Retrieval for many queries at once: gram index, phrase recall, BM25, ranking, gates and offers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmill.shared import keep


def grams(text: Column, n: int = 3) -> Column:
    """All n-grams of a text, in order.

    The characters are taken apart once: a substring at a place would count
    characters from the start of the text for each gram.
    """
    def of(chars: Column) -> Column:
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(F.split(text, "")), of), 1)


def counted(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of some texts, and (place of the gram, place of the text, times) of each that a text has, by gram."""
    whole = "".join(texts)
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
    most = max(0, len(chars) - n + 1)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.flatnonzero(row[:most] == row[n - 1 : n - 1 + most])  # not across two texts
    code, bits = chars[at], 21
    for k in range(1, n):
        if bits + 21 > 63:
            seen, code = np.unique(code, return_inverse=True)
            bits = len(seen).bit_length()
        code, bits = (code << 21) | chars[at + k], bits + 21
    seen, first, gram = np.unique(code, return_index=True, return_inverse=True)
    pair, tf = np.unique(gram * len(texts) + row[at], return_counts=True)
    return [whole[i : i + n] for i in at[first].tolist()], pair // max(1, len(texts)), pair % max(1, len(texts)), tf


def counted_batches(key: str, fields: list[str], n: int, most: int = 500_000):
    """A mapInArrow helper: (field, keys, *counted(texts)) for blocks of rows with about `most` characters of a field."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for field in fields:
                texts = [t or "" for t in b.column(field).to_pylist()]
                block = np.cumsum([len(t) for t in texts]) // most
                for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
                    if len(part):
                        yield field, b.column(key).slice(part[0], len(part)), *counted(texts[part[0] : part[-1] + 1], n)

    return run


def build_index(entries: DataFrame, key: str, fields: list[str], n: int = 3) -> DataFrame:
    """Postings (gram, field, key, tf).

    All postings of a row come from that row, so rows are dealt by key first and grams are
    counted where they are made, block by block: texts cross the network once, postings
    never (but where a key has several rows).
    """
    blocks = counted_batches(key, fields, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for field, keys, grams, gram, row, tf in blocks(batches):
            names = pa.array(grams, pa.string()).take(pa.array(gram))
            yield pa.RecordBatch.from_arrays([names, pa.array([field]).take(pa.array(np.zeros(len(tf), np.int64))), keys.take(pa.array(row)), pa.array(tf, pa.int64())], ["gram", "field", key, "tf"])

    rows = entries.select(key, *[F.lower(f).alias(f) for f in fields]).repartition(key)
    found = rows.mapInArrow(run, f"gram string, field string, `{key}` {dict(entries.dtypes)[key]}, tf long")
    if entries.groupBy(key).count().filter("count > 1").limit(1).count():
        return found.groupBy("gram", "field", key).agg(F.sum("tf").alias("tf"))
    return found


def expand_terms(queries: DataFrame, key: str, text: str, aliases: DataFrame, per_hit: int = 2, most: int = 8) -> DataFrame:
    """(key, term, place): up to `per_hit` aliases (name, place, alias, nth) of each name the query contains, distinct, at most `most`."""
    hits = queries.join(F.broadcast(aliases.filter(F.col("nth") <= per_hit)), F.contains(queries[text], aliases["name"])).select(key, "place", "nth", "alias")
    first = hits.groupBy(key, "alias").agg(F.min(F.struct("place", "nth")).alias("at"))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("at", "alias")))
    return ranked.filter(F.col("place") <= most).select(key, F.col("alias").alias("term"), "place")


def _phrase_finder(shared):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for low in shared.value:
            machine.add_word(low, low)
        machine.make_automaton()
        for b in batches:
            out = []
            for doc, field, v in zip(b["doc"], b["field"], b["v"], strict=True):
                tf: Counter = Counter()
                free: dict[str, int] = {}
                for end, low in machine.iter(v):
                    if end - len(low) >= free.get(low, -1):  # occurrences do not overlap
                        tf[low] += 1
                        free[low] = end
                out += [(doc, field, low, n, len(v)) for low, n in tf.items()]
            yield pd.DataFrame(out, columns=["doc", "field", "low", "tf", "length"]).astype({"tf": "int64", "length": "int64"})

    return find


def phrase_matches(docs: DataFrame, doc_key: str, fields: list[str], phrases: DataFrame, query_key: str, block: int = 100_000, small: int = 200_000) -> DataFrame:
    """(query, term, doc, field, tf, length): documents that hold a phrase of `phrases` (query, term), counted by containment.

    The phrases are the stated side: they go to the tasks in blocks of at most
    `block`, and each block is one pass over the texts that meets all its phrases at
    once, so that cost hardly depends on their number and only matches leave a task.
    """
    spark = docs.sparkSession
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(F.col(f), F.lit(""))).alias("v")) for f in fields])
    values = docs.select(F.col(doc_key).alias("doc"), F.inline(each))
    schema = f"doc {dict(docs.dtypes)[doc_key]}, field string, low string, tf long, length long"
    found = spark.createDataFrame([], schema)
    terms = (r[0] for r in phrases.select(F.lower("term").alias("low")).filter("low <> ''").distinct().toLocalIterator())
    while own := list(islice(terms, block)):
        found = found.unionByName(values.mapInPandas(_phrase_finder(spark.sparkContext.broadcast(own)), schema))
    asked = phrases.select(query_key, "term", F.lower("term").alias("low"))
    # few phrases meet a hot term's documents where those are
    asked = F.broadcast(asked) if phrases.count() <= small else asked
    return found.join(asked, "low").select(query_key, "term", "doc", "field", "tf", "length")


def bm25(docs: DataFrame, doc_key: str, weights: dict[str, float], phrases: DataFrame, query_key: str, k1: float = 1.2, b: float = 0.75, matches: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """(query, doc, score): field-weighted BM25 over phrases; idf is kept above zero.

    matches and size, where an index has them: what `phrase_matches` tells, and one row of
    n and avg_<field>.
    """
    fields = [f for f, w in weights.items() if w > 0]
    m = keep(phrase_matches(docs, doc_key, fields, phrases, query_key) if matches is None else matches, "matches")
    if size is None:
        size = docs.agg(F.count("*").alias("n"), *[F.avg(F.length(F.coalesce(F.col(f), F.lit("")))).alias(f"avg_{f}") for f in fields])
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(weights[f]))) for f in fields])
    mean = F.coalesce(*[F.when(F.col("field") == f, F.col(f"avg_{f}")) for f in fields])
    per_doc = m.join(F.broadcast(size)).withColumn("w", weight * F.col("tf") / (1 - b + b * F.col("length") / mean))
    tf = per_doc.groupBy(query_key, "term", "doc", "n").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)
    return tf.join(df, "term").groupBy(query_key, "doc").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query_key: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each query with their rank; the filter stands on the rank, so tasks keep k rows before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(*order))).filter(F.col("rank") <= k)


def fetch_rows(ranked: DataFrame, wide: DataFrame, doc_key: str, columns: list[str]) -> DataFrame:
    """Wide rows of ranked ids only: ids first, texts after."""
    return ranked.join(wide.select(F.col(doc_key).alias("doc"), *columns), "doc")


def fill_shortfall(recalled: DataFrame, sampled: DataFrame, query_key: str, k: int) -> DataFrame:
    """Recalled rows (query, doc, rank), then sampled ones (query, doc, place) not yet among them, k a query; mode says which."""
    extra = sampled.join(recalled, [query_key, "doc"], "left_anti").select(query_key, "doc", F.lit(1).alias("late"), F.col("place").alias("o"))
    both = recalled.select(query_key, "doc", F.lit(0).alias("late"), F.col("rank").alias("o")).unionByName(extra)
    place = F.row_number().over(W.partitionBy(query_key).orderBy("late", "o", "doc"))
    mode = F.when(F.col("late") == 0, "full_text").otherwise("stable_sample")
    return both.withColumn("place", place).filter(F.col("place") <= k).select(query_key, "doc", "place", mode.alias("mode"))


def facet_score(pairs: DataFrame, query_text: str, story_text: str, facets: list[tuple[str, list[str], list[str]]], affinity: Column, direct: Column, matched: Column, curated: Column, broad: Column) -> Column:
    """Relevance of a candidate: 4 and up to 2 more a facet hit on both sides, 3 for affinity, 2 a direct specific signal, up to 6 for matched terms; 1 for a broad overlap of curated rows."""
    score = F.lit(0)
    for _, user_terms, story_terms in facets:
        user = sum((F.contains(F.col(query_text), F.lit(t)).cast("int") for t in user_terms), F.lit(0))
        story = F.rlike(story_text, F.lit("|".join(story_terms)))
        score = score + F.when((user > 0) & story, 4 + F.least(user - 1, F.lit(2))).otherwise(0)
    score = score + F.when(affinity, 3).otherwise(0) + 2 * direct + F.least(F.lit(6), matched * 3)
    return F.when((score == 0) & broad & curated, 1).otherwise(score)


def confident(score: Column, model: Column, curated: Column, matched: Column, specific: Column) -> Column:
    """Whether a candidate may be offered; a model score under 0.55 always rejects."""
    recalled = (matched > 0) & (score >= 3)
    own = (score >= 3) | F.coalesce(model >= 0.72, F.lit(False)) | (~specific & (score >= 1))
    return F.coalesce(model >= 0.55, F.lit(True)) & F.when(curated, own).otherwise(recalled)


def rerank_shortlist(ranked: DataFrame, query_key: str, tier: str, most: dict[str, int], order: list[Column], total: int = 8) -> DataFrame:
    """The first rows of each tier up to that tier's share, `total` in all."""
    place = F.row_number().over(W.partitionBy(query_key, tier).orderBy(*order))
    share = F.coalesce(*[F.when(F.col(tier) == k, F.lit(n)) for k, n in most.items()], F.lit(0))
    kept = ranked.withColumn("tier_place", place).filter(F.col("tier_place") <= share)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(query_key).orderBy(*order))).filter(F.col("place") <= total)


def valid_rerank(answers: DataFrame, candidates: DataFrame, query_key: str) -> DataFrame:
    """candidates (query, doc, score) with `model`: a query's answers (query, doc, model) count only if every candidate is answered once, in [0, 1]; else null."""
    a = answers.groupBy(query_key, "doc").agg(F.count("*").alias("times"), F.first("model").alias("model"))
    both = candidates.select(query_key, "doc").withColumn("known", F.lit(True)).join(a, [query_key, "doc"], "full")
    bad = F.col("known").isNull() | F.col("times").isNull() | (F.col("times") > 1) | ~F.col("model").between(0, 1)
    ok = both.groupBy(query_key).agg(F.bool_and(~F.coalesce(bad, F.lit(True))).alias("ok"))
    return candidates.join(a.select(query_key, "doc", "model"), [query_key, "doc"], "left").join(ok, query_key, "left").withColumn("model", F.when(F.col("ok"), F.col("model")))


def best_of_family(ranked: DataFrame, query_key: str, family: str, order: list[Column]) -> DataFrame:
    """One row a family and query, the first in ranking order."""
    return ranked.withColumn("_qm_n", F.row_number().over(W.partitionBy(query_key, family).orderBy(*order))).filter("_qm_n = 1").drop("_qm_n")


def offers(candidates: DataFrame, seen: DataFrame, query_key: str, family: str, limit: int, order: list[Column]) -> DataFrame:
    """candidates by family, families already seen left out, at most 2 to 3 rows, with the status of the whole offer."""
    k = min(max(limit, 2), 3)
    fresh = best_of_family(candidates.join(seen, [query_key, family], "left_anti"), query_key, family, order)
    n = F.count("*").over(W.partitionBy(query_key))
    out = fresh.withColumns({"place": F.row_number().over(W.partitionBy(query_key).orderBy(*order)), "available": n}).filter(F.col("place") <= k)
    status = F.when(F.col("available") >= k, "matched").otherwise("partial")
    return out.withColumns({"status": status, "exhausted": F.col("available") <= k})


def summary_gate(summary: DataFrame, work_counts: DataFrame) -> DataFrame:
    """The one-row summary if its counts agree with each other and with the counts by work; else nothing."""
    total = work_counts.agg(F.sum("n").alias("of_works"))
    ok = (F.col("rejected") <= F.col("raw")) & (F.col("unique_rows") <= F.col("raw") - F.col("rejected")) & (F.col("full_rows") <= F.col("unique_rows")) & (F.col("of_works") == F.col("unique_rows"))
    return summary.join(F.broadcast(total)).filter(ok).drop("of_works")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows added up from left to right, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _nearest(shared, k: int, names: tuple[str, str], chunk: int = 256):
    """The k best rows of a task for each query of a block: a matrix product leaves few pairs, and these are scored and ranked exactly."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        qn = np.sqrt(_dot(q, q))
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, ids.dtype)) for _ in range(0, len(ids), chunk)]
        floor = np.full(len(ids), -np.inf)
        for b in batches:
            keys, v = b["_qm_k"].to_numpy(), np.stack(b["_qm_v"].to_numpy()).astype(np.float64)
            vn = np.sqrt(_dot(v, v))
            unit = v / vn[:, None]
            for c, at in enumerate(range(0, len(ids), chunk)):
                near = (q[at : at + chunk] / qn[at : at + chunk, None]) @ unit.T
                least = floor[at : at + chunk]
                if len(keys) > k + 1:  # the query itself may be among them
                    least = np.maximum(least, np.partition(near, len(keys) - k - 1, axis=1)[:, len(keys) - k - 1])
                i, j = np.nonzero(near >= least[:, None] - 1e-9)
                i, j = i[keys[j] != ids[at + i]], j[keys[j] != ids[at + i]]
                score = np.concatenate([_dot(v[j[p : p + 100_000]], q[at + i[p : p + 100_000]]) for p in range(0, max(1, len(i)), 100_000)])
                who, score, key = (np.concatenate(x) for x in zip(best[c], (i, score / (vn[j] * qn[at + i]), keys[j]), strict=True))
                order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, who))
                who, score, key = who[order], score[order], key[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                best[c] = who[place < k], score[place < k], key[place < k]
                last = place == k - 1
                floor[at + who[last]] = score[last]
        for c, (who, score, key) in enumerate(best):
            yield pd.DataFrame({names[0]: ids[c * chunk + who], names[1]: key, "score": score})

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str, k: int, block: int = 10_000) -> DataFrame:
    """(query, key, rank, score): a stated query set against all vectors, in blocks of about `block` queries; each task keeps k rows a query.

    Every pair is looked at, as a matrix product in the tasks. Vectors without a length
    (null, empty, zero or not finite) and those of another size meet the others in a join.
    """
    spark = vectors.sparkSession
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    left = vectors.select(F.col(key).alias("_qm_k"), F.col(vector).alias("_qm_v"), norm(F.col(vector)).alias("_qm_n"))
    right = queries.select(F.col(query_key).alias("_qm_q"), F.col(vector).alias("_qm_w"), norm(F.col(vector)).alias("_qm_m"))
    size = right.agg(F.max(F.size("_qm_w"))).first()[0] or 0
    whole = lambda i, v, n: F.coalesce(F.col(i).isNotNull() & (F.size(v) == size) & (F.col(n) > 0) & (F.col(n) < float("inf")), F.lit(False))
    good, fine = whole("_qm_k", "_qm_v", "_qm_n"), whole("_qm_q", "_qm_w", "_qm_m")
    dot = F.aggregate(F.zip_with("_qm_v", "_qm_w", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    schema = f"_qm_q {kinds[1]}, _qm_k {kinds[0]}, score double"
    blocks = max(1, -(-queries.count() // block))
    parts = []
    for i in range(blocks):
        own = right.filter(F.pmod(F.xxhash64("_qm_q"), F.lit(blocks)) == i)  # about `block` vectors
        asked = own.filter(fine).select("_qm_q", "_qm_w").toPandas()
        if len(asked):
            shared = spark.sparkContext.broadcast((asked["_qm_q"].to_numpy(), np.stack(asked["_qm_w"].to_numpy()).astype(np.float64)))
            parts.append(left.filter(good).select("_qm_k", "_qm_v").mapInPandas(_nearest(shared, k, ("_qm_q", "_qm_k")), schema))
    for rows, asked in ((left.filter(~good), right), (left.filter(good), right.filter(~fine))):
        if rows.limit(1).count() and asked.limit(1).count():
            met = rows.join(F.broadcast(asked), F.col("_qm_k") != F.col("_qm_q"))
            parts.append(met.select("_qm_q", "_qm_k", (dot / (F.col("_qm_n") * F.col("_qm_m"))).alias("score")))
    scored = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return top_k(scored, "_qm_q", k, [F.desc("score"), F.col("_qm_k")]).select(F.col("_qm_q").alias("query"), F.col("_qm_k").alias(key), "rank", "score")


def fuse_ranks(lists: list[DataFrame], query_key: str, doc: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query, doc, rank)."""
    every = None
    for df in lists:
        part = df.select(query_key, doc, (1 / (k + F.col("rank"))).alias("r"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(query_key, doc).agg(F.sum("r").alias("fused"))

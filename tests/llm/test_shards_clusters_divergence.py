"""External shuffle, threshold-algorithm clustering and the divergence audit against brute force."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import centroids, divergence, queries, sharding

SMALL = DATA / "sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, shard string"
ODD = [
    (1, "alpha beta", "en", "s1", "x"),
    (1, "alpha beta", "en", "s1", "x"),
    (2, None, None, "s1", None),
    (None, "", "en", None, "y"),
    (None, None, None, None, None),
    (3, "word " * 300_000 + "end", "en", "s2", "z"),
    (4, "q" * 5_000, "de", "s2", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


# ------------------------------------------------------------ 11 sharding


def check_law(rows, shards=24):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_slots(keys, shards=24):
    """(record, key, bucket) to (record, shard, slot): buckets one after the other, each in shuffled order."""
    buckets = defaultdict(list)
    for record, key, bucket in keys:
        buckets[bucket].append((key, record))
    line = []
    for b in sorted(buckets):
        own = sorted(buckets[b])
        order = np.arange(len(own))
        np.random.default_rng([11, b]).shuffle(order)
        line += [own[i][1] for i in order]
    cuts = [len(line) // shards + (s < len(line) % shards) for s in range(shards)]
    out, at = [], 0
    for s, n in enumerate(cuts):
        out += [(record, s, k) for k, record in enumerate(line[at : at + n])]
        at += n
    return out


@pytest.mark.parametrize("bucket_bytes", [20_000, 32 << 20])
def test_shards_of_documents(spark, tmp_path, bucket_bytes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sharding.placements(sharding.write_shards(docs, f"file://{tmp_path}/a", bucket_bytes=bucket_bytes)).collect()
    check_law(got)
    total = sum(len((r.text or "").encode()) + 8 for r in docs.collect())
    key = F.xxhash64(*docs.columns)
    bucket = F.pmod(F.xxhash64(F.lit(11), key, F.lit(0).cast("long")), F.lit(max(1, -(-total // bucket_bytes))))
    want = brute_slots([tuple(r) for r in docs.select("doc_id", key, bucket).collect()])
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted(want)
    # another deal of the input gives the same slots
    again = sharding.external_shuffle(docs.repartition(7), bucket_bytes=bucket_bytes).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_the_query_tells_what_was_written(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    import zlib

    rows = queries.op11_sharding(spark, str(SMALL)).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
    check_law(rows)
    # neighbours in the input do not stay neighbours
    place = {r.doc_id: r.shard * 1000 + r.slot for r in rows}
    ids = sorted(place)
    assert abs(np.corrcoef([place[i] for i in ids], ids)[0, 1]) < 0.3


def test_files_hold_slots_in_order(spark, tmp_path):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    sharding.write_shards(docs, f"file://{tmp_path}/b", shards=3, bucket_bytes=4000)
    import pyarrow.parquet as pq

    files = [f for f in tmp_path.rglob("*.parquet")]
    assert len(files) >= 3
    for f in files:
        slots = pq.ParquetFile(f).read(columns=["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)


def test_shards_of_odd_rows(odd):
    out = sharding.external_shuffle(odd, shards=3, bucket_bytes=100)
    assert out.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in rows) == Counter(r[:4] for r in ODD)
    check_law(rows, 3)
    assert sharding.external_shuffle(odd.limit(0)).count() == 0
    few = sharding.external_shuffle(odd, shards=24).collect()
    check_law(few)


def test_records_that_are_there_often_are_spread(spark, monkeypatch):
    """A third of all rows is one record: its copies go to all buckets."""
    monkeypatch.setattr(sharding, "CHUNK", 100)
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    rest = spark.range(6000).select((F.col("id") + 10).alias("doc_id"), F.lit("the same text").alias("text"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    rows = sharding.external_shuffle(same.union(rest), shards=9, bucket_bytes=4000).select("doc_id", "shard", "slot", "m").collect()
    check_law(rows, 9)
    assert Counter(r.doc_id for r in rows)[7] == 3000 and len(rows) == 9000 and all(r.m == {"a": 1} for r in rows)
    own = Counter(r.shard for r in rows if r.doc_id == 7)
    assert all(240 < own[s] < 430 for s in range(9))


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60))
@settings(max_examples=5, deadline=None)
def test_starts_add_up(spark, sizes):
    counts = spark.createDataFrame([(b, n) for b, n in enumerate(sizes) if n > 2] or [(0, 1)], "bucket long, n long")
    got = {r.bucket: r.start for r in sharding.starts(counts, len(sizes), width=3).collect()}
    at = 0
    for r in sorted(counts.collect()):
        assert got[r.bucket] == at
        at += r.n


# ------------------------------------------------------------ 12 centroids


def brute_clusters(rows, k=16, rounds=3, dims=64, scale=64, seed=1):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(fine, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda v: min((far(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in fine:
            own[place(v)[1]].append(v)
        cs = [[sum(col) // len(own[n]) for col in zip(*own[n])] if own[n] else c for n, c in enumerate(cs)]
    got = [(i, *place(v)) for i, v in fine]
    inertia = Counter()
    for _, d, n in got:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in got)


def test_clusters_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op12_centroids(spark, str(SMALL)).collect()) == brute_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    line = [0.5, -0.5, 1.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, line), (1, line), (1, [0.1, 0.2, 0.3]), (None, line), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [-0.0, -1e-9, 3.25])]
    rows += [(100 + n, [float(n % 7), float(n % 3), -float(n % 5)]) for n in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("mine"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (1, 4, 16, 100):
        assert Counter(tuple(r) for r in centroids.cluster(df, dims=3, k=k).collect()) == brute_clusters(single, k=k, dims=3)
    assert centroids.cluster(df.limit(0)).count() == 0 == centroids.cluster(df, dims=5).count()
    too_far = spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert centroids.cluster(too_far, dims=3).count() == 0


@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 2**32 - 1), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_the_walk_finds_the_nearest(k, dims, seed, wide):
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-wide, wide, (k, dims)), rng.integers(-wide, wide, (30, dims))
    d = ((x[:, None, :] - c) ** 2).sum(2)
    label, best, _ = centroids.nearest(x, c)
    assert label.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()


def test_the_walk_stops_early():
    rng = np.random.default_rng(3)
    c = rng.integers(-10_000, 10_000, (500, 3))
    _, _, steps = centroids.nearest(c + 1, c)
    assert steps.max() <= 50 and steps.mean() < 10  # of 500 possible


# ------------------------------------------------------------ 13 divergence


def brute_audit(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, df, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        groups.add((lang, source))
        for t in terms:
            n[lang, source, t] += 1
        for t in set(terms):
            df[lang, t] += 1
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), d in df.items() if g == lang and d >= least]
        sources = [s for g, s in groups if g == lang]
        p = lambda count, total: 1 + 10**9 * (count + 2) // (total + 2 * len(kept))
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        for s in sources:
            pairs = [(sum(f(p(n[lang, s, t], total[s]), p(n[lang, o, t], total[o])) for t in kept), o) for o in sources if o != s]
            terms = []
            for t in kept:
                a, b = p(n[lang, s, t], total[s]), p(sum(n[lang, o, t] for o in sources), sum(total.values()))
                if n[lang, s, t] and a > b:
                    terms.append((f(a, b), t))
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out.update((lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= top)
    return out


SMALL_CELLS = {"block_entries": 20, "block_sources": 2, "cell_rows": 30}


@pytest.mark.parametrize("options", [{}, SMALL_CELLS])
def test_audit_of_documents(spark, options):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = Counter(tuple(r) for r in divergence.audit(docs, **options).collect())
    assert got == brute_audit([(r.lang, r.source, r.text) for r in docs.collect()])


@pytest.mark.parametrize("least", [1, 10])
def test_audit_of_odd_rows(odd, least, monkeypatch):
    monkeypatch.setattr(divergence, "LONG_TEXT", 100)
    monkeypatch.setattr(divergence, "SMALL_TABLE", 0)
    rows = [(lang, source, text) for _, text, lang, source, _ in ODD]
    docs = odd.withColumns({"value": F.lit("mine"), "p": F.lit(0), "term": F.lit("mine"), "v": F.lit(1)})
    for options in ({}, SMALL_CELLS):
        assert Counter(tuple(r) for r in divergence.audit(docs, least_docs=least, **options).collect()) == brute_audit(rows, least)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_one_source_holds_most_rows(spark):
    rows = [("en", "hot", f"Common wörter {k % 13} t{k % 4} 漢字É") for k in range(600)] + [("en", f"s{k % 9}", f"common x{k % 3}x words_{'ab'[k % 2]}") for k in range(90)] + [("", f"s{k % 2}", "COMMON.É") for k in range(15)]
    rows = [(r[0], r[1], r[2].replace("13", "thirteen")) for r in rows]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for options in ({}, SMALL_CELLS):
        assert Counter(tuple(r) for r in divergence.audit(docs, **options).collect()) == brute_audit(rows)


def test_runs_leave_sorted_and_bounded():
    """Postings of sixty documents of fifty terms leave when a hundred are held."""
    block, runs = divergence._Block(), []
    for k in range(60):
        block.read("en", "s", " ".join(chr(97 + (i + k) % 26) * (1 + (i * k) % 7) for i in range(50)).encode())
        block.count()
        if len(block.keys) >= 100:
            runs.append([t for b in block.run() for t in b.column("term").to_pylist()])
            block = divergence._Block()
    assert len(runs) > 3 and all(r == sorted(set(r)) and 100 <= len(r) < 150 for r in runs)

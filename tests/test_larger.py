"""Cases that only larger or odder tables show."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillmill.operators import evidence, kept_index, retrieval, rules
from quillmill.sources import files, pages
from quillmill.streaming import sessions


def test_word_edges_are_ascii(spark):
    df = spark.createDataFrame([(1, "éle ciment"), (2, "xle ciment"), (3, "not deé the nation"), (4, r"a\b the")], "k int, text string")
    r = rules.route(F.col("text"), [r"not de\b"], [("a", r"(?i)\ble [a-z]+ment"), ("b", r"^ é"), ("c", r"a\\b")], "now")
    assert {x.k: x.r.categories for x in df.select("k", r.alias("r")).collect()} == {1: ["a"], 2: [], 3: ["b"], 4: ["c"]}


def test_character_references_that_are_cut_short(spark):
    html = "<article><h1>a &amp;&amp;&amp</h1><p>b &lt; c &lt &copy d&#38;&#38 &nosuch; &notit; R&D</p></article>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = pages.segment_by_heading(df, (1,)).first()
    assert (r.title, r.body) == ("a &&&amp", "b < c &lt &copy d&&#38 &nosuch; &notit; R&D")
    link = df.withColumn("html", F.lit('<a href="x?a=1&copy=2">t&amp;&amp</a>'))
    assert [tuple(x) for x in pages.link_titles(link).collect()] == [("x?a=1&copy=2", "t&&amp")]


def test_postings_of_blocks_and_of_repeated_keys(spark):
    from collections import Counter

    rows = [(1, "Abab", None), (1, "aba𝄞", "x"), (2, "", "xyzxyz"), (3, "ab", "é" * 5), (None, "ßabab", "")]
    want = Counter()
    for k, *texts in rows:
        for field, t in zip("ab", texts, strict=True):
            t = (t or "").lower()
            want.update((t[i : i + 4], field, k) for i in range(len(t) - 3))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = retrieval.build_index(df, "k", ["a", "b"], 4).collect()
    assert len(got) == len(want) and Counter({(r.gram, r.field, r.k): r.tf for r in got}) == want
    few = list(retrieval.counted_batches("k", ["a"], 3, most=3)([df.filter("k = 1").toArrow().combine_chunks().to_batches()[0]]))
    assert len(few) == 2  # a block a text


def test_an_index_keeps_lists_not_rows(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    kept_index.create(docs.coalesce(1), "doc_id", ["text"], f"file://{tmp_path}/i")
    stored = spark.read.parquet(f"file://{tmp_path}/i/segments")
    assert stored.count() == 12 and stored.filter("size(docs) = 300").count() == 12
    index = kept_index.postings(spark, f"file://{tmp_path}/i")
    assert index.count() == 3600 and index.agg(F.sum("tf")).first()[0] == 3600


def test_candidates_come_from_the_rarest_grams(spark, tmp_path):
    docs = spark.createDataFrame([(k, "common words here" + (" zqxj" if k == 7 else "")) for k in range(50)], "doc_id long, text string")
    kept_index.create(docs, "doc_id", ["text"], f"file://{tmp_path}/i")
    asked = spark.createDataFrame([(1, "common words here zqxj"), (2, "zqxj common")], "q long, term string")
    index = kept_index.postings(spark, f"file://{tmp_path}/i")
    plan = kept_index.candidates(index, asked, "q", ["text"])
    assert {(r.q, r.doc) for r in plan.collect()} == {(1, 7)}
    rarest = plan.inputFiles()
    assert sum(r.asked for r in [spark.read.parquet(f).agg(F.count("*").alias("asked")).first() for f in rarest if "rarest-" in f]) <= 2 * 2 * kept_index.RAREST
    assert [r.tf for r in kept_index.phrase_matches(index, docs, "doc_id", ["text"], asked, "q").collect()] == [1]


def test_nearest_vectors_with_ties_and_odd_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(-3, 4, (60, 5)).astype(float)
    rows = [(k, (base[k % 60] * (1 + k % 3)).tolist()) for k in range(300)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([x for x in rows if x[1] is None or any(x[1])], "k long, v array<double>").repartition(3)
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
    known = {k: v for k, v in rows if v and all(x is not None for x in v) and any(v)}
    got = retrieval.cosine_top_k(df, df.filter("k % 20 = 0 and k < 900"), "k", "k", "v", 7, block=6).collect()
    assert any("mapInPandas" in x or "MapInPandas" in x for x in [retrieval.cosine_top_k(df, df.filter("k = 20"), "k", "k", "v", 7)._jdf.queryExecution().toString()])
    for q in [k for k in known if k % 20 == 0]:
        order = sorted((-dot(v, known[q]) / (dot(v, v) ** 0.5 * dot(known[q], known[q]) ** 0.5), k) for k, v in known.items() if k != q)
        assert [k for _, k in order[:7]] == [x.k for x in sorted((x for x in got if x.query == q), key=lambda x: x["rank"])]


def test_shards_are_files_of_one_folder_a_work(spark, tmp_path):
    rows = spark.createDataFrame([(k, ["a", "b", "", None][k % 4], "x\ry z") for k in range(55)], "entry_id long, work string, text string")
    path = f"file://{tmp_path}/s"
    m = files.write_shards(rows.repartition(5), path, "work", "entry_id", 3).collect()
    assert sorted(r.rows for r in m) == [2, 2] + [3] * 17 and not list(tmp_path.glob("s/*/*/*.json"))
    for f in tmp_path.glob("s/work=a/*.json"):
        ids = sorted(json.loads(x)["entry_id"] for x in f.read_text().split("\n") if x)
        assert ids == list(range(ids[0], ids[-1] + 1, 4))
    assert files.read_shards(spark, path, "entry_id long, text string").count() == 55
    (tmp_path / "s/work=a/stray.json").write_text('{"entry_id": 1}')
    told = files.verify_shards(spark, path, "entry_id long", spark.createDataFrame(m)).collect()
    assert [r.problem for r in told] == ["unlisted"]


def test_batches_of_python_workers_are_small(spark):
    from quillmill.shipping import BATCH, ship

    before = spark.conf.get(BATCH)
    ship(spark)
    assert int(spark.conf.get(BATCH)) == 1000
    spark.conf.set(BATCH, before)
    sizes = pages.elements(spark.range(250).select(F.col("id").alias("page_id"), F.lit("<p>a").alias("html")).coalesce(1))
    assert sizes.count() == 500


def test_cover_takes_one_small_row_an_entry(spark):
    e = spark.createDataFrame([(k, f"{'x' * (i % 7)}{i}", i, [f"s{i % 5}"]) for k in range(3) for i in range(200)], "entry_id long, excerpt string, start long, supports array<string>")
    need = e.select("entry_id", F.explode("supports").alias("support")).distinct()
    out = evidence.compact(e, need)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = [(r.start, r.excerpt) for r in out.filter("entry_id = 1").orderBy("start", "excerpt").collect()]
    assert got == [(i, f"{'x' * (i % 7)}{i}") for i in sorted({0, 1, 7, 14, 28} | set(range(24)))][:24] or len(got) == 24
    assert {i % 5 for i, _ in got} == set(range(5)) and out.filter("ok").count() == 72


def test_no_broadcast_without_large_groups(spark):
    from quillmill.llm.common import join_groups

    rows = spark.range(3000).select((F.col("id") % 1000).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert "Union" not in join_groups(rows, groups, "k", "n", 3000)._jdf.queryExecution().toString()
    assert join_groups(rows, groups, "k", "n", 3000).count() == 3000


def test_quotes_are_aligned_once_for_evidence_and_entries(spark):
    texts = spark.createDataFrame([(1, "一二，三四。五六七八"), (2, "abc def ghi"), (3, None)], "entry_id long, text string")
    quotes = spark.createDataFrame([(1, "二三四", ["a"]), (1, "五六", ["b"]), (2, "abc...ghi", ["a"]), (2, "none", ["b"]), (3, "x y", ["a"]), (3, None, ["b"])], "entry_id long, quote string, supports array<string>")
    found, entries = evidence.settle(quotes, texts, quotes.select("entry_id", F.explode("supports").alias("support")))
    assert not any("ArrowEvalPython" in x._jdf.queryExecution().toString() for x in (found, entries))
    assert sorted((r.entry_id, r.excerpt, r.start, r.end) for r in found.collect()) == [(1, "二，三四", 1, 5), (1, "五六", 6, 8), (2, "abc", 0, 3), (2, "ghi", 8, 11)]
    assert sorted((r.entry_id, r.dropped, r.lost, r.ok) for r in entries.collect()) == [(1, 0, [], True), (2, 1, ["b"], False), (3, 2, ["a", "b"], False)]


def test_places_of_what_is_found_need_no_list_of_all_places():
    import random

    r = random.Random(5)
    notes = f"{evidence.NUMBERED_NOTE}|{evidence.EDITION_NOTE}"
    forms = evidence._writers(((ord("甲"), "乙丙"), (ord("丁"), "")))
    for _ in range(3000):
        text = "".join(r.choice(["甲", "丁", "戊", "，", " ", "「", "(註)", "[1]", "釡", "a", "​"]) for _ in range(r.randrange(30)))
        for form in (*forms, evidence.SAME):
            whole = evidence.places(text, form, notes)
            a = r.randrange(len(whole.text) + 1)
            quote = whole.text[a : a + r.randrange(6)]
            for alone in (True, False):
                assert evidence.locate(text, quote, form, notes, alone) == whole.find(quote, alone)


def test_a_bucket_of_keys_costs_as_many_calls_as_one_key():
    import pandas as pd

    calls = []

    class State(list):
        exists = lambda self: bool(self)
        get = lambda self: calls.append("get") or (self[0] if self and not isinstance(self[0], tuple) else list(self))
        appendList = lambda self, rows: calls.append("append") or self.extend(rows)  # noqa: E731, N815
        put = lambda self, rows: calls.append("put") or self.__setitem__(slice(None), rows)
        update = lambda self, row: calls.append("update") or self.__setitem__(slice(None), [list(row)])

    class Handle:
        getListState = getValueState = lambda self, name, schema: State()  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")  # noqa: E731, N815

    class At:
        getCurrentWatermarkInMs = lambda self: 5  # noqa: E731, N802

    seen = {}

    def step(k, own, due, now):
        seen[k] = [r[0] for r in due]
        return [(k, len(due))], (len(due),), None

    p = sessions._InOrder("", "", ["us", "k", "id"], step, lambda out: pd.DataFrame(out, columns=["k", "n"]))
    p.init(Handle())
    rows = pd.DataFrame([(us, k, None if k % 7 == 0 else str(2**60 + k)) for us in (9000, 4000, 1000, 1000) for k in range(400)], columns=["us", "k", "id"])
    assert not list(p.handleInputRows((3,), iter([rows[:800], rows[800:]]), None)) and not list(p.handleInputRows((-1,), iter([rows]), None))
    (out,) = p.handleExpiredTimer((3,), At(), None)
    assert len(out) == 400 and set(out["n"]) == {3} and all(v == [1000, 1000, 4000] for v in seen.values())
    assert sorted(p.waiting)[0] == (9000, 0, None) and len(p.waiting) == 400 and (9000, 5, 2**60 + 5) in p.waiting
    assert len(p.own) == 400 and len(calls) <= 20


def test_replay_of_many_keys_with_ids_that_no_float_holds(spark, tmp_path):
    import datetime as dt

    schema = "request string, ts timestamp_ntz, event_id long, body string"
    rows = [(f"k{k % 90}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k % 40), None if k == 17 else 2**60 + k, "ab"[k % 3 == 0]) for k in range(900)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"file://{tmp_path}/in")
    s = sessions.read_stream(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema)
    got = sessions.run_to_end(s, lambda e: sessions.replay(e, "request", "body"), spark, f"file://{tmp_path}/out").collect()
    want, first = [], {}
    for k, t, e, b in sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2])):
        if k not in first or t >= first[k][1]:
            first[k] = (b, t + dt.timedelta(hours=24))
            want.append((k, e, "first"))
        else:
            want.append((k, e, "replay" if b == first[k][0] else "conflict"))
    text = lambda x: sorted(map(repr, x))
    assert text((r.request, r.event_id, r.outcome) for r in got) == text(want)


def test_corpus_rules_read_entries_once(spark):
    from quillmill.operators import run

    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passes.add(len(b))
            yield b

    rows = [(k, f"h{k % 5}", "canonical" if k < 5 else "exact_duplicate", k % 5, k < 5, False) for k in range(20)]
    entries = spark.createDataFrame(rows, "entry_id long, normal_sha256 string, dedupe_status string, canonical_id long, runtime_eligible boolean, production_eligible boolean")
    told = run.corpus_rules(entries.select("entry_id"), entries.select("entry_id").limit(0), entries.mapInPandas(count, entries.schema), {"raw": 20, "canonical": 5})
    assert all(r.ok for r in told.collect()) and passes.value == 20


def against_sql(spark, folder, name, texts):
    """Rows of a query and of its SQL over documents with these texts."""
    import duckdb

    from quillmill import registry

    rows = [(k, x, "en", f"src{k % 2}", len(x)) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{folder}/documents.parquet")
    df = registry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in df.collect()), sorted(want)


def test_texts_too_short_to_quote_ask_for_no_title(spark, tmp_path):
    texts = ["", "a", " b ", "\n" * 30 + "c", "ab", " \n\t" * 30, "x" * 50, "Of words there are some, " * 6] * 3
    got, want = against_sql(spark, tmp_path, "e3_drop_unaligned", texts)
    assert got == want and (1, 1, "tone,", False) in got and (0, 1, "tone,end", False) in got


def test_empty_texts_are_published(spark, tmp_path):
    texts = ["", "a", "", "some words", "some, words", " "] * 2
    got, want = against_sql(spark, tmp_path, "s10_publish_entries", texts)
    assert got == want and {r[-2] for r in got} == {12}


def test_near_copies_go_without_a_shuffle_of_texts(spark):
    from quillmill.llm import shingles, simhash

    words = [f"w{k}" for k in range(900)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 7 % 300 :][: 60 + k % 2])) for k in range(40)] + [(50, "one Two"), (51, "one  two")], "doc_id long, text string")
    for drop in (simhash.drop_near_copies, shingles.drop_near_copies):
        kept = drop(docs)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().toString() and 0 < kept.count() < 42


def test_shingles_of_prefixes_by_brute_force(spark):
    from collections import Counter

    import numpy as np

    from quillmill.llm import shingles

    words, common = [f"w{k}" for k in range(4000)], " ".join(f"c{k}" for k in range(40))
    texts = [" ".join(words[k * 60 : k * 60 + 50]) + (f" {common}" if k % 3 == 0 else "") for k in range(60)] + [" ".join(words[60:108]), "", "one two"]
    sets = [shingles.shingle_set(t, 5) for t in texts]
    held = Counter(h for _, own in sets for h in (own.view(np.uint64) >> np.uint64(22)).tolist())
    want = set()
    for fp, own in sets:
        h = sorted((own.view(np.uint64) >> np.uint64(22)).tolist())
        shared = [x for x in h if held[x] > 1]
        some = len(h) - shingles.needed(len(h), 0.8) + 1 - (len(h) - len(shared))
        want |= {(np.uint64(fp).astype(np.int64).item(), x) for x in shared[: max(0, some)]}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert {tuple(r) for r in shingles._prefix_rows(rows, 5, 0.8).collect()} == want and 0 < len(want) < 500


def test_a_text_meets_all_its_phrases_at_once(spark, tmp_path):
    texts = [("Abab abab zzz", "ababab"), ("nothing here", None), ("ABABAB of ab", "of abab"), (None, "zzzz")] * 5
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, "abab"), (2, "ABab"), (2, "abab"), (3, "zzz"), (3, "not there"), (4, "of ab")], "q long, term string")
    path, fields = f"file://{tmp_path}/i", ["title", "text"]
    kept_index.create(docs.filter("doc_id < 9"), "doc_id", fields, path)
    kept_index.add(docs.filter("doc_id >= 9"), "doc_id", fields, path)
    got = kept_index.phrase_matches(kept_index.postings(spark, path), docs, "doc_id", fields, asked, "q")
    want = {(q.q, q.term, k, f, n, len(v)) for q in asked.collect() for k, t in enumerate(texts) for f, v in zip(("text", "title"), (x or "" for x in t), strict=True) if (n := v.lower().count(q.term.lower()))}
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r[c] for c in ("q", "term", "doc", "field", "tf", "length")) for r in rows} == want
    # texts are not repeated for each phrase: they meet one row a document
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "replace(" not in plan and "MapInPandas" in plan

"""Hand-made cases of the corpus operators."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import curation, dedup, evidence, ledger, retrieval, rules, sampling
from quillmill.sources import files, pages


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_clip_backs_off_to_a_sentence_end(spark):
    text = "a" * 45 + ". " + "b" * 30
    assert one(spark, tx.clip_at_sentence(F.col("t"), 60), t=text) == "a" * 45 + ".…"
    assert one(spark, tx.clip_at_sentence(F.col("t"), 60), t="c" * 80) == "c" * 60 + "…"
    assert one(spark, tx.clip_at_sentence(F.col("t"), 60), t=" short  text ") == "short text"
    assert one(spark, tx.clip_at_sentence(F.col("t").cast("string"), 60), t=None) is None


def test_identity_scrub(spark):
    assert one(spark, tx.scrub_identity(F.col("t")), t="mail me@x.org or 13812345678, id 11010519491231002X, no 123456 but 12345") == "mail or , id , no but 12345"


def test_first_row_of_a_hash_stays(spark):
    rows = [(3, "b", "Same text!"), (2, "b", "Same, text"), (1, "c", "same text"), (4, "a", None), (5, "a", None)]
    df = spark.createDataFrame(rows, "entry_id long, work string, text string")
    got = {r.entry_id: r.canonical_id for r in dedup.mark_duplicates(dedup.with_hashes(df).fillna("none", ["normal_sha256"])).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_packing_closes_on_count_and_budget(spark):
    rows = [("w", i, n) for i, n in enumerate([1000, 2000, 1500, 3500, 10, 10, 10])]
    df = spark.createDataFrame(rows, "work string, entry_id long, char_count long")
    got = [r.batch for r in sampling.pack_batches(df, "work", "entry_id", "char_count", size=2).orderBy("entry_id").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def greedy(lengths, size=6, budget=4000, alone=3000):
    out, batch, n, total = [], -1, 0, 0
    for c in lengths:
        if c > alone:
            batch, n = batch + 1, 0
        else:
            if n == 0 or n >= size or total + c > budget:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + c
        out.append(batch)
    return out


@pytest.mark.parametrize(("rows_each", "fan"), [(8, 2), (8, 1024), (8192, 1024)])
def test_packing_of_slices_is_greedy(spark, rows_each, fan):
    """A hot work in slices, with several levels of composition, gives the batches of one pass over it."""
    import random

    rng = random.Random(rows_each + fan)
    works = {"hot": 700, "six": 6, "seven": 17, "one": 1, None: 5}
    lengths = {w: [rng.choice([10, 600, 900, 1500, 2900, 3500, 9000]) for _ in range(n)] for w, n in works.items()}
    rows = [(w, i, c) for w, own in lengths.items() for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "work string, entry_id long, char_count long").repartition(5)
    got = {}
    for r in sampling.pack_batches(df.filter("work is not null"), "work", "entry_id", "char_count", rows_each=rows_each, fan=fan).orderBy("entry_id").collect():
        got.setdefault(r.work, []).append(r.batch)
    assert got == {w: greedy(own) for w, own in lengths.items() if w}
    assert sampling.pack_batches(df.limit(0), "work", "entry_id", "char_count").count() == 0


def test_a_text_that_is_a_third_of_all_rows_stays_in_place(spark):
    df = spark.range(6000).select(F.col("id").alias("entry_id"), F.lit("w").alias("work"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text"))
    marked = dedup.mark_duplicates(dedup.with_hashes(df))
    first = {}
    for r in sorted(df.collect()):
        first.setdefault(r.text, r.entry_id)
    assert {(r.entry_id, r.canonical_id) for r in marked.collect()} == {(r.entry_id, first[r.text]) for r in df.collect()}
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan


def test_postings_are_counted_where_they_are_made(spark):
    df = spark.createDataFrame([(1, "abab", None), (2, "", "xyzx")], "k long, a string, b string")
    index = retrieval.build_index(df, "k", ["a", "b"])
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in index.collect()} == {("aba", "a", 1, 1), ("bab", "a", 1, 1), ("xyz", "b", 2, 1), ("yzx", "b", 2, 1)}


def test_stratified_ranks_are_prefix_stable(spark):
    df = spark.range(100).select(F.col("id").alias("entry_id"), (F.col("id") % 3).alias("s"))
    few = {r.entry_id: r["rank"] for r in sampling.stratified(df, ["s"], "x", 10).collect()}
    many = {r.entry_id: r["rank"] for r in sampling.stratified(df, ["s"], "x").collect()}
    assert sorted(few.values()) == list(range(1, 11)) and sorted(many.values()) == list(range(1, 101))
    assert all(many[k] == v for k, v in few.items())


SOURCE = "The fox ran home. It slept well; nobody came. At dawn the fox left again, quietly."


@pytest.mark.parametrize(
    ("source", "quote", "want"),
    [
        (SOURCE, "It slept well", "It slept well"),
        (SOURCE, "The fox ran……slept well", "The fox ran home. It slept well"),
        (SOURCE, "Itsleptwellnobodycame", "It slept well; nobody came"),
        (SOURCE, "the fox……the fox", None),
        (SOURCE, "a bear came", None),
        (SOURCE, "", None),
        (SOURCE, None, None),
        # edition notes are left out of the source, not of the excerpt
        ("昔者王（一作帝）歸家去也", "王歸家去也", "王（一作帝）歸家去也"),
        ("昔者王〈注〉歸［脫］家", "者王歸家", "者王〈注〉歸［脫］家"),
        ("昔者王歸家（去", "王歸家去", "王歸家（去"),  # an open bracket is no note, but punctuation
        # overlong quotes end with a sentence, or at the limit
        ("甲" * 50 + "。" + "乙" * 80, "甲" * 50 + "。" + "乙" * 60, "甲" * 50 + "。"),
        ("甲" * 200, "甲" * 90, "甲" * 80),
        ("。" + "甲" * 200, "。" + "甲" * 90, "。" + "甲" * 79),
        # display form: glyphs, quotation marks and numbered notes
        ("王曰「歸家」[12]去也", "王曰归家去也", "王曰「歸家」[12]去也"),
        ("王曰「歸家」，去", "曰归家，去", "曰「歸家」，去"),
        ("「歸家」王「歸家」", "归家", None),
        ("火上釡中", "上釜中", "上釡中"),
        # what a gap's note reads stands for the gap with its note
        ("其□(葉本作「正」。)言也", "其正言也", "其□(葉本作「正」。)言也"),
        ("其□（本作「正」）言（注）也。", "正言也", "□（本作「正」）言（注）也"),
        # punctuation and white space
        ("王歸，家\n去 也", "王歸家。去也", "王歸，家\n去 也"),
        # an unmarked omission across a sentence end
        ("甲乙丙丁戊己庚辛。壬癸子。丑寅卯辰", "甲乙丙丁戊己庚辛丑寅卯辰", "甲乙丙丁戊己庚辛。壬癸子。丑寅卯辰"),
        ("甲乙丙丁戊己庚辛壬癸子丑寅卯辰", "甲乙丙丁戊己庚辛丑寅卯辰", None),
    ],
)
def test_alignment_ladder(spark, source, quote, want):
    glyphs = str.maketrans({"歸": "归"})
    span = evidence.align(source, quote, glyphs)
    assert (source[slice(*span)] if span else None) == want
    q = spark.createDataFrame([(1, quote)], "entry_id long, quote string")
    row = evidence.aligned(q, spark.createDataFrame([(1, source)], "entry_id long, text string"), glyphs=glyphs).first()
    assert (row.excerpt, row.start) == (want, span[0] if span else None)


def brute_spans(text, quote, limit=80):
    """Rungs 1, 3, 4 and 6 by trying every substring, with notes found by hand."""
    hidden = lambda extra: {i for a in range(len(text)) for b in range(a + 1, len(text)) if note(text[a : b + 1], extra) for i in range(a, b + 1)}
    pairs = {"(": ")", "（": "）", "〈": "〉", "［": "］"}

    def note(s, extra):
        if s[0] in pairs and s[-1] == pairs[s[0]] and not any(c in s[1:-1] for c in (s[0], s[-1], "\n")):
            return True
        return extra and s[0] == "[" and s[-1] == "]" and len(s) > 2 and s[1:-1].isdigit()

    quote = quote.strip()
    if len(quote) < 2:
        return None
    rungs = [(set(), "", False), (hidden(False), "", False), (hidden(True), "「」『』", True), (hidden(True), None, True)]
    for k, (skip, drop, alone) in enumerate(rungs):
        kept = lambda i: i not in skip and not (text[i] in "「」『』，。 \n（）()[]〈〉［］" if drop is None else text[i] in drop)
        q = "".join(c for c in quote if not (c in "「」『』，。 \n（）()[]〈〉［］…" if drop is None else c in drop))
        own = [i for i in range(len(text)) if kept(i)]
        hits = [(own[a], own[a + len(q) - 1] + 1) for a in range(len(own) - len(q) + 1) if "".join(text[i] for i in own[a : a + len(q)]) == q] if len(q) >= 2 else []
        apart = []
        for h in hits:
            if not apart or h[0] >= apart[-1][1]:
                apart.append(h)
        if not hits or (alone and len(apart) > 1) or (k == 1 and not skip):
            continue
        a, b = hits[0]
        if k == 2:
            while a and text[a - 1] in "「」『』":
                a -= 1
            while b < len(text) and text[b] in "「」『』":
                b += 1
        return a, b
    return None


@given(st.text("ab「」（），。", max_size=14), st.text("ab「」，", min_size=2, max_size=4))
@settings(max_examples=300, deadline=None)
def test_alignment_against_every_substring(source, quote):
    assert evidence.align(source, quote) == brute_spans(source, quote)


@given(st.text("abc（），。「", max_size=16), st.lists(st.text("abc，", min_size=1, max_size=3), min_size=1, max_size=3), st.sampled_from(["……", "...", "....", "。"]))
@settings(max_examples=300, deadline=None)
def test_segments_against_every_substring(source, parts, mark):
    quote = mark.join(parts)
    pieces = [p.strip() for p in ([p + mark for p in parts[:-1]] + parts[-1:] if mark == "。" else parts)]
    spans = [brute_spans(source, p) if len(p) >= 2 else None for p in pieces]
    fine = len(spans) >= 2 and all(s and source.count(source[slice(*s)]) == 1 for s in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert evidence.align_segments(source, quote) == (spans if fine else None)


def test_segments_keep_source_order():
    assert evidence.align_segments(SOURCE, "The fox ran home……At dawn") == [(0, 16), (46, 53)]
    assert evidence.align_segments(SOURCE, "At dawn...The fox ran home") is None
    assert evidence.align_segments("甲乙。丙丁。戊己。", "甲乙。戊己。") == [(0, 3), (6, 9)]
    assert evidence.align_segments(SOURCE, "At dawn") is None is evidence.align_segments(SOURCE, None)


def test_entries_fail_closed(spark):
    """A required support that has lost its evidence, here by a quote from nowhere, is named."""
    texts = spark.createDataFrame([(1, "甲乙丙丁。戊己庚辛。"), (2, "甲乙丙丁。"), (3, None)], "entry_id long, text string")
    rows = [(1, "甲乙", ["tone"]), (1, "甲乙……庚辛……", ["end"]), (1, "甲乙丙丁。庚辛。", ["end", "tone"]), (2, "甲乙", ["tone"]), (2, "nowhere", ["end"]), (3, "甲乙", ["tone"])]
    quotes = spark.createDataFrame(rows, "entry_id long, quote string, supports array<string>")
    need = spark.createDataFrame([(k, s) for k in (1, 2, 3) for s in ("tone", "end")], "entry_id long, support string")
    kept, entries = evidence.settle(quotes, texts, need)
    assert sorted((r.entry_id, r.excerpt, r.start, r.end, tuple(r.supports)) for r in kept.collect()) == [(1, "庚辛。", 7, 10, ("end", "tone")), (1, "甲乙", 0, 2, ("tone",)), (1, "甲乙丙丁。", 0, 5, ("end", "tone")), (2, "甲乙", 0, 2, ("tone",))]
    assert {r.entry_id: (r.dropped, r.lost, r.ok) for r in entries.collect()} == {1: (1, [], True), 2: (1, ["end"], False), 3: (1, ["end", "tone"], False)}


def test_cover_takes_what_is_needed(spark):
    rows = [(1, f"e{i}", i, ["a"]) for i in range(30)] + [(1, "last", 99, ["b"])]
    e = spark.createDataFrame(rows, "entry_id long, excerpt string, start long, supports array<string>")
    need = spark.createDataFrame([(1, "a"), (1, "b")], "entry_id long, support string")
    got = evidence.compact(e, need, most=5).collect()
    assert len(got) == 5 and all(r.ok for r in got) and "last" in {r.excerpt for r in got}


GOOD = [("x", 1, None, "a"), ("x", 2, "a", "b"), ("x", 3, "b", "c")]


@pytest.mark.parametrize(("change", "codes"), [({}, set()), ({1: ("x", 2, "z", "b")}, {"parent"}), ({1: ("x", 5, "a", "b")}, {"parent", "gap"}), ({2: ("x", 3, "b", "a")}, {"repeated"})])
def test_tampered_lineage_is_named(spark, change, codes):
    rows = [change.get(i, r) for i, r in enumerate(GOOD)]
    df = spark.createDataFrame(rows, "k string, iteration int, parent string, hash string")
    found = {r.code for r in ledger.lineage_check(df, "k").collect()}
    assert codes <= found and (found == codes or codes == {"parent", "gap"})


def test_scope_guard():
    with pytest.raises(ValueError):
        ledger.scope_guard(10, 10, False, [], [])
    with pytest.raises(ValueError):
        ledger.scope_guard(1, 10, False, ["a"], ["a"])


def test_bm25_prefers_the_shorter_text(spark):
    docs = spark.createDataFrame([(1, "deep blue sea"), (2, "deep blue sea " + "and more " * 9), (3, "red hills"), (4, "x"), (5, "y")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "blue sea")], "q long, term string")
    got = retrieval.bm25(docs, "doc_id", {"text": 1.0}, phrases, "q").orderBy(F.desc("score")).collect()
    assert [r.doc for r in got] == [1, 2]


def test_rerank_answers_count_only_when_whole(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "q int, doc int")
    a = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.9), (2, 9, 0.1)], "q int, doc int, model double")
    assert all(r.model is None for r in retrieval.valid_rerank(a, c, "q").collect())


def test_masked_phrases_do_not_signal(spark):
    signal = [("fall", "fell", ["fell asleep"], ["harm"])]
    f = lambda t: one(spark, rules.uncovered_signals(F.col("t"), F.array().cast("array<string>"), signal), t=t)
    assert f("he fell asleep") == [] and f("he fell asleep, then fell") == ["fall"]


def test_negation_is_taken_out_before_routing(spark):
    f = lambda t: one(spark, rules.route(F.col("t"), ["do not leave"], [("going", "leave")], "now"), t=t)
    assert not f("do not leave now").blocked and f("leave now").categories == ["going", "immediate_danger"]


HTML = "<html><head><title>x</title></head><body><h2>One</h2><p>a<p>b</p><div class='navbox'><p>no</p></div><h3>又</h3><p>c &amp; d</p><h2>Notes</h2><p>gone</p><a href='/w/One'>First</a></body></html>"


def test_headings_and_excluded_subtrees(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id long, html string")
    got = sorted(tuple(r) for r in pages.segment_by_heading(df, (2, 3), titles=("Notes",)).collect())
    assert got == [(1, 1, 2, "One", "a\nb", None), (1, 2, 3, "One·又", "c & d", "One")]
    assert [r.body for r in pages.segment_by_paragraph(df).orderBy("ordinal").collect()] == ["a", "b", "c & d", "gone"]
    assert [tuple(r) for r in pages.link_titles(df).collect()] == [("One", "First")]


def test_lists_and_blocks_stay_in_a_body(spark):
    """List items and blocks are kept, nested sections and tables are not; end tags may be missing."""
    html = "<h2>A</h2><p>one</p><ul><li>two<li>three</ul><div>four <b>five</div><section><h3>B</h3><p>six</p></section><table><tr><td>no</table>tail<h2>C</h2>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = sorted(tuple(r)[1:5] for r in pages.segment_by_heading(df, (2, 3)).collect())
    assert got == [(1, 2, "A", "one\ntwothree\nfour five"), (2, 3, "B", "six"), (3, 2, "C", "")]


def brute_segments(root, levels, excluded):
    """Headings, bodies and paragraphs of well-formed pages by walking the tree."""
    up = {c: p for p in root.iter() for c in p}
    text = lambda e: " ".join("".join(e.itertext()).split())
    bad = lambda e: any(x in (e.get("class") or "").lower() for x in excluded)
    heads, paragraphs = [], []
    for h in root.iter():
        if h.tag in ("h1", "h2", "h3") and int(h.tag[1]) in levels and text(h):
            beside = list(up[h])
            lines = []
            for e in beside[beside.index(h) + 1 :]:
                if e.tag in ("h1", "h2", "h3") and text(e):
                    break
                if e.tag not in ("section", "table") and not bad(e) and text(e):
                    lines.append(text(e))
            heads.append((len(heads) + 1, int(h.tag[1]), text(h), "\n".join(lines)))
        if h.tag == "p":
            around, e = False, h
            while e is not None:
                around, e = around or bad(e), up.get(e)
            if not around and text(h):
                paragraphs.append(text(h))
    return heads, paragraphs


_LEAF = st.tuples(st.sampled_from(["p", "h1", "h2", "h3", "li"]), st.sampled_from(["", "ad", "Big AD x"]), st.text("ab ", max_size=3))
_TREE = st.recursive(_LEAF, lambda inner: st.tuples(st.sampled_from(["div", "section", "ul", "table"]), st.sampled_from(["", "ad"]), st.lists(inner, max_size=4)), max_leaves=12)


def _markup(tree):
    tag, classes, inside = tree
    return f'<{tag} class="{classes}">{inside if isinstance(inside, str) else "".join(map(_markup, inside))}</{tag}>'


@given(st.lists(st.lists(_TREE, max_size=5), min_size=40, max_size=40))
@settings(max_examples=1, deadline=None, derandomize=True)
def test_segments_against_a_walk_over_the_tree(spark, trees):
    import xml.etree.ElementTree as ET

    markup = [f"<body>{''.join(map(_markup, t))}</body>" for t in trees]
    df = spark.createDataFrame(list(enumerate(markup)), "page_id long, html string")
    heads, paragraphs = {}, {}
    for r in pages.segment_by_heading(df, (1, 3), excluded=("ad",)).orderBy("ordinal").collect():
        heads.setdefault(r.page_id, []).append((r.ordinal, r.level, r.title, r.body))
    for r in pages.segment_by_paragraph(df, excluded=("ad",)).orderBy("ordinal").collect():
        paragraphs.setdefault(r.page_id, []).append(r.body)
    for k, m in enumerate(markup):
        assert (heads.get(k, []), paragraphs.get(k, [])) == brute_segments(ET.fromstring(m), (1, 3), ("ad",)), m


def test_issue_examples_are_bounded(spark):
    df = spark.range(50).select(F.col("id"), F.lit(None).cast("boolean").alias("b"))
    got = curation.issue_histogram(curation.issues(df, "id", {"x": F.col("b")}), "id", 3).first()
    assert got.n == 50 and got.examples == [0, 1, 2]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_spoilt_shards_fail_the_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"w{k % 2}", f"text {k}") for k in range(7)], "entry_id long, work string, text string")
    path = f"file://{tmp_path}/shards"
    m = files.write_shards(rows, path, "work", "entry_id", 2).collect()
    manifest = spark.createDataFrame(m)
    assert sorted(r["rows"] for r in m) == [1, 1, 1, 2, 2] or sum(r["rows"] for r in m) == 7
    assert files.read_shards(spark, path, "entry_id long, text string", manifest).count() == 7
    assert files.verify_shards(spark, path, "entry_id long, text string", manifest).count() == 0
    first = sorted(r.path for r in m)[0]
    os.remove(os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc"))  # the local file system's own check
    with open(first, "a") as f:
        f.write("{broken\n")
    with pytest.raises(ValueError, match="size"):
        files.read_shards(spark, path, "entry_id long, text string", manifest)
    with pytest.raises(ValueError, match="broken"):
        files.read_shards(spark, path, "entry_id long, text string")


def test_publication_fails_as_a_whole(spark, tmp_path):
    from quillmill import registry
    from quillmill.plans import streams
    from quillmill.sources import snapshots

    path = f"file://{tmp_path}/p"
    good = streams.published(registry.Tables(spark, "/root/testdata/sf0.001"))
    told = files.publish_entries(good, path)
    assert told["version"] == 0 and told["metrics"]["rows"] == snapshots.read(spark, path).count() == good.count()
    for bad, why in ((good.withColumn("production_eligible", F.col("entry_id") == 2), "production_eligible"), (good.drop("url"), "columns are missing.*url"), (good.union(good.limit(1)), "repeated_entry_id"), (good.withColumn("title", F.lit(None).cast("string")), "title")):
        with pytest.raises(ValueError, match=f"not published.*{why}"):
            files.publish_entries(bad, path)
    assert snapshots.versions(spark, path) == [0] and len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("v-")]) == 1
    assert files.publish_entries(good.limit(3), path)["version"] == 1 and snapshots.read(spark, path).count() == 3 and snapshots.read(spark, path, 0).count() == good.count()


def test_writers_do_not_lose_each_others_changes(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quillmill.sources import snapshots

    path = f"file://{tmp_path}/n"
    with pytest.raises(FileNotFoundError):
        snapshots.update(spark, path, lambda x: x)
    snapshots.publish(spark.createDataFrame([(0, 0)], "a int, b int"), path)

    def add(who):
        for batch in (0, 1, 1, 0):  # batches that come again change nothing
            snapshots.update(spark, path, lambda x: x.withColumn(who, F.col(who) + 1), who, batch)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(add, ["a", "b"]))
    assert tuple(snapshots.read(spark, path).first()) == (2, 2) and snapshots.versions(spark, path) == [0, 1, 2, 3, 4]
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark.createDataFrame([(9, 9)], "a int, b int"), path, base=2)
    assert snapshots.forget(spark, path) == 3 and tuple(snapshots.read(spark, path).first()) == (2, 2)
    assert len([f for f in (tmp_path / "n").iterdir() if f.name.startswith("v-")]) == 2


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    from quillmill.sources import snapshots
    from quillmill.streaming import sessions

    path = f"file://{tmp_path}/ledger"
    snapshots.publish(spark.createDataFrame([(1, "old", "valid", "p")], "entry_id long, source_hash string, status string, payload string"), path)
    rows = spark.createDataFrame([(1, "new"), (2, "x")], "entry_id long, source_hash string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/f0")
    for run in range(2):  # the second time a checkpoint is lost, and the same batch comes again
        stream = sessions.read_stream(spark, f"{tmp_path}/in/f", rows.schema, 1)
        snapshots.stream_into(stream, path, ledger.enqueue, "queue", f"{tmp_path}/state{run}", unique=("entry_id",))
    assert snapshots.versions(spark, path) == [0, 1]
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == [(1, "new", "stale", None), (2, "x", "queued", None)]


def test_an_empty_run_is_no_success(spark, tmp_path):
    from quillmill.operators import run
    from quillmill.plans import runs

    docs = spark.createDataFrame([(runs.EVERY, "some text")], "doc_id long, text string")
    records, sources = runs.records(docs)
    told = run.validate_run(records, sources, f"file://{tmp_path}/r")
    assert told["ok"] and told["valid"] == told["rows"] == 1
    none = run.validate_run(records.limit(0), sources, f"file://{tmp_path}/r")
    assert none["codes"] == {"no_accepted_rows": (1, None)} and not none["ok"]
    assert run.validate_run(records.limit(0), sources, f"file://{tmp_path}/r", allow_empty=True)["ok"]
    planted = {code for f in runs.FAULTS for code in f[2].split()}
    assert planted == {"invalid_json", "root_not_object", *run.record_rules(lambda x: x)}


def test_phrases_are_counted_without_overlap(spark):
    docs = spark.createDataFrame([(1, "Anana anANa banana", "x"), (2, None, "ana"), (3, "", None)], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(7, "ana"), (8, "ANA"), (8, "banana"), (9, "none")], "q long, term string")
    for block in (100, 1):
        got = {(r.q, r.term, r.doc, r.field): (r.tf, r.length) for r in retrieval.phrase_matches(docs, "doc_id", ["text", "title"], asked, "q", block).collect()}
        assert got == {(q, t, d, f): v for q, t in ((7, "ana"), (8, "ANA")) for d, f, v in ((1, "text", (3, 18)), (2, "title", (1, 3)))} | {(8, "banana", 1, "text"): (1, 18)}


def test_positions_are_the_same_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([(k * 37 % 101, "a" if k % 3 else None) for k in range(101)], "doc_id long, source string").repartition(5)
    got = {r.doc_id: r.place for r in sampling.with_position(rows, ["source"], ["doc_id"], "place").collect()}
    for s in ("a", None):
        own = sorted(r.doc_id for r in rows.collect() if r.source == s)
        assert [got[d] for d in own] == list(range(len(own)))


def test_every_check_of_the_closure_is_broken_somewhere(spark):
    from quillmill.operators import closure
    from quillmill.plans import closure as plans

    planted = {code for f in plans.FAULTS for code in f[3].split()}
    history = {"history_absent", "history_iteration", "history_prefix", "history_envelope_lineage", "history_envelope_hash"}
    names = set(closure.entry_checks(plans.CURRENT)) | history
    assert len(names) > 80 and not names - planted


def test_closure_options(spark):
    """Contracts are checks of their own, a run that must have passed says who has not, and empty ledgers close."""
    from quillmill.operators import closure
    from quillmill.plans import closure as plans

    docs = spark.createDataFrame([(plans.EVERY, "one text", "en", "w"), (2 * plans.EVERY, "other text", "en", "w")], "doc_id long, text string, lang string, source string")
    own = plans.ledgers(docs)
    tables = [own[k] for k in ("source", "annotation", "review", "repair", "history")]
    assert closure.closure(*tables, plans.CURRENT).count() == 0
    strict = closure.closure(*tables, plans.CURRENT, {"schema": F.get_json_object("repair_effective", "$.of").cast("long") > plans.EVERY}, require_passed=True)
    assert sorted(map(tuple, strict.collect())) == [(plans.EVERY, "review_not_passed"), (plans.EVERY, "schema"), (2 * plans.EVERY, "review_not_passed")]
    assert {r.code: r.entries for r in closure.summary(own["repair"], strict).collect()} == {"review_not_passed": 2, "schema": 1, "closed": 0}
    assert closure.closure(*[x.limit(0) for x in tables], plans.CURRENT).count() == 0


def test_members_of_an_envelope_are_read_in_one_pass(spark):
    """No check reads the envelope by itself; odd spaces, a member named twice and one of another kind say what they did before."""
    from quillmill.operators import closure
    from quillmill.plans import closure as plans

    checks = closure.entry_checks(plans.CURRENT)
    assert not [k for k, c in checks.items() if "get_json_object(repair_envelope" in str(c) or "get_json_object(repair_input" in str(c)]
    e = plans.EVERY
    docs = spark.createDataFrame([(k * e, f"text {k}", "en", "w") for k in range(1, 6)], "doc_id long, text string, lang string, source string")
    own = plans.ledgers(docs)
    change = {1: "replace(envelope, ',', ' , ')", 2: "regexp_replace(envelope, '^[{]', '{\"base\":1,')", 3: "regexp_replace(envelope, '\"provenance\":[{][^}]*[}]', '\"provenance\":5')", 4: "substring(envelope, 1, 300)"}
    repairs = own["repair"]
    for k, x in change.items():
        repairs = repairs.withColumn("envelope", F.when(F.col("entry_id") == k * e, F.expr(x)).otherwise(F.col("envelope")))
    found = closure.closure(own["source"], own["annotation"], own["review"], repairs, own["history"], plans.CURRENT).collect()
    codes = {k: {r.code for r in found if r.entry_id == k * e} for k in range(1, 6)}
    assert codes[1] == {"repair_envelope_json"} and codes[2] == {"repair_envelope_json", "envelope_base"} and codes[3] == {"envelope_provenance"} and not codes[5]
    # the parent's hash and what follows the cut are gone; a null parent is never there
    assert codes[4] == {"repair_envelope_json", "envelope_provenance", "envelope_lineage", *[f"envelope_{n}" for n in closure.ENVELOPE if n not in ("provenance", "lineage")]}


def test_a_review_run_that_is_whole_says_nothing(spark):
    from quillmill.operators import review_run
    from quillmill.plans import reviews

    docs = spark.range(1, 400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    codes = spark.createDataFrame(reviews.CODES, "stage_code string, code string")
    final = ("pass", "revise")

    def told(x):
        return review_run.review_run(x["entry"], x["annotation"], x["omission"].unionByName(x["contradiction"]), x["merged"], codes, reviews.WANTED, final)

    whole = reviews.run(docs)
    assert told(whole).count() == 0 and told({k: v.limit(0) for k, v in whole.items()}).count() == 0
    # one entry holds a third of all issues: it is spread by issue
    many = F.transform(F.sequence(F.lit(1), F.lit(700)), lambda k: F.struct(F.lit("wrong_end").alias("code"), F.lit("end").alias("field"), k.cast("string").alias("excerpt"), F.lit("h").alias("hint")))
    hot = whole["contradiction"].withColumns({c: F.when(F.col("entry_id") == 7, many).otherwise(F.col(c)) for c in ("issues", "raw")})
    got = [tuple(r) for r in told(whole | {"contradiction": hot}).collect()]
    assert sorted(got) == [(7, "merged:added", 1), (7, "merged:lost", 700)]


@given(st.lists(st.lists(st.sets(st.sampled_from("abcdef"), min_size=1, max_size=3), min_size=1, max_size=7), min_size=8, max_size=8), st.integers(1, 4))
@settings(max_examples=4, deadline=None, derandomize=True)
def test_cover_against_all_choices(spark, entries, most):
    """Entries with few excerpts pass; of the others the cover is greedy, and fails only where greedy needs more than `most`."""
    import itertools

    rows = [(k, f"{'x' * (j % 3)}e{j}", j, sorted(s)) for k, own in enumerate(entries) for j, s in enumerate(own)]
    e = spark.createDataFrame(rows, "entry_id long, excerpt string, start long, supports array<string>")
    need = {k: set("ab") | (set("f") if k % 2 else set()) for k in range(len(entries))}
    required = spark.createDataFrame([(k, s) for k, own in need.items() for s in own], "entry_id long, support string")
    got = {}
    for r in evidence.compact(e, required, most=most).collect():
        got.setdefault(r.entry_id, []).append(r)
    for k, own in enumerate(entries):
        mine = [r for r in rows if r[0] == k]
        if len(own) <= most:
            assert len(got[k]) == len(own) and all(r.ok for r in got[k])
            continue
        covers = lambda c: need[k] <= {s for r in c for s in r[3]}
        possible = any(covers(c) for n in range(most + 1) for c in itertools.combinations(mine, n))
        chosen = [r for r in mine if (r[1], r[2]) in {(x.excerpt, x.start) for x in got[k]}]
        assert len(chosen) == len(got[k]) <= most
        if got[k][0].ok:
            assert possible and covers(chosen)
        left, picked, pool = set(need[k]), [], list(mine)
        while left and any(left & set(r[3]) for r in pool):
            best = sorted(pool, key=lambda r: (-len(left & set(r[3])), len(r[1]), r[2]))[0]
            pool.remove(best)
            picked.append(best)
            left -= set(best[3])
        assert got[k][0].ok == (not left and len(picked) <= most)


def test_recall_from_a_kept_index_equals_the_full_scan(spark, tmp_path):
    """Segments that are added and merged change nothing; a search reads only folders of its grams."""
    from quillmill.operators import kept_index

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(9001, None, "src1"), (9002, "aaaaaa AAaa", None), (9003, "", "")], docs.schema))
    fields, path = ["text", "source"], f"file://{tmp_path}/i"
    asked = spark.createDataFrame([(1, "the "), (1, "aaaa"), (2, "src1"), (2, "SRC1"), (3, "nowhere in it"), (4, "aa aa"), (4, "tion")], "q long, term string")
    want = sorted(map(tuple, retrieval.phrase_matches(docs, "doc_id", fields, asked, "q").collect()))
    assert len(want) > 100

    def told():
        index = kept_index.postings(spark, path)
        return sorted(map(tuple, kept_index.phrase_matches(index, docs, "doc_id", fields, asked, "q").collect()))

    kept_index.create(docs.filter("doc_id % 2 = 0"), "doc_id", fields, path)
    kept_index.add(docs.filter("doc_id % 2 = 1"), "doc_id", fields, path)
    assert told() == want
    kept_index.merge(spark, path)
    assert told() == want
    weights = {"text": 1.0, "source": 2.0}
    full = {(r.q, r.doc): round(r.score, 9) for r in retrieval.bm25(docs, "doc_id", weights, asked, "q").collect()}
    found = kept_index.phrase_matches(kept_index.postings(spark, path), docs, "doc_id", fields, asked, "q")
    assert {(r.q, r.doc): round(r.score, 9) for r in retrieval.bm25(docs, "doc_id", weights, asked, "q", matches=found, size=kept_index.sizes(spark, path)).collect()} == full
    plan = kept_index.candidates(kept_index.postings(spark, path), asked, "q", fields)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters" in plan and "In(gram" in plan


@given(st.lists(st.integers(1, 9), min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_ranks_are_those_of_a_cursor_that_restarts(sizes):
    left, cursor, order = {g: n for g, n in enumerate(sizes)}, 0, []
    while left:
        open_ = sorted(left)
        g = open_[cursor % len(open_)]
        order.append((g, sizes[g] - left[g] + 1))
        left[g] -= 1
        cursor += 1
        if not left[g]:
            del left[g]
            cursor = 0
    stratum, turn = np.array(order).T
    assert sampling.ranks_of(sampling.restarts(sizes), stratum, turn).tolist() == list(range(1, len(order) + 1))

"""Queries of page and file sources and of session streams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import kept_index, rules
from quillmill.plans.corpus import SCRUBBED, marked
from quillmill.plans.retrieval import _GRAMS, titled
from quillmill.registry import query
from quillmill import shared
from quillmill.shared import shared_folder
from quillmill.sources import files, pages, snapshots
from quillmill.streaming import sessions


def folder(t, name: str) -> str:
    return shared_folder(t.spark, name)


#: What pages get at the end of their article: a list, a block, an advert, a nested section that says "again".
_ADDED = '<ul><li>one </li><li>two</li></ul><div>three</div><div class="x noprint">four</div><table><tr><td>five</td></tr></table><section><h2>又</h2>six<p>seven &amp; eight</section>'


def richer(t):
    return t.pages.withColumn("html", F.replace("html", F.lit("</article>"), F.lit(f"{_ADDED}</article>")))


def _plain(x: str) -> str:
    """SQL of the text of a piece of HTML."""
    return rf"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', chr(34)), '&lt;', '<'), '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'))"


#: Pieces of an article's text between marks of paragraphs.
_PARTS = r"regexp_extract(html, '(?s)</h1>(.*?)</article>', 1)"
_BODY = f"array_to_string(list_filter(list_transform(string_split_regex({_PARTS}, '</?p>'), lambda x: {_plain('x')}), lambda x: x <> ''), chr(10))"
_TITLE = _plain("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


@query("s2_heading_segments", f"WITH p AS (SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages) SELECT page_id, 1 AS ordinal, 1 AS level, title, concat_ws(chr(10), nullif(body, ''), 'one two', 'three') AS body, NULL AS parent_heading FROM p UNION ALL SELECT page_id, 2, 2, title || '·又', 'seven & eight', title FROM p")
def _(t):
    return pages.segment_by_heading(richer(t), (1, 2))


@query("s3_level_table", f"WITH p AS (SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages), x AS (SELECT title FROM p WHERE page_id % 10 = 4) SELECT page_id, 1 AS ordinal, 1 AS level, title, concat_ws(chr(10), nullif(body, ''), 'one two', 'three') AS body FROM p WHERE page_id % 3 = 0 AND title NOT IN (SELECT title FROM x) UNION ALL SELECT page_id, 1, 2, title || '·又', 'seven & eight' FROM p WHERE page_id % 3 = 1")
def _(t):
    # sources by page: headings of level 1 where there are second ones, of level 2 where there are no third ones, none
    p = richer(t).withColumn("kind", F.element_at(F.array(F.lit("one"), F.lit("two"), F.lit("three")), (F.col("page_id") % 3 + 1).cast("int")))
    levels = t.spark.createDataFrame([("one", [1], [3], 2), ("two", [3], [2], 3), ("three", [3, 4], [5], 2)], "kind string, deep array<int>, shallow array<int>, split int")
    named = pages.segment_by_heading(t.pages.filter("page_id % 10 = 4"), (1,)).select("title")
    return pages.segment_by_level_table(p, levels, "kind", titles=named).select("page_id", "ordinal", "level", "title", "body")


_P = rf"list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?:</p>)?<p>')[2:], lambda x: {_plain('x')}), lambda x: true)"


@query("s4_paragraph_segments", f"WITH p AS (SELECT page_id, {_P} AS l FROM pages), k AS (SELECT page_id, list_filter(CASE WHEN page_id % 5 = 0 THEN l[2:] ELSE l END, lambda x: x <> '') AS l FROM p), u AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS ordinal, l FROM k) SELECT page_id, ordinal::INT AS ordinal, page_id || '·' || ordinal AS title, l[ordinal] AS body FROM u")
def _(t):
    skip = t.pages.filter("page_id % 5 = 0").select("page_id")
    return pages.segment_by_paragraph(t.pages, skip)


@query("s5_excluded_subtrees", "SELECT page_id, len(regexp_extract_all(html, '<[a-z]')) + 3 AS elements, len(regexp_extract_all(html, '<div class=.ad.>')) + 3 AS excluded FROM pages")
def _(t):
    more = t.pages.withColumn("html", F.replace("html", F.lit("</body>"), F.lit('<div class="big AD"><p>in<b>it</b></div></body>')))
    more = more.withColumn("html", F.when(F.contains("html", F.lit("</body>")), F.col("html")).otherwise(F.concat("html", F.lit('<div class="big AD"><p>in<b>it</b></div>'))))
    return pages.excluded_subtrees(more, ("ad",))


@query("s6_link_titles", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS u, unnest(regexp_extract_all(html, '(?s)<a [^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS t, unnest(range(len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)))) AS place FROM pages),
k AS (SELECT page_id, place, regexp_extract(u, '[^/]*$') AS href, {_plain('t')} AS title FROM l) SELECT href, arg_max(title, page_id * 1000000 + place) AS title FROM k WHERE href <> '' AND title <> '' GROUP BY href""")
def _(t):
    return pages.link_titles(t.pages)


@query("s7_verify_files", "SELECT unnest(['absent.parquet', 'nation.parquet', 'region.parquet', 'supplier.parquet']) AS file, unnest(['missing', 'size', 'hash', 'unlisted']) AS problem")
def _(t):
    found = None
    for name in ("nation", "region", "supplier", "part"):
        own = files.file_hashes(t.spark, f"{t.sf_dir}/{name}.parquet")
        found = own if found is None else found.unionByName(own)
    spoilt = {"bytes": F.col("bytes") + F.when(F.col("file") == "nation.parquet", 1).otherwise(0), "sha256": F.when(F.col("file") == "region.parquet", "x").otherwise(F.col("sha256"))}
    absent = t.spark.createDataFrame([("absent.parquet", 1, "x")], "file string, bytes long, sha256 string")
    return files.verify_files(found, found.filter("file <> 'supplier.parquet'").withColumns(spoilt).union(absent))


@query("s8_write_shards", "SELECT count(*) AS shards, sum(n)::BIGINT AS rows, max(n) AS most FROM (SELECT source, k, count(*) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS k FROM documents) GROUP BY ALL)")
def _(t):
    m = files.write_shards(t.documents, folder(t, "shards"), "source", "doc_id", 10)
    return m.agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))


_SHARDS = "h AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS k FROM documents), f AS (SELECT source, count(DISTINCT k) AS n FROM h GROUP BY source)"


@query("s9_read_shards", f"WITH {_SHARDS} SELECT 'rows' AS what, count(*) AS n FROM documents UNION ALL SELECT 'ids', count(DISTINCT doc_id) FROM documents UNION ALL SELECT CASE source WHEN 'src1' THEN 'hash' WHEN 'src2' THEN 'rows differ' ELSE 'unlisted' END, n FROM f WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT 'missing', 1")
def _(t):
    path, schema = folder(t, "lines"), "doc_id long, text string, lang string"
    m = shared.keep(files.write_shards(t.documents, path, "source", "doc_id", 10), "manifest")
    back = files.read_shards(t.spark, path, schema, m)
    of = lambda source: F.contains("path", F.lit(f"source={source}/"))
    spoilt = m.filter(~of("src3")).withColumns({"sha256": F.when(of("src1"), "x").otherwise(F.col("sha256")), "rows": F.col("rows") + of("src2").cast("int")})
    spoilt = spoilt.unionByName(t.spark.createDataFrame([("/absent.json", 1, "x", 1)], "path string, bytes long, sha256 string, rows long"))
    found = files.verify_shards(t.spark, path, schema, spoilt).groupBy(F.when(F.col("problem") == "rows", "rows differ").otherwise(F.col("problem")).alias("what")).agg(F.count("*").alias("n"))
    told = back.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).select(F.inline(F.array(F.struct(F.lit("rows").alias("what"), F.col("rows").alias("n")), F.struct(F.lit("ids").alias("what"), F.col("ids").alias("n")))))
    return told.unionByName(found)


def published(t):
    """Marked entries with all columns of the published table."""
    own = F.col("entry_id").cast("string")
    more = {
        "source_key": F.concat_ws("/", "work", own), "work_title": F.initcap("work"), "work_period": F.col("lang"), "volume": F.lit("1"), "locator": F.concat(F.lit("p"), own), "ordinal": F.col("entry_id").cast("int"),
        "title": F.substring("text", 1, 12), "title_origin": F.lit("first_words"), "url": F.concat(F.lit("https://example.org/"), own), "text_mode": F.lit("source"), "catalog_status": F.lit("raw"),
        "production_eligible": F.lit(False), "full_text_search": F.col("entry_id") % 3 != 0,
    }
    return marked(t).withColumns(more)


_FIRST_OF = "m AS (SELECT source AS work, doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '[\\p{P}\\p{Z}]', '', 'g') ORDER BY source, doc_id) AS k FROM documents)"


@query("s10_publish_entries", f"WITH {_FIRST_OF} SELECT work, count(*) AS n, count(*) FILTER (k = 1 AND doc_id % 3 <> 0) AS searchable, (SELECT count(*) FROM m) AS all_rows, (SELECT count(*) FROM m WHERE k = 1 AND doc_id % 3 <> 0) AS all_searchable FROM m GROUP BY work")
def _(t):
    path = folder(t, "published")
    told = files.publish_entries(published(t), path)["metrics"]
    rows = snapshots.read(t.spark, path).groupBy("work").agg(F.count("*").alias("n"), F.count_if((F.col("dedupe_status") == "canonical") & F.col("full_text_search")).alias("searchable"))
    return rows.withColumns({"all_rows": F.lit(told["rows"]), "all_searchable": F.lit(told["searchable"])})


#: A row that is not as it should be, or a column that is not there, and what publication says to it.
_SPOILT = {"char_count": "char_count + 1", "text_sha256": "'x'", "normal_sha256": "'x'", "canonical_id": "-1L", "production_eligible": "true", "title": "null", "entry_id": "0L", "ordinal": "-1"}


@query("s10_refused_entries", "SELECT unnest(['canonical_id', 'char_count', 'entry_id', 'normal_sha256', 'ordinal', 'production_eligible', 'text_sha256', 'title', 'url']) AS spoilt, unnest([m, n, 1, n, n, n, n, n, 0]) AS rows, unnest([false, false, true, false, false, false, false, false, true]) AS other FROM (SELECT count(*) AS n, count(*) FILTER (k = 1) AS m FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '[\\p{P}\\p{Z}]', '', 'g') ORDER BY source, doc_id) AS k FROM documents) WHERE doc_id % 7 = 1)")
def _(t):
    # a publication a column: every seventh row is spoilt, and none may be published
    good, out = shared.keep(published(t), "entries"), []
    for column, change in [*_SPOILT.items(), ("url", None)]:
        path = folder(t, "refused")
        bad = good.drop(column) if change is None else good.withColumn(column, F.when(F.col("ordinal") % 7 == 1, F.expr(change).cast(good.schema[column].dataType)).otherwise(F.col(column)))
        try:
            files.publish_entries(bad, path)
            out.append((column, -1, False))
        except ValueError as e:
            counts = dict(re.findall(r"'(\w+)': (\d+)", str(e)))
            other = "missing" in str(e) or f"repeated_{column}" in counts
            out.append((column, int(counts.get(f"repeated_{column}", counts.get(column, 0))), other))
        if snapshots.versions(t.spark, path):
            out.append((column, -2, False))
    return t.spark.createDataFrame(out, "spoilt string, rows long, other boolean")


@query("s11_full_text_index", f"WITH {_GRAMS} SELECT gram, field, count(DISTINCT doc_id) AS entries, count(*) AS tf FROM g GROUP BY gram, field")
def _(t):
    # written as an index of two segments and read from there
    path, docs, fields = folder(t, "index"), titled(t), ["title", "text", "source", "lang"]
    kept_index.create(docs.filter("doc_id % 3 <> 0"), "doc_id", fields, path)
    kept_index.add(docs.filter("doc_id % 3 = 0"), "doc_id", fields, path)
    index = kept_index.postings(t.spark, path)
    return index.groupBy("gram", "field").agg(F.count("*").alias("entries"), F.sum("tf").alias("tf"))


@query("s12_envelope", "SELECT doc_id, lang FROM documents WHERE doc_id // 50 % 2 = 0")
def _(t):
    path = folder(t, "envelope")
    rows = t.documents.withColumn("k", F.floor(F.col("doc_id") / 50))
    tier = F.when(F.col("k") % 2 == 0, "c2").otherwise("draft")
    rows.groupBy("k").agg(F.collect_list(F.struct("doc_id", "lang")).alias("records")).withColumn("tier", tier).write.option("maxRecordsPerFile", 1).json(path)
    return files.read_envelope(t.spark, path, "tier string, records array<struct<doc_id: long, lang: string>>", F.col("tier") == "c2")


def events(t):
    return sessions.read_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema)


_FIRST = "f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events)"


@query("t1_session_expiry", f"WITH {_FIRST} SELECT user_id, event_id, CASE WHEN ts < first + INTERVAL 24 HOUR THEN 'live' ELSE 'expired' END AS outcome FROM f")
def _(t):
    out = sessions.run_to_end(events(t), sessions.expire, t.spark, folder(t, "expiry"))
    return out.filter("event_id is not null").select("user_id", "event_id", "outcome")


@query("t2_idempotent_replay", """WITH RECURSIVE o AS (SELECT event_id, ts, user_id * 10 + event_id % 7 AS request, event_type FROM events),
r AS (SELECT request, min(ts) AS s FROM o GROUP BY request UNION ALL SELECT r.request, min(o.ts) FROM r JOIN o ON o.request = r.request AND o.ts >= r.s + INTERVAL 24 HOUR GROUP BY r.request),
l AS (SELECT o.request, event_id, ts, event_type, max(s) AS s FROM o JOIN r ON r.request = o.request AND r.s <= o.ts GROUP BY ALL)
SELECT request, event_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN event_type = first_value(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM l WINDOW w AS (PARTITION BY request, s ORDER BY ts, event_id)""")
def _(t):
    e = events(t).withColumn("request", F.col("user_id") * 10 + F.col("event_id") % 7)
    return sessions.run_to_end(e, lambda e: sessions.replay(e, "request", "event_type"), t.spark, folder(t, "replay"))


@query("t3_provenance_log", "SELECT event_id, event_type AS \"eventType\", ts AS occurred_at FROM events")
def _(t):
    log = events(t).select("event_id", F.col("event_type").alias("eventType"), F.col("ts").alias("occurred_at"))
    return sessions.run_available(log, t.spark, folder(t, "log"))


#: Turns as versions: every fourth names a wrong parent, every fifth has seen other content than its parent's.
_FORK = """c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS parent, sha256(text) AS tag, (conv_id + turn) % 5 = 4 AS stale FROM conversations)"""


def forked(t, rows):
    """Turns with parent, tag and the tag their writer has seen; a static table tells the parents' content."""
    parent = F.when((F.col("conv_id") + F.col("turn")) % 4 == 3, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    tag = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    seen = t.conversations.select("conv_id", F.col("turn").alias("parent"), tag("text").alias("seen"))
    match = F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, "stale").otherwise(F.coalesce("seen", F.lit("")))
    return rows.select("conv_id", "turn", parent.alias("parent"), tag("text").alias("tag")).join(seen, ["conv_id", "parent"], "left").withColumn("match", match)


@query("t4_version_chain", f"WITH RECURSIVE {_FORK}, r AS (SELECT conv_id, 0 AS k, -1::BIGINT AS last FROM (SELECT DISTINCT conv_id FROM c) UNION ALL SELECT r.conv_id, r.k + 1, CASE WHEN c.parent = r.last AND NOT c.stale THEN c.turn ELSE r.last END FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.k) SELECT c.conv_id, c.turn, CASE WHEN c.parent <> r.last THEN 'conflict' WHEN c.stale THEN 'tag_conflict' ELSE 'accepted' END AS outcome FROM c JOIN r ON r.conv_id = c.conv_id AND r.k = c.turn")
def _(t):
    s = sessions.read_stream(t.spark, f"{t.sf_dir}/conversations.parquet", t.conversations.schema)
    return sessions.run_available(sessions.versions(forked(t, s), "conv_id", "turn", "parent", tag="tag", match="match"), t.spark, folder(t, "versions"))


@query("w9_version_chain", f"WITH {_FORK}, p AS (SELECT conv_id, turn, parent, coalesce(lag(turn) OVER w, -1) AS before, stale, coalesce(lag(tag) OVER w, '') AS latest FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT p.*, CASE WHEN p.stale THEN 'stale' ELSE coalesce(c.tag, '') END AS match FROM p LEFT JOIN c ON c.conv_id = p.conv_id AND c.turn = p.parent) SELECT conv_id, turn, parent <> before AS parent_conflict, match <> latest AS tag_conflict FROM m")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    v = forked(t, t.conversations).withColumns({"before": F.coalesce(F.lag("turn").over(w), F.lit(-1)), "latest": F.coalesce(F.lag("tag").over(w), F.lit(""))})
    return v.select("conv_id", "turn", (F.col("parent") != F.col("before")).alias("parent_conflict"), (F.col("match") != F.col("latest")).alias("tag_conflict"))


@query("t5_deletion", "WITH d AS (SELECT user_id, min(ts) AS deleted_at FROM events WHERE event_type = 'error' AND user_id % 3 = 0 GROUP BY user_id) SELECT user_id, event_id, 'kept' AS outcome FROM events WHERE user_id NOT IN (SELECT user_id FROM d) UNION ALL SELECT user_id, event_id, 'rejected' FROM events JOIN d USING (user_id) WHERE ts > deleted_at UNION ALL SELECT user_id, NULL, 'tombstone' FROM d")
def _(t):
    gone = events(t).filter("event_type = 'error' and user_id % 3 = 0")
    told = sessions.run_available(sessions.deletions_live(events(t), gone, "user_id"), t.spark, folder(t, "deletion"))
    return sessions.purge(told, "user_id").drop("hash")


@query("t6_safety_routing", r"SELECT conv_id, turn, regexp_matches(text, '(?i)\b(?:the|der) [a-z]+ion') AS blocked FROM conversations")
def _(t):
    s = sessions.read_stream(t.spark, f"{t.sf_dir}/conversations.parquet", t.conversations.schema)
    r = rules.route(F.col("text"), [], [("harm_self", r"(?i)\b(?:the|der) [a-z]+ion")], "(?i)now")
    return sessions.run_available(s.select("conv_id", "turn", r["blocked"].alias("blocked")), t.spark, folder(t, "routing"))


@query("t7_stale_results", "SELECT event_id, user_id, event_id % 4 = 0 AS stale FROM events")
def _(t):
    tokens = t.events.select("user_id").distinct().withColumn("now_token", F.sha2(F.col("user_id").cast("string").cast("binary"), 256))
    token = F.when(F.col("event_id") % 4 == 0, "old").otherwise(F.sha2(F.col("user_id").cast("string").cast("binary"), 256))
    j = events(t).withColumn("token", token).join(tokens, "user_id")
    return sessions.run_available(j.select("event_id", "user_id", (F.col("token") != F.col("now_token")).alias("stale")), t.spark, folder(t, "stale"))


@query("t8_conversation_cues", f"""WITH s AS (SELECT conv_id, turn, {SCRUBBED} AS text FROM conversations WHERE role = 'user'), """ + r"""c AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), '[。！？!?；;，,.]+'), lambda x: trim(x)), lambda x: length(x) >= 3) AS l FROM s), d AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM c)
SELECT conv_id, turn, array_to_string(list_transform(l[1:2], lambda x: CASE WHEN length(x) > 36 THEN rtrim(substr(x, 1, 35)) || '…' ELSE x END), '|') AS cues FROM d""")
def _(t):
    safe = tx.clauses(tx.scrub_identity(F.col("text")))
    cut = F.transform(F.slice(safe, 1, 2), lambda c: F.when(F.length(c) > 36, F.concat(F.rtrim(F.substring(c, 1, 35)), F.lit("…"))).otherwise(c))
    return t.conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.array_join(cut, "|").alias("cues"))


@query("t9_run_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    path = folder(t, "progress")
    schema = sessions.progress(t.events, "event_type").schema
    counts = sessions.progress(events(t), "event_type")

    def keep(df, n):
        df.write.mode("overwrite").parquet(f"{path}/rows")

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{path}/rows")


@query("t10_session_report", "WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS approved_version, count(*) AS versions FROM conversations GROUP BY conv_id), e AS (SELECT user_id AS conv_id, count(*) AS events FROM events GROUP BY user_id) SELECT conv_id, approved_version, versions, coalesce(events, 0) AS events FROM l LEFT JOIN e USING (conv_id)")
def _(t):
    l = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("approved_version"), F.count("*").alias("versions"))
    e = t.events.groupBy(F.col("user_id").alias("conv_id")).agg(F.count("*").alias("events"))
    return l.join(e, "conv_id", "left").na.fill(0, ["events"])


@query("t11_readiness", "SELECT conv_id, count(*) AS nodes, count(*) FILTER (role = 'assistant') AS written, count(*) >= 3 AND count(*) FILTER (role = 'assistant') >= 2 AS ready FROM conversations GROUP BY conv_id")
def _(t):
    written = F.count_if(F.col("role") == "assistant")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("nodes"), written.alias("written"), ((F.count("*") >= 3) & (written >= 2)).alias("ready"))

"""Queries of sampling, packing, catalogue and validation operators.

part stands for story versions: p_partkey is the version, p_brand the family.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import curation, sampling
from quillmill.plans.corpus import entries, marked
from quillmill.registry import query

DOCS = "(SELECT doc_id AS entry_id, source AS work, lang, text, length(text) AS char_count, ((length(text) >= 100)::INT + (length(text) >= 500)::INT + (length(text) >= 1000)::INT + (length(text) >= 3000)::INT) AS bucket FROM documents)"
#: Rows by strata; `ph` has a row a phase of the cursor: sizes left (r), rows taken (s), turns (m), the stratum that ends it (gs).
RANKED = f"""t AS (SELECT *, row_number() OVER (PARTITION BY work, bucket ORDER BY sha256('s1|' || entry_id), entry_id) AS turn FROM {DOCS}),
st AS (SELECT work, bucket, count(*) AS n, row_number() OVER (ORDER BY work, bucket) AS g FROM t GROUP BY work, bucket),
ph AS (SELECT 0 AS p, list(n ORDER BY g) AS r, 0::BIGINT AS s FROM st UNION ALL
SELECT p + 1, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] = 0 THEN 0 WHEN i <= gs THEN r[i] - m ELSE r[i] - m + 1 END), s + (m - 1) * act + len(list_filter(range(1, gs + 1), lambda i: r[i] > 0))
FROM (SELECT *, list_min(list_filter(r, lambda x: x > 0)) AS m, list_position(r, list_min(list_filter(r, lambda x: x > 0))) AS gs, len(list_filter(r, lambda x: x > 0)) AS act FROM ph) WHERE act > 0),
u AS (SELECT p, r, s, len(list_filter(r, lambda x: x > 0)) AS act, lead(r) OVER (ORDER BY p) AS after FROM ph),
r AS (SELECT t.*, u.s + (t.turn - (st.n - u.r[st.g]) - 1) * u.act + len(list_filter(range(1, st.g + 1), lambda i: u.r[i] > 0)) AS rank FROM t JOIN st ON st.work = t.work AND st.bucket = t.bucket JOIN u ON t.turn > st.n - u.r[st.g] AND t.turn <= st.n - u.after[st.g])"""


def bucketed(t):
    from quillmill.functions.text import length_bucket

    return entries(t).withColumns({"char_count": F.length("text"), "bucket": length_bucket(F.length("text"))})


@query("w3_stratified_sample", f"WITH RECURSIVE {RANKED} SELECT entry_id, work, bucket, turn, rank FROM r WHERE rank <= 120")
def _(t):
    return sampling.stratified(bucketed(t).select("entry_id", "work", "bucket"), ["work", "bucket"], "s1", 120)


@query("w4_staged_release", f"""WITH RECURSIVE {RANKED}, s AS (SELECT * FROM (VALUES (0, 'pilot', 40), (1, 'canary', 120), (2, 'full', (SELECT count(*) FROM documents))) v(step, stage, wanted)),
x AS (SELECT step, stage, wanted, count(*) AS rows, count(*) FILTER (entry_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS failed_rows FROM s JOIN r ON r.rank <= s.wanted GROUP BY ALL)
SELECT stage, wanted, rows, failed_rows, coalesce(sum(failed_rows) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS released FROM x""")
def _(t):
    ranked = sampling.stratified(bucketed(t).select("entry_id", "work", "bucket"), ["work", "bucket"], "s1")
    return sampling.staged_release(ranked, {"pilot": 40, "canary": 120, "full": t.documents.count()}, t.labels.filter("quality = 0").select(F.col("doc_id").alias("entry_id")))


@query("w5_pack_batches", f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY entry_id) AS k FROM {DOCS}),
g AS (SELECT work, entry_id, char_count, k, 0 AS batch, CASE WHEN char_count > 3000 THEN 0 ELSE 1 END AS n, CASE WHEN char_count > 3000 THEN 0 ELSE char_count END AS total FROM o WHERE k = 1
UNION ALL SELECT o.work, o.entry_id, o.char_count, o.k,
 CASE WHEN o.char_count > 3000 OR g.n = 0 OR g.n >= 6 OR g.total + o.char_count > 4000 THEN g.batch + 1 ELSE g.batch END,
 CASE WHEN o.char_count > 3000 THEN 0 WHEN g.n = 0 OR g.n >= 6 OR g.total + o.char_count > 4000 THEN 1 ELSE g.n + 1 END,
 CASE WHEN o.char_count > 3000 THEN 0 WHEN g.n = 0 OR g.n >= 6 OR g.total + o.char_count > 4000 THEN o.char_count ELSE g.total + o.char_count END
 FROM g JOIN o ON o.work = g.work AND o.k = g.k + 1) SELECT work, entry_id, char_count, batch FROM g""")
def _(t):
    return sampling.pack_batches(bucketed(t), "work", "entry_id", "char_count")


@query("w6_circular_sample", """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
q AS (SELECT item_id, ('0x' || substr(sha256('s2|' || text), 1, 15))::BIGINT % (SELECT count(*) FROM documents) AS off FROM benchmark)
SELECT item_id, doc_id, place::INT AS place FROM q, (SELECT unnest(range(0, 8)) AS place) JOIN i ON i.idx = (off + place) % i.n""")
def _(t):
    return sampling.circular_sample(t.documents, t.benchmark, "doc_id", 8, "s2", "item_id", "text")


@query("s13_select_by_ids", """WITH l AS (SELECT (user_id * 7)::VARCHAR AS id, event_id AS pos FROM events WHERE event_id % 7 <> 0), s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM l)
SELECT id, pos, doc_id, CASE WHEN doc_id IS NULL THEN 'unknown' WHEN nth > 1 THEN 'duplicate' END AS problem FROM s LEFT JOIN documents d ON d.doc_id::VARCHAR = s.id""")
def _(t):
    k = F.col("event_id") % 7
    lines = t.events.select(F.when(k == 0, F.lit("# note")).otherwise((F.col("user_id") * 7).cast("string")).alias("value"), F.col("event_id").alias("pos"))
    return sampling.select_by_ids(t.documents.select("doc_id"), lines, "doc_id")


@query("w11_shard_index", "SELECT doc_id, source, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10)::INT AS shard FROM documents")
def _(t):
    return sampling.with_shard(t.documents.select("doc_id", "source"), "source", "doc_id", 10)


@query("w2_segment_ordinal", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations")
def _(t):
    from pyspark.sql import Window as W

    return t.conversations.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("ordinal"))


@query("w12_running_progress", "SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER w AS total_failed, sum(1) OVER w AS total_done FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    b = t.events.select("user_id", "event_id", (F.col("event_type") == "error").cast("int").alias("failed"), F.lit(1).alias("done"))
    return sampling.running_progress(b, "user_id", "event_id", ["failed", "done"]).drop("failed", "done")


@query("p3_alias_record", "SELECT p_partkey, p_name AS title, p_brand AS family, p_size > 40 AS sensitive, p_retailprice > 1500 AND NOT p_size > 40 AS offerable FROM part")
def _(t):
    raw = t.part.withColumnsRenamed({"p_name": "storyTitle", "p_brand": "family_id"})
    r = curation.coalesce_aliases(raw, {"title": ["story_title", "storyTitle"], "family": ["familyId", "family_id"]})
    return r.select("p_partkey", "title", "family", (F.col("p_size") > 40).alias("sensitive")).join(t.part.select("p_partkey", "p_retailprice"), "p_partkey").select("p_partkey", "title", "family", "sensitive", ((F.col("p_retailprice") > 1500) & ~F.col("sensitive")).alias("offerable"))




@query("p4_eligibility", "SELECT p_partkey, coalesce(length(p_name) > 0, false) AS ok_title, coalesce(p_size BETWEEN 1 AND 30, false) AS ok_size, coalesce(p_retailprice < 1800, false) AS ok_price, coalesce(p_type LIKE '%E%', false) AS ok_type, coalesce(length(p_name) > 0 AND p_size BETWEEN 1 AND 30 AND p_retailprice < 1800 AND p_type LIKE '%E%', false) AS eligible FROM part")
def _(t):
    rules = {"title": F.length("p_name") > 0, "size": F.col("p_size").between(1, 30), "price": F.col("p_retailprice") < 1800, "type": F.contains("p_type", F.lit("E"))}
    return curation.gate(t.part, rules).select("p_partkey", "ok_title", "ok_size", "ok_price", "ok_type", "eligible")


@query("p5_sensitive_gate", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 OR quality = 1")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    opted_in = F.lit(True)
    return d.filter((F.coalesce("toxic", F.lit(0)) == 0) | (opted_in & (F.col("quality") == 1))).select("doc_id")


@query("p6_excluded_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.filter("toxic = 1"), "doc_id", "left_anti")


@query("p7_story_card", r"""WITH c AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, text FROM documents), h AS (SELECT *, substr(t, 1, 520) AS head, regexp_extract(substr(t, 1, 520), '(?s)^(.*[。！？；.!?;])', 1) AS cut FROM c)
SELECT doc_id, source AS title, CASE WHEN length(t) <= 520 THEN t ELSE rtrim(CASE WHEN length(cut) - 1 >= 260 THEN cut ELSE head END) || '…' END AS excerpt, right(t, 220) AS ending, sha256(text) AS text_sha256 FROM h""")
def _(t):
    from quillmill.functions import text as tx

    whole = tx.compact_text(F.col("text"))
    return t.documents.select("doc_id", F.col("source").alias("title"), tx.clip_at_sentence(F.col("text"), 520).alias("excerpt"), F.right(whole, F.lit(220)).alias("ending"), tx.text_hash(F.col("text")).alias("text_sha256"))


@query("a5_overview", "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type")
def _(t):
    return curation.overview(t.part, "p_type")


@query("a6_catalog_status", "SELECT c_mktsegment AS status, count(*) AS n, count(*) FILTER (c_custkey IS NULL) AS without_id FROM customer GROUP BY c_mktsegment")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("without_id"))


@query("a7_unique_families", "SELECT p_partkey, p_type || p_size AS family FROM part WHERE p_type || p_size IN (SELECT p_type || p_size FROM part GROUP BY ALL HAVING count(*) = 1)")
def _(t):
    return curation.unique_families(t.part.select(F.concat("p_type", F.col("p_size").cast("string")).alias("family"), "p_partkey"), "family")


@query("a15_family_types", "SELECT p_brand AS family, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy(F.col("p_brand").alias("family")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query("a17_remaining_candidates", "SELECT lang, greatest(0, count(*) - count(DISTINCT l.doc_id)) AS remaining FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY lang")
def _(t):
    seen = t.labels.filter("quality = 1").select("doc_id").distinct().withColumn("seen", F.lit(1))
    return t.documents.join(seen, "doc_id", "left").groupBy("lang").agg(F.greatest(F.lit(0), F.count("*") - F.count("seen")).alias("remaining"))


@query("a11_distribution", "SELECT lang, max(length(text)) AS max_chars, count(*) FILTER (length(text) > 4000) AS oversize, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.max(F.length("text")).alias("max_chars"), F.count_if(F.length("text") > 4000).alias("oversize"), F.count("*").alias("n"))


@query("u2_merge_unique", "WITH b AS (SELECT s_suppkey AS id, s_name AS sig, 0 AS added FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 1 THEN s_name || '*' ELSE s_name END, 1 FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 5 = 1) SELECT id, first(sig ORDER BY added) AS sig, CASE WHEN count(DISTINCT sig) > 1 THEN 'conflict' WHEN min(added) = 0 THEN 'kept' ELSE 'added' END AS action FROM b GROUP BY id")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("sig"))
    odd = F.col("id") % 5 == 1
    new = s.filter((F.col("id") % 2 == 0) | odd).withColumn("sig", F.when(odd, F.concat("sig", F.lit("*"))).otherwise(F.col("sig")))
    return curation.merge_unique(s.filter("id % 3 <> 0"), new, "id", "sig")


@query("u3_exact_partition", "SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) AS both, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0) AS missing, 0 AS unknown")
def _(t):
    s = t.supplier.select("s_suppkey")
    return curation.partition_check(s, s.filter("s_suppkey % 2 = 0"), s.filter("s_suppkey % 3 = 0"), "s_suppkey")


@query("u4_set_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT doc_id FROM documents WHERE lang <> 'de') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def _(t):
    return curation.set_difference(t.documents.filter("lang <> 'de'"), t.labels, "doc_id")


@query("u7_role_split", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'primary' ELSE 'secondary' END AS role, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['quote', 'retell', 'stage'] ELSE ['quote'] END, ',') AS uses FROM part")
def _(t):
    first = F.col("p_size") % 2 == 0
    uses = F.when(first, F.array(F.lit("quote"), F.lit("retell"), F.lit("stage"))).otherwise(F.array(F.lit("quote")))
    return t.part.select("p_partkey", F.when(first, "primary").otherwise("secondary").alias("role"), F.array_join(uses, ",").alias("uses"))


@query("j12_family_pointers", """WITH s AS (SELECT p_brand AS family, min(p_partkey) AS primary_id, max(p_partkey) + CASE WHEN p_brand LIKE '%5' THEN 1000000 ELSE 0 END AS secondary_id FROM part GROUP BY p_brand)
SELECT s.family, primary_id, secondary_id, CASE WHEN a.p_partkey IS NULL THEN 'primary_unknown' WHEN b.p_partkey IS NULL THEN 'secondary_unknown' WHEN a.p_brand <> s.family OR b.p_brand <> s.family THEN 'family_differs' WHEN primary_id = secondary_id THEN 'same_version' END AS problem
FROM s LEFT JOIN part a ON a.p_partkey = primary_id LEFT JOIN part b ON b.p_partkey = secondary_id""")
def _(t):
    sel = t.part.groupBy(F.col("p_brand").alias("family")).agg(F.min("p_partkey").alias("primary_id"), F.max("p_partkey").alias("secondary_id"))
    sel = sel.withColumn("secondary_id", F.col("secondary_id") + F.when(F.endswith("family", F.lit("5")), 1000000).otherwise(0))
    return curation.family_pointers(sel, t.part.select(F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("family")))


@query("v1_record_rules", r"WITH k AS (SELECT doc_id, text, lang, source, n_chars FROM documents), i AS (SELECT doc_id, unnest([CASE WHEN NOT length(text) >= 20 THEN 'short' END, CASE WHEN NOT regexp_matches(source, '^src\d+$') THEN 'source' END, CASE WHEN NOT n_chars = length(text) THEN 'chars' END, CASE WHEN NOT lang IN ('en', 'de') THEN 'lang' END]) AS code FROM k) SELECT doc_id, code FROM i WHERE code IS NOT NULL")
def _(t):
    rules = {"short": F.length("text") >= 20, "source": F.rlike("source", F.lit(r"^src\d+$")), "chars": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "de")}
    return curation.issues(t.documents, "doc_id", rules)


@query("a13_issue_histogram", "WITH i AS (SELECT doc_id, 'short' AS code FROM documents WHERE length(text) < 300 UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang NOT IN ('en', 'de')) SELECT code, count(*) AS n, array_to_string((list(doc_id ORDER BY doc_id))[1:5], ',') AS examples FROM i GROUP BY code")
def _(t):
    found = curation.issues(t.documents, "doc_id", {"short": F.length("text") >= 300, "lang": F.col("lang").isin("en", "de")})
    return curation.issue_histogram(found, "doc_id").withColumn("examples", F.array_join("examples", ","))


@query("v4_layer_rules", "SELECT p_brand AS family, count(*) FILTER (p_size % 2 = 0) AS primaries, count(*) FILTER (p_size % 2 = 1) AS witnesses, count(DISTINCT p_type) AS types, count(*) FILTER (p_size % 2 = 0) = 1 AS ok FROM part GROUP BY p_brand")
def _(t):
    first = F.count_if(F.col("p_size") % 2 == 0)
    return t.part.groupBy(F.col("p_brand").alias("family")).agg(first.alias("primaries"), F.count_if(F.col("p_size") % 2 == 1).alias("witnesses"), F.count_distinct("p_type").alias("types"), (first == 1).alias("ok"))


@query("v5_leak_scan", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?:password|secret|token)\s*[:=]') OR contains(text, 'AKIA')")
def _(t):
    return curation.leaks(t.documents, "doc_id", r"(?:password|secret|token)\s*[:=]|AKIA")


@query("v6_build_catalog", "WITH s AS (SELECT s_suppkey AS id, s_name AS title FROM supplier), d AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'approved' ELSE 'drafted' END AS status FROM part WHERE p_partkey % 3 = 0), o AS (SELECT s_suppkey AS id, 'retired' AS status FROM supplier WHERE s_suppkey % 10 = 0), r AS (SELECT coalesce(s.id, d.id) AS id, title, coalesce(o.status, d.status, 'discovered') AS status FROM s FULL JOIN d ON s.id = d.id LEFT JOIN o ON o.id = coalesce(s.id, d.id)) SELECT id, title, status, CASE status WHEN 'approved' THEN 'none' WHEN 'drafted' THEN 'review' ELSE 'draft' END AS next_gate FROM r")
def _(t):
    seed = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    detailed = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "approved").otherwise("drafted").alias("status"))
    return curation.build_catalog(seed, detailed, t.supplier.filter("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("id"), F.lit("retired").alias("status")))


@query("v7_catalog_rules", "SELECT s_suppkey AS id, 'nation' AS code FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def _(t):
    known = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    return t.supplier.join(known, "s_nationkey", "left_anti").select(F.col("s_suppkey").alias("id"), F.lit("nation").alias("code"))


@query("v8_witness_count", "SELECT count(*) AS n, count(DISTINCT p_name) AS names, count(*) = count(DISTINCT p_partkey) AS ids_unique FROM part WHERE p_size % 2 = 1")
def _(t):
    return t.part.filter("p_size % 2 = 1").agg(F.count("*").alias("n"), F.count_distinct("p_name").alias("names"), (F.count("*") == F.count_distinct("p_partkey")).alias("ids_unique"))


@query("v12_contract", r"WITH i AS (SELECT c_custkey, unnest([CASE WHEN c_name IS NULL THEN 'required:c_name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE') THEN 'enum:c_mktsegment' END, CASE WHEN NOT regexp_matches(c_name, '[02468]$') THEN 'pattern:c_name' END, CASE WHEN NOT length(c_mktsegment) BETWEEN 1 AND 9 THEN 'size:c_mktsegment' END]) AS code FROM customer) SELECT c_custkey, code FROM i WHERE code IS NOT NULL")
def _(t):
    return curation.contract(t.customer, "c_custkey", ["c_name"], {"c_mktsegment": ["BUILDING", "AUTOMOBILE"]}, {"c_name": "[02468]$"}, {"c_mktsegment": (1, 9)})


@query("s15_standardise_columns", "SELECT doc_id AS entry_id, source AS work, n_chars AS char_count FROM documents")
def _(t):
    wanted = {"entry_id": ["story_id", "doc_id"], "work": ["source_work_id", "source"], "char_count": ["chars", "n_chars"]}
    return curation.standardise_columns(t.documents, wanted).select("entry_id", "work", "char_count")

"""Queries of ledger, lineage, review and calibration operators.

events stand for a ledger's event log (user_id is the entry, event_type the
status), labels for a gold set, conversations for lineages (turn is the iteration).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.operators import ledger as lg
from quillmill.operators import review as rv
from quillmill.registry import query

SHA = lambda c: F.sha2(F.col(c).cast("binary"), 256)
_STATUS = "CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'retryable_failed' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'queued' ELSE 'quarantined' END"
_EV = f"e AS (SELECT event_id, ts, user_id AS entry_id, {_STATUS} AS status, value, event_id % 2 AS mode FROM events)"
_LAST = f"{_EV}, l AS (SELECT entry_id, arg_max(status, event_id) AS status, count(*) AS attempts FROM e GROUP BY entry_id)"


def log(t):
    s = F.col("event_type")
    status = F.when(s == "purchase", "valid").when(s == "error", "retryable_failed").when(s == "view", "leased").when(s == "click", "queued").otherwise("quarantined")
    return t.events.select("event_id", "ts", F.col("user_id").alias("entry_id"), status.alias("status"), "value", (F.col("event_id") % 2).alias("mode"))


def last(t):
    return lg.latest(log(t), "entry_id", ["event_id"], ["status"])


@query("l1_enqueue", """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS entry_id, coalesce(n.h, o.h) AS source_hash, CASE WHEN o.h IS NULL THEN 'queued' WHEN n.h IS NOT NULL AND o.h <> n.h THEN 'stale' ELSE 'valid' END AS status, CASE WHEN o.h IS NOT NULL AND (n.h IS NULL OR o.h = n.h) THEN 'p' END AS payload FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("entry_id"), SHA("text").alias("source_hash"))
    old = d.filter("entry_id % 5 <> 0").withColumn("source_hash", F.when(F.col("entry_id") % 7 == 0, "old").otherwise(F.col("source_hash")))
    return lg.enqueue(old.withColumns({"status": F.lit("valid"), "payload": F.lit("p")}), d.filter("entry_id % 11 <> 0"))


@query("l2_invalidate", f"WITH {_EV} SELECT event_id, CASE WHEN status = 'valid' AND (event_id % 3 <> 0 OR mode <> 0) THEN 'stale' ELSE status END AS status FROM e")
def _(t):
    x = log(t).select("event_id", "status", F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.concat(F.lit("p"), F.col("mode").cast("string")).alias("prompt"))
    return lg.invalidate(x, {"model": "m0", "prompt": "p0"}).select("event_id", "status")


@query("l3_pending", f"WITH {_LAST}, s AS (SELECT entry_id, count(DISTINCT mode) AS modes FROM e WHERE status = 'valid' GROUP BY entry_id) SELECT l.entry_id, status, NULL::VARCHAR AS problem FROM l LEFT JOIN s USING (entry_id) WHERE status IN ('queued', 'retryable_failed', 'stale', 'leased') OR status = 'valid' AND coalesce(modes, 0) < 2")
def _(t):
    return lg.pending(log(t).select("entry_id").distinct(), last(t), True, False, log(t).select("entry_id", "mode", "status"))


@query("l4_transitions", f"""WITH {_EV}, b AS (SELECT event_id, entry_id, status, lag(status) OVER (PARTITION BY entry_id ORDER BY event_id) AS before FROM e)
SELECT event_id, before, coalesce((before IS NULL AND status = 'queued') OR (before = 'queued' AND status = 'leased') OR (before = 'leased' AND status IN ('valid', 'retryable_failed', 'quarantined')) OR (before = 'retryable_failed' AND status IN ('leased', 'quarantined')) OR (before = 'valid' AND status = 'stale') OR (before IN ('stale', 'quarantined') AND status = 'leased'), false) AS legal FROM b""")
def _(t):
    return lg.transitions(log(t), "entry_id", ["event_id"]).select("event_id", "before", "legal")


@query("l4_latest_status", f"WITH {_LAST} SELECT entry_id, status, attempts FROM l")
def _(t):
    return last(t)


@query("l5_retry_budget", f"WITH {_LAST} SELECT entry_id, attempts, greatest(70 - attempts, 0) AS left_, CASE WHEN attempts < 70 THEN 'retry_single' ELSE 'quarantined' END AS action FROM l WHERE status = 'retryable_failed'")
def _(t):
    return lg.retry_round(last(t).filter("status = 'retryable_failed'"), "entry_id", "attempts", 70).withColumnRenamed("left", "left_")


@query("l6_revalidate", f"WITH {_EV} SELECT event_id, entry_id, CASE WHEN value >= 10 THEN 'valid' ELSE 'quarantined' END AS status FROM e WHERE status = 'quarantined' AND mode = 0")
def _(t):
    same = log(t).filter("status = 'quarantined' and mode = 0")
    return same.select("event_id", "entry_id", F.when(F.col("value") >= 10, "valid").otherwise("quarantined").alias("status"))


@query("l7_archive", "SELECT doc_id, sha256(text) AS digest, 'superseded' AS reason FROM documents WHERE doc_id % 4 = 0")
def _(t):
    d = t.documents.select("doc_id", SHA("text").alias("digest"))
    return lg.archive(d, d.withColumn("digest", F.when(F.col("doc_id") % 4 == 0, "new").otherwise(F.col("digest"))), "doc_id", "digest")


@query("l8_scope_guard", "SELECT source AS work, count(*) AS selected, CASE WHEN source = 'src3' THEN 'a full run needs confirmation' WHEN source = 'src4' THEN 'outputs overwrite inputs: [''documents'']' ELSE '' END AS problem FROM documents WHERE doc_id % 3 = 0 OR source = 'src3' GROUP BY source")
def _(t):
    # one run a source: src3 wants all its rows, src4 would write over its input
    picked = t.documents.filter("doc_id % 3 = 0 or source = 'src3'").groupBy("source").agg(F.count("*").alias("selected"))
    sizes = picked.join(t.documents.groupBy("source").agg(F.count("*").alias("rows")), "source").collect()  # a row a source
    out = []
    for r in sizes:
        try:
            lg.scope_guard(r.selected, r["rows"], False, ["documents"], ["documents" if r.source == "src4" else "selection"])
            out.append((r.source, r.selected, ""))
        except ValueError as e:
            out.append((r.source, r.selected, str(e)))
    return t.spark.createDataFrame(out, "work string, selected long, problem string")


@query("l9_manifest", f"WITH {_LAST} SELECT count(*) AS entries, sum(attempts)::BIGINT AS attempts, count(*) FILTER (status = 'valid') AS valid, 'v1' AS schema_version FROM l")
def _(t):
    return last(t).agg(F.count("*").alias("entries"), F.sum("attempts").alias("attempts"), F.count_if(F.col("status") == "valid").alias("valid"), F.lit("v1").alias("schema_version"))


@query("s14_valid_export", f"WITH {_LAST} SELECT entry_id, attempts FROM l WHERE status = 'valid'")
def _(t):
    out = last(t).filter("status = 'valid'").select("entry_id", "attempts")
    return out.repartitionByRange("entry_id").sortWithinPartitions("entry_id")


@query("a1_status_counts", f"WITH {_LAST} SELECT status, count(*) AS n FROM l GROUP BY status")
def _(t):
    return lg.status_counts(last(t))


@query("a2_stage_matrix", f"WITH {_EV} SELECT mode, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'leased') AS leased, count(*) FILTER (status = 'queued') AS queued FROM e GROUP BY mode")
def _(t):
    return lg.stage_matrix(log(t), "mode", ["valid", "leased", "queued"])


@query("a9_token_usage", f"WITH {_EV}, o AS (SELECT mode, event_id // 3 AS response_id, max(floor(value)::BIGINT) AS tokens FROM e GROUP BY ALL) SELECT mode, sum(tokens)::BIGINT AS tokens, count(*) AS responses FROM o GROUP BY mode")
def _(t):
    a = log(t).select("mode", F.floor(F.col("event_id") / 3).alias("response_id"), F.floor("value").alias("tokens"))
    return lg.token_usage(a, ["mode"], "response_id", "tokens")


@query("a10_rollup", f"WITH {_LAST} SELECT sum(attempts)::BIGINT AS attempts, count(*) FILTER (status = 'valid') AS succeeded, count(*) FILTER (status = 'retryable_failed') AS failed, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status IN ('queued', 'leased', 'stale')) AS pending FROM l")
def _(t):
    return lg.rollup(last(t))


@query("a12_quality_metrics", "SELECT round(avg((length(text) >= 100)::INT), 6) AS long_enough, round(avg((lang = 'en')::INT), 6) AS english, round(avg((n_chars = length(text))::INT), 6) AS count_ok FROM documents")
def _(t):
    c = t.documents.select((F.length("text") >= 100).alias("long_enough"), (F.col("lang") == "en").alias("english"), (F.col("n_chars") == F.length("text")).alias("count_ok"))
    return lg.quality_metrics(c, ["long_enough", "english", "count_ok"])


@query("j1_entry_annotations", "SELECT doc_id, quality, n_chars = length(text) AS length_ok FROM documents JOIN labels USING (doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "quality", (F.col("n_chars") == F.length("text")).alias("length_ok"))


@query("j2_overlay", f"WITH {_EV}, r AS (SELECT entry_id, max(event_id) AS iteration FROM e WHERE status = 'valid' GROUP BY entry_id) SELECT c_custkey AS entry_id, CASE WHEN iteration IS NULL THEN c_name ELSE 'r' || iteration END AS payload, CASE WHEN iteration IS NULL THEN 'base' ELSE 'repair' END AS origin, coalesce(iteration, 0) AS iteration FROM customer LEFT JOIN r ON entry_id = c_custkey")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("payload"))
    repairs = log(t).select("entry_id", "status", F.col("event_id").alias("iteration"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("payload"))
    return lg.overlay(base, repairs, "entry_id", "payload")


@query("j3_orphans", "SELECT DISTINCT user_id AS entry_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(t):
    known = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entry_id"))
    return log(t).select("entry_id").distinct().join(known, "entry_id", "left_anti")


@query("j8_repair_base", "SELECT doc_id AS entry_id, CASE doc_id % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'repair' END AS origin, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS iteration, CASE WHEN doc_id % 4 = 3 THEN 'hash_matches_nothing' END AS problem FROM documents")
def _(t):
    h = lambda s: F.sha2(F.concat("text", F.lit(s)).cast("binary"), 256)
    v = t.documents.select(F.col("doc_id").alias("entry_id"), h("b").alias("base_hash"), h("p").alias("progress_hash"), h("c").alias("current_hash"), F.lit(2).alias("current_iteration"))
    k = F.col("doc_id") % 4
    r = t.documents.select(F.col("doc_id").alias("entry_id"), F.when(k == 0, h("b")).when(k == 1, h("p")).when(k == 2, h("c")).otherwise("x").alias("reviewed_hash"))
    return lg.repair_base(r, v)


@query("j9_stage_pairs", f"WITH {_EV}, v AS (SELECT entry_id, count(*) FILTER (mode = 0) AS a, count(*) FILTER (mode = 1) AS b FROM e WHERE status = 'quarantined' GROUP BY entry_id) SELECT entry_id, CASE WHEN a = 0 THEN 'omission_missing' WHEN b = 0 THEN 'contradiction_missing' WHEN a > 1 OR b > 1 THEN 'repeated' END AS problem FROM v")
def _(t):
    s = log(t).filter("status = 'quarantined'").withColumn("mode", F.when(F.col("mode") == 0, "omission").otherwise("contradiction"))
    return lg.stage_pairs(s, "entry_id", "omission", "contradiction")


_CHAIN = "c AS (SELECT conv_id, turn + 1 + CASE WHEN conv_id % 5 = 1 AND turn > 1 THEN 1 ELSE 0 END AS iteration, sha256(text) AS hash, CASE WHEN conv_id % 4 = 1 THEN 'x' ELSE lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations)"


def chain(t):
    from pyspark.sql import Window as W

    before = F.lag(SHA("text")).over(W.partitionBy("conv_id").orderBy("turn"))
    step = F.col("turn") + 1 + F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") > 1), 1).otherwise(0)
    return t.conversations.select("conv_id", step.alias("iteration"), SHA("text").alias("hash"), F.when(F.col("conv_id") % 4 == 1, "x").otherwise(before).alias("parent"))


_BROKEN = f"{_CHAIN}, x AS (SELECT *, lag(hash) OVER w AS p, lag(iteration) OVER w AS pi FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY iteration)), y AS (SELECT conv_id, bool_or(pi IS NOT NULL AND parent IS DISTINCT FROM p) AS parent, bool_or(CASE WHEN pi IS NULL THEN iteration <> 1 ELSE iteration <> pi + 1 END) AS gap, count(DISTINCT hash) < count(*) AS repeated FROM x GROUP BY conv_id)"


@query("w8_lineage_check", f"WITH {_BROKEN} SELECT conv_id, code FROM (SELECT conv_id, unnest([CASE WHEN parent THEN 'parent' END, CASE WHEN gap THEN 'gap' END, CASE WHEN repeated THEN 'repeated' END]) AS code FROM y) WHERE code IS NOT NULL")
def _(t):
    return lg.lineage_check(chain(t), "conv_id")


@query("c8_cycle_check", "WITH n AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN sha256(arg_max(text, turn)) WHEN conv_id % 3 = 1 THEN sha256(arg_min(text, turn)) ELSE 'fresh' END AS h, sha256(arg_max(text, turn)) AS base FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN h = base THEN 'no_op' WHEN h <> 'fresh' THEN 'cycle' ELSE 'new' END AS verdict FROM n")
def _(t):
    from pyspark.sql import functions as G

    k = F.col("conv_id") % 3
    n = t.conversations.groupBy("conv_id").agg(G.max_by("text", "turn").alias("last"), G.min_by("text", "turn").alias("first"))
    cand = n.select("conv_id", F.when(k == 0, SHA("last")).when(k == 1, SHA("first")).otherwise("fresh").alias("new_hash"), SHA("last").alias("base_hash"))
    return lg.cycle_check(cand, t.conversations.select("conv_id", SHA("text").alias("hash")), "conv_id")


@query("j14_four_ledgers", "WITH i AS (SELECT d.doc_id, unnest([CASE WHEN l.doc_id IS NULL THEN 'labels:missing' END, CASE WHEN d.doc_id % 6 = 0 THEN 'review:missing' END, CASE WHEN d.doc_id % 6 <> 0 AND d.doc_id % 5 = 0 THEN 'review:chars' END]) AS code FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id, code FROM i WHERE code IS NOT NULL")
def _(t):
    d = t.documents.select("doc_id", F.col("n_chars").alias("chars"))
    review = d.filter("doc_id % 6 <> 0").withColumn("chars", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("chars")))
    return lg.agreement({"source": d, "labels": d.join(t.labels.select("doc_id"), "doc_id"), "review": review, "effective": d}, "doc_id", ["chars"])


_ISS = "i AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 13 = 0 THEN 'strange' WHEN toxic = 1 THEN 'missing_tone' ELSE 'wrong_quality' END AS code, CASE WHEN toxic = 1 THEN 'tone' ELSE 'quality' END AS field, substr(text, 5, 12) AS excerpt, CASE WHEN doc_id % 2 = 0 THEN 'maybe add it' ELSE 'correct it' END AS hint FROM labels JOIN documents USING (doc_id) WHERE toxic = 1 OR quality = 0)"
FIELDS = [("missing_tone", "tone"), ("wrong_quality", "quality")]


def issues(t):
    tox = F.col("toxic") == 1
    j = t.labels.join(t.documents, "doc_id").filter(tox | (F.col("quality") == 0))
    code = F.when(F.col("doc_id") % 13 == 0, "strange").when(tox, "missing_tone").otherwise("wrong_quality")
    return j.select(F.col("doc_id").alias("entry_id"), code.alias("code"), F.when(tox, "tone").otherwise("quality").alias("field"), F.substring("text", 5, 12).alias("excerpt"), F.when(F.col("doc_id") % 2 == 0, "maybe add it").otherwise("correct it").alias("hint"))


@query("c1_review_audit", f"WITH {_ISS} SELECT entry_id, code, problem FROM (SELECT entry_id, code, unnest([CASE WHEN code = 'strange' THEN 'unknown_code' END, CASE WHEN hint LIKE 'maybe%' THEN 'soft_language' END]) AS problem FROM i) WHERE problem IS NOT NULL")
def _(t):
    texts = t.documents.select(F.col("doc_id").alias("entry_id"), "text")
    return rv.audit_issues(issues(t), texts, t.spark.createDataFrame(FIELDS, "code string, field string"))


@query("c2_direction_audit", f"WITH {_ISS} SELECT entry_id, CASE WHEN code = 'strange' THEN 'code_not_allowed' WHEN field = 'quality' THEN 'target_absent' END AS problem FROM i WHERE code = 'strange' OR field = 'quality' AND entry_id % 3 = 0")
def _(t):
    x = issues(t).withColumn("mode", F.when(F.col("field") == "tone", "omission").otherwise("contradiction"))
    x = x.withColumn("target", F.when((F.col("field") == "quality") & (F.col("entry_id") % 3 == 0), "gone").otherwise(F.col("field")))
    values = t.documents.select(F.col("doc_id").alias("entry_id"), F.lit("quality").alias("field"), F.lit("quality").alias("value"))
    return rv.audit_direction(x, values, {"omission": ["missing_tone"], "contradiction": ["wrong_quality"]})


@query("c3_field_values", "SELECT doc_id, field, value FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS field, unnest([quality::VARCHAR, toxic::VARCHAR]) AS value FROM labels)")
def _(t):
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic")])
    return t.labels.select("doc_id", F.inline(pairs))


@query("c4_canonical_names", "SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'press' ELSE event_type END AS event_type FROM events")
def _(t):
    a = t.spark.createDataFrame([("view", "read"), ("click", "press")], "alias string, name string")
    return rv.canonical_names(t.events.select("event_id", "event_type"), "event_type", a)


@query("c5_shape_normalisation", """SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT = 0 AS empty FROM events""")
def _(t):
    m = F.from_json("props", "map<string,int>")
    pairs = F.map_from_entries(F.transform(F.map_keys(m), lambda k: F.struct(k, m[k])))
    return t.events.select("event_id", pairs["k"].alias("k"), F.forall(F.map_values(pairs), lambda v: v == 0).alias("empty"))


@query("c6_repair_candidates", "SELECT doc_id AS entry_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 3 END AS iteration FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 2 = 0")
def _(t):
    from quillmill import registry

    x = registry._QUERIES["j8_repair_base"](t.spark, t.sf_dir)
    return x.filter("problem is null and iteration <= 3 and entry_id % 2 = 0").select("entry_id", "iteration")


@query("c7_effective_record", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS lineage_length, sha256(text) AS current_hash FROM documents JOIN labels USING (doc_id)")
def _(t):
    unsure = F.col("toxic") == 1
    line = F.array(F.sha2(F.col("source").cast("binary"), 256))
    grown = F.when(unsure, F.array_append(line, SHA("text"))).otherwise(line)
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.when(unsure, "low").otherwise("high").alias("confidence"), F.size(grown).alias("lineage_length"), SHA("text").alias("current_hash"))


@query("c10_rereview_coverage", "SELECT count(*) AS repaired, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS passed FROM labels WHERE toxic = 1")
def _(t):
    passed = t.labels.filter("quality = 1").select("doc_id").withColumn("p", F.lit(1))
    return t.labels.filter("toxic = 1").select("doc_id").join(passed, "doc_id", "left").agg(F.count("*").alias("repaired"), F.count("p").alias("passed"))


def gold(t):
    empty = F.array().cast("array<string>")
    must = F.concat(F.when(F.col("toxic") == 1, F.array(F.lit("tone"))).otherwise(empty), F.when(F.col("quality") == 0, F.array(F.lit("quality"))).otherwise(empty))
    never = F.when((F.col("toxic") == 0) | (F.col("doc_id") % 10 == 0), F.array(F.lit("tone"))).otherwise(empty)
    return t.labels.select(F.col("doc_id").alias("entry_id"), must.alias("must_detect"), never.alias("must_not_flag"), (F.size(must) > 0).alias("has_error"))


_GOLD = "g AS (SELECT doc_id AS entry_id, toxic = 1 AS need_tone, quality = 0 AS need_quality, toxic = 0 OR doc_id % 10 = 0 AS no_tone, toxic = 1 OR quality = 0 AS has_error FROM labels), f AS (SELECT doc_id AS entry_id, regexp_matches(text, 'idiot|clown|trash') AS tone, regexp_matches(text, '[#%$]{3}|!!') AS quality FROM documents)"


def found(t):
    tone, quality = F.rlike("text", F.lit("idiot|clown|trash")), F.rlike("text", F.lit("[#%$]{3}|!!"))
    return t.documents.select(F.col("doc_id").alias("entry_id"), F.array_compact(F.array(F.when(tone, "tone"), F.when(quality, "quality"))).alias("fields"))


@query("c11_gold_checks", f"WITH {_GOLD} SELECT entry_id, 'overlap' AS problem FROM g WHERE need_tone AND no_tone")
def _(t):
    return rv.gold_checks(gold(t))


@query("c12_issue_direction", f"WITH {_ISS} SELECT entry_id, code, CASE WHEN code LIKE 'wrong%' THEN 'contradiction' WHEN code LIKE 'missing%' OR hint LIKE '%add%' THEN 'omission' ELSE 'contradiction' END AS direction FROM i")
def _(t):
    return issues(t).select("entry_id", "code", rv.infer_direction(F.col("code"), F.col("hint")).alias("direction"))


@query("c13_field_scores", f"""WITH {_GOLD}, j AS (SELECT g.*, tone OR quality AS revised, tone, quality FROM g JOIN f USING (entry_id)) SELECT round(count(*) FILTER (has_error AND revised) / nullif(count(*) FILTER (has_error), 0), 6) AS record_recall, round(count(*) FILTER (has_error AND revised) / nullif(count(*) FILTER (revised), 0), 6) AS revise_precision,
round(sum((need_tone AND tone)::INT + (need_quality AND quality)::INT) / nullif(sum(need_tone::INT + need_quality::INT), 0), 6) AS required_detection, count(*) FILTER (NOT has_error AND revised) AS pure_false_positives, count(*) FILTER (no_tone AND tone) AS must_not_violations, count(*) FILTER (has_error AND NOT revised) AS false_passes FROM j""")
def _(t):
    return rv.field_scores(gold(t), found(t))


@query("c14_direction_scores", f"WITH {_GOLD}, x AS (SELECT entry_id, 'tone' AS field, 'omission' AS direction FROM g WHERE need_tone UNION ALL SELECT entry_id, 'quality', 'contradiction' FROM g WHERE need_quality AND NOT entry_id % 6 = 0), h AS (SELECT direction, CASE WHEN field = 'tone' THEN tone ELSE quality END AS hit FROM x JOIN f USING (entry_id)) SELECT direction, count(*) AS expected, count(*) FILTER (hit) AS detected, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM h GROUP BY direction")
def _(t):
    g = gold(t).select("entry_id", F.explode("must_detect").alias("field"))
    way = lambda df: df.withColumn("direction", F.when(F.col("field") == "tone", "omission").otherwise("contradiction"))
    twice = way(g).filter("field = 'quality' and entry_id % 6 = 0").withColumn("direction", F.lit("omission"))
    return rv.direction_scores(way(g).union(twice), way(found(t).select("entry_id", F.explode("fields").alias("field"))))


@query("c15_strict_audit", "WITH j AS (SELECT d.source, d.doc_id, CASE WHEN r.doc_id IS NULL THEN '' WHEN d.source = 'src2' AND d.doc_id % 40 = 2 THEN 'x' ELSE sha256(d.text) END = sha256(d.text) AS same FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE source <> 'src1' OR doc_id % 3 <> 0) r ON r.doc_id = d.doc_id) SELECT source, bool_and(same) AS complete, count(*) AS rows, CASE WHEN bool_and(same) THEN count(*) END AS audited FROM j GROUP BY source")
def _(t):
    # a run a source: src1 lacks reviews, src2 has stale ones, the others are whole
    d = t.documents.select(F.col("doc_id").alias("entry_id"), "source", SHA("text").alias("expected_hash"))
    stale = (F.col("source") == "src2") & (F.col("entry_id") % 40 == 2)
    reviews = d.filter("source <> 'src1' or entry_id % 3 <> 0").select("entry_id", F.when(stale, "x").otherwise(F.col("expected_hash")).alias("review_hash"))
    return rv.strict_audit(reviews, d, by=("source",))


@query("c16_entry_report", f"WITH {_ISS} SELECT entry_id, count(*) AS issues, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM i GROUP BY entry_id")
def _(t):
    return issues(t).groupBy("entry_id").agg(F.count("*").alias("issues"), F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))


@query("u5_merge_directions", f"WITH {_ISS} SELECT d.doc_id AS entry_id, CASE WHEN i.entry_id IS NULL THEN 'pass' ELSE 'revise' END AS verdict, (i.entry_id IS NOT NULL)::BIGINT AS issues, coalesce(field, '') AS fields FROM documents d LEFT JOIN (SELECT * FROM i WHERE code <> 'strange') i ON i.entry_id = d.doc_id")
def _(t):
    codes = t.spark.createDataFrame([("missing_tone", "TONE"), ("wrong_quality", "QUALITY")], "stage_code string, code string")
    both = issues(t).withColumnRenamed("code", "stage_code")
    merged = rv.merge_directions(both.union(both), codes)
    return rv.verdicts(t.documents.select(F.col("doc_id").alias("entry_id")), merged)


@query("u6_batch_closure", f"WITH {_EV}, w AS (SELECT DISTINCT event_id // 10 AS batch, entry_id FROM e), g AS (SELECT event_id // 10 AS batch, entry_id, count(*) AS n FROM e WHERE status <> 'valid' GROUP BY ALL) SELECT batch, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated FROM w LEFT JOIN g USING (batch, entry_id) GROUP BY batch")
def _(t):
    x = log(t).withColumn("batch", F.floor(F.col("event_id") / 10))
    got = x.filter("status <> 'valid'").groupBy("batch", "entry_id").agg(F.count("*").alias("n"))
    asked = x.select("batch", "entry_id").distinct()
    return asked.join(got, ["batch", "entry_id"], "full").groupBy("batch").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("k5_ordered_issues", f"WITH {_ISS} SELECT entry_id, string_agg(concat_ws('|', CASE field WHEN 'tone' THEN '1' ELSE '2' END, code, excerpt, hint), ';') AS ordered FROM i GROUP BY entry_id")
def _(t):
    return rv.ordered_issues(issues(t), t.spark.createDataFrame([("tone", 1), ("quality", 2)], "field string, position int"))


@query("j10_gold_reviews", "SELECT coalesce(l.doc_id, d.doc_id) AS entry_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'extra' ELSE 'title' END AS drift FROM (SELECT doc_id, source FROM labels JOIN documents USING (doc_id)) l FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE source END AS source FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL OR l.source <> d.source")
def _(t):
    g = t.labels.select(F.col("doc_id").alias("entry_id")).join(t.documents.select(F.col("doc_id").alias("entry_id"), F.col("source").alias("title")), "entry_id")
    r = t.documents.filter("lang = 'en'").select(F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("source")).alias("title"))
    return rv.drift(g, r, "entry_id", ["title"])


@query("j11_input_drift", "SELECT doc_id AS entry_id, CASE WHEN doc_id % 8 = 0 THEN 'text_hash' ELSE 'chars' END AS drift FROM documents JOIN labels USING (doc_id) WHERE doc_id % 8 = 0 OR doc_id % 9 = 0")
def _(t):
    now = t.documents.join(t.labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("entry_id"), SHA("text").alias("text_hash"), F.length("text").alias("chars"))
    then = now.withColumns({"text_hash": F.when(F.col("entry_id") % 8 == 0, "old").otherwise(F.col("text_hash")), "chars": F.when(F.col("entry_id") % 9 == 0, -1).otherwise(F.col("chars"))})
    return rv.drift(then, now, "entry_id", ["text_hash", "chars"])

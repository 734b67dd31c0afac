"""Queries of run and corpus validators and of ledgers under concurrent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill import shared
from quillmill.functions import text as tx
from quillmill.operators import dedup
from quillmill.operators import ledger as lg
from quillmill.operators import run
from quillmill.plans import corpus
from quillmill.plans.corpus import MARKED
from quillmill.registry import query
from quillmill.sources import snapshots

SHA = lambda c: F.sha2(F.col(c).cast("binary"), 256)
PLAIN = {"é": "e", "è": "e"}

#: What is spoilt (a field of the record, of the ledger row `row.` or of the source `source.`, by an SQL expression) and the codes.
FAULTS = [
    ("row.payload", "'{'", "invalid_json"),
    ("row.payload", "'[1]'", "root_not_object"),
    ("row.outer_sha256", "'x'", "outer_hash"),
    ("row.status", "'queued'", ""),
    ("row.payload", "'  '", ""),
    ("unit_id", "'x'", "outer_id"),
    ("source_sha256", "'x'", "outer_hash source_hash"),
    ("source_text", "'x'", "source_text"),
    ("source.gone", None, "source_missing"),
    ("source.canonical", "false", "source_not_canonical"),
    ("source.eligible", "false", "source_not_eligible"),
    ("evidence", "concat(evidence, slice(evidence, 1, 1))", "evidence_id_repeated"),
    ("evidence", "transform(evidence, e -> named_struct('id', e.id, 'start', e.start, 'end', 9999999L, 'excerpt', e.excerpt, 'supports', e.supports))", "evidence_range"),
    ("evidence", "transform(evidence, e -> named_struct('id', e.id, 'start', e.start, 'end', e.end, 'excerpt', repeat('x', 81), 'supports', e.supports))", "evidence_length evidence_not_exact"),
    ("evidence", "transform(evidence, e -> named_struct('id', e.id, 'start', e.start, 'end', e.end, 'excerpt', concat('~', e.excerpt), 'supports', e.supports))", "evidence_not_exact"),
    ("references", "array('E01', 'E09')", "reference_missing"),
    ("required", "array('tone', 'end')", "support_missing"),
    ("required", "slice(required, 1, 0)", "support_dangling"),
    ("generated", "array('caf' || char(233))", "generated_not_fixed"),
    ("review_status", "'reviewed'", "status_review"),
    ("research_ready", "true", "status_ready"),
    ("model_preannotation", "null", "status_preannotation"),
    ("human_reviewed", "true", "status_human"),
]
EVERY = 1 + len(FAULTS)
FIELDS = ["unit_id", "source_text", "source_sha256", "evidence", "required", "references", "generated", "product_status", "review_status", "research_ready", "model_preannotation", "human_reviewed"]


def records(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of texts with four characters at least, and their sources, with fault k in doc_id % EVERY = k."""
    d = documents.filter(F.length("text") >= 4).select(F.col("doc_id").cast("long").alias("outer_id"), F.col("text").alias("source_text"))
    piece = F.struct(F.lit("E01").alias("id"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("end"), F.substring("source_text", 1, 3).alias("excerpt"), F.array(F.lit("tone")).alias("supports"))
    r = d.withColumns({"unit_id": F.col("outer_id").cast("string"), "source_sha256": SHA("source_text"), "evidence": F.array(piece), "required": F.array(F.lit("tone")), "references": F.array(F.lit("E01")), "generated": F.array(F.lit("plain text"))})
    r = r.withColumns({"product_status": F.lit(run.AUTOMATIC), "review_status": F.lit("not_reviewed"), "research_ready": F.lit(False), "model_preannotation": F.lit(True), "human_reviewed": F.lit(False)})
    r = r.withColumns({"outer_sha256": F.col("source_sha256"), "status": F.lit("valid")})
    sources = d.select(F.col("outer_id").alias("entry_id"), F.col("source_text").alias("text"), SHA("source_text").alias("text_sha256"), F.lit(True).alias("canonical"), F.lit(True).alias("eligible"))
    late = []
    for k, (where, change, _) in enumerate(FAULTS, 1):
        layer, _, column = where.rpartition(".")
        if layer == "source":
            here = F.col("entry_id") % EVERY == k
            sources = sources.filter(~here) if change is None else sources.withColumn(column, F.when(here, F.expr(change)).otherwise(F.col(column)))
        elif column == "payload":
            late.append((k, change))
        else:
            r = r.withColumn(column, F.when(F.col("outer_id") % EVERY == k, F.expr(change).cast(r.schema[column].dataType)).otherwise(F.col(column)))
    r = r.withColumn("payload", F.to_json(F.struct(*FIELDS)))
    for k, change in late:
        r = r.withColumn("payload", F.when(F.col("outer_id") % EVERY == k, F.expr(change)).otherwise(F.col("payload")))
    return r.select("outer_id", "outer_sha256", "status", "payload"), sources


_CODES = ", ".join(f"({k}, '{code}')" for k, f in enumerate(FAULTS, 1) for code in f[2].split())
_SKIPPED = ", ".join(str(k) for k, f in enumerate(FAULTS, 1) if not f[2])
_BLANK = next(k for k, f in enumerate(FAULTS, 1) if f[1] == "'  '")


@query("v11_whole_run", f"""WITH d AS (SELECT doc_id FROM documents WHERE length(text) >= 4), p(k, code) AS (VALUES {_CODES}), f AS (SELECT doc_id, code FROM d JOIN p ON doc_id % {EVERY} = k)
SELECT code, count(*) AS n, min(doc_id) AS first FROM f GROUP BY code UNION ALL SELECT 'rows', count(*), NULL FROM d UNION ALL SELECT 'accepted', count(*) FILTER (doc_id % {EVERY} NOT IN ({_SKIPPED})), NULL FROM d UNION ALL SELECT 'skipped', count(*) FILTER (doc_id % {EVERY} IN ({_SKIPPED})), NULL FROM d
UNION ALL SELECT 'with_json', count(*) FILTER (doc_id % {EVERY} <> {_BLANK}), NULL FROM d UNION ALL SELECT 'invalid', count(DISTINCT doc_id), NULL FROM f UNION ALL SELECT 'valid', count(*) FILTER (doc_id % {EVERY} NOT IN ({_SKIPPED}) AND doc_id NOT IN (SELECT doc_id FROM f)), NULL FROM d""")
def _(t):
    told = run.validate_run(*records(t.documents), shared.shared_folder(t.spark, "run"), generated=lambda x: tx.simplified(x, PLAIN))
    rows = [(k, *v) for k, v in told["codes"].items()] + [(k, told[k], None) for k in ("rows", "with_json", "accepted", "skipped", "valid", "invalid")]
    return t.spark.createDataFrame(rows, "code string, n long, first long")


@query("v11_record_codes", f"WITH d AS (SELECT doc_id FROM documents WHERE length(text) >= 4), p(k, code) AS (VALUES {_CODES}) SELECT doc_id AS outer_id, string_agg(code, ',' ORDER BY code) AS codes FROM d JOIN p ON doc_id % {EVERY} = k GROUP BY doc_id")
def _(t):
    found = run.checked(*records(t.documents), generated=lambda x: tx.simplified(x, PLAIN))
    return found.filter("size(codes) > 0").select("outer_id", F.array_join(F.sort_array("codes"), ",").alias("codes"))


@query("v10_status_rules", "SELECT doc_id, code FROM (SELECT doc_id, unnest([CASE WHEN quality = 1 THEN 'status_review' END, CASE WHEN toxic = 1 THEN 'status_ready' END, CASE WHEN doc_id % 4 = 1 THEN 'status_preannotation' END, CASE WHEN doc_id % 6 = 1 THEN 'status_human' END]) AS code FROM labels WHERE doc_id % 5 <> 0) WHERE code IS NOT NULL")
def _(t):
    c = F.col
    record = F.struct(
        F.when(c("doc_id") % 5 == 0, "reviewed").otherwise(run.AUTOMATIC).alias("product_status"), F.when(c("quality") == 1, "reviewed").otherwise("not_reviewed").alias("review_status"),
        (c("toxic") == 1).alias("research_ready"), F.when(c("doc_id") % 4 != 1, True).alias("model_preannotation"), F.when(c("doc_id") % 6 != 1, False).alias("human_reviewed"),
    )
    from quillmill.operators import curation

    return curation.issues(t.labels.withColumn("record", record), "doc_id", run.status_rules(c("record")))


_CORPUS = f"""WITH {MARKED}, r AS (SELECT count(*) AS raw, count(*) FILTER (length(trim(text)) < 20) AS short, count(*) FILTER (length(trim(text)) >= 20 AND entry_id % 17 = 0) AS lost FROM k),
a AS (SELECT * FROM k WHERE length(trim(text)) >= 20), g AS (SELECT normal_sha256, count(*) FILTER (entry_id = low) AS firsts, min(low) AS low, count(*) FILTER (entry_id % 17 <> 0) AS n, count(*) FILTER (entry_id = low AND entry_id % 17 <> 0) AS seen FROM (SELECT *, canonical_id AS low FROM a) GROUP BY normal_sha256)"""


@query("v2_corpus_rules", f"""{_CORPUS}, f AS (SELECT count(*) FILTER (entry_id % 17 <> 0) AS accepted, count(*) FILTER (entry_id % 17 <> 0 AND dedupe_status = 'canonical') AS firsts, count(*) FILTER (entry_id % 17 <> 0 AND entry_id % 19 = 0) AS twice FROM a), h AS (SELECT count(*) FILTER (seen <> 1 AND n > 0) AS headless FROM g),
w AS (SELECT unnest(['ids_repeated', 'raw_unaccounted', 'not_from_raw', 'accepted_and_rejected', 'canonical_per_hash', 'eligible_per_hash', 'pointers_per_hash', 'production', 'sum', 'eligible_is_canonical', 'declared_raw', 'declared_canonical']) AS rule, unnest([0, lost, 1, 0, headless, 0, headless, 0, raw, firsts, raw, firsts]) AS found, unnest([0, 0, 0, 0, 0, 0, 0, 0, accepted + short + 1, firsts, raw, 0]) AS wanted FROM r, f, h)
SELECT rule, found, wanted::BIGINT AS wanted, found = wanted AS ok FROM w""")
def _(t):
    # every seventeenth entry is lost on the way, one rejected row comes from nowhere, and a pinned count is wrong
    # texts are read and hashed once
    hashed = dedup.with_hashes(corpus.entries(t)).select("entry_id", "work", "normal_sha256", (F.length(F.trim("text")) >= 20).alias("long"))
    m = shared.keep(dedup.mark_duplicates(shared.keep(hashed, "hashed")), "marked")
    long = F.col("long")
    short = m.filter(~long).select("entry_id").unionByName(t.spark.createDataFrame([(-1,)], "entry_id long"))
    entries = m.filter(long & (F.col("entry_id") % 17 != 0)).withColumn("production_eligible", F.lit(False))
    return run.corpus_rules(m, short, entries, {"raw": m.count(), "canonical": 0})


def enqueued(h: str, old: str, new: str) -> str:
    """SQL of the next snapshot of ledger `old` when the entries `new` come."""
    return f"{h} AS (SELECT coalesce(o.entry_id, n.entry_id) AS entry_id, coalesce(n.source_hash, o.source_hash) AS source_hash, CASE WHEN o.source_hash IS NULL THEN 'queued' WHEN n.source_hash IS NOT NULL AND o.source_hash <> n.source_hash THEN 'stale' ELSE o.status END AS status, CASE WHEN o.source_hash IS NOT NULL AND (n.source_hash IS NULL OR o.source_hash = n.source_hash) THEN o.payload END AS payload FROM {old} o FULL JOIN {new} n ON o.entry_id = n.entry_id)"


@query("l1_interleaved_runs", f"WITH d AS (SELECT doc_id AS entry_id, sha256(text) AS source_hash FROM documents), o AS (SELECT entry_id, CASE WHEN entry_id % 7 = 0 THEN 'old' ELSE source_hash END AS source_hash, 'valid' AS status, 'p' AS payload FROM d WHERE entry_id % 5 <> 0), a AS (SELECT * FROM d WHERE entry_id % 11 <> 0), b AS (SELECT entry_id, CASE WHEN entry_id % 13 = 1 THEN 'b' ELSE source_hash END AS source_hash FROM d WHERE entry_id % 3 = 0), {enqueued('x', 'o', 'b')}, {enqueued('y', 'x', 'a')} SELECT *, 2 AS version FROM y")
def _(t):
    # run A has read the first version when run B publishes; A's batch is sent again at the end
    d = t.documents.select(F.col("doc_id").alias("entry_id"), SHA("text").alias("source_hash"))
    old = d.filter("entry_id % 5 <> 0").withColumn("source_hash", F.when(F.col("entry_id") % 7 == 0, "old").otherwise(F.col("source_hash")))
    a, b = d.filter("entry_id % 11 <> 0"), d.filter("entry_id % 3 = 0").withColumn("source_hash", F.when(F.col("entry_id") % 13 == 1, "b").otherwise(F.col("source_hash")))
    path, waiting = shared.shared_folder(t.spark, "ledger"), [True]
    snapshots.publish(old.withColumns({"status": F.lit("valid"), "payload": F.lit("p")}), path, unique=("entry_id",))

    def run_a(rows: DataFrame) -> DataFrame:
        if waiting:
            waiting.pop()
            snapshots.update(t.spark, path, lambda x: lg.enqueue(x, b), "b", 0)
        return lg.enqueue(rows, a)

    for _ in range(2):
        version = snapshots.update(t.spark, path, run_a, "a", 0)
    return snapshots.read(t.spark, path).withColumn("version", F.lit(version))


@query("l7_archived_runs", "WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), a AS (SELECT doc_id, digest FROM d WHERE doc_id % 4 = 0), b AS (SELECT doc_id, digest FROM d WHERE doc_id % 6 = 0) SELECT doc_id, digest, 'superseded' AS reason, 2 AS version FROM (SELECT * FROM a UNION SELECT * FROM b)")
def _(t):
    # two runs archive what they supersede, both from the first version; the first one's batch is sent again
    d = t.documents.select("doc_id", SHA("text").alias("digest"))
    newer = lambda n: d.withColumn("digest", F.when(F.col("doc_id") % n == 0, "new").otherwise(F.col("digest")))
    path, waiting = shared.shared_folder(t.spark, "history"), [True]
    snapshots.publish(lg.archive(d.limit(0), d, "doc_id", "digest"), path, unique=("doc_id",))
    with_old = lambda rows, n: rows.unionByName(lg.archive(d, newer(n), "doc_id", "digest")).dropDuplicates(["doc_id", "digest"])

    def first(rows: DataFrame) -> DataFrame:
        if waiting:
            waiting.pop()
            snapshots.update(t.spark, path, lambda x: with_old(x, 6), "second", 0)
        return with_old(rows, 4)

    for _ in range(2):
        version = snapshots.update(t.spark, path, first, "first", 0)
    return snapshots.read(t.spark, path).withColumn("version", F.lit(version))


_FORM = "replace(replace({0}, 'é', 'e'), 'è', 'e')"


@query("e12_bulk_repair", f"""WITH d AS (SELECT doc_id, text, doc_id % 11 = 10 AS waits, CASE WHEN doc_id % 3 = 0 THEN ' Unknown' ELSE 'a storm' END AS trigger, doc_id % 12 = 0 AS bare FROM documents),
r AS (SELECT doc_id, CASE WHEN waits THEN 0 ELSE (({_FORM.format('text')}) <> text)::INT END AS changed, CASE WHEN waits OR trigger = 'a storm' OR bare THEN 0 ELSE 1 END AS removed, CASE WHEN waits THEN NULL WHEN doc_id % 7 = 5 THEN 'provenance_changed' WHEN trigger <> 'a storm' AND bare THEN 'empty_evidence' END AS problem,
sha256(CASE WHEN waits THEN text ELSE {_FORM.format('text')} END) AS generated, CASE WHEN bare THEN 'trigger' WHEN waits OR trigger = 'a storm' THEN 'tone,trigger' ELSE 'tone' END AS supports FROM d) SELECT * FROM r""")
def _(t):
    # every seventh record is changed where nothing may be; every twelfth has evidence for its unknown trigger alone
    k = F.col("doc_id")
    supports = F.when(k % 12 == 0, F.array(F.lit("trigger"))).otherwise(F.array(F.lit("tone"), F.lit("trigger")))
    piece = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.substring("text", 1, 3).alias("excerpt"), supports.alias("supports"))
    d = t.documents.select("doc_id", F.when(k % 11 == 10, "queued").otherwise("valid").alias("status"), k.cast("string").alias("unit"), F.col("source").alias("source_profile"), F.array("text").alias("generated"), F.when(k % 3 == 0, " Unknown").otherwise("a storm").alias("trigger"), F.array(piece).alias("evidence"))
    spoil = lambda df: df.withColumn("source_profile", F.when(k % 7 == 5, "x").otherwise(F.col("source_profile")))
    out = run.bulk_repair(d, [lambda df: run.normalise_generated(df, lambda x: tx.simplified(x, PLAIN)), run.strip_unknown, spoil])
    return out.select("doc_id", "changed", "removed", "problem", F.sha2(F.col("generated")[0].cast("binary"), 256).alias("generated"), F.array_join(F.col("evidence")[0]["supports"], ",").alias("supports"))

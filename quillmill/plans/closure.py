"""Queries of the closure and run validators: ledgers built from documents, with every check broken somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill import shared
from quillmill.operators import closure as cl
from quillmill.registry import query

CURRENT = {"review_model": "reader", "review_prompt_version": "r2", "review_prompt_sha256": "rp", "review_schema_sha256": "rs", "repair_review_prompt_version": "r2", "repair_review_prompt_sha256": "rp", "repair_review_schema_sha256": "rs", "repair_model": "mender", "repair_prompt_version": "m1", "repair_prompt_sha256": "mp", "repair_schema_sha256": "ms", "repair_effective_schema_sha256": "es", "repair_envelope_schema_sha256": "vs"}

_STEP_OF = "transform({steps}, s -> named_struct('iteration', s.iteration, 'root', {root}, 'parent', {parent}, 'base', s.base, 'review', s.review, 'normalized', s.normalized, 'effective', {effective}, 'raw', s.raw, 'response', s.response, 'prompt_version', s.prompt_version, 'model', s.model, 'response_id', s.response_id))"


def _steps(steps: str = "lineage", root: str = "s.root", parent: str = "s.parent", effective: str = "s.effective") -> str:
    return _STEP_OF.format(steps=steps, root=root, parent=parent, effective=effective)


#: What is spoilt (ledger, column, SQL expression; no column: the row is gone) and the checks that must say so. A fault
#: marked `first` is planted in entries with one step, the others in entries with three.
FAULTS = [
    ("source", None, None, "source_missing"),
    ("source", "dedupe_status", "'exact_duplicate'", "source_canonical"),
    ("source", "runtime_eligible", "false", "source_canonical"),
    ("source", "canonical_id", "-1L", "source_pointer"),
    ("source", "chars", "chars + 1", "source_chars annotation_chars review_chars repair_chars"),
    ("source", "text_sha256", "'x'", "source_hash"),
    ("annotation", None, None, "annotation_missing"),
    ("annotation", "status", "'stale'", "annotation_status"),
    ("annotation", "work", "'x'", "annotation_work"),
    ("annotation", "title", "null", "annotation_title"),
    ("annotation", "source_sha256", "'x'", "annotation_source_hash"),
    ("annotation", "payload", "concat(' ', payload)", "annotation_payload_json"),
    ("annotation", "payload", "'{}'", "root_closure envelope_root_sha256 repair_input lineage_root lineage_base lineage_current"),
    ("review", None, None, "review_missing"),
    ("review", "status", "'x'", "review_status"),
    ("review", "verdict", "'later'", "review_status review_identity review_terminal review_target"),
    ("review", "work", "'x'", "review_work"),
    ("review", "title", "'x'", "review_title"),
    ("review", "source_sha256", "null", "review_source_hash"),
    ("review", "candidate_sha256", "'x'", "review_target review_unrepaired"),
    ("review", "payload", "concat(payload, ' ')", "review_payload_json"),
    ("review", "payload", "replace(payload, 'entryId\":\"', 'entryId\":\"0')", "review_identity review_target review_unrepaired"),
    ("review", "payload", "replace(payload, '\"kind\":\"tone\",\"sourceExcerpt\":\"', '\"kind\":\"tone\",\"sourceExcerpt\":\"~nowhere~')", "review_issues review_excerpts review_target review_unrepaired"),
    ("review", "issues", "'[]'", "review_issues"),
    ("review", "issues", "concat(issues, ' ')", "review_issues_json"),
    ("review", "model", "'x'", "current_review_model"),
    ("review", "reported_model", "' '", "review_reported_model"),
    ("review", "prompt_version", "'r1'", "current_review_prompt_version"),
    ("review", "prompt_sha256", "'x'", "current_review_prompt_sha256"),
    ("review", "schema_sha256", "'x'", "current_review_schema_sha256"),
    ("repair", "status", "'queued'", "repair_status"),
    ("repair", "work", "'x'", "repair_work"),
    ("repair", "title", "'x'", "repair_title"),
    ("repair", "source_sha256", "'x'", "repair_source_hash"),
    ("repair", "iteration", "0", "iteration envelope_iteration lineage_current lineage_depth repair_input"),
    ("repair", "origin", "'annotation'", "later_origin envelope_origin repair_input"),
    ("repair", "origin", "'repair'", "first_origin envelope_origin repair_input", "first"),
    ("repair", "parent_sha256", "'x'", "later_parent envelope_parent_sha256 repair_input lineage_current"),
    ("repair", "parent_sha256", "'x'", "first_origin envelope_parent_sha256 repair_input lineage_current", "first"),
    ("repair", "root_sha256", "'x'", "root_closure"),
    ("repair", "base", "'{}'", "base_closure later_parent envelope_base_sha256 envelope_base repair_input lineage_current review_target review_unrepaired"),
    ("repair", "base", "'{}'", "base_closure first_base envelope_base_sha256 envelope_base repair_input lineage_current review_target review_unrepaired", "first"),
    ("repair", "base", "concat(base, ' ')", "repair_base_json"),
    ("repair", "base_sha256", "'x'", "base_closure"),
    ("repair", "review", "concat(review, ' ')", "repair_review_json"),
    ("repair", "review", "replace(review, 'entryId\":\"', 'entryId\":\"0')", "review_closure repair_review_identity envelope_review_sha256 envelope_review repair_input lineage_current review_target review_unrepaired"),
    ("repair", "review", "replace(review, '\"kind\":\"tone\",\"sourceExcerpt\":\"', '\"kind\":\"tone\",\"sourceExcerpt\":\"~nowhere~')", "review_closure repair_review_excerpts envelope_review_sha256 envelope_review repair_input lineage_current review_target review_unrepaired"),
    ("repair", "review_sha256", "'x'", "review_closure"),
    ("repair", "review_verdict", "'pass'", "repair_target repair_review_identity envelope_review_verdict repair_input review_target review_unrepaired"),
    ("repair", "review_prompt_version", "'r1'", "current_repair_review_prompt_version"),
    ("repair", "review_prompt_sha256", "'x'", "current_repair_review_prompt_sha256"),
    ("repair", "review_schema_sha256", "'x'", "current_repair_review_schema_sha256"),
    ("repair", "input", "replace(input, '\"origin\"', '\"0rigin\"')", "repair_input repair_input_json"),
    ("repair", "input", "'{'", "repair_input_json repair_input"),
    ("repair", "raw", "'{}'", "lineage_current"),
    ("repair", "raw", "' {}'", "repair_raw_json lineage_current"),
    ("repair", "response", "'{} '", "repair_response_json lineage_current"),
    ("repair", "normalized", "'{}'", "normalized_closure envelope_normalized_sha256 envelope_normalized lineage_current"),
    ("repair", "normalized", "concat(normalized, ' ')", "repair_normalized_json"),
    ("repair", "normalized_sha256", "'x'", "normalized_closure"),
    ("repair", "effective", "'{}'", "effective_closure envelope_effective_sha256 envelope_effective lineage_end lineage_current"),
    ("repair", "effective", "concat(effective, ' ')", "repair_effective_json"),
    ("repair", "effective_sha256", "'x'", "effective_closure"),
    ("repair", "envelope", "concat(' ', envelope)", "repair_envelope_json"),
    ("repair", "envelope", "regexp_replace(envelope, '\"entry_id\":\"', '\"entry_id\":\"0')", "envelope_entry_id"),
    ("repair", "envelope", "regexp_replace(envelope, '\"source_sha256\":\"', '\"source_sha256\":\"0')", "envelope_source_sha256"),
    ("repair", "envelope", "regexp_replace(envelope, '\"iteration\":3,\"lineage\"', '\"iteration\":4,\"lineage\"')", "envelope_iteration"),
    ("repair", "envelope", "regexp_replace(envelope, '\"human_reviewed\":false', '\"human_reviewed\":true')", "envelope_human_reviewed"),
    ("repair", "envelope", "regexp_replace(envelope, '\"research_ready\":false', '\"research_ready\":true')", "envelope_research_ready"),
    ("repair", "envelope", "regexp_replace(envelope, '\"lineage\":\\\\[', '\"lineage\":[0,')", "envelope_lineage"),
    ("repair", "model", "'x'", "current_repair_model envelope_provenance lineage_current"),
    ("repair", "reported_model", "''", "repair_reported_model envelope_provenance"),
    ("repair", "prompt_version", "'m0'", "current_repair_prompt_version envelope_provenance lineage_current"),
    ("repair", "prompt_sha256", "'x'", "current_repair_prompt_sha256 envelope_provenance"),
    ("repair", "schema_sha256", "'x'", "current_repair_schema_sha256"),
    ("repair", "effective_schema_sha256", "'x'", "current_repair_effective_schema_sha256"),
    ("repair", "envelope_schema_sha256", "'x'", "current_repair_envelope_schema_sha256"),
    ("repair", "lineage", "slice(lineage, 1, 2)", "lineage_depth lineage_end lineage_current envelope_lineage"),
    ("repair", "lineage", "reverse(lineage)", "lineage_sequence lineage_parent lineage_base lineage_end lineage_current envelope_lineage history_absent history_prefix"),
    ("repair", "lineage", _steps(root="if(s.iteration = 2, 'x', s.root)"), "lineage_root envelope_lineage history_prefix"),
    ("repair", "lineage", _steps(parent="if(s.iteration = 2, 'x', s.parent)"), "lineage_parent envelope_lineage history_prefix"),
    ("repair", "lineage", _steps(effective="if(s.iteration = 2, lineage[0].effective, s.effective)"), "lineage_unique lineage_parent lineage_base envelope_lineage history_iteration history_prefix"),
    ("history", None, None, "history_absent"),
    ("history", "iteration", "iteration + 1", "history_iteration"),
    ("history", "lineage", "slice(lineage, 1, 0)", "history_prefix history_envelope_lineage"),
    ("history", "envelope", "'{}'", "history_envelope_lineage history_envelope_hash"),
    ("history", "envelope", "replace(envelope, 'effective_sha256\":\"', 'effective_sha256\":\"0')", "history_envelope_hash"),
]
EVERY = 1 + len(FAULTS)  # entries with doc_id % EVERY = 0 close
FIRST = [k for k, f in enumerate(FAULTS, 1) if f[-1] == "first"]


def _json(**values) -> F.Column:
    """A JSON object with sorted keys."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))


def _joined_json(**texts) -> F.Column:
    """A JSON object with sorted keys of members that are JSON already; a null member is left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), texts[k]) for k in sorted(texts)]), F.lit("}"))


def ledgers(documents: DataFrame) -> dict[str, DataFrame]:
    """Four ledgers and a history that close, one entry a document with one or three repairs."""
    c, sha = F.col, cl.sha
    n = F.when((c("doc_id") % EVERY).isin(*FIRST), 1).otherwise(3)
    d = documents.select("doc_id", c("doc_id").cast("long").alias("entry_id"), c("source").alias("work"), c("lang").alias("title"), F.length("text").alias("chars"), "text", n.alias("n"))
    about = d.select("entry_id", "work", "title", "chars", sha("text").alias("source_sha256"), "n", F.substring("text", 1, 5).alias("excerpt"))
    sources = d.select("entry_id", "work", "title", "chars", "text", sha("text").alias("text_sha256"), F.lit("canonical").alias("dedupe_status"), c("entry_id").alias("canonical_id"), F.lit(True).alias("runtime_eligible"))

    of = lambda kind, k: F.concat(F.lit(f'{{"{kind}":'), k.cast("string"), F.lit(',"of":'), c("entry_id").cast("string"), F.lit("}"))
    root = F.concat(F.lit('{"label":"root","of":'), c("entry_id").cast("string"), F.lit("}"))
    version = lambda k: F.when(k == 0, root).otherwise(of("iteration", k))
    issues = F.array(F.struct(F.lit("tone").alias("kind"), c("excerpt").alias("sourceExcerpt")))
    review = _json(entryId=c("entry_id").cast("string"), issues=issues, verdict=F.lit("revise"))

    def step(k):
        return F.struct(
            k.cast("int").alias("iteration"), sha(root).alias("root"), F.when(k > 1, sha(version(k - 1))).alias("parent"), sha(version(k - 1)).alias("base"), sha(c("review_json")).alias("review"),
            sha(of("normal", k)).alias("normalized"), sha(version(k)).alias("effective"), sha(of("draft", k)).alias("raw"), sha(of("answer", k)).alias("response"), F.lit("m1").alias("prompt_version"), F.lit("mender").alias("model"), F.concat(F.lit("id"), k.cast("string")).alias("response_id"),
        )

    a = about.withColumn("review_json", review).withColumn("lineage", F.transform(F.sequence(F.lit(1), c("n")), step))
    steps_json = cl.sorted_json(a, "lineage")
    shared = ["entry_id", "work", "title", "chars"]
    annotations = a.select(*shared, F.lit("valid").alias("status"), "source_sha256", root.alias("payload"))
    last = {"prompt_version": F.lit("r2"), "prompt_sha256": F.lit("rp"), "schema_sha256": F.lit("rs")}
    reviews = a.select(*shared, F.lit("revise").alias("status"), F.lit("revise").alias("verdict"), "source_sha256", sha(version(c("n") - 1)).alias("candidate_sha256"), c("review_json").alias("payload"), F.to_json(issues).alias("issues"), F.lit("reader").alias("model"), F.lit("reader-1").alias("reported_model"), *[v.alias(k) for k, v in last.items()])
    own = {
        "entry_id": c("entry_id").cast("string"), "source_sha256": c("source_sha256"), "root_sha256": sha(root), "base_sha256": sha(version(c("n") - 1)), "parent_sha256": F.when(c("n") > 1, sha(version(c("n") - 1))),
        "iteration": c("n"), "origin": F.when(c("n") > 1, "repair").otherwise("annotation"), "review_sha256": sha(c("review_json")), "review_verdict": F.lit("revise"),
    }
    payloads = {"base": version(c("n") - 1), "review": c("review_json"), "normalized": of("normal", c("n")), "effective": version(c("n"))}
    provenance = _json(model=F.lit("mender"), reported_model=F.lit("mender-1"), prompt_version=F.lit("m1"), prompt_sha256=F.lit("mp"), response_id=F.concat(F.lit("id"), c("n").cast("string")))
    plain = own | {"normalized_sha256": sha(payloads["normalized"]), "effective_sha256": sha(payloads["effective"])}  # hashes, ids and names, none with a letter to escape
    members = {k: v.cast("string") if k == "iteration" else F.concat(F.lit('"'), v, F.lit('"')) for k, v in plain.items()}
    r = a.withColumn("envelope", _joined_json(**members, **payloads, human_reviewed=F.lit("false"), research_ready=F.lit("false"), lineage=steps_json, provenance=provenance))
    repairs = r.select(
        *shared, F.lit("valid").alias("status"), c("n").alias("iteration"), own["origin"].alias("origin"), "source_sha256", *[own[k].alias(k) for k in ("root_sha256", "parent_sha256", "base_sha256", "review_sha256", "review_verdict")], *[v.alias(k) for k, v in payloads.items()],
        F.lit("r2").alias("review_prompt_version"), F.lit("rp").alias("review_prompt_sha256"), F.lit("rs").alias("review_schema_sha256"), _json(**own).alias("input"), of("draft", c("n")).alias("raw"), of("answer", c("n")).alias("response"), sha(payloads["normalized"]).alias("normalized_sha256"), sha(payloads["effective"]).alias("effective_sha256"),
        "envelope", "lineage", F.lit("mender").alias("model"), F.lit("mender-1").alias("reported_model"), F.lit("m1").alias("prompt_version"), F.lit("mp").alias("prompt_sha256"), F.lit("ms").alias("schema_sha256"), F.lit("es").alias("effective_schema_sha256"), F.lit("vs").alias("envelope_schema_sha256"), F.concat(F.lit("id"), c("n").cast("string")).alias("response_id"),
    )
    prior = a.select("entry_id", "lineage", F.explode(F.filter("lineage", lambda s: s["iteration"] < c("n"))).alias("s")).select("entry_id", c("s.iteration").alias("iteration"), c("s.effective").alias("effective_sha256"), F.slice("lineage", 1, c("s.iteration")).alias("lineage"))
    history = prior.withColumn("envelope", _joined_json(lineage=cl.sorted_json(prior, "lineage"), effective_sha256=F.concat(F.lit('"'), "effective_sha256", F.lit('"'))))
    return {"source": sources, "annotation": annotations, "review": reviews, "repair": repairs, "history": history}


def spoilt(own: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ledgers with fault k in the entries with entry_id % EVERY = k."""
    out = dict(own)
    for k, (ledger, column, change, *_) in enumerate(FAULTS, 1):
        here = F.col("entry_id") % EVERY == k
        df = out[ledger]
        out[ledger] = df.filter(~here) if column is None else df.withColumn(column, F.when(here, F.expr(change).cast(df.schema[column].dataType)).otherwise(F.col(column)))
    return out


_PLANTED = ", ".join(f"({k}, '{code}')" for k, f in enumerate(FAULTS, 1) for code in f[3].split())


@query("c9_closure", f"WITH p(k, code) AS (VALUES (0, 'closed'), {_PLANTED}) SELECT doc_id AS entry_id, code FROM documents JOIN p ON doc_id % {EVERY} = k")
def _(t):
    own = spoilt(ledgers(t.documents))
    found = cl.closure(own["source"], own["annotation"], own["review"], own["repair"], own["history"], CURRENT)
    found = shared.keep(found, "closure")
    closed = own["repair"].select("entry_id").join(found.select("entry_id"), "entry_id", "left_anti")
    return found.unionByName(closed.withColumn("code", F.lit("closed")))

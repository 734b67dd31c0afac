"""Closure of four ledgers: every hash, link and version of a repair leads back to its source.

Sources, annotations, reviews and repairs meet by entry in one row, so that each named
check is a boolean column over it. A repair's lineage is an array of steps; the history
holds the earlier versions with the lineage they had. That a version's lineage is the
beginning of today's is one comparison: a step's prefix hash covers it and all before it
(`prefix_hashes`), a version's own hash covers its whole lineage, and the two meet in an
equi-join by entry and version, not in a walk over pairs.

Columns, beside entry_id:

- sources: work, title, chars, text, text_sha256, dedupe_status, canonical_id, runtime_eligible
- annotations: work, title, chars, status, source_sha256, payload
- reviews: work, title, chars, status, verdict, source_sha256, candidate_sha256, payload,
  issues, model, reported_model, prompt_version, prompt_sha256, schema_sha256
- repairs: work, title, chars, status, iteration, origin, source_sha256, root_sha256,
  parent_sha256, base, base_sha256, review, review_sha256, review_verdict,
  review_prompt_version, review_prompt_sha256, review_schema_sha256, input, raw, response,
  normalized, normalized_sha256, effective, effective_sha256, envelope, lineage, model,
  reported_model, prompt_version, prompt_sha256, schema_sha256, effective_schema_sha256,
  envelope_schema_sha256, response_id
- history: iteration, effective_sha256, lineage, envelope

Payloads, envelopes and issues are JSON texts; a lineage is an array of `STEP` structs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = "struct<iteration: int, root: string, parent: string, base: string, review: string, normalized: string, effective: string, raw: string, response: string, prompt_version: string, model: string, response_id: string>"
FINAL = "valid"
ROOT_ORIGIN, LATER_ORIGIN = "annotation", "repair"
OPEN_VERDICTS, VERDICTS = ("revise", "uncertain"), ("pass", "revise", "uncertain")
SHARED = ("work", "title", "chars")


def sha(c: Column | str) -> Column:
    return F.sha2((F.col(c) if isinstance(c, str) else c).cast("binary"), 256)


def canonical(c: Column | str) -> Column:
    """JSON with sorted keys and no spaces; null where it does not parse."""
    return F.to_json(F.try_parse_json(c))


def sorted_json(df: DataFrame, lineage: str) -> Column:
    """JSON of the steps of a lineage with sorted keys."""
    keys = sorted(df.schema[lineage].dataType.elementType.names)
    return F.to_json(F.transform(lineage, lambda s: F.struct(*[s[k].alias(k) for k in keys])))


def _same_json(text: Column, other: Column, other_json: Column) -> Column:
    """Whether text is the same JSON as `other`, whose canonical form is `other_json`; equal texts are not parsed again."""
    return F.when(text == other, other_json.isNotNull()).otherwise(canonical(text) == other_json)


def _same_lineage(text: Column, lineage: str, sorted_steps: Column) -> Column:
    return F.when(text == sorted_steps, F.lit(True)).otherwise(canonical(text) == canonical(F.to_json(lineage)))


def prefix_hashes(lineage: Column) -> Column:
    """For each step the hash of it and of all before it."""
    def add(done: Column, step: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return F.concat(done, F.array(sha(F.concat_ws("|", before, F.to_json(step)))))

    return F.aggregate(lineage, F.array().cast("array<string>"), add)


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("entry_id", F.lit(True).alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "entry_id"])


#: Members of an envelope and of a repair's input that are checked.
OWN = ("entry_id", "source_sha256", "root_sha256", "base_sha256", "parent_sha256", "iteration", "origin", "review_sha256", "review_verdict")
ENVELOPE = (*OWN, "normalized_sha256", "effective_sha256", "human_reviewed", "research_ready", "base", "review", "normalized", "effective", "lineage", "provenance")


def _members(text: str, names: tuple[str, ...]) -> Column:
    """Members of a JSON object as texts, all read in one pass. Of members named twice, which have no canonical form, the first ones count."""
    told = F.from_json(text, ", ".join(f"{n} string" for n in names), {"allowUnquotedControlChars": "true"})
    return F.when(F.col(f"{text}_json").isNotNull(), told).otherwise(F.struct(*[F.get_json_object(text, f"$.{n}").alias(n) for n in names]))


def joined(sources: DataFrame, annotations: DataFrame, reviews: DataFrame, repairs: DataFrame) -> DataFrame:
    """A row a repair with the rows of the other ledgers, columns named after their ledger, canonical payloads with their hashes, and members of envelope and input."""
    j = _named(repairs, "repair")
    for df, prefix in ((sources, "source"), (annotations, "annotation"), (reviews, "review")):
        j = j.join(_named(df, prefix), "entry_id", "left")
    payloads = ["annotation_payload", "review_payload", "review_issues", *[f"repair_{c}" for c in ("base", "review", "input", "raw", "response", "normalized", "effective", "envelope")]]
    j = j.withColumns({f"{c}_json": canonical(c) for c in payloads} | {"text_sha256": sha("source_text"), "lineage_json": sorted_json(j, "repair_lineage")})
    return j.withColumns({f"{c}_json_sha256": sha(f"{c}_json") for c in payloads} | {"envelope_told": _members("repair_envelope", ENVELOPE), "input_told": _members("repair_input", OWN)})


def _excerpts_stand(payload: str) -> Column:
    """All excerpts of a review's issues stand in the source text."""
    issues = F.from_json(F.get_json_object(payload, "$.issues"), "array<struct<sourceExcerpt: string>>")
    return F.forall(issues, lambda i: F.coalesce(F.contains("source_text", i["sourceExcerpt"]), F.lit(False)))


def _lineage_checks() -> dict[str, Column]:
    steps, c = F.col("repair_lineage"), F.col
    n = F.size(steps)
    at = F.sequence(F.lit(1), n)
    every = lambda test: (n == 0) | F.forall(F.arrays_zip(steps.alias("s"), at.alias("k")), lambda z: F.coalesce(test(z["s"], z["k"]), F.lit(False)))
    before = lambda k: F.try_element_at(steps, k - 1)["effective"]
    last = F.try_element_at(steps, F.lit(-1))
    effective = F.transform(steps, lambda s: s["effective"])
    closes = {"iteration": c("repair_iteration"), "root": c("annotation_payload_json_sha256"), "parent": c("repair_parent_sha256"), "base": c("repair_base_json_sha256"), "review": c("repair_review_json_sha256"), "normalized": c("repair_normalized_json_sha256"), "effective": c("repair_effective_json_sha256"), "raw": c("repair_raw_json_sha256"), "response": c("repair_response_json_sha256"), "prompt_version": c("repair_prompt_version"), "model": c("repair_model"), "response_id": c("repair_response_id")}
    current = F.lit(True)
    for name, value in closes.items():
        current = current & last[name].eqNullSafe(value)
    return {
        "lineage_depth": n == c("repair_iteration"),
        "lineage_sequence": every(lambda s, k: s["iteration"] == k),
        "lineage_root": every(lambda s, k: s["root"] == c("annotation_payload_json_sha256")),
        "lineage_parent": every(lambda s, k: F.when(k == 1, s["parent"].isNull()).otherwise(s["parent"].eqNullSafe(before(k)))),
        "lineage_base": every(lambda s, k: F.when(k == 1, s["base"] == c("annotation_payload_json_sha256")).otherwise(s["base"].eqNullSafe(before(k)))),
        "lineage_unique": F.forall(effective, lambda e: e.isNotNull()) & (F.size(F.array_distinct(effective)) == n),
        "lineage_end": last["effective"] == c("repair_effective_json_sha256"),
        "lineage_current": current,
    }


def entry_checks(current: Mapping[str, str], require_repaired: bool = True, require_passed: bool = False) -> dict[str, Column]:
    """The named checks over a row of `joined`. current: the values provenance columns must have, by column name there."""
    c = F.col
    first = c("repair_iteration") == 1
    causal = (c("review_candidate_sha256") == c("repair_base_json_sha256")) & (c("review_payload_json_sha256") == c("repair_review_json_sha256")) & (c("review_verdict") == c("repair_review_verdict"))
    rereview = c("review_candidate_sha256") == c("repair_effective_json_sha256")
    checks = {
        "repair_status": c("repair_status") == FINAL,
        "source_missing": c("source").isNotNull(),
        "source_canonical": (c("source_dedupe_status") == "canonical") & c("source_runtime_eligible"),
        "source_pointer": c("source_canonical_id").cast("string") == c("entry_id").cast("string"),
        "source_chars": c("source_chars") == F.length("source_text"),
        "source_hash": c("source_text_sha256") == c("text_sha256"),
        "annotation_missing": c("annotation").isNotNull(),
        "review_missing": c("review").isNotNull(),
        "annotation_status": c("annotation_status") == FINAL,
    }
    for ledger in ("annotation", "review", "repair"):
        checks |= {f"{ledger}_{s}": c(f"{ledger}_{s}").eqNullSafe(c(f"source_{s}")) for s in SHARED}
        checks[f"{ledger}_source_hash"] = c(f"{ledger}_source_sha256") == c("text_sha256")
    for p in ("annotation_payload", "review_payload", "review_issues", "repair_base", "repair_review", "repair_input", "repair_raw", "repair_response", "repair_normalized", "repair_effective", "repair_envelope"):
        checks[f"{p}_json"] = c(p) == c(f"{p}_json")
    checks |= {
        "root_closure": c("repair_root_sha256") == c("annotation_payload_json_sha256"),
        "base_closure": c("repair_base_sha256") == c("repair_base_json_sha256"),
        "review_closure": c("repair_review_sha256") == c("repair_review_json_sha256"),
        "normalized_closure": c("repair_normalized_sha256") == c("repair_normalized_json_sha256"),
        "effective_closure": c("repair_effective_sha256") == c("repair_effective_json_sha256"),
        "iteration": c("repair_iteration") >= 1,
        "first_origin": ~first | ((c("repair_origin") == ROOT_ORIGIN) & c("repair_parent_sha256").isNull()),
        "first_base": ~first | (c("repair_base_json") == c("annotation_payload_json")),
        "later_origin": first | (c("repair_origin") == LATER_ORIGIN),
        "later_parent": first | c("repair_parent_sha256").eqNullSafe(c("repair_base_json_sha256")),
        "repair_target": c("repair_review_verdict").isin(*OPEN_VERDICTS),
        "repair_review_identity": (F.get_json_object("repair_review", "$.entryId") == c("entry_id").cast("string")) & (F.get_json_object("repair_review", "$.verdict") == c("repair_review_verdict")),
        "repair_review_excerpts": _excerpts_stand("repair_review"),
        "review_terminal": c("review_verdict").isin(*VERDICTS),
        "review_status": c("review_status") == c("review_verdict"),
        "review_identity": (F.get_json_object("review_payload", "$.entryId") == c("entry_id").cast("string")) & (F.get_json_object("review_payload", "$.verdict") == c("review_verdict")),
        "review_issues": _same_json(F.get_json_object("review_payload", "$.issues"), c("review_issues"), c("review_issues_json")),
        "review_excerpts": _excerpts_stand("review_payload"),
        "review_target": causal | rereview,
    }
    if require_repaired:
        checks["review_unrepaired"] = ~c("review_verdict").isin(*OPEN_VERDICTS) | causal
    if require_passed:
        checks["review_not_passed"] = rereview & (c("review_verdict") == "pass")
    checks |= {f"current_{name}": c(name) == value for name, value in current.items()}
    checks |= {f"{ledger}_reported_model": F.trim(f"{ledger}_reported_model") != "" for ledger in ("review", "repair")}
    own = {
        "entry_id": c("entry_id").cast("string"),
        "source_sha256": c("text_sha256"),
        "root_sha256": c("annotation_payload_json_sha256"),
        "base_sha256": c("repair_base_json_sha256"),
        "parent_sha256": c("repair_parent_sha256"),
        "iteration": c("repair_iteration").cast("string"),
        "origin": c("repair_origin"),
        "review_sha256": c("repair_review_json_sha256"),
        "review_verdict": c("repair_review_verdict"),
    }
    closes = own | {
        "normalized_sha256": c("repair_normalized_json_sha256"),
        "effective_sha256": c("repair_effective_json_sha256"),
        "human_reviewed": F.lit("false"),
        "research_ready": F.lit("false"),
    }
    told = {"model": c("repair_model"), "reported_model": c("repair_reported_model"), "prompt_version": c("repair_prompt_version"), "prompt_sha256": c("repair_prompt_sha256"), "response_id": c("repair_response_id")}
    for path, value in closes.items():
        checks[f"envelope_{path}"] = c(f"envelope_told.{path}").eqNullSafe(value)
    for path in ("base", "review", "normalized", "effective"):
        checks[f"envelope_{path}"] = _same_json(c(f"envelope_told.{path}"), c(f"repair_{path}"), c(f"repair_{path}_json"))
    checks["envelope_lineage"] = _same_lineage(c("envelope_told.lineage"), "repair_lineage", c("lineage_json"))
    provenance = inputs = F.lit(True)
    for path, value in told.items():
        provenance = provenance & F.get_json_object("envelope_told.provenance", f"$.{path}").eqNullSafe(value)
    for path, value in own.items():
        inputs = inputs & c(f"input_told.{path}").eqNullSafe(value)
    return checks | {"envelope_provenance": provenance, "repair_input": inputs} | _lineage_checks()


def history_checks(repairs: DataFrame, history: DataFrame) -> DataFrame:
    """(entry_id, code) of earlier versions that are absent, numbered otherwise, not the beginning of today's lineage, or at odds with their envelope."""
    steps = F.arrays_zip(F.transform("lineage", lambda s: s["effective"]).alias("effective"), F.transform("lineage", lambda s: s["iteration"]).alias("iteration"), prefix_hashes(F.col("lineage")).alias("prefix"))
    prior = repairs.select("entry_id", F.inline(F.slice(steps, 1, F.greatest(F.size("lineage") - 1, F.lit(0))))).withColumnRenamed("effective", "effective_sha256")
    own = history.select(
        "entry_id",
        "effective_sha256",
        F.lit(True).alias("there"),
        F.col("iteration").alias("own_iteration"),
        F.try_element_at(prefix_hashes(F.col("lineage")), F.lit(-1)).alias("own_prefix"),
        _same_lineage(F.get_json_object("envelope", "$.lineage"), "lineage", sorted_json(history, "lineage")).alias("own_lineage"),
        (F.get_json_object("envelope", "$.effective_sha256") == F.col("effective_sha256")).alias("own_hash"),
    )
    j = prior.join(own, ["entry_id", "effective_sha256"], "left")
    there = F.col("there").isNotNull()
    checks = {
        "history_absent": there,
        "history_iteration": ~there | F.col("own_iteration").eqNullSafe(F.col("iteration")),
        "history_prefix": ~there | F.col("own_prefix").eqNullSafe(F.col("prefix")),
        "history_envelope_lineage": ~there | F.coalesce("own_lineage", F.lit(False)),
        "history_envelope_hash": ~there | F.coalesce("own_hash", F.lit(False)),
    }
    return j.select("entry_id", _codes(checks)).distinct()


def _codes(checks: Mapping[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))).alias("code")


def closure(
    sources: DataFrame,
    annotations: DataFrame,
    reviews: DataFrame,
    repairs: DataFrame,
    history: DataFrame,
    current: Mapping[str, str],
    contracts: Mapping[str, Column] | None = None,
    require_repaired: bool = True,
    require_passed: bool = False,
) -> DataFrame:
    """(entry_id, code) of everything that does not close; a check on what is missing or null fails too.

    contracts: further checks by name, over the columns of `joined` (such as the schema
    of a payload). A ledger that lacks an entry is named once, without the checks that
    would need it.
    """
    checks = entry_checks(current, require_repaired, require_passed) | dict(contracts or {})
    j = joined(sources, annotations, reviews, repairs)
    whole = F.col("source").isNotNull() & F.col("annotation").isNotNull() & F.col("review").isNotNull()
    missing = {k: checks[k] for k in ("source_missing", "annotation_missing", "review_missing", "repair_status")}
    found = j.filter(whole).select("entry_id", _codes(checks)).unionByName(j.filter(~whole).select("entry_id", _codes(missing)))
    return found.unionByName(history_checks(repairs, history))


def summary(repairs: DataFrame, broken: DataFrame) -> DataFrame:
    """(code, entries) with a row `closed` for the entries where nothing is broken."""
    closed = repairs.select("entry_id").join(broken.select("entry_id").distinct(), "entry_id", "left_anti")
    return broken.groupBy("code").agg(F.count_distinct("entry_id").alias("entries")).unionByName(closed.agg(F.lit("closed").alias("code"), F.count("*").alias("entries")))

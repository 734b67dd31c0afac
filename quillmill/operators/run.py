"""A whole annotation run checked in one pass, and the corpus it was made from.

Records are JSON texts with the status and the hash that the ledger has for them. Each
accepted record meets its source once; all rules are columns over that row, the record's
codes are written, and the run's totals are metrics of that write (`validate_run`), so
nothing is read or computed a second time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill import shared
from quillmill.operators.evidence import LIMIT, span_text
from quillmill.sources import snapshots

RECORD = (
    "unit_id string, source_text string, source_sha256 string, evidence array<struct<id: string, start: bigint, `end`: bigint, excerpt: string, supports: array<string>>>, "
    "required array<string>, `references` array<string>, generated array<string>, product_status string, review_status string, research_ready boolean, model_preannotation boolean, human_reviewed boolean"
)
#: Fixed value: the status of a record that no one has reviewed.
AUTOMATIC = "automatically_validated"


def status_rules(record: Column) -> dict[str, Column]:
    """What must hold of an automatically validated record: it claims no review (true: fine; others pass)."""
    other = ~record["product_status"].eqNullSafe(F.lit(AUTOMATIC))
    return {
        "status_review": other | record["review_status"].eqNullSafe(F.lit("not_reviewed")),
        "status_ready": other | record["research_ready"].eqNullSafe(F.lit(False)),
        "status_preannotation": other | record["model_preannotation"].eqNullSafe(F.lit(True)),
        "status_human": other | record["human_reviewed"].eqNullSafe(F.lit(False)),
    }


def record_rules(generated=None) -> dict[str, Column]:
    """Rules over (outer_id, outer_sha256, payload, record, there, text, text_sha256, canonical, eligible).

    generated: the form that generated texts must already have, a function of a column.
    """
    c, r = F.col, F.col("record")
    every = lambda test: F.coalesce(F.forall(r["evidence"], test), F.lit(False))
    ids = F.transform(r["evidence"], lambda e: e["id"])
    supports = F.array_distinct(F.flatten(F.transform(r["evidence"], lambda e: e["supports"])))
    inside = lambda e: (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length("text"))
    of = lambda name: F.coalesce(r[name], F.array().cast("array<string>"))
    rules = {
        "outer_id": r["unit_id"] == c("outer_id").cast("string"),
        "outer_hash": c("outer_sha256") == r["source_sha256"],
        "source_missing": c("there").isNotNull(),
        "source_hash": r["source_sha256"] == c("text_sha256"),
        "source_text": r["source_text"] == c("text"),
        "source_not_canonical": c("canonical"),
        "source_not_eligible": c("eligible"),
        "evidence_id_repeated": F.size(F.array_distinct(ids)) == F.size(ids),
        "evidence_range": every(inside),
        "evidence_length": every(lambda e: F.length(e["excerpt"]).between(2, LIMIT)),
        "evidence_not_exact": every(lambda e: ~inside(e) | (span_text(c("text"), e["start"], e["end"]) == e["excerpt"])),
        "reference_missing": F.size(F.array_except(of("references"), ids)) == 0,
        "support_missing": F.size(F.array_except(of("required"), supports)) == 0,
        "support_dangling": F.size(F.array_except(supports, of("required"))) == 0,
    }
    if generated is not None:
        rules["generated_not_fixed"] = F.forall(of("generated"), lambda x: generated(x) == x)
    return rules | status_rules(r)


def _codes(rules: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()]))


def checked(records: DataFrame, sources: DataFrame, accepted: Sequence[str] = ("valid",), generated=None) -> DataFrame:
    """records (outer_id, outer_sha256, status, payload) with `accepted` and the codes of what accepted ones break.

    sources: entry_id, text, text_sha256, canonical, eligible. What does not parse, or is
    no object, has that code alone; a record without its source has no codes about text.
    """
    src = sources.select(F.col("entry_id").alias("_qm_id"), F.lit(True).alias("there"), "text", "text_sha256", "canonical", "eligible")
    known = records.withColumns({"taken": F.col("payload").isNotNull() & (F.trim("payload") != "") & F.lower(F.trim("status")).isin(*accepted)})
    j = known.join(src, known["outer_id"] == src["_qm_id"], "left").withColumn("record", F.from_json("payload", RECORD))
    rules = record_rules(generated)
    alone = {k: rules[k] for k in ("outer_id", "outer_hash", "source_missing", *status_rules(F.col("record")))}
    codes = (
        F.when(~F.col("taken"), F.array().cast("array<string>"))
        .when(F.try_parse_json("payload").isNull(), F.array(F.lit("invalid_json")))
        .when(~F.startswith(F.ltrim("payload"), F.lit("{")), F.array(F.lit("root_not_object")))
        .when(F.col("there").isNull(), _codes(alone))
        .otherwise(_codes(rules))
    )
    return j.select("outer_id", "status", F.col("taken").alias("accepted"), codes.alias("codes"), (F.trim(F.coalesce("payload", F.lit(""))) != "").alias("has_json"))


def validate_run(records: DataFrame, sources: DataFrame, path: str, accepted: Sequence[str] = ("valid",), generated=None, allow_empty: bool = False) -> dict:
    """Writes the records' codes as a version of the snapshots at `path` and returns the run's totals.

    rows, with_json, accepted, skipped, valid and invalid count records; `codes` has the
    number and the smallest id of each code that was found, and `no_accepted_rows` where
    there was nothing to check (unless `allow_empty`). ok: nothing was found.
    """
    names = ["invalid_json", "root_not_object", *record_rules(generated)]
    has = lambda k: F.array_contains("codes", k)
    invalid = F.size("codes") > 0
    metrics = {"with_json": F.count_if("has_json"), "accepted": F.count_if("accepted"), "invalid": F.count_if(invalid)}
    metrics |= {f"n_{k}": F.count_if(has(k)) for k in names} | {f"first_{k}": F.min(F.when(has(k), F.col("outer_id"))) for k in names}
    told = snapshots.publish(checked(records, sources, accepted, generated), path, metrics=metrics)["metrics"]
    codes = {k: (told[f"n_{k}"], told[f"first_{k}"]) for k in names if told[f"n_{k}"]}
    if not told["accepted"] and not allow_empty:
        codes["no_accepted_rows"] = (1, None)
    totals = {k: told[k] for k in ("rows", "with_json", "accepted", "invalid")}
    return totals | {"skipped": told["rows"] - told["accepted"], "valid": told["accepted"] - told["invalid"], "codes": codes, "ok": not codes}


#: What a trigger says that no one knows.
UNKNOWN = ("unknown", "未知", "不详", "不明")


def frozen(*columns: str) -> Column:
    """A hash of the columns a repair may not touch."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def normalise_generated(records: DataFrame, form) -> DataFrame:
    """records with their generated texts in the given form, and how many changed added to `changed`."""
    new = F.transform("generated", form)
    changed = F.size(F.filter(F.zip_with("generated", new, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    return records.withColumn("changed", F.col("changed") + F.greatest(changed, F.lit(0))).withColumn("generated", new)


def strip_unknown(records: DataFrame, path: str = "trigger", unknown: Sequence[str] = UNKNOWN) -> DataFrame:
    """records whose trigger is unknown without the supports that point to it: what is no claim needs no proof.

    Excerpts and places stay; the number of links that go is added to `removed`. Evidence
    that would be left without support is a problem, and its record is not changed.
    """
    says_nothing = F.coalesce(F.lower(F.trim(path)).isin(*unknown), F.lit(False))
    kept = F.transform("evidence", lambda e: e.withField("supports", F.filter(e["supports"], lambda s: s != path)))
    links = lambda e: F.aggregate(e, F.lit(0), lambda n, x: n + F.size(x["supports"]))
    empty = says_nothing & F.exists(kept, lambda e: F.size(e["supports"]) == 0)
    gone = F.when(says_nothing & ~empty, links(F.col("evidence")) - links(kept)).otherwise(0)
    return records.withColumns({"removed": F.col("removed") + gone, "problem": F.coalesce("problem", F.when(empty, "empty_evidence")), "evidence": F.when(says_nothing & ~empty, kept).otherwise(F.col("evidence"))})


def bulk_repair(records: DataFrame, repairs: Sequence, immutable: Sequence[str] = ("unit", "source_profile"), accepted: str = "valid") -> DataFrame:
    """Stored valid records after all `repairs` (functions of the table), with changed, removed and problem; other records as they are.

    records: entry_id, status, unit, source_profile, generated, trigger, evidence. What is
    immutable, and every excerpt with its place, is hashed before and after; a record in
    which that differs has the problem `provenance_changed` and must not be stored.
    """
    places = F.transform("evidence", lambda e: e.dropFields("supports"))
    seen = frozen(*immutable), F.sha2(F.to_json(places).cast("binary"), 256)
    before = records.withColumns({"changed": F.lit(0), "removed": F.lit(0), "problem": F.lit(None).cast("string"), "_qm_0": seen[0], "_qm_1": seen[1]})
    after = before.filter(F.col("status") == accepted)
    for repair in repairs:
        after = repair(after)
    same = F.col("_qm_0").eqNullSafe(seen[0]) & F.col("_qm_1").eqNullSafe(seen[1])
    after = after.withColumn("problem", F.when(~same, "provenance_changed").otherwise(F.col("problem")))
    return after.unionByName(before.filter(~F.col("status").eqNullSafe(F.lit(accepted)))).drop("_qm_0", "_qm_1")


def corpus_rules(raw: DataFrame, rejected: DataFrame, entries: DataFrame, declared: Mapping[str, int]) -> DataFrame:
    """(rule, found, wanted, ok): ids once, one canonical row a hash that is eligible and that its copies point to, raw = accepted + rejected without overlap, and counts as declared.

    raw and rejected: entry_id; entries: entry_id, normal_sha256, dedupe_status,
    canonical_id, runtime_eligible, production_eligible. declared: pinned counts by name.
    These columns of entries are written, as ids, hashes and marks are counted apart.
    """
    c = F.col
    entries = shared.keep(entries.select("entry_id", "normal_sha256", "dedupe_status", "canonical_id", "runtime_eligible", "production_eligible"), "entries")
    first = c("dedupe_status") == "canonical"
    hashes = entries.groupBy("normal_sha256").agg(F.count_if(first).alias("firsts"), F.count_if(first & c("runtime_eligible")).alias("eligible"), F.count_distinct("canonical_id").alias("targets"), F.max(F.when(first, c("entry_id"))).alias("first_id"), F.max("canonical_id").alias("target"))
    wrong = hashes.agg(F.count_if(c("firsts") != 1).alias("canonical_per_hash"), F.count_if(c("eligible") != c("firsts")).alias("eligible_per_hash"), F.count_if((c("targets") != 1) | ~c("first_id").eqNullSafe(c("target"))).alias("pointers_per_hash"))
    layers = raw.select("entry_id", F.lit("raw").alias("k")).unionByName(rejected.select("entry_id", F.lit("rejected").alias("k"))).unionByName(entries.select("entry_id", F.lit("entry").alias("k")))
    n = lambda k: F.count_if(c("k") == k)
    ids = layers.groupBy("entry_id").agg(n("raw").alias("raw"), n("rejected").alias("rejected"), n("entry").alias("entry"))
    found = ids.agg(
        F.sum("raw").alias("raw"), F.sum("rejected").alias("rejected"), F.sum("entry").alias("accepted"),
        F.count_if((c("raw") > 1) | (c("entry") > 1) | (c("rejected") > 1)).alias("ids_repeated"),
        F.count_if((c("raw") > 0) & (c("rejected") + c("entry") == 0)).alias("raw_unaccounted"),
        F.count_if((c("raw") == 0) & (c("rejected") + c("entry") > 0)).alias("not_from_raw"),
        F.count_if((c("rejected") > 0) & (c("entry") > 0)).alias("accepted_and_rejected"),
    )
    marks = entries.agg(F.count_if(first).alias("canonical"), F.count_if(~first).alias("exact_duplicates"), F.count_if("runtime_eligible").alias("eligible"), F.count_if("production_eligible").alias("production"))
    one = {**found.first().asDict(), **wrong.first().asDict(), **marks.first().asDict()}  # three rows of counts
    one = {k: v or 0 for k, v in one.items()}
    zero = ("ids_repeated", "raw_unaccounted", "not_from_raw", "accepted_and_rejected", "canonical_per_hash", "eligible_per_hash", "pointers_per_hash", "production")
    rows = [(k, one[k], 0) for k in zero] + [("sum", one["raw"], one["accepted"] + one["rejected"]), ("eligible_is_canonical", one["eligible"], one["canonical"])] + [(f"declared_{k}", one[k], v) for k, v in declared.items()]
    return entries.sparkSession.createDataFrame([(*r, r[1] == r[2]) for r in rows], "rule string, found long, wanted long, ok boolean")

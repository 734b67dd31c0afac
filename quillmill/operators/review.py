"""Reviews: audits of issue lists, merging of two directions, scores against a gold set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ledger import rate


def canonical_names(issues: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Drifted names replaced by their canonical form; aliases (alias, name) is a small table."""
    a = aliases.select(F.col("alias").alias(column), F.col("name").alias("_qm_n"))
    return issues.join(F.broadcast(a), column, "left").withColumn(column, F.coalesce("_qm_n", column)).drop("_qm_n")


def audit_issues(issues: DataFrame, texts: DataFrame, fields: DataFrame, key: str = "entry_id", soft: str = "maybe|perhaps|possibly") -> DataFrame:
    """(key, code, problem) of issues (key, code, field, excerpt, hint): unknown code, wrong field, excerpt not in the text, soft language, repeats."""
    j = issues.join(F.broadcast(fields.select("code", F.col("field").alias("right_field"))), "code", "left").join(texts.select(key, "text"), key, "left")
    n = F.count("*").over
    from pyspark.sql import Window as W

    repeated = n(W.partitionBy(key, "code", "field", "excerpt", "hint")) > 1
    j = j.withColumn("repeated", repeated)
    problems = F.array_compact(
        F.array(
            F.when(F.col("right_field").isNull(), "unknown_code"),
            F.when(F.col("right_field") != F.col("field"), "wrong_field"),
            F.when(~F.coalesce(F.contains("text", "excerpt"), F.lit(False)), "excerpt_not_in_text"),
            F.when(F.rlike("hint", F.lit(f"(?i)\\b(?:{soft})\\b")), "soft_language"),
            F.when(F.col("repeated"), "repeated"),
        )
    )
    return j.select(key, "code", F.explode(problems).alias("problem")).distinct()


def merge_directions(stages: DataFrame, codes: DataFrame, key: str = "entry_id") -> DataFrame:
    """Issues of both directions under unified codes (stage_code, code), distinct."""
    return stages.join(F.broadcast(codes), "stage_code").select(key, "code", "field", "excerpt", "hint").dropDuplicates()


def verdicts(entries: DataFrame, issues: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, verdict, issues, fields): revise if there is any issue, else pass."""
    by = issues.groupBy(key).agg(F.count("*").alias("issues"), F.array_join(F.sort_array(F.collect_set("field")), ",").alias("fields"))
    n = F.coalesce("issues", F.lit(0))
    return entries.select(key).join(by, key, "left").select(key, F.when(n > 0, "revise").otherwise("pass").alias("verdict"), n.alias("issues"), F.coalesce("fields", F.lit("")).alias("fields"))


def ordered_issues(issues: DataFrame, positions: DataFrame, key: str = "entry_id") -> DataFrame:
    """Issues of each entry in checklist order, then code, excerpt and hint, as one text a row."""
    j = issues.join(F.broadcast(positions), "field")
    line = F.struct("position", "code", "excerpt", "hint")
    return j.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: F.concat_ws("|", s["position"].cast("string"), s["code"], s["excerpt"], s["hint"])), ";").alias("ordered"))


def infer_direction(code: Column, hint: Column) -> Column:
    """omission or contradiction, from the code, else from the hint; contradiction by default."""
    omit = F.rlike(code, F.lit("(?i)missing|omit")) | F.rlike(hint, F.lit("(?i)add|include|supply"))
    return F.when(F.rlike(code, F.lit("(?i)wrong|contradict")), "contradiction").when(omit, "omission").otherwise("contradiction")


def audit_direction(issues: DataFrame, values: DataFrame, allowed: dict[str, Sequence[str]], key: str = "entry_id") -> DataFrame:
    """(key, problem) of directional issues (key, mode, code, field, target): code not allowed in its mode, omitted target present, contradicted target absent."""
    ok = F.lit(False)
    for mode, codes in allowed.items():
        ok = ok | ((F.col("mode") == mode) & F.col("code").isin(*codes))
    there = values.select(key, "field", F.col("value").alias("target"), F.lit(True).alias("present")).distinct()
    j = issues.join(there, [key, "field", "target"], "left")
    present = F.coalesce("present", F.lit(False))
    problem = F.when(~ok, "code_not_allowed").when((F.col("mode") == "omission") & present, "target_present").when((F.col("mode") == "contradiction") & ~present, "target_absent")
    return j.select(key, problem.alias("problem")).filter("problem is not null")


def gold_checks(gold: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, problem) of gold rows (must_detect, must_not_flag, has_error): overlapping sets, or an error flag that disagrees."""
    overlap = F.arrays_overlap("must_detect", "must_not_flag")
    differs = (F.size("must_detect") > 0) != F.col("has_error")
    return gold.select(key, F.when(overlap, "overlap").when(differs, "flag_differs").alias("problem")).filter("problem is not null")


def drift(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, drift): missing, extra, or the first column that differs; equal rows are left out."""
    e = expected.select(key, F.lit(True).alias("e"), *[F.col(c).alias(f"e_{c}") for c in columns])
    a = actual.select(key, F.lit(True).alias("a"), *columns)
    d = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra")
    for c in columns:
        d = d.when(~F.col(c).eqNullSafe(F.col(f"e_{c}")), c)
    return e.join(a, key, "full").select(key, d.alias("drift")).filter("drift is not null")


def field_scores(gold: DataFrame, found: DataFrame, key: str = "entry_id") -> DataFrame:
    """One row of scores; gold (key, must_detect, must_not_flag, has_error), found (key, fields). Rates are null over nothing."""
    j = gold.join(found, key, "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))
    hit = F.size(F.array_intersect("must_detect", "fields"))
    wanted, revised = F.size("must_detect"), F.size("fields") > 0
    return j.agg(
        rate(F.count_if(F.col("has_error") & revised), F.count_if(F.col("has_error"))).alias("record_recall"),
        rate(F.count_if(F.col("has_error") & revised), F.count_if(revised)).alias("revise_precision"),
        rate(F.sum(hit), F.sum(wanted)).alias("required_detection"),
        F.count_if(~F.col("has_error") & revised).alias("pure_false_positives"),
        F.count_if(F.arrays_overlap("must_not_flag", "fields")).alias("must_not_violations"),
        F.count_if(F.col("has_error") & ~revised).alias("false_passes"),
    )


def direction_scores(expected: DataFrame, found: DataFrame, key: str = "entry_id") -> DataFrame:
    """(direction, expected, detected, recall) over (key, field, direction); pairs expected in both directions are ambiguous and left out."""
    ambiguous = expected.groupBy(key, "field").agg(F.count_distinct("direction").alias("n")).filter("n > 1")
    clear = expected.select(key, "field", "direction").distinct().join(ambiguous, [key, "field"], "left_anti")
    hits = clear.join(found.select(key, "field", "direction").distinct().withColumn("hit", F.lit(1)), [key, "field", "direction"], "left")
    return hits.groupBy("direction").agg(F.count("*").alias("expected"), F.count("hit").alias("detected"), rate(F.count("hit"), F.count("*")).alias("recall"))


def strict_audit(reviews: DataFrame, hashes: DataFrame, key: str = "entry_id", by: Sequence[str] = ()) -> DataFrame:
    """One row (a row of each group `by`): whether every review is there with the expected hash, and its score only then."""
    j = hashes.join(reviews, key, "left")
    ok = F.bool_and(F.coalesce(F.col("review_hash") == F.col("expected_hash"), F.lit(False)))
    return j.groupBy(*by).agg(ok.alias("complete"), F.count("*").alias("rows")).withColumn("audited", F.when(F.col("complete"), F.col("rows")))

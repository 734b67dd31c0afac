"""Job ledgers as snapshots: a run joins the last snapshot and writes the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses a row may move to from each status; null is "not there yet".
TRANSITIONS = {None: ["queued"], "queued": ["leased"], "leased": ["valid", "retryable_failed", "quarantined"], "retryable_failed": ["leased", "quarantined"], "valid": ["stale"], "stale": ["leased"], "quarantined": ["leased"]}


def enqueue(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Next snapshot of (entry_id, source_hash, status, payload): new entries queued, changed sources stale with no payload, others kept."""
    e = entries.select("entry_id", F.col("source_hash").alias("new_hash"))
    j = ledger.join(e, "entry_id", "full")
    changed = F.col("source_hash").isNotNull() & F.col("new_hash").isNotNull() & (F.col("source_hash") != F.col("new_hash"))
    status = F.when(F.col("source_hash").isNull(), "queued").when(changed, "stale").otherwise(F.col("status"))
    return j.select("entry_id", F.coalesce("new_hash", "source_hash").alias("source_hash"), status.alias("status"), F.when(~changed, F.col("payload")).alias("payload"))


def invalidate(ledger: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Valid rows whose provenance columns differ from the wanted values become stale; a null differs."""
    same = F.lit(True)
    for c, v in wanted.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return ledger.withColumn("status", F.when((F.col("status") == "valid") & ~same, "stale").otherwise(F.col("status")))


def pending(selected: DataFrame, ledger: DataFrame, resume: bool, retry_quarantined: bool, stages: DataFrame | None = None, modes: int = 2) -> DataFrame:
    """Selected entries still to do; valid ones are an error without `resume`. Rows that are valid with a stage missing reopen."""
    allowed = ["queued", "retryable_failed", "stale", "leased", *(["quarantined"] if retry_quarantined else [])]
    j = selected.join(ledger.select("entry_id", "status"), "entry_id")
    open_ = F.col("status").isin(*allowed)
    if stages is not None:
        done = stages.filter("status = 'valid'").groupBy("entry_id").agg(F.count_distinct("mode").alias("modes"))
        j = j.join(done, "entry_id", "left")
        open_ = open_ | ((F.col("status") == "valid") & (F.coalesce("modes", F.lit(0)) < modes))
    problem = F.lit(None).cast("string") if resume else F.when(F.col("status") == "valid", "already_valid")
    return j.withColumns({"todo": open_, "problem": problem}).filter("todo or problem is not null").select("entry_id", "status", "problem")


def transitions(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each event with the status before it and whether the move is legal."""
    before = F.lag("status").over(W.partitionBy(key).orderBy(*order))
    legal = F.lit(False)
    for a, b in TRANSITIONS.items():
        legal = legal | ((F.col("before").isNull() if a is None else F.col("before") == a) & F.col("status").isin(*b))
    return events.withColumn("before", before).withColumn("legal", F.coalesce(legal, F.lit(False)))


def latest(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last event of each key, by pre-aggregation, with the number of events as attempts."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(last.alias("_qm_l"), F.count("*").alias("attempts")).select(key, *[F.col(f"_qm_l.{c}") for c in columns], "attempts")


def retry_round(failed: DataFrame, key: str, attempts: str, budget: int) -> DataFrame:
    """Next round of failed rows: singly, with one attempt less; quarantined when none is left."""
    left = F.lit(budget) - F.col(attempts)
    return failed.select(key, attempts, F.greatest(left, F.lit(0)).alias("left"), F.when(left > 0, "retry_single").otherwise("quarantined").alias("action"))


def archive(current: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """History rows of valid rows that an incoming row with another digest supersedes; one row a (key, digest)."""
    new = incoming.select(key, F.col(digest).alias("_qm_new"))
    old = current.join(new, key).filter(F.col(digest) != F.col("_qm_new"))
    return old.select(key, digest, F.lit("superseded").alias("reason")).dropDuplicates([key, digest])


def scope_guard(selected: int, corpus: int, confirmed: bool, inputs: Sequence[str], outputs: Sequence[str]) -> None:
    """A whole-corpus run needs confirmation, and no output may be an input."""
    if selected >= corpus and not confirmed:
        raise ValueError("a full run needs confirmation")
    if both := set(inputs) & set(outputs):
        raise ValueError(f"outputs overwrite inputs: {sorted(both)}")


def status_counts(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ledger.groupBy(*by, "status").agg(F.count("*").alias("n"))


def stage_matrix(stages: DataFrame, mode: str, statuses: Sequence[str]) -> DataFrame:
    """Counts by mode (rows) and status (columns)."""
    return stages.groupBy(mode).pivot("status", list(statuses)).agg(F.count(F.lit(1))).na.fill(0)


def token_usage(artifacts: DataFrame, by: Sequence[str], response: str, tokens: str) -> DataFrame:
    """Tokens summed once per distinct provider response."""
    once = artifacts.groupBy(*by, response).agg(F.max(tokens).alias(tokens))
    return once.groupBy(*by).agg(F.sum(tokens).alias(tokens), F.count("*").alias("responses"))


def rollup(ledger: DataFrame) -> DataFrame:
    """One row: attempts, succeeded, failed, quarantined, pending."""
    s = F.col("status")
    return ledger.agg(F.sum("attempts").alias("attempts"), F.count_if(s == "valid").alias("succeeded"), F.count_if(s == "retryable_failed").alias("failed"), F.count_if(s == "quarantined").alias("quarantined"), F.count_if(s.isin("queued", "leased", "stale")).alias("pending"))


def quality_metrics(checks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows that pass each check, null where there is no row."""
    return checks.agg(*[F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in columns])


def overlay(base: DataFrame, repairs: DataFrame, key: str, payload: str) -> DataFrame:
    """Base rows with the latest valid repair (iteration) on top; origin and iteration say which it is."""
    r = repairs.filter("status = 'valid'").groupBy(key).agg(F.max(F.struct("iteration", payload)).alias("r"))
    j = base.join(r, key, "left")
    return j.select(key, F.coalesce(F.col(f"r.{payload}"), F.col(payload)).alias(payload), F.when(F.col("r").isNotNull(), "repair").otherwise("base").alias("origin"), F.coalesce("r.iteration", F.lit(0)).alias("iteration"))


def repair_base(reviews: DataFrame, versions: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, origin, iteration, problem): which version a review was made of; versions (key, base_hash, progress_hash, current_hash, current_iteration)."""
    h = F.col("reviewed_hash")
    j = reviews.join(versions, key, "left")
    origin = F.when(h == F.col("base_hash"), "base").when(h == F.col("progress_hash"), "in_progress").when(h == F.col("current_hash"), "repair")
    step = F.when(origin == "repair", F.col("current_iteration") + 1).when(origin.isNotNull(), 1)
    return j.select(key, origin.alias("origin"), step.alias("iteration"), F.when(origin.isNull(), "hash_matches_nothing").alias("problem"))


def stage_pairs(stages: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, problem): entries whose two directional stages are not both there exactly once."""
    n = lambda m: F.count_if(F.col("mode") == m)
    by = stages.groupBy(key).agg(n(first).alias("a"), n(second).alias("b"))
    problem = F.when(F.col("a") == 0, f"{first}_missing").when(F.col("b") == 0, f"{second}_missing").when((F.col("a") > 1) | (F.col("b") > 1), "repeated")
    return by.select(key, problem.alias("problem"))


def lineage_check(lineage: DataFrame, key: str) -> DataFrame:
    """(key, code) for broken chains of (key, iteration, parent, hash): wrong parent, gaps, or a hash that comes twice."""
    w = W.partitionBy(key).orderBy("iteration")
    x = lineage.withColumns({"p": F.lag("hash").over(w), "pi": F.lag("iteration").over(w)})
    first = F.col("pi").isNull()
    wrong = F.when(first, F.lit(False)).otherwise(~F.col("parent").eqNullSafe(F.col("p")))
    gap = F.when(first, F.col("iteration") != 1).otherwise(F.col("iteration") != F.col("pi") + 1)
    by = x.groupBy(key).agg(F.bool_or(wrong).alias("parent"), F.bool_or(gap).alias("gap"), (F.count_distinct("hash") < F.count("*")).alias("repeated"))
    codes = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("parent", "gap", "repeated")]))
    return by.select(key, F.explode(codes).alias("code"))


def cycle_check(candidates: DataFrame, lineage: DataFrame, key: str) -> DataFrame:
    """(key, verdict) of a new hash: no_op if it equals its base, cycle if the lineage has it, else new."""
    seen = lineage.groupBy(key).agg(F.collect_set("hash").alias("seen"))
    verdict = F.when(F.col("new_hash") == F.col("base_hash"), "no_op").when(F.array_contains("seen", F.col("new_hash")), "cycle").otherwise("new")
    return candidates.join(seen, key, "left").select(key, F.coalesce(verdict, F.lit("new")).alias("verdict"))


def agreement(tables: dict[str, DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """(key, code): ledgers in which a key is missing or a column differs from the first one."""
    (name, base), *rest = tables.items()
    j = base.select(key, *[F.col(c).alias(f"{name}_{c}") for c in columns])
    checks = []
    for other, df in rest:
        j = j.join(df.select(key, F.lit(True).alias(f"has_{other}"), *[F.col(c).alias(f"{other}_{c}") for c in columns]), key, "left")
        checks.append(F.when(F.col(f"has_{other}").isNull(), F.lit(f"{other}:missing")))
        checks += [F.when(F.col(f"has_{other}") & ~F.col(f"{name}_{c}").eqNullSafe(F.col(f"{other}_{c}")), F.lit(f"{other}:{c}")) for c in columns]
    return j.select(key, F.explode(F.array_compact(F.array(*checks))).alias("code"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), 6)

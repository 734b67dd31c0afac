"""Story versions, families and catalogues: admission, merging, linking and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coalesce_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each target column from the first of its source names that df has and that is not null."""
    out = {}
    for target, names in aliases.items():
        have = [F.col(n) for n in names if n in df.columns]
        out[target] = F.coalesce(*have) if have else F.lit(None)
    return df.withColumns(out)


def standardise_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Renames the first present candidate of each wanted column; a missing one fails."""
    names = {}
    for target, candidates in wanted.items():
        found = next((c for c in candidates if c in df.columns), None)
        if found is None:
            raise ValueError(f"none of {candidates} is a column")
        names[found] = target
    return df.withColumnsRenamed(names)


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One boolean column a rule (null counts as failed) and `eligible`, their conjunction."""
    checks = {f"ok_{k}": F.coalesce(c, F.lit(False)) for k, c in rules.items()}
    everything = F.lit(True)
    for c in checks.values():
        everything = everything & c
    return df.withColumns(checks | {"eligible": everything})


def issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for every rule (true: fine) that a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("code"))


def issue_histogram(found: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """Issues by code with a bounded number of example keys, the smallest ones."""
    ranked = found.withColumn("_qm_n", F.row_number().over(W.partitionBy("code").orderBy(key)))
    few = ranked.filter(F.col("_qm_n") <= examples).groupBy("code").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return found.groupBy("code").agg(F.count("*").alias("n")).join(few, "code")


def unique_families(df: DataFrame, family: str) -> DataFrame:
    """Rows of families that have exactly one; all rows of the others are rejected."""
    single = df.groupBy(family).agg(F.count("*").alias("_qm_n")).filter("_qm_n = 1").select(family)
    return df.join(single, family, "left_semi")


def merge_unique(existing: DataFrame, additions: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, signature, action): kept, added or conflict; an id must keep one signature."""
    both = existing.select(key, signature, F.lit(0).alias("added")).unionByName(additions.select(key, signature, F.lit(1).alias("added")))
    by = both.groupBy(key).agg(F.min("added").alias("first"), F.count_distinct(signature).alias("kinds"), F.min_by(signature, "added").alias(signature))
    action = F.when(F.col("kinds") > 1, "conflict").when(F.col("first") == 0, "kept").otherwise("added")
    return by.select(key, signature, action.alias("action"))


def partition_check(all_ids: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids in both parts, missing from both, and unknown to the whole; all zero for an exact partition."""
    sides = all_ids.select(key, F.lit(1).alias("a"), F.lit(0).alias("l"), F.lit(0).alias("r"))
    sides = sides.union(left.select(key, F.lit(0), F.lit(1), F.lit(0))).union(right.select(key, F.lit(0), F.lit(0), F.lit(1)))
    by = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("l").alias("l"), F.max("r").alias("r"))
    return by.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("both"), F.count_if((F.col("a") == 1) & (F.col("l") + F.col("r") == 0)).alias("missing"), F.count_if(F.col("a") == 0).alias("unknown"))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that are missing from, or extra in, the actual table."""
    e, a = expected.select(key).distinct().withColumn("e", F.lit(1)), actual.select(key).distinct().withColumn("a", F.lit(1))
    return e.join(a, key, "full").filter("e is null or a is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))


def family_pointers(selection: DataFrame, versions: DataFrame) -> DataFrame:
    """selection (family, primary_id, secondary_id) checked against versions (version_id, family): one problem or null a row."""
    p = versions.select(F.col("version_id").alias("primary_id"), F.col("family").alias("primary_family"))
    s = versions.select(F.col("version_id").alias("secondary_id"), F.col("family").alias("secondary_family"))
    j = selection.join(p, "primary_id", "left").join(s, "secondary_id", "left")
    problem = (
        F.when(F.col("primary_family").isNull(), "primary_unknown")
        .when(F.col("secondary_family").isNull(), "secondary_unknown")
        .when((F.col("primary_family") != F.col("family")) | (F.col("secondary_family") != F.col("family")), "family_differs")
        .when(F.col("primary_id") == F.col("secondary_id"), "same_version")
    )
    return j.select("family", "primary_id", "secondary_id", problem.alias("problem"))


def build_catalog(seed: DataFrame, detailed: DataFrame, overrides: DataFrame) -> DataFrame:
    """seed (id, title) with details (id, status) and overrides (id, status); detailed rows without a seed are added."""
    d = detailed.select("id", F.col("status").alias("d_status"))
    o = overrides.select("id", F.col("status").alias("o_status"))
    rows = seed.join(d, "id", "left").unionByName(detailed.join(seed, "id", "left_anti").select("id", F.lit(None).cast("string").alias("title"), F.col("status").alias("d_status")))
    status = F.coalesce("o_status", "d_status", F.lit("discovered"))
    step = F.when(status == "approved", "none").when(status == "drafted", "review").otherwise("draft")
    return rows.join(o, "id", "left").select("id", "title", status.alias("status"), step.alias("next_gate"))


def overview(df: DataFrame, by: str) -> DataFrame:
    """Counts by a column with their place in (-count, name) order."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), by)))


def leaks(df: DataFrame, key: str, forbidden: str) -> DataFrame:
    """Rows whose whole serialised record matches a forbidden pattern."""
    return df.filter(F.rlike(F.to_json(F.struct("*")), F.lit(forbidden))).select(key)


def contract(df: DataFrame, key: str, required: list[str] = (), enums: dict[str, list[str]] | None = None, patterns: dict[str, str] | None = None, sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(key, code) for each breach of a schema contract: required columns, enums, patterns and text sizes."""
    rules = {f"required:{c}": F.col(c).isNotNull() for c in required}
    rules |= {f"enum:{c}": F.col(c).isin(*v) for c, v in (enums or {}).items()}
    rules |= {f"pattern:{c}": F.rlike(F.col(c).cast("string"), F.lit(p)) for c, p in (patterns or {}).items()}
    rules |= {f"size:{c}": F.length(c).between(*b) for c, b in (sizes or {}).items()}
    return issues(df, key, rules)

"""Exact dedup of corpus entries, with pointers to the row that stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.shared import keep


def with_hashes(entries: DataFrame, normalise: bool = True) -> DataFrame:
    """entries (entry_id, work, text, ...) with text_sha256, normal_sha256 and char_count."""
    return entries.withColumns({"char_count": F.length("text"), "text_sha256": tx.text_hash(F.col("text")), "normal_sha256": tx.text_hash(tx.comparison_text(F.col("text"), normalise=normalise))})


def mark_duplicates(entries: DataFrame, key: str = "normal_sha256", order: tuple[str, ...] = ("work", "entry_id")) -> DataFrame:
    """Adds dedupe_status, canonical_id and runtime_eligible: the first row of each key stays.

    The first row comes from a pre-aggregated minimum, not from a window, and keys with
    many rows, a thousand of them at most, are broadcast, so that a text that owns a third
    of the rows is no task of its own: its rows stay where they are.
    """
    first = keep(entries.groupBy(key).agg(F.min(F.struct(*order))["entry_id"].alias("canonical_id"), F.count("*").alias("_qm_n")), "first")
    total = first.agg(F.coalesce(F.sum("_qm_n"), F.lit(0))).first()[0]
    cut = max(500, total // 1000)
    large, small = first.filter(F.col("_qm_n") > cut).drop("_qm_n"), first.filter(F.col("_qm_n") <= cut).drop("_qm_n")
    if large.limit(1).count():
        rest = entries.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key)
        joined = entries.join(F.broadcast(large), key).unionByName(rest)
    else:
        joined = entries.join(small, key)
    own = F.col("entry_id") == F.col("canonical_id")
    return joined.withColumns({"dedupe_status": F.when(own, "canonical").otherwise("exact_duplicate"), "runtime_eligible": own})


def canonical_entries(marked: DataFrame) -> DataFrame:
    """Eligible canonical rows whose stored hash still fits their text."""
    return marked.filter((F.col("dedupe_status") == "canonical") & F.col("runtime_eligible")).withColumn("hash_ok", tx.text_hash(F.col("text")) == F.col("text_sha256"))


def dangling_pointers(marked: DataFrame) -> DataFrame:
    """Duplicates that point at no canonical row."""
    canonical = marked.filter("dedupe_status = 'canonical'").select(F.col("entry_id").alias("canonical_id"))
    return marked.filter("dedupe_status = 'exact_duplicate'").join(canonical, "canonical_id", "left_anti")


def length_gate(entries: DataFrame, least: int = 20) -> DataFrame:
    """Raw, rejected and accepted segments by work."""
    short = F.length(F.trim("text")) < least
    return entries.groupBy("work").agg(F.count("*").alias("raw"), F.count_if(short).alias("rejected"), F.count_if(~short).alias("accepted"))


def build_summary(marked: DataFrame, least: int = 20) -> DataFrame:
    """One row: raw, rejected, accepted, duplicates, unique, works."""
    ok = F.length(F.trim("text")) >= least
    return marked.agg(
        F.count("*").alias("raw"),
        F.count_if(~ok).alias("rejected"),
        F.count_if(ok).alias("accepted"),
        F.count_if(F.col("dedupe_status") == "exact_duplicate").alias("duplicates"),
        F.count_if(F.col("dedupe_status") == "canonical").alias("unique_rows"),
        F.count_distinct("work").alias("works"),
    )


def work_counts(entries: DataFrame) -> DataFrame:
    """Rows by work and, with a null work, their total."""
    return entries.rollup("work").agg(F.count("*").alias("n"))


def fingerprint(entries: DataFrame, line: Column, bucket_rows: int = 5000) -> DataFrame:
    """Hash of a whole ordered table as a hash of ordered bucket hashes, in buckets of about `bucket_rows` rows."""
    buckets = max(1, -(-entries.count() // bucket_rows))
    b = F.pmod(F.conv(F.substring(F.sha2(F.col("entry_id").cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))
    parts = entries.select(b.alias("b"), F.col("entry_id"), line.alias("line")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("entry_id", "line"))).alias("rows"))
    hashed = parts.select("b", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), "\n").cast("binary"), 256).alias("h"), F.size("rows").cast("long").alias("n"))
    return hashed.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda r: r["h"]), "\n").cast("binary"), 256).alias("fingerprint"), F.sum("n").alias("n"))

"""Exact dedup: two-pass Bloom filtering, only possibly repeated hashes shuffle.

Texts are equal when they are identical after every run of ASCII white space has
become one space; a null text counts as empty. Pass one fills a Bloom filter of
bounded size that knows which text hashes may occur twice (`repeat_filter`). Pass
two sends the rows it names through a grouped aggregate on SHA-256, so the filter's
false positives cost a shuffle and never a wrong answer; all other rows are
answered where they are.

Cases: an empty table gives an empty result. A null id counts as larger than any
other, so it stays only in a group of null ids. Of several rows with the same
smallest id and equal text exactly one stays. Columns of the input that clash with
the columns added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import SPACE, Stash, join_groups, one_of_each, repeat_filter, text_key, text_of, without

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def _hashed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    sha = F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256)
    return docs.select(F.col(id_col).alias("id"), *more, sha.alias("sha")).withColumn("h", F.xxhash64("sha"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 27) -> DataFrame:
    """One row for each row of docs: (id, keep_id, group_size, kept, text_sha256); no text is shuffled."""
    stash = Stash(docs.sparkSession, "exact")
    keyed = stash.keep(_hashed(docs, id_col, text_col), "keyed")
    maybe = repeat_filter(keyed, "h", keyed.count(), max_bits).may_repeat(F.col("h"))
    marked = keyed.withColumn("maybe", maybe)

    alone = marked.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    counted = stash.keep(marked.filter("maybe").groupBy("sha", "id").agg(F.count("*").alias("n")), "counted")
    groups = stash.keep(counted.groupBy("sha").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("ids")), "groups")
    found = (
        join_groups(counted, groups, "sha", "ids", counted.count())
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    )
    return alone.unionByName(found).select(F.col("id").alias(id_col), *ADDED)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 27) -> DataFrame:
    """docs without all but one row of each group of equal texts, columns unchanged.

    Only rows whose hash may be repeated meet other rows, by ids and hashes; their texts
    then meet the rows that stay by id. Of rows that also share the smallest id one is taken.
    """
    stash = Stash(docs.sparkSession, "exact")
    keyed = stash.keep(_hashed(docs.withColumn("_qm_key", text_key(text_col)), id_col, text_col, "_qm_key"), "keyed")
    seen = repeat_filter(keyed, "h", keyed.count(), max_bits)
    sha = F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256)
    maybe = docs.withColumn("_qm_maybe", seen.may_repeat(F.xxhash64(sha)))
    groups = keyed.filter(seen.may_repeat(F.col("h"))).select("id", F.col("_qm_key").alias("key"), F.col("sha").alias("group"))
    alone = maybe.filter(~F.col("_qm_maybe")).select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(one_of_each(groups, maybe.filter("_qm_maybe").select(*[F.col(f"`{c}`") for c in docs.columns]), id_col, text_col))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 27) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 of each row's group added.

    Rows with the same id and equal text are told apart only by `kept`.
    """
    base = without(docs, ADDED).withColumn("_qm_sha", F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256))
    groups = copy_groups(docs, id_col, text_col, max_bits)
    info = groups.groupBy("text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    from pyspark.sql import Window as W

    order = W.partitionBy("_qm_sha", id_col).orderBy(F.lit(1))
    return (
        base.join(info, F.col("_qm_sha") == F.col("text_sha256"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.row_number().over(order) == 1))
        .drop("_qm_sha")
    )

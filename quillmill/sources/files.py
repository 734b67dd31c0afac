"""File sources and sinks: pinned files, NDJSON shards with a manifest, gated envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators.sampling import with_shard
from quillmill.sources import snapshots


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a path; contents stay on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, problem): missing, unlisted, size or hash; fine files are left out."""
    m = manifest.select("file", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"))
    j = found.join(m, "file", "full")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("m_bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("m_bytes"), "size").when(F.col("sha256") != F.col("m_sha"), "hash")
    return j.select("file", problem.alias("problem")).filter("problem is not null")


def _plain(path: str | Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _shard_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, bytes, sha256, rows, broken) of every NDJSON file under a path, as it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    facts = files.select(_plain("path").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("value"))
    parsed = F.from_json("value", f"{schema}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    # a file's last line ends, and an empty file has none
    lines = facts.withColumn("value", F.explode_outer(F.split(F.regexp_replace("value", r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")))
    there = F.when(F.col("bytes") > 0, F.lit(1))
    return lines.groupBy("path", "bytes", "sha256").agg(F.count(there).alias("rows"), F.count(F.when(F.col("bytes") > 0, parsed["broken"])).alias("broken"))


def write_shards(entries: DataFrame, path: str, work: str, order: str, rows: int = 1000) -> DataFrame:
    """NDJSON files of at most `rows` rows, one folder a work; returns the manifest (path, bytes, sha256, rows) of what was written.

    A task has whole shards in order, and only the last one of a work is short, so that
    counting rows cuts the files where the shards end; there is no folder for each, which
    would be listed and sent to the driver one by one.
    """
    # null and empty are one work, named as Spark names their folder
    named = F.coalesce(F.when(F.col(work).cast("string") != "", F.col(work).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    placed = with_shard(entries.withColumn(work, named), work, order, rows).withColumn(work, named)
    placed.repartition(work, "shard").sortWithinPartitions(work, "shard", order).write.partitionBy(work).option("maxRecordsPerFile", rows).mode("overwrite").json(path)
    return _shard_facts(entries.sparkSession, path, f"{order} string").drop("broken")


def verify_shards(spark: SparkSession, path: str, schema: str, manifest: DataFrame) -> DataFrame:
    """(path, problem) of shards against their manifest: missing, unlisted, size, hash, rows or broken lines."""
    m = manifest.select("path", *[F.col(c).alias(f"m_{c}") for c in ("bytes", "sha256", "rows")])
    j = _shard_facts(spark, path, schema).join(m, "path", "full")
    problem = F.when(F.col("bytes").isNull(), "missing").when(F.col("m_bytes").isNull(), "unlisted")
    for c, name in (("bytes", "size"), ("sha256", "hash"), ("rows", "rows")):
        problem = problem.when(F.col(c) != F.col(f"m_{c}"), name)
    return j.select("path", problem.when(F.col("broken") > 0, "broken").alias("problem")).filter("problem is not null")


def read_shards(spark: SparkSession, path: str, schema: str, manifest: DataFrame | None = None) -> DataFrame:
    """Rows of all shards. Shards that differ from the manifest, or lines that do not parse, fail the whole read."""
    if manifest is None:
        manifest = _shard_facts(spark, path, schema)
    if bad := verify_shards(spark, path, schema, manifest).orderBy("path").limit(5).collect():
        raise ValueError("shards do not hold what they should: " + ", ".join(f"{r.path} ({r.problem})" for r in bad))
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)


def read_envelope(spark: SparkSession, path: str, schema: str, gates: Column, records: str = "records") -> DataFrame:
    """Records of envelopes (one JSON object a file) that pass all gates; an envelope that fails gives nothing."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.filter(F.coalesce(gates, F.lit(False))).select(F.inline(records))


#: The columns of the published table.
ENTRY_COLUMNS = (
    "entry_id", "source_key", "work", "work_title", "work_period", "volume", "locator", "ordinal", "title", "title_origin", "url",
    "char_count", "text_mode", "text", "text_sha256", "normal_sha256", "dedupe_status", "canonical_id", "catalog_status",
    "runtime_eligible", "production_eligible", "full_text_search",
)


def entry_checks() -> dict[str, Column]:
    """What must hold for every published row; all 22 columns have a value (a text may be empty: too short ones are refused by the length gate)."""
    c = F.col
    canonical = c("dedupe_status") == "canonical"
    checks = {k: c(k).isNotNull() for k in ENTRY_COLUMNS}
    return checks | {
        "ordinal": c("ordinal") >= 0,
        "char_count": c("char_count") == F.length("text"),
        "text_sha256": c("text_sha256") == F.sha2(c("text").cast("binary"), 256),
        "normal_sha256": F.rlike("normal_sha256", F.lit("^[0-9a-f]{64}$")),
        "dedupe_status": c("dedupe_status").isin("canonical", "exact_duplicate"),
        "canonical_id": canonical == (c("canonical_id") == c("entry_id")),
        "runtime_eligible": canonical | ~c("runtime_eligible"),
        "production_eligible": ~c("production_eligible"),
    }


def publish_entries(entries: DataFrame, path: str, work: str = "work", files_each: int = 16) -> dict:
    """Publishes the entries table as a version of its snapshots and returns what its marker says.

    A column that is missing is an error, and so is a row that breaks a check or a value
    of entry_id or source_key that is there twice; nothing is published then. Counts of
    all rows and of searchable ones are gathered in the same pass.
    """
    if gone := [c for c in ENTRY_COLUMNS if c not in entries.columns]:
        raise ValueError(f"not published, columns are missing: {gone}")
    searchable = F.count_if((F.col("dedupe_status") == "canonical") & F.col("full_text_search"))
    return snapshots.publish(entries.select(*ENTRY_COLUMNS), path, entry_checks(), ("entry_id", "source_key"), (work,), {"searchable": searchable, "canonical": F.count_if(F.col("dedupe_status") == "canonical")}, files_each=files_each)

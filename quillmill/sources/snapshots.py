"""Tables as numbered snapshots: written apart, checked while written, published by a marker.

A table is a folder. Its data lie in folders of their own, and a small numbered marker
file names the folder of each version; the greatest number is the table. A writer brings
its data to a new folder first, gathers its checks as observed metrics of that very write,
and then creates the next marker without overwriting. Two writers that started from the
same version want the same marker, and the file system lets one of them have it: the
other one reads again and repeats its change (`update`). Readers see whole versions only.
A marker also keeps the last batch of each writer, so that a batch of a stream that is
sent again changes nothing.

Creating a file only if it is absent is atomic on HDFS and on local disks; stores without
that need a lock beside it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKERS = "_versions"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _path(spark, f"{path}/{MARKERS}")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def describe(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What the marker of a version (the latest one) says; None if there is none."""
    if version is None:
        if not (known := versions(spark, path)):
            return None
        version = known[-1]
    lines = spark.read.text(f"{path}/{MARKERS}/{version:012d}.json").collect()  # one line
    return json.loads(lines[0][0])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the latest."""
    told = describe(spark, path, version)
    if told is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{path}/{told['folder']}")


def commit(spark: SparkSession, path: str, version: int, told: Mapping) -> None:
    """Publishes a version, or raises Conflict if it is there already."""
    fs, p = _path(spark, f"{path}/{MARKERS}/{version:012d}.json")
    text = json.dumps({**told, "version": version}, sort_keys=True)
    try:
        out = fs.create(p, False)
    except Exception as e:  # the JVM's, named by its class
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"version {version} of {path} is there already") from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _repeated(spark: SparkSession, rows: DataFrame, keys: Sequence[str]) -> dict[str, int]:
    """How many values of each key column are there more than once."""
    return {f"repeated_{k}": n for k in keys if (n := rows.groupBy(k).agg(F.count("*").alias("n")).filter("n > 1").count())}


def publish(
    df: DataFrame,
    path: str,
    checks: Mapping[str, Column] | None = None,
    unique: Sequence[str] = (),
    by: Sequence[str] = (),
    metrics: Mapping[str, Column] | None = None,
    base: int | None = None,
    batches: Mapping[str, int] | None = None,
    files_each: int = 16,
) -> dict:
    """Writes df as the next version and returns what its marker says.

    Each check (true: fine, null: broken) is counted while the rows are written, and so
    are `metrics`; nothing is computed twice. Columns that must be unique are read back
    from the written files alone. If anything is broken, the folder goes and ValueError
    says how often. by: columns that name the folders; a value of any size is written by
    `files_each` tasks. base: the version df was made from, the latest by default.
    """
    spark = df.sparkSession
    if base is None:
        base = (versions(spark, path) or [-1])[-1]
    folder = f"v-{uuid.uuid4().hex}"
    seen = Observation()
    broken = {f"broken_{k}": F.count_if(~F.coalesce(ok, F.lit(False))) for k, ok in (checks or {}).items()}
    watched = df.observe(seen, *[c.alias(k) for k, c in {"rows": F.count(F.lit(1)), **(metrics or {}), **broken}.items()])
    if by:
        salt = F.pmod(F.xxhash64(*unique) if unique else F.monotonically_increasing_id(), F.lit(files_each))
        watched = watched.withColumn("_qm_salt", salt).repartition(*by, "_qm_salt").drop("_qm_salt")
    writer = watched.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{folder}")
    told = seen.get
    bad = {k.removeprefix("broken_"): n for k, n in told.items() if k.startswith("broken_") and n}
    bad |= _repeated(spark, spark.read.schema(df.schema).parquet(f"{path}/{folder}"), unique)
    if bad:
        _drop(spark, f"{path}/{folder}")
        raise ValueError(f"not published, rows break checks: {bad}")
    marker = {"folder": folder, "schema": df.schema.jsonValue(), "metrics": {k: v for k, v in told.items() if not k.startswith("broken_")}, "batches": dict(batches or {})}
    try:
        commit(spark, path, base + 1, marker)
    except Conflict:
        _drop(spark, f"{path}/{folder}")
        raise
    return {**marker, "version": base + 1}


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], writer: str = "", batch: int | None = None, attempts: int = 20, **options) -> int:
    """Makes the next version from the latest one by `change`; returns its number.

    If another writer is first, the change is made again from what that one has published.
    A batch that this writer has brought before (or a later one) changes nothing.
    """
    for _ in range(attempts):
        told = describe(spark, path)
        if told is None:
            raise FileNotFoundError(f"nothing is published at {path}")
        if batch is not None and told["batches"].get(writer, -1) >= batch:
            return told["version"]
        done = told["batches"] | ({writer: batch} if batch is not None else {})
        try:
            return publish(change(read(spark, path, told["version"])), path, base=told["version"], batches=done, **options)["version"]
        except Conflict:
            continue
    raise Conflict(f"{path}: no version of {attempts} attempts was the first")


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes data and markers of all but the last versions; returns how many went."""
    old = versions(spark, path)[:-keep]
    for v in old:
        _drop(spark, f"{path}/{describe(spark, path, v)['folder']}")
        _drop(spark, f"{path}/{MARKERS}/{v:012d}.json")
    return len(old)


def stream_into(stream: DataFrame, path: str, change: Callable[[DataFrame, DataFrame], DataFrame], writer: str, folder: str, **options):
    """Every micro-batch of a stream as one version: change(latest rows, batch). Runs until all that is there has been taken."""
    def one(batch: DataFrame, number: int) -> None:
        update(batch.sparkSession, path, lambda rows: change(rows, batch), writer, number, **options)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()

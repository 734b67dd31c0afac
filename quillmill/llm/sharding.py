"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets of about `bucket_bytes` by a seeded hash
of the record. Pass two takes one bucket at a time, brings it into hash order, so that
the order of arrival does not matter, applies a Fisher-Yates shuffle seeded with the
bucket's number and writes it. Buckets follow one another in one sequence of all
records, which is cut into `shards` runs whose row counts differ by one at most (law
`rows`), so a record's shard and slot follow from its bucket's start, and the starts
from counts of hashes alone: each text crosses the network once.

A record that is there so often that its copies would overfill a bucket (more than a
quarter of one; at most 2**20 such records) is reduced to one row and a count before
the scatter; its copies are made again in chunks and get a hash each.

Cases: a null text has no bytes. Null or repeated ids are no matter, since a record's
hash covers all its columns but maps; equal records are placed as records of their
own, of which it makes no difference which is which. Fewer records than shards leave
the last shards empty; an empty table gives an empty one. Columns named shard or slot
are replaced. The same records, seed and bucket size give the same slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillmill.llm.common import Stash, text_of, without

ADDED = ["shard", "slot"]
#: Records with more copies than a bucket should hold are told apart up to this number.
HOT_KEYS = 1 << 20
CHUNK = 4096


def record_size(text_col: str = "text"):
    """UTF-8 bytes of the text and eight for the rest."""
    return F.octet_length(text_of(text_col)).cast("long") + 8


def starts(counts: DataFrame, keys: int, width: int = 4096) -> DataFrame:
    """(bucket, n) -> (bucket, start), the rows in buckets before it; no window holds more than `width` rows."""
    block = F.floor(F.col("bucket") / width).cast("long")
    before = W.partitionBy("block").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("block", block).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if keys <= width:
        return inside.select("bucket", "start")
    above = starts(inside.groupBy("block").agg(F.sum("n").alias("n")).withColumnRenamed("block", "bucket"), -(-keys // width), width)
    above = above.select(F.col("bucket").alias("block"), F.col("start").alias("above"))
    return inside.join(above, "block").select("bucket", (F.col("start") + F.col("above")).alias("start"))


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 11, bucket_bytes: int = 32 << 20, text_col: str = "text") -> DataFrame:
    """docs with (shard int, slot long) added, in slot order within each bucket."""
    stash = Stash(docs.sparkSession, "sharding")
    rows = without(docs, ADDED)
    columns = [f"`{c}`" for c in rows.columns]
    keyed = rows.withColumn("_qm_key", F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t and "variant" not in t]))
    facts = stash.keep(keyed.select(F.col("_qm_key").alias("key"), record_size(text_col).alias("size")).groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "facts")
    all_rows, all_bytes = facts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-all_bytes // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_qm_key", "_qm_copy"), F.lit(buckets)).alias("bucket")

    often = facts.filter((F.col("n") > 1) & (F.col("bytes") > max(bucket_bytes // 4, all_bytes // HOT_KEYS))).select("key")
    scattered = keyed.withColumn("_qm_copy", F.lit(0).cast("long"))
    counts = facts.withColumnsRenamed({"key": "_qm_key"}).withColumn("_qm_copy", F.lit(0).cast("long"))
    if often.limit(1).count():
        often = F.broadcast(often.withColumnRenamed("key", "_qm_key"))
        single = stash.keep(keyed.join(often, "_qm_key", "left_semi").groupBy("_qm_key", *columns).agg(F.count("*").alias("_qm_n")), "often")
        chunks = single.withColumn("_qm_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_qm_n") - 1, F.lit(CHUNK).cast("long")))).repartition("_qm_key", "_qm_from")
        last = F.least(F.col("_qm_from") + (CHUNK - 1), F.col("_qm_n") - 1)
        copies = chunks.withColumn("_qm_copy", F.explode(F.sequence("_qm_from", last)))
        scattered = scattered.join(often, "_qm_key", "left_anti").unionByName(copies.drop("_qm_n", "_qm_from"))
        counts = counts.join(often, "_qm_key", "left_anti").select("_qm_key", "_qm_copy", "n").unionByName(copies.select("_qm_key", "_qm_copy", F.lit(1).cast("long").alias("n")))
    first = starts(counts.groupBy(bucket).agg(F.sum("n").alias("n")), buckets)

    small, longer = divmod(all_rows, shards)
    edge = longer * (small + 1)

    def shuffle(key: tuple, records: pa.Table, start: pa.Table) -> pa.Table:
        order = np.lexsort((records["_qm_copy"].to_numpy(), records["_qm_key"].to_numpy()))
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)  # Fisher-Yates
        place = start["start"][0].as_py() + np.arange(len(order))
        shard = np.where(place < edge, place // (small + 1), longer + (place - edge) // max(small, 1))
        slot = place - shard * small - np.minimum(shard, longer)
        out = records.take(pa.array(order)).drop_columns(["_qm_key", "_qm_copy", "bucket"])
        out = out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))
        return out.cast(to_arrow_schema(schema))  # nested fields differ in nullability

    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField("shard", IntegerType()), StructField("slot", LongType())])
    scattered = scattered.select(*columns, "_qm_key", "_qm_copy", bucket)
    return scattered.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(shuffle, schema)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Shuffled records as Parquet, one folder a shard, each file in slot order; reads them back."""
    shuffled = external_shuffle(docs, **options)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(shuffled.schema).parquet(path)


def placements(written: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of records as they were written."""
    return written.select(
        id_col, record_size(text_col).alias("size"), F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

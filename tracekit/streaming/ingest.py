"""Incremental ingest with Structured Streaming: each key once, or the latest delivery of a weight."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyindex import FULL, append_new_keys


def new_shards(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of Parquet shards as they appear in a folder, with the time of arrival."""
    shards = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return shards.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def ingest_manifest(shards: DataFrame, target: str, checkpoint: str, keys: list[str], lateness: str = "7 days", full: int = FULL) -> StreamingQuery:
    """Accepts each key once, however old its event: the watermark runs on arrival, so duplicates that arrive within it go by
    streaming state (which it bounds) and later ones by the target's key index (``<target>_keys``), of which a micro-batch reads the
    buckets of its own keys only."""
    once = shards.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(keys)
    run = once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return run.foreachBatch(lambda batch, number: append_new_keys(batch.drop("arrived"), target, f"{target}_keys", keys, number, full)).start()


def new_deliveries(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of Parquet files from ``<folder>/delivery=<id>/``, with the delivery and the file that a row comes from."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)
    path = F.col("_metadata.file_path")
    return files.select("*", F.regexp_extract(path, "/delivery=([^/]+)/[^/]*$", 1).alias("delivery"), F.regexp_extract(path, "([^/]+)$", 1).alias("file"))


def ingest_scores(files: DataFrame, target: str, checkpoint: str, key: str = "weight", order: str = "scored_at") -> StreamingQuery:
    """Stores every row under (weight, scored_at, delivery, micro-batch) in ``<target>/rows`` and logs the files it has seen in ``<target>/files``.

    A delivery may span many micro-batches, and a repeated micro-batch overwrites nothing but itself. Nothing that lies here
    is read before ``publish`` has found the delivery whole.
    """

    def keep(batch: DataFrame, number: int) -> None:
        stored = batch.withColumn("micro_batch", F.lit(number).cast("long"))
        put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{target}/{name}")
        put(stored.drop("file"), "rows", key, order, "delivery", "micro_batch")
        put(stored.groupBy("delivery", "file", "micro_batch").agg(F.count(F.lit(1)).alias("n")), "files", "micro_batch")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


def _whole(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(delivery, file) of the deliveries whose writer has set its mark."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{folder}/delivery=*/_SUCCESS")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for mark in fs.globStatus(place) or []:
        home = mark.getPath().getParent()
        names = [s.getPath().getName() for s in fs.listStatus(home) if s.isFile()]
        found += [(home.getName().split("=", 1)[1], n) for n in names if n[0] not in "._"]
    return found


def _with_rows(spark: SparkSession, folder: str, schema: T.StructType, files: list[tuple[str, str]]) -> DataFrame:
    """(delivery) of those files that have rows; only their footers are read."""
    if not files:
        return spark.createDataFrame([], "delivery string")
    plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f"delivery={delivery}/{file}") for delivery, file in files]  # names, not patterns
    held = spark.read.schema(schema).parquet(*[f"{folder}/{p}" for p in plain])
    return held.select(F.regexp_extract("_metadata.file_path", "/delivery=([^/]+)/[^/]*$", 1).alias("delivery")).distinct()


def publish(spark: SparkSession, folder: str, target: str, schema: T.StructType, key: str = "weight", order: str = "scored_at") -> DataFrame:
    """Adds to the commit log ``<target>/commits`` the deliveries that are whole: their writer's mark is set and every file with rows has been
    stored. Returns the log: (key, order, delivery, n_rows, digest), one row for each key and order of a delivery.

    Files without rows, which Spark writes for an empty first partition, never come up in a stream's rows, so a file that was not
    stored holds a delivery back only if it has rows.

    A delivery shows at once or not at all; one that broke off never does. Its digest adds up over its rows, so the same rows sent
    again under any name or split into other files have the same one.
    """
    names = spark.createDataFrame(_whole(spark, folder), "delivery string, file string")
    seen = spark.read.schema("delivery string, file string, n long, micro_batch long").parquet(f"{target}/files").select("delivery", "file").distinct()
    old = commits(spark, target, schema, key, order).select("delivery").distinct()
    fresh = names.join(old, "delivery", "left_anti")
    unseen = [(r.delivery, r.file) for r in fresh.join(seen, ["delivery", "file"], "left_anti").collect()]  # names from this driver's listing
    ready = fresh.select("delivery").distinct().join(_with_rows(spark, folder, schema, unseen), "delivery", "left_anti")
    values = [c for c in schema.names if c not in (key, order)]
    rows = _stored(spark, target, schema, key, order).join(F.broadcast(ready), "delivery")  # names of new deliveries
    sizes = rows.groupBy(key, order, "delivery").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*values).cast("decimal(20,0)")).cast("string").alias("digest"))
    sizes.write.mode("append").parquet(f"{target}/commits")
    return commits(spark, target, schema, key, order)


def _stored(spark: SparkSession, target: str, schema: T.StructType, key: str, order: str) -> DataFrame:
    extra = [T.StructField("delivery", T.StringType()), T.StructField("micro_batch", T.LongType())]
    return spark.read.schema(T.StructType([*schema.fields, *extra])).parquet(f"{target}/rows")


def commits(spark: SparkSession, target: str, schema: T.StructType, key: str = "weight", order: str = "scored_at") -> DataFrame:
    kinds = T.StructType([schema[key], schema[order], T.StructField("delivery", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("digest", T.StringType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/commits")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(f"{target}/commits").distinct()  # an entry that a broken run wrote twice counts once


def newest(log: DataFrame, key: str = "weight", order: str = "scored_at") -> DataFrame:
    """(key, order, delivery): the delivery that stands for each key, of its newest order; of several with that order the last name."""
    best = F.max(F.struct(order, "delivery")).alias("_b")
    return log.groupBy(key).agg(best).select(F.col(key).alias("_key"), F.col(f"_b.{order}").alias("_order"), F.col("_b.delivery").alias("_delivery"))


def latest_scores(spark: SparkSession, target: str, schema: T.StructType, key: str = "weight", order: str = "scored_at") -> DataFrame:
    """The rows of each weight's newest published delivery; all others are pruned as partitions."""
    held, last = _stored(spark, target, schema, key, order), newest(commits(spark, target, schema, key, order), key, order)
    same = held[key].eqNullSafe(last["_key"]) & held[order].eqNullSafe(last["_order"]) & (held["delivery"] == last["_delivery"])
    return held.join(last, same, "left_semi").select(*schema.names)


def compact(spark: SparkSession, target: str, schema: T.StructType, key: str = "weight", order: str = "scored_at") -> int:
    """Deletes the stored rows of published deliveries that newer ones have replaced; returns how many (key, order, delivery) went.

    The log stays, so a delivery that comes again is still known. Only partition names reach the driver.
    """
    log = commits(spark, target, schema, key, order)
    last = newest(log, key, order)
    same = log[key].eqNullSafe(last["_key"]) & log[order].eqNullSafe(last["_order"]) & (log["delivery"] == last["_delivery"])
    gone = {(str(r[0]), str(r[1]), r[2]) for r in log.join(last, same, "left_anti").select(key, order, "delivery").collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{target}/rows/{key}=*/{order}=*/delivery=*")
    fs, done = place.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for found in fs.globStatus(place) or []:
        at = found.getPath()
        names = [p.getName().split("=", 1)[1] for p in (at.getParent().getParent(), at.getParent(), at)]
        if tuple(names) in gone:
            fs.delete(at, True)
            done += 1
    return done


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; the same expression serves streams and tables."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("window"), by).agg(F.count(F.lit(1)).alias("n"))

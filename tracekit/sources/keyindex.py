"""A key index beside a growing target, and append of new keys that reads only what a delivery's keys can meet.

The index holds the keys of the target in buckets of their hash, ``bits`` leading bits of it, as partitions. A delivery reads the
buckets that its own keys fall into and no others. Buckets hold ``FULL`` keys on average at most: when there are more, the index
is written again with two more bits, whose cost is spread over the deliveries that made it grow, as in a hash table. So what a delivery
reads is bounded by its own keys times the size of a bucket, whatever the size of the target.

Deliveries are numbered. Both the target's rows and the index's keys lie in partitions of their delivery's number, which a repeated
delivery overwrites; what it finds under its own number it does not take for known. A delivery that broke off anywhere and comes again
ends as if it had come once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written

FULL = 100_000  # keys of a bucket on average
FIRST_BITS = 4
STEP = 2


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    place, fs = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def _bits(spark: SparkSession, index: str) -> int | None:
    """The finest index that was written to its end."""
    found = [int(n.split("=")[1]) for n in _names(spark, index) if n.startswith("bits=")]
    whole = [b for b in found if b == FIRST_BITS or "_SUCCESS" in _names(spark, f"{index}/bits={b}")]  # a rewrite sets the mark at its end
    return max(whole, default=None)


def _bucket(bits: int):
    return F.shiftrightunsigned("_h", 64 - bits).cast("int")


def firsts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key: of several the smallest, column by column; null keys are keys."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def known_keys(spark: SparkSession, index: str, schema: T.StructType, hit: Sequence[int] | None = None) -> DataFrame | None:
    """(keys, bucket, delivery) of the index, of some buckets only if they are named; None before the first delivery."""
    bits = _bits(spark, index)
    if bits is None:
        return None
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("delivery", T.LongType())])).parquet(f"{index}/bits={bits}")
    return held if hit is None else held.where(F.col("bucket").isin(list(hit)))


def append_new_keys(df: DataFrame, target: str, index: str, keys: Sequence[str], number: int, full: int = FULL) -> DataFrame:
    """Appends the rows whose keys neither the target nor an earlier row of the delivery holds, under the delivery's number; returns them.

    Keys that repeat within the delivery count once, by their smallest row.
    """
    spark, keys = df.sparkSession, list(keys)
    schema = df.select(*keys).schema
    rows = firsts(df, keys).withColumn("_h", F.xxhash64(*keys))
    bits = _bits(spark, index)
    if bits is not None:
        rows = written(rows)
        hit = [r[0] for r in rows.select(_bucket(bits)).distinct().collect()]  # numbers of buckets
        held = known_keys(spark, index, schema, hit).where(F.col("delivery") != number).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        rows = rows.join(held, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_anti")
    rows = written(rows)
    bits = FIRST_BITS if bits is None else bits
    rows.drop("_h").withColumn("delivery", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(target)
    named = rows.select(*keys, _bucket(bits).alias("bucket"), F.lit(number).cast("long").alias("delivery"))
    named.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "delivery").parquet(f"{index}/bits={bits}")
    size = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("delivery", F.lit(number).cast("long"))  # a row a delivery
    size.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("delivery").parquet(f"{index}/sizes")
    _grow(spark, index, schema, keys, bits, number, full)
    return rows.drop("_h")


def _grow(spark: SparkSession, index: str, schema: T.StructType, keys: list[str], bits: int, number: int, full: int) -> None:
    total = spark.read.schema("n long, delivery long").parquet(f"{index}/sizes").agg(F.sum("n")).first()[0] or 0
    finer = bits
    while total > full * 2**finer:
        finer += STEP
    if finer > bits:
        held = known_keys(spark, index, schema).withColumn("_h", F.xxhash64(*keys)).withColumn("bucket", _bucket(finer)).drop("_h")
        # deliveries before this one become one, -1, which no later one overwrites
        held.withColumn("delivery", F.when(F.col("delivery") == number, number).otherwise(-1).cast("long")).repartition("bucket").write.mode("overwrite").partitionBy("bucket", "delivery").parquet(f"{index}/bits={finer}")
        place, fs = _files(spark, f"{index}/bits={bits}")
        fs.delete(place, True)

"""Lookups, masks and comparisons that join two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the given order: a minimum over structs, combined before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if rest and all(o in rest for o in order if isinstance(o, str)) and not any(isinstance(o, Column) for o in order) and "map<" not in df.schema.simpleString():
        held = df.groupBy(*keys).agg(F.min(F.struct(*dict.fromkeys([*order, *rest]))).alias("_row"))  # a row travels once
        return held.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
    ranked = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    held = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row"))
    return held.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def anti(df: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(names.select(*keys).distinct(), keys, "left_anti")


def semi(df: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(names.select(*keys), keys, "left_semi")


def lookup(df: DataFrame, other: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Left lookup in a table that is first reduced to one row a key and written, so the planner knows its size."""
    return df.join(written(first_by(other, keys, order)), keys, "left")


def precedence(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join in which the left side's value of a shared column wins and the right fills its nulls."""
    right = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def not_yet(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to append."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def config_product(configs: DataFrame, splits: DataFrame, bins: DataFrame) -> DataFrame:
    """Every configuration by split by bin, with an extra bin "all"; all three are short configuration tables."""
    every = bins.select("dist_bin").distinct().union(bins.sparkSession.range(1).select(F.lit("all")))
    return configs.crossJoin(splits).crossJoin(every)


def compare_tables(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    a, b = (x.select(*keys, F.col(value).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, keys, "full").withColumn("change", F.col("after") - F.col("before"))


def fingerprint_status(expected: DataFrame, actual: DataFrame, key: str = "manifest", digest: str = "sha256") -> DataFrame:
    joined = expected.join(actual.withColumnRenamed(digest, "_found"), key, "left")
    status = F.when(F.col("_found").isNull(), "MISSING").when(F.col("_found") == F.col(digest), "MATCH").otherwise("MISMATCH")
    return joined.select(key, status.alias("status"))


def drop_duplicates(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_by(df, keys, order)


def processing_index(manifest: DataFrame, status: DataFrame, skips: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest with the written status and the first skip reason; what has neither was skipped."""
    reasons = first_by(skips, keys, ["skip_reason"])
    joined = manifest.join(status, keys, "left").join(reasons, keys, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("skipped"))).withColumn("skip_reason", F.when(F.col("status") == "skipped", F.coalesce("skip_reason", F.lit("unknown"))))


def shard_index(rows: DataFrame, shards: DataFrame, trace: str = "trace_name", shard: str = "chunk") -> DataFrame:
    """Trace to shard, the last one among shards that have a data file."""
    return rows.join(shards.select(shard).distinct(), shard, "left_semi").groupBy(trace).agg(F.max(shard).alias(shard))


def ranked(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def mask_lookup(df: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Adds verifiable and leaked from row masks, each key once; rows without a mask are neither."""
    once = mask.groupBy(*keys).agg(F.bool_and("verifiable").alias("verifiable"), F.bool_or("leaked").alias("leaked"))
    return df.join(once, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("verifiable", "leaked")})


def at_position(curves: DataFrame, results: DataFrame, keys: list[str], curve: str, pick: str, name: str = "at_pick") -> DataFrame:
    """The curve's value at the pick (null outside of it) beside each trace's results."""
    return curves.select(*keys, F.get(curve, F.col(pick).cast("int")).alias(name)).join(results, keys, "left")


def ragged_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(a: DataFrame, b: DataFrame, key: str = "event_key") -> DataFrame:
    """How many keys two sets share, as a one-row table."""
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("n"))

"""Leakage audits: which benchmark rows share an event with what a family of weights was trained on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spacetime import near_in_space_time
from ..sources.scratch import written


def derived_keys(frames: dict[str, DataFrame], derive: Callable[[DataFrame, str], DataFrame], columns: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """(columns, dataset, event_key) of all datasets whose keys can be derived, and why the others failed.

    A dataset that cannot be read or lacks its columns becomes an entry in the report and does not end the audit.
    """
    made, errors = None, {}
    for name, df in frames.items():
        try:
            found = derive(df, name).select(*columns, F.lit(name).alias("dataset"), F.explode_outer("event_keys").alias("event_key"))
        except (PySparkException, ValueError, KeyError) as e:
            errors[name] = f"error: {str(e).splitlines()[0][:120]}"
            continue
        made = found if made is None else made.unionByName(found)
    return made, errors


def audit_families(benchmark: DataFrame, trained: DataFrame, weights: DataFrame, errors: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, row masks) for every (manifest family, benchmark dataset).

    ``benchmark(dataset, trace_name, event_key)`` with a null key where a row has none, ``trained(manifest_family, part, dataset,
    event_key)`` with part train or val, ``weights(manifest_family, weight)``. A mask row is (manifest_family, dataset,
    trace_name, verifiable, leaked). All families and datasets go through the same few joins.
    """
    spark = benchmark.sparkSession
    families = weights.groupBy("manifest_family").agg(F.concat_ws(",", F.sort_array(F.collect_set("weight"))).alias("weights"))
    seen = trained.select("manifest_family", "part", "dataset", "event_key").distinct()
    train = seen.where("part = 'train'").select("manifest_family", "dataset", "event_key", F.lit(True).alias("_in"))
    # every benchmark row once a family: families are a handful of configurations
    rows = benchmark.crossJoin(F.broadcast(families.select("manifest_family")))
    hit = rows.join(train, ["manifest_family", "dataset", "event_key"], "left")
    masks = hit.groupBy("manifest_family", "dataset", "trace_name").agg(F.bool_or(F.col("event_key").isNotNull()).alias("verifiable"), F.bool_or(F.coalesce("_in", F.lit(False))).alias("leaked"))
    by_row = masks.groupBy("manifest_family", "dataset").agg(F.count(F.lit(1)).alias("n_benchmark_rows"), F.count_if(~F.col("verifiable")).alias("n_unverifiable"), F.count_if("leaked").alias("n_benchmark_rows_leaked"))
    events = hit.where("event_key IS NOT NULL").groupBy("manifest_family", "dataset", "event_key").agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("_in"))
    by_event = events.groupBy("manifest_family", "dataset").agg(F.count(F.lit(1)).alias("n_benchmark_events"), F.count_if("_in").alias("n_events_leaked_into_train"))
    parts = seen.groupBy("manifest_family", "dataset", "event_key").agg(F.bool_or(F.col("part") == "train").alias("t"), F.bool_or(F.col("part") == "val").alias("v"))
    by_part = parts.groupBy("manifest_family", "dataset").agg(F.count_if("t").alias("n_train_events"), F.count_if("v").alias("n_val_events"), F.count_if(F.col("t") & F.col("v")).alias("n_train_val_event_overlap"))
    on = ["manifest_family", "dataset"]
    counts = ["n_benchmark_events", "n_events_leaked_into_train", "n_train_events", "n_val_events", "n_train_val_event_overlap"]
    out = by_row.join(by_event, on, "left").join(by_part, on, "left").na.fill(0, counts).join(families, "manifest_family")
    out = out.withColumns({
        "method_used": F.lit("event keys"),
        "leaked_event_frac": F.col("n_events_leaked_into_train") / F.nullif(F.col("n_benchmark_events"), F.lit(0)),
        "unverifiable_row_frac": F.col("n_unverifiable") / F.col("n_benchmark_rows"),
    })
    for name, why in (errors or {}).items():
        failed = families.select("manifest_family", "weights", F.lit(name).alias("dataset"), F.lit(why).alias("method_used"))
        out = out.unionByName(failed, allowMissingColumns=True)
    return out, masks


def audit_parents(benchmark: DataFrame, corpora: dict[str, DataFrame | None], seconds: float = 2.0, km: float = 10.0, time: str = "ts", lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """(summary, row masks) of benchmark rows against the full corpora that public weights were trained on.

    ``benchmark(dataset, trace_name, time, lat, lon)``, ``corpora`` by name with the same three columns, or None where the corpus is
    not at hand: such a one gets a line of nulls and no mask. A row leaks if any corpus event lies within both tolerances; rows
    without time or place are not verifiable. A mask row is (corpus, dataset, trace_name, verifiable, leaked).
    """
    spark, masks = benchmark.sparkSession, None
    rows = benchmark.select("dataset", "trace_name", time, lat, lon).withColumn("_row", F.struct("dataset", "trace_name"))
    for name, corpus in corpora.items():  # a handful of configurations
        if corpus is not None:
            found = near_in_space_time(rows, corpus, "_row", seconds, km, time, lat, lon).groupBy("dataset", "trace_name").agg(F.bool_or("verifiable").alias("verifiable"), F.bool_or("leaked").alias("leaked"))
            found = found.select(F.lit(name).alias("corpus"), "dataset", "trace_name", "verifiable", "leaked")
            masks = found if masks is None else masks.unionByName(found)
    if masks is None:
        masks = spark.createDataFrame([], "corpus string, dataset string, trace_name string, verifiable boolean, leaked boolean")
    masks = written(masks)
    counts = masks.groupBy("corpus", "dataset").agg(F.count(F.lit(1)).alias("n_benchmark_rows"), F.count_if("verifiable").alias("n_verifiable"), F.count_if("leaked").alias("n_leaked"))
    summary = counts.withColumn("unverifiable_row_frac", 1 - F.col("n_verifiable") / F.col("n_benchmark_rows")).withColumn("leaked_row_frac", F.col("n_leaked") / F.nullif(F.col("n_verifiable"), F.lit(0)))
    absent = spark.createDataFrame([(name,) for name, corpus in corpora.items() if corpus is None], "corpus string")
    return summary.unionByName(absent, allowMissingColumns=True), masks


def write_masks(masks: DataFrame, target: str) -> DataFrame:
    """One folder a family, as ``filters.clean_holdout`` reads them."""
    masks.write.mode("overwrite").partitionBy("manifest_family").parquet(target)
    return masks.sparkSession.read.schema(masks.schema).parquet(target)

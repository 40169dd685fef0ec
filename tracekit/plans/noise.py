"""Noise from the time before the P arrival of labelled traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bins, clean
from ..functions import waveform as W
from ..operators import joins, sampling
from ..sources import catalogs
from ..sources.scratch import checkpointed
from .build import merge_noise

ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("trace_name", "source_dataset", "network", "station", "latitude", "longitude", "region", "tectonic_setting", "distance_bin")] + [T.StructField("wf", T.ArrayType(T.ArrayType(T.DoubleType())))])


def candidates(manifest: DataFrame, cap: int, lead: float, rate: float, skip: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Rows whose pick leaves room for the window at the target rate, at most ``cap`` a dataset, with the name of their noise trace."""
    room = manifest.where(~F.col("dataset_name").isin(list(skip)) & (F.col("p_arrival_sample") >= lead * rate))
    drawn = sampling.sample_in_groups(room, ["dataset_name"], cap, ["dataset_name", "trace_name", "chunk"], seed)
    return drawn.withColumn("name", F.concat(F.lit("pre_"), clean.compose_name(F.col("dataset_name"), F.col("trace_name"))))


def prephase_noise(manifest: DataFrame, waveforms: DataFrame, target: str, cap: int, rate: float = 100.0, lead: float = 35.0, gap: float = 5.0, least: int = 2900, skip: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Cuts the window from ``lead`` to ``gap`` seconds before P out of each candidate, appends what ``<target>`` does not hold yet, and
    returns the run's index (name, status, skip_reason).

    ``manifest``: as ``catalogs.MANIFEST``; ``waveforms(dataset_name, trace_name, chunk, wf, rate, network, station, lat, lon)``. Windows are cut at the
    trace's own rate, resampled to the target rate (FFT), padded with zeros or trimmed to the window's length; short and flat ones
    are skipped. Names decide what is held, so a run that broke off is resumed.
    """
    spark, keys = manifest.sparkSession, ["dataset_name", "trace_name", "chunk"]
    length = round((lead - gap) * rate)
    wanted = candidates(manifest, cap, lead, rate, skip, seed).dropDuplicates(["name"])
    if catalogs._exists(spark, target):
        wanted = joins.not_yet(wanted, spark.read.schema(ROWS).parquet(target).select(F.col("trace_name").alias("name")), ["name"])
    wanted = checkpointed(wanted)
    given = waveforms.select(*[F.coalesce(F.col(k), F.lit("")).alias(f"_{k}") for k in keys], "wf", F.coalesce(F.when(F.col("rate") > 0, F.col("rate")), F.lit(rate)).cast("double").alias("rate"), "network", "station", "lat", "lon")
    on = [F.coalesce(F.col(k), F.lit("")) == F.col(f"_{k}") for k in keys]
    held = wanted.join(given, on, "left").drop(*[f"_{k}" for k in keys])
    start, end = (F.floor(F.col("p_arrival_sample") - s * F.col("rate")).cast("int") for s in (lead, gap))
    held = held.withColumn("wf", W.three_channels(F.col("wf"))).withColumn("_inside", (start >= 0) & (end <= F.size(F.col("wf")[0])) & (end > start))
    cut = held.withColumn("wf", F.when(F.col("_inside"), F.transform("wf", lambda w: W.cut(w, start, end - start))))
    same = F.abs(F.col("rate") - rate) < 0.5
    cut = cut.where(same | F.col("wf").isNull()).unionByName(W.resampled(cut.where(~same & F.col("wf").isNotNull()), "wf", "rate", rate, "fft"))
    fitted = cut.withColumn("_n", F.size(F.col("wf")[0])).withColumn("wf", F.transform("wf", lambda w: F.slice(F.concat(w, W.zeros(length)), 1, length)))
    why = F.when(F.col("_inside").isNull(), "missing_waveform").when(F.col("wf").isNull(), "outside_trace").when(F.col("_n") < least, "too_short").when(~W.noise_gate(F.col("wf"), 1), "flat")
    checked = checkpointed(fitted.withColumn("_why", why))
    rows = checked.where("_why IS NULL").select(
        F.col("name").alias("trace_name"), F.col("dataset_name").alias("source_dataset"), F.coalesce("network", F.lit("")).alias("network"), F.coalesce("station", F.lit("")).alias("station"),
        clean.fixed_coordinate(F.col("lat")).alias("latitude"), clean.fixed_coordinate(F.col("lon")).alias("longitude"),
        bins.coarse_region(F.col("lat"), F.col("lon")).alias("region"), bins.tectonic_class(F.col("lat"), F.col("lon"), "unknown").alias("tectonic_setting"), F.coalesce("distance_bin", F.lit("")).alias("distance_bin"), "wf",
    )
    rows.write.mode("append").parquet(target)
    return checked.select("name", F.when(F.col("_why").isNull(), "ok").otherwise("skipped").alias("status"), F.col("_why").alias("skip_reason"))


def add_to_manifests(spark: SparkSession, noise: str, target: str, train: float = 0.9, dataset: str = "noise_prephase", seed: int = 42) -> None:
    """Deals the noise traces under ``noise`` to the train and val parts of a written manifest; those it holds stay where they are."""
    names = spark.read.schema(ROWS).parquet(noise).select("trace_name")
    quiet = names.select("trace_name", F.lit(0.0).alias("max_p"), F.lit(0.0).alias("max_s"))  # taken before any arrival
    merge_noise(names, quiet, target, 1.0, 1.0, train, dataset, seed)

"""The training corpus from ragged catalogs to manifests and reports, and noise that joins them later."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators import filters, joins, keys, profile, sampling
from ..sources import catalogs as sources
from ..sources.scratch import checkpointed, written
from .corpus import build_corpus, prepare_catalog

# Where catalogs keep what a manifest needs, by priority.
FIELDS = {
    "rid": ["rid", "trace_name"],
    "trace_name": ["trace_name"],
    "chunk": ["trace_chunk", "chunk"],
    "km": ["path_ep_distance_km", "source_distance_km", "path_hyp_distance_km", "km"],
    "vendor": ["split", "trace_split"],
}


@dataclass(frozen=True)
class CatalogPlan:
    """How one catalog enters the corpus."""

    name: str
    cap: int
    use_s: bool = True
    p_only: bool = True


def event_keys_of(df: DataFrame, dataset: str) -> DataFrame:
    """Adds event_keys by the best method that the catalog's columns allow."""
    method, c = keys.key_method(df.columns), F.col
    event = next((c(n) for n in ("source_id", "event_id", "source_event_id") if n in df.columns), None)
    cols = {
        "multi": lambda: {"events": c("source_id_list")},
        "scalar": lambda: {"event": event},
        "synthetic": lambda: {"time": c("source_origin_time").cast("timestamp"), "lat": clean.number("source_latitude_deg"), "lon": clean.number("source_longitude_deg")},
        "none": dict,
    }
    return keys.derive_event_keys(df, method, F.lit(dataset), **cols[method]())


def harmonised(raw: DataFrame, plan: CatalogPlan) -> DataFrame:
    """A ragged catalog of strings as rid, dataset, trace_name, chunk, p, s, p_col, s_col, km, vendor and event_keys."""
    (p, p_col), (s, s_col) = clean.coalesce_picks(raw, clean.P_PRIORITY), clean.coalesce_picks(raw, clean.S_PRIORITY if plan.use_s else [])
    keyed = event_keys_of(raw.withColumn("_p", p).withColumn("_s", s), plan.name)
    fields = clean.harmonise(keyed, {**FIELDS, "p": ["_p"], "s": ["_s"], "event_keys": ["event_keys"]}, {"km": "double", "p": "double", "s": "double", "event_keys": "array<string>"})
    named = fields.withColumn("dataset", F.lit(plan.name)).withColumn("p_col", F.lit(p_col).cast("string")).withColumn("s_col", F.lit(s_col).cast("string"))
    return named.withColumn("chunk", clean.repair_chunk(F.col("chunk")))


def build_manifests(raw: dict[str, DataFrame], plans: list[CatalogPlan], benchmark: DataFrame, bad_names: DataFrame, fractions: dict[str, float], val: float, test: float, target: str, benchmark_events: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Writes manifest, composition_summary and removal_report under ``target`` and returns the manifest as it reads.

    Each catalog is harmonised, loses benchmark traces, flagged labels and rows that share an event with the benchmark, and is
    capped; the pool is then split by connected events and the training part balanced. ``benchmark`` and ``bad_names`` hold
    (dataset, trace_name); the benchmark's events are those of its traces unless they are given. Both are written first, so the
    planner knows their size and rows need not be shuffled for them. Only rows with a pick outside the benchmark are kept.
    """
    spark = benchmark.sparkSession
    benchmark, bad_names = (written(names.select("dataset", "trace_name").distinct()) for names in (benchmark, bad_names))
    whole = joins.ragged_union([harmonised(raw[p.name], p) for p in plans])
    if benchmark_events is None:
        benchmark_events = joins.semi(whole, benchmark, ["dataset", "trace_name"]).select(F.explode("event_keys").alias("event_key"))
    excluded = written(benchmark_events.distinct())
    valid = written(joins.anti(whole.where(filters.valid_pick(F.col("p"))), benchmark, ["dataset", "trace_name"]), "zstd")
    pools = [prepare_catalog(valid.where(F.col("dataset") == p.name), p.cap, benchmark, bad_names, None, excluded, p.use_s, p.p_only, seed) for p in plans]
    pool = written(joins.ragged_union(pools))
    out = written(build_corpus(pool, None, fractions, val, test, seed))
    manifest = out.select(F.col("dataset").alias("dataset_name"), "trace_name", "chunk", F.col("p").alias("p_arrival_sample"), F.col("s").alias("s_arrival_sample"), F.col("km").alias("distance_km"), "distance_bin", "p_col", "s_col", "split")
    sources.write_manifest(manifest, f"{target}/manifest")
    profile.composition(manifest, "split", "dataset_name", "distance_bin", "s_arrival_sample").write.mode("overwrite").parquet(f"{target}/composition_summary")
    _, removed = filters.drop_flagged(valid, bad_names, ["dataset", "trace_name"], "dataset")
    removed = removed.withColumn("pct_removed", F.bround(100 * F.col("n_removed") / F.col("n_before"), 2))
    removed.write.mode("overwrite").parquet(f"{target}/removal_report")
    return read_manifest(spark, target)


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(T.StructType([*sources.MANIFEST.fields, T.StructField("split", T.StringType())])).parquet(f"{target}/manifest")


def variant(base: DataFrame, key: list[str], keep: Column | None = None, stratum: Column | None = None, factor: float = 1.0, seed: int = 42) -> DataFrame:
    """A manifest derived from another: rows that ``keep`` holds for, with a stratum oversampled by a factor above 1."""
    out = base if keep is None else base.where(keep)
    return out if stratum is None else sampling.oversample(out, stratum, factor, key, seed)


def write_variants(variants: dict[str, DataFrame], target: str) -> DataFrame:
    """Writes every manifest to ``<target>/<name>`` and the fingerprints (manifest, n_rows, sha256) of what was written to ``<target>/checksums``."""
    spark = next(iter(variants.values())).sparkSession
    for name, df in variants.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    checksums(spark, target, list(variants)).write.mode("overwrite").parquet(f"{target}/checksums")
    return spark.read.parquet(f"{target}/checksums")


def checksums(spark: SparkSession, target: str, names: list[str]) -> DataFrame:
    """(manifest, n_rows, sha256) of the manifests that are there, all in one pass."""
    present = [n for n in names if sources._exists(spark, f"{target}/{n}")]
    if not present:
        return spark.createDataFrame([], "manifest string, n_rows long, sha256 string")
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{target}/{n}").select(F.lit(n).alias("manifest"), "dataset_name", "trace_name", "chunk") for n in present])
    return profile.fingerprint(rows, "manifest", ["dataset_name", "trace_name", "chunk"])


def check_variants(spark: SparkSession, target: str) -> DataFrame:
    """(manifest, status, n_rows, expected_rows): whether each manifest still is what was written: ok, changed, empty or missing."""
    want = spark.read.parquet(f"{target}/checksums").select("manifest", F.col("n_rows").alias("expected_rows"), F.col("sha256").alias("_want"))
    names = [r[0] for r in want.select("manifest").collect()]  # a handful
    there = spark.createDataFrame([(n, sources._exists(spark, f"{target}/{n}")) for n in names], "manifest string, _there boolean")
    now = checksums(spark, target, names)
    status = F.when(~F.col("_there"), "missing").when(F.col("sha256").isNull(), "empty").when(F.col("sha256") == F.col("_want"), "ok").otherwise("changed")
    return want.join(there, "manifest").join(now, "manifest", "left").select("manifest", status.alias("status"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "expected_rows")


def merge_noise(noise: DataFrame, audit: DataFrame, target: str, p_limit: float = 0.1, s_limit: float = 0.1, train: float = 0.9, dataset: str = "noise_global", seed: int = 42) -> None:
    """Appends clean noise traces to the train and val parts of a written manifest.

    ``noise(trace_name)``, ``audit(trace_name, max_p, max_s)``. The split is a draw by name, so a run that was broken off, or
    one with more traces, adds what neither part holds yet.
    """
    fine = audit.where(filters.clean_noise(F.col("max_p"), F.col("max_s"), p_limit, s_limit))
    dealt = sampling.ratio_split(joins.semi(noise.select("trace_name").distinct(), fine, ["trace_name"]), train, ["trace_name"], seed)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in sources.MANIFEST if f.name != "trace_name"} | {"dataset_name": F.lit(dataset), "distance_bin": F.lit("noise")}
    rows = dealt.withColumns(blank)
    held = read_manifest(noise.sparkSession, target).where(F.col("dataset_name") == dataset).select("trace_name")
    fresh = checkpointed(joins.not_yet(rows, held, ["trace_name"]))  # read before the append
    fresh.select(*sources.MANIFEST.names, "split").write.mode("append").partitionBy("split").parquet(f"{target}/manifest")

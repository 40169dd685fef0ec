"""End-to-end jobs: training corpus, benchmark, noise corpus, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins, clean
from ..operators import filters, joins, keys, metrics, sampling, splits
from ..sources.scratch import written


def prepare_catalog(df: DataFrame, cap: int, benchmark: DataFrame, bad_names: DataFrame, row_keys: DataFrame | None, excluded_events: DataFrame, use_s: bool = True, p_only: bool = True, seed: int = 0) -> DataFrame:
    """Picks, S filter, exclusions, distance bins and the proportional cap, in the order that the reports count on.

    ``df``: rid, dataset, trace_name, chunk, p, s, km, vendor. Without ``row_keys`` it lists its keys in ``event_keys``, and only rows that are still
    there are compared with the events.
    """
    df = filters.require_s(df.where(filters.valid_pick(F.col("p"))), "s", use_s)
    df = joins.anti(df, benchmark, ["dataset", "trace_name"])
    df = joins.anti(df, bad_names, ["dataset", "trace_name"])
    df = keys.drop_overlapping(df, keys.exploded(df, "rid") if row_keys is None else row_keys, excluded_events)
    df = df.withColumn("distance_bin", bins.distance_bin(F.col("km")))
    if p_only:
        df = df.withColumn("s", clean.p_only_policy(F.col("s"), F.col("distance_bin")))
    return sampling.proportional_cap(df, cap, "distance_bin", ["rid"], seed, "dataset")


def build_corpus(df: DataFrame, row_keys: DataFrame | None, fractions: dict[str, float], val: float, test: float, seed: int = 0) -> DataFrame:
    """Event-grouped split of the pool, with the training part rebalanced to the target fractions.

    Without ``row_keys`` the rows list their keys in ``event_keys`` (see ``splits.event_grouped_split``).
    """
    named = df.withColumn("vendor", clean.normalise_split(F.col("vendor")))
    held = written(splits.event_grouped_split(named, row_keys, val, test, seed=seed), "zstd")
    train = sampling.rebalance(held.where("split = 'train'"), fractions, "distance_bin", ["rid"], seed)
    return train.unionByName(held.where("split <> 'train'").select(*train.columns))


def build_benchmark(df: DataFrame, dataset_cap: int, bin_cap: int, seed: int = 0) -> DataFrame:
    """Three-axis physics bins, capped by dataset and bin, then by bin."""
    axes = [bins.assign_bins(F.col("km"), bins.DIST_EDGES, bins.DIST_LABELS), bins.assign_bins(F.col("depth"), bins.DEPTH_EDGES, bins.DEPTH_LABELS), bins.assign_bins(F.col("mag"), bins.MAG_EDGES, bins.MAG_LABELS)]
    return sampling.two_level_cap(df.withColumn("physics_bin", bins.physics_bin(*axes)), "physics_bin", "dataset", dataset_cap, bin_cap, ["rid"], seed)


def noise_corpus(df: DataFrame, audit: DataFrame, cap: int, p_limit: float, s_limit: float, key: str = "id", seed: int = 0) -> DataFrame:
    """Clean noise traces by latitude bands with region names, dealt 90 to 10."""
    fine = audit.where(filters.clean_noise(F.col("max_p"), F.col("max_s"), p_limit, s_limit))
    kept = sampling.latitude_bands(joins.semi(df, fine, [key]), "lat", cap, [key], seed)
    named = kept.withColumn("region", bins.coarse_region(F.col("lat"), F.col("lon"))).withColumn("tectonic", bins.tectonic_class(F.col("lat"), F.col("lon"), "stable"))
    return sampling.ratio_split(named, 0.9, [key], seed)


def leaderboard(results: DataFrame, in_domain, ci_key: list[str] | None = None) -> DataFrame:
    """Metrics of every weight by bin (and all bins) and split (all, in, cross), with degenerate scorers marked, best first.

    ``ci_key``, the unique key of a result, adds bootstrap intervals of errors and recalls.
    """
    which = F.when(in_domain, F.array(F.lit("all"), F.lit("in"))).otherwise(F.array(F.lit("all"), F.lit("cross")))
    sliced = splits.expand_slices(results, splits=which).drop("dist_bin").withColumnRenamed("slice_bin", "dist_bin")
    table = metrics.pick_metrics(sliced, ["weight", "split", "dist_bin"], ci_key=ci_key)
    marked = table.join(metrics.degenerate_scorers(results), "weight", "left")
    return marked.orderBy("degenerate", "p_mae_s", "weight", "split", "dist_bin")


def clean_leaderboard(results: DataFrame, in_domain, own, own_mask: DataFrame, own_keys: list[str], parent_mask: DataFrame, parent_keys: list[str], corpus, ci_key: list[str] | None = None) -> DataFrame:
    """Metrics by weight, bin (and all bins) and split, with the splits that leakage audits allow.

    Beside all, in_domain and cross_domain, own weights get clean_holdout, the rows that their family's mask (``own_mask`` with verifiable
    and leaked by ``own_keys``) shows to be free of training events, and public weights cross_domain_clean, their cross-domain
    rows that share no event with their ``corpus`` (``parent_mask`` by corpus and ``parent_keys``); a corpus without any verifiable row
    gives no such split. ``in_domain``, ``own`` and ``corpus`` are columns of ``results``.
    """
    marked = filters.clean_holdout(results.withColumns({"_in": in_domain, "_own": own}), own_mask, own_keys, F.col("_own"))
    marked = filters.parent_clean(marked, parent_mask, parent_keys, corpus, ~F.col("_in"))
    which = [F.lit("all"), F.when(F.col("_in"), "in_domain").otherwise("cross_domain"), F.when(F.col("_own") & F.col("clean"), "clean_holdout"), F.when(~F.col("_own") & F.col("parent_clean"), "cross_domain_clean")]
    sliced = splits.expand_slices(marked, splits=F.array_compact(F.array(*which))).drop("dist_bin").withColumnRenamed("slice_bin", "dist_bin")
    table = metrics.pick_metrics(sliced, ["weight", "split", "dist_bin"], ci_key=ci_key)
    return table.join(metrics.degenerate_scorers(results), "weight", "left").orderBy("degenerate", "p_mae_s", "weight", "split", "dist_bin")

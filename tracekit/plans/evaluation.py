"""Evaluation of scorers on a benchmark: curves, picks, results by weight, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import waveform as W
from ..operators import metrics
from ..sources import catalogs
from ..sources.scratch import written


def curves(index: DataFrame, waveforms: DataFrame, scorers: dict[str, W.Scorer], keys: Sequence[str], length: int, batch: int = 128) -> DataFrame:
    """(index columns, weight, p_curve, s_curve, score_status): every usable trace of the index by every scorer.

    Traces with status ok and a waveform count; channels are demeaned and divided by their deviation, without a clip. A trace or
    a scorer that fails keeps its rows, with the error as status.
    """
    keys = list(keys)
    held = index.where("status = 'ok'").join(waveforms.select(*keys, "wf"), keys)
    held = held.withColumn("wf", F.transform("wf", lambda w: W.normalise(w, "std", 1e-10, None)))
    return W.scored(held, "wf", scorers, length, batch).withColumnRenamed("scorer", "weight").drop("wf")


def picked(scores: DataFrame, span: int, rate: float = 100.0) -> DataFrame:
    """p_prob, s_prob and residuals of each row's curves within ``span`` samples of its true picks."""
    out = scores
    for phase in "ps":
        found = W.oracle_pick(F.col(f"{phase}_curve"), F.col(f"{phase}_in_window"), span, rate)
        out = out.withColumn(f"{phase}_prob", found["prob"].cast("double")).withColumn(f"{phase}_residual_s", found["residual_s"])
    return out.drop("p_curve", "s_curve")


def evaluate(index: DataFrame, waveforms: DataFrame, scorers: dict[str, W.Scorer], target: str, keys: Sequence[str], length: int, span: int, rate: float = 100.0, again: Sequence[str] = ()) -> DataFrame:
    """Scores what is missing and stores it by weight; returns the report (weight, n_traces, n_failed, error), one row a scorer of this run.

    Weights that the target holds are not scored again unless named in ``again``, whose partitions are then replaced. A scorer that
    fails on every trace leaves a line in the report, no results, and is tried again in the next run; one that fails on some is
    stored without those.
    """
    spark = index.sparkSession
    done = set() if not catalogs._exists(spark, target) else {r[0] for r in catalogs.read_results(spark, target).select("weight").distinct().collect()}  # names of weights
    todo = {k: v for k, v in scorers.items() if k in again or k not in done}
    if not todo:
        return spark.createDataFrame([], "weight string, n_traces long, n_failed long, error string")
    found = written(picked(curves(index, waveforms, todo, keys, length), span, rate))
    fine = found.where("score_status = 'ok'").drop("score_status")
    if fine.limit(1).count():
        catalogs.write_results(fine, target)
    failed = F.col("score_status") != "ok"
    return found.groupBy("weight").agg(F.count(F.lit(1)).alias("n_traces"), F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("score_status"))).alias("error"))


def ensembles(scores: DataFrame, sets: dict[str, dict[str, float]], keys: Sequence[str]) -> DataFrame:
    """Scores of every member set by the weighted mean of its members' curves, as ``weight``; only traces that all members have scored.

    ``scores``: rows of ``curves``. The sets are configuration; a trace's curves meet in one row of a few members.
    """
    spark, keys = scores.sparkSession, list(keys)
    table = spark.createDataFrame([(name, m, float(w), len(members)) for name, members in sets.items() for m, w in members.items()], "_set string, _member string, _w double, _size int")
    fine = scores.where("score_status = 'ok'").join(F.broadcast(table), F.col("weight") == F.col("_member"))
    rest = [c for c in scores.columns if c not in (*keys, "weight", "p_curve", "s_curve", "score_status")]
    held = fine.groupBy(*keys, "_set", "_size").agg(F.array_sort(F.collect_list(F.struct("weight", "_w", "p_curve", "s_curve"))).alias("_m"), F.first(F.struct(*rest)).alias("_rest"))
    held = held.where(F.size("_m") == F.col("_size"))
    total = F.aggregate("_m", F.lit(0.0), lambda a, m: a + m["_w"])

    def blended(curve: str) -> Column:
        first = F.transform(F.col("_m")[0][curve], lambda x: F.lit(0.0))
        summed = F.aggregate("_m", first, lambda a, m: F.zip_with(a, m[curve], lambda x, y: x + m["_w"] * y.cast("double")))
        return F.transform(summed, lambda x: x / total)

    return held.select(*keys, "_rest.*", F.col("_set").alias("weight"), *[blended(f"{x}_curve").alias(f"{x}_curve") for x in "ps"])


def ensemble_metrics(scores: DataFrame, sets: dict[str, dict[str, float]], keys: Sequence[str], span: int, by: Sequence[str] = ("weight", "dist_bin"), rate: float = 100.0) -> DataFrame:
    """Pick metrics of every member set."""
    return metrics.pick_metrics(picked(ensembles(scores, sets, keys), span, rate), by)

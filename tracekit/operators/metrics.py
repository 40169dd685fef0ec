"""Pick metrics: one grouped aggregate for every (weight, split, bin) slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bootstrap import OfSums, intervals, mean
from .quantiles import exact_quantiles, same_group, with_quantiles

# Thresholds in seconds and probability.
OUTLIER_S, OUTLIER_STRICT_S = 1.5, 1.0
RECALL_THRESHOLDS = (0.1, 0.2, 0.3, 0.5, 0.7)
P_PROB, S_PROB = 0.3, 0.3


def _share(condition: Column, among: Column) -> Column:
    return F.avg(F.when(among, condition.cast("int")))


def phase_metrics(phase: str, threshold: float, recall_thresholds: Sequence[float] = RECALL_THRESHOLDS) -> list[Column]:
    """Aggregates of one phase. ``in_window >= 0`` marks a true pick; residuals of undetected picks count in the unconditional ones."""
    prob, residual = F.col(f"{phase}_prob"), F.col(f"{phase}_residual_s")
    true = F.col(f"{phase}_in_window") >= 0
    seen = true & (prob >= threshold)
    out = [F.count_if(true).alias(f"n_{phase}_traces"), F.count_if(seen).alias(f"n_{phase}_detected"), _share(prob >= threshold, true).alias(f"{phase}_recall")]
    out += [_share(prob >= x, true).alias(f"{phase}_recall_t{round(x * 10):02d}") for x in recall_thresholds]
    for suffix, rows in (("", true), ("_cond", seen)):
        r = F.abs(F.when(rows, residual))
        out += [
            F.avg(r).alias(f"{phase}_mae_s{suffix}"),
            F.sqrt(F.avg(r * r)).alias(f"{phase}_rmse_s{suffix}"),
            F.avg((r > OUTLIER_S).cast("int")).alias(f"{phase}_outlier{suffix}"),
            F.avg((r > OUTLIER_STRICT_S).cast("int")).alias(f"{phase}_outlier_1s{suffix}"),
        ]
    return out


def phase_mcc(least: int = 5) -> Column:
    """P-against-S correlation of rows with both phases, from three counts; null below ``least`` rows, 0 where undefined."""
    both = (F.col("p_in_window") >= 0) & (F.col("s_in_window") >= 0)
    n = F.count_if(both)
    a, b = F.count_if(both & (F.col("p_prob") > F.col("s_prob"))), F.count_if(both & (F.col("s_prob") > F.col("p_prob")))
    under = ((a + b) * (2 * n - a - b)).cast("double")
    return F.when(n >= least, F.when(under == 0, 0.0).otherwise((a - b) / F.sqrt(F.when(under > 0, under))))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    under = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(under == 0, 0.0).otherwise((tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(F.when(under > 0, under)))


def pick_metrics(df: DataFrame, by: Sequence[str], p_threshold: float = P_PROB, s_threshold: float = S_PROB, ci_key: Sequence[str] | None = None) -> DataFrame:
    """One row a slice; an empty slice gives no row. ``ci_key``, the unique key of a row, adds bootstrap intervals of
    errors, recalls and the MCC, all in one pass."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_traces"), *phase_metrics("p", p_threshold), *phase_metrics("s", s_threshold), phase_mcc().alias("mcc")).withColumn("outlier_thr_s", F.lit(OUTLIER_S))
    out = _median_probabilities(out, df, by)
    if ci_key is None:
        return out
    asked = {"mcc": mcc_of_sums()}
    for phase, threshold in (("p", p_threshold), ("s", s_threshold)):
        true = F.col(f"{phase}_in_window") >= 0
        asked[f"{phase}_mae_s"] = mean(F.when(true, F.abs(f"{phase}_residual_s")))
        asked[f"{phase}_recall"] = mean(F.when(true, (F.col(f"{phase}_prob") >= threshold).cast("double")))
    ci = intervals(df, by, asked, ci_key)
    ci = ci.select(*[F.col(b).alias(f"_g_{b}") for b in by], *[f"{n}_{e}" for n in asked for e in ("ci_lo", "ci_hi")])
    return (out.join(ci, same_group(out, ci, by), "left") if by else out.crossJoin(F.broadcast(ci))).drop(*[f"_g_{b}" for b in by])  # one row each


def _median_probabilities(out: DataFrame, df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds p_med_prob and s_med_prob; both phases share one run of the quantiles."""
    probs = F.array(*[F.struct(F.lit(x).alias("phase"), F.when(F.col(f"{x}_in_window") >= 0, F.col(f"{x}_prob")).alias("prob")) for x in "ps"])
    medians = exact_quantiles(df.select(*by, F.inline(probs)), [*by, "phase"], "prob", [0.5])
    pick = lambda x: F.max(F.when(F.col("phase") == x, F.col("quantiles")[0])).alias(f"{x}_med_prob")
    medians = medians.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(pick("p"), pick("s"))
    return out.join(medians, same_group(out, medians, by), "left").drop(*[f"_g_{b}" for b in by])


def degenerate_scorers(df: DataFrame, recall: float = 0.99, mae: float = 2.0, threshold: float = P_PROB) -> DataFrame:
    """(weight, degenerate): nearly everything is picked, and badly; over all rows, not only those with a true pick."""
    stats = df.groupBy("weight").agg(F.avg((F.col("p_prob") >= threshold).cast("int")).alias("_r"), F.avg(F.abs("p_residual_s")).alias("_m"))
    return stats.select("weight", F.coalesce((F.col("_r") > recall) & (F.col("_m") > mae), F.lit(False)).alias("degenerate"))


def threshold_sweep(df: DataFrame, by: Sequence[str], thresholds: Sequence[float], phase: str = "p", medians: bool = False) -> DataFrame:
    """Recall, detected-only error and outliers by threshold; ``medians`` adds the exact detected-only median error.

    One histogram over the thresholds that a probability reaches, then sums over the cells above each threshold: a
    row is counted once however many thresholds there are.
    """
    marks = sorted(float(x) for x in thresholds)
    prob, r = F.col(f"{phase}_prob"), F.abs(F.col(f"{phase}_residual_s"))
    reached = F.size(F.filter(F.array(*map(F.lit, marks)), lambda x: x <= prob))
    true = F.col(f"{phase}_in_window") >= 0
    cells = df.groupBy(*by, F.when(true & prob.isNotNull(), reached).alias("_at")).agg(F.count(F.lit(1)).alias("n"), F.count(r).alias("k"), F.sum(r).alias("r"), F.count_if(r > OUTLIER_S).alias("o"))
    held = cells.groupBy(*by).agg(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "n", "k", "r", "o"))).alias("_c"))  # at most one a threshold
    add = lambda c, name, zero: F.aggregate(c, zero, lambda a, x: a + F.coalesce(x[name], zero))
    none, nought = F.lit(0).cast("long"), F.lit(0.0)

    def at(x, i):
        over = F.filter("_c", lambda c: c["_at"] > i)
        n, k = add(over, "n", none), add(over, "k", none)
        some = F.nullif(k, none)
        return F.struct(x.alias("threshold"), n.alias("n_detected"), (n / F.nullif(add(F.col("_c"), "n", none), none)).alias("recall"), (add(over, "r", nought) / some).alias("mae_cond"), (add(over, "o", none) / some).alias("outlier_cond"))

    out = held.select(*by, F.inline(F.transform(F.array(*map(F.lit, marks)), at)))
    return with_medians(out, df.select(*by, F.when(true, reached).alias("_at"), r.alias("_v")), by, marks) if medians else out


def with_medians(out: DataFrame, rows: DataFrame, by: Sequence[str], marks: Sequence[float], cells: int = 256) -> DataFrame:
    """Adds median_cond to a sweep: for each threshold the median _v of rows whose _at, the thresholds they reach, lies above its number.

    The thresholds' subsets are nested, so one histogram by (_at, cell of the value), its cells bounded by sample quantiles, serves all:
    summed over the _at above a threshold it names the cells that hold the median. Only values of those cells are counted,
    again by _at, and given to the thresholds that ask for their cell.
    """
    by = list(by)
    rows = rows.select(*by, "_at", F.nanvl(F.col("_v").cast("double"), F.lit(None)).alias("_v")).where("_v IS NOT NULL AND _at > 0")
    edges = rows.groupBy(*by).agg(F.approx_percentile("_v", F.array(*[F.lit((k + 1) / cells) for k in range(cells - 1)]), F.lit(10 * cells)).alias("_e")).select(*[F.col(b).alias(f"_g_{b}") for b in by], "_e")
    dealt = rows.join(edges, same_group(rows, edges, by)) if by else rows.crossJoin(F.broadcast(edges))  # one row
    # edges below the value, by halving; equal values share a cell
    halve = lambda acc, _: F.when(acc["l"] >= acc["h"], acc).otherwise(F.when(F.get("_e", F.shiftright(acc["l"] + acc["h"], 1)) < F.col("_v"), F.struct((F.shiftright(acc["l"] + acc["h"], 1) + 1).alias("l"), acc["h"].alias("h"))).otherwise(F.struct(acc["l"].alias("l"), F.shiftright(acc["l"] + acc["h"], 1).alias("h"))))
    cell = F.aggregate(F.sequence(F.lit(0), F.lit(cells.bit_length())), F.struct(F.lit(0).alias("l"), F.lit(cells - 1).alias("h")), halve)["l"]
    dealt = dealt.select(*by, "_at", "_v", cell.alias("_cell"))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.col("_at") - 1), lambda i: i)).alias("_i")  # of counts, not of rows
    counts = dealt.groupBy(*by, "_at", "_cell").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_cell", "_n", above).groupBy(*by, "_i", "_cell").agg(F.sum("_n").alias("_n"))
    whole = Window.partitionBy(*by, "_i")  # a row a cell
    counts = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_cell")) - F.col("_n")).withColumn("_place", 0.5 * (F.sum("_n").over(whole) - 1))
    asked = counts.where((F.col("_before") <= F.ceil("_place")) & (F.floor("_place") < F.col("_before") + F.col("_n")))
    asked = asked.groupBy(*[F.col(b).alias(f"_g_{b}") for b in [*by, "_cell"]]).agg(F.collect_list(F.struct("_i", "_before", "_place")).alias("_need"))  # a row a threshold
    held = dealt.join(asked, same_group(dealt, asked, [*by, "_cell"])).groupBy(*by, "_cell", "_at", "_v", "_need").agg(F.count(F.lit(1)).alias("_n"))
    given = held.select(*by, "_cell", "_v", "_n", F.inline(F.filter("_need", lambda s: s["_i"] < F.col("_at")))).groupBy(*by, "_cell", "_i", "_before", "_place", "_v").agg(F.sum("_n").alias("_n"))
    given = given.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_cell", "_i").orderBy("_v")))
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = given.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by], "_i", "_place").agg(reach(F.floor("_place")).alias("_x"), reach(F.ceil("_place")).alias("_y"))
    names = F.array(*map(F.lit, marks))
    found = found.select(*[f"_g_{b}" for b in by], F.get(names, F.col("_i")).alias("_g_threshold"), ((F.col("_x") + F.col("_y")) / 2).alias("median_cond"))
    return out.join(found, same_group(out, found, [*by, "threshold"]), "left").drop(*[f"_g_{b}" for b in [*by, "threshold"]])




def recall_curve(df: DataFrame, by: Sequence[str], step: float = 0.04, phase: str = "p") -> DataFrame:
    """Recall from 0 to 1 in equal steps."""
    n = round(1 / step)
    return threshold_sweep(df, by, [round(i * step, 6) for i in range(n + 1)], phase).select(*by, "threshold", "recall", "n_detected")


def bootstrap_ci(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], n_boot: int = 1000, level: float = 0.95, seed: int = 42, least: int = 5) -> DataFrame:
    """(by, n, ci_lo, ci_hi): Poisson bootstrap of the mean over values that are not null; null below ``least`` of them."""
    ci = intervals(df.where(F.col(value).isNotNull()), by, {"v": mean(F.col(value))}, key, n_boot, level, seed, least)
    return ci.select(*by, F.col("v_n").alias("n"), F.col("v_ci_lo").alias("ci_lo"), F.col("v_ci_hi").alias("ci_hi"))


def mcc_of_sums() -> OfSums:
    """The P-against-S correlation as a function of three weighted counts."""
    both = (F.col("p_in_window") >= 0) & (F.col("s_in_window") >= 0)
    count = lambda condition: F.when(condition, F.lit(1.0))

    def value(s: list[Column]) -> Column:
        n, a, b = s
        under = (a + b) * (2 * n - a - b)
        return F.when(n > 0, F.when(under == 0, 0.0).otherwise((a - b) / F.sqrt(F.when(under > 0, under))))

    return OfSums((count(both), count(both & (F.col("p_prob") > F.col("s_prob"))), count(both & (F.col("s_prob") > F.col("p_prob")))), value, both)


def box_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return with_quantiles(out, df, by, value, {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)}).withColumn("iqr", F.col("p75") - F.col("p25"))


def domain_ratio(df: DataFrame, in_domain: Column, value: Column, by: str = "weight") -> DataFrame:
    stats = df.groupBy(by).agg(F.avg(F.when(in_domain, value)).alias("in_value"), F.avg(F.when(~in_domain, value)).alias("cross_value"))
    return stats.withColumn("degradation", F.col("cross_value") / F.nullif(F.col("in_value"), F.lit(0.0)))


def class_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def ranking(df: DataFrame, metric: Column | str, by: str = "weight", n: str = "n") -> DataFrame:
    """Mean of a metric by weight, smallest first."""
    return df.groupBy(by).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias(n)).orderBy("mean", by)


def smallest(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k rows with the smallest values (ties by key): a distributed top-k."""
    return df.where(F.col(value).isNotNull()).orderBy(value, key).limit(k)


def best_per_metric(table: DataFrame, weight: str, higher: Sequence[str] = (), lower: Sequence[str] = ()) -> DataFrame:
    """(metric, best, value): the weight with the largest or smallest value of each metric, ties by name."""
    cases = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), (sign * F.col(m)).cast("double").alias("cost")) for sign, names in ((-1, higher), (1, lower)) for m in names]
    long = table.select(F.col(weight).alias("_weight"), F.inline(F.array(*cases))).where("value IS NOT NULL")
    found = long.groupBy("metric").agg(F.min_by(F.struct("_weight", "value"), F.struct("cost", "_weight")).alias("_b"))
    return found.select("metric", F.col("_b._weight").alias("best"), F.col("_b.value").alias("value"))

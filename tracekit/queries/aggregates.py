"""A1-A48."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bootstrap, metrics, profile
from .base import query

C = F.col
BINS = ["local", "regional", "teleseismic", "unknown"]


@query("""WITH c AS (SELECT vendor, dataset, distance_bin, count(*) AS n, count(s) AS n_with_s FROM {fx_binned} GROUP BY ALL)
SELECT a.vendor, b.dataset, d.distance_bin, coalesce(n, 0) AS n, coalesce(n_with_s, 0) AS n_with_s FROM (SELECT DISTINCT vendor FROM c) a CROSS JOIN (SELECT DISTINCT dataset FROM c) b CROSS JOIN (SELECT DISTINCT distance_bin FROM c) d LEFT JOIN c USING (vendor, dataset, distance_bin)""")
def a1_composition(t):
    return profile.composition(t.fx_binned, "vendor", "dataset", "distance_bin", "s")


@query("SELECT coalesce(dataset, 'TOTAL') AS dataset, " + ", ".join(f"count(*) FILTER (distance_bin = '{b}') AS {b}" for b in BINS) + ", count(*) AS n, avg(CASE WHEN s IS NULL THEN 0 ELSE 1 END) AS s_coverage FROM {fx_binned} GROUP BY ROLLUP (dataset)")
def a2_pivot_with_total(t):
    return profile.pivot_with_total(t.fx_binned, "dataset", "distance_bin", BINS, "s")


@query("SELECT source, n_before, n_removed, round_even(100 * n_removed / n_before, 3) AS pct_removed FROM (SELECT source, count(*) AS n_before, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS n_removed FROM documents GROUP BY source)")
def a3_removal_report(t):
    flagged = t.labels.where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return profile.removal_report(t.documents.select("doc_id", "source").join(flagged, "doc_id", "left"), "source", C("bad").isNotNull())


@query("SELECT dataset, count(*) AS n, count(km) AS n_p, count(s) AS n_s, count(*) FILTER (km IS NOT NULL AND s IS NOT NULL) AS n_both, count(*) FILTER (km IS NOT NULL AND s IS NULL) AS n_p_only, count(*) FILTER (km IS NULL AND s IS NOT NULL) AS n_s_only, 100 * count(*) FILTER (km IS NOT NULL AND s IS NOT NULL) / count(*) AS pct_both FROM {fx_catalog} GROUP BY dataset")
def a4_pick_availability(t):
    return profile.pick_availability(t.fx_catalog, "dataset", "km", "s")


_HIST = "SELECT g.dataset, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset FROM {fx_catalog}) g CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN (SELECT dataset, CASE WHEN km = 4000 THEN 19 ELSE floor(km / 200) END AS bin, count(*) AS n FROM {fx_catalog} GROUP BY ALL) h ON g.dataset = h.dataset AND b.bin = h.bin"


@query(_HIST)
def a5_histogram(t):
    return profile.histogram(t.fx_catalog, ["dataset"], C("km"), 0.0, 200.0, 20)


@query("""WITH r AS (SELECT dataset, (s - p) / 100 AS sp FROM {fx_catalog}), h AS (SELECT dataset, floor(sp / 0.5) AS bin, count(*) AS n FROM r WHERE sp >= 0 AND sp < 10 GROUP BY ALL),
g AS (SELECT d.dataset, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset FROM r) d CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN h ON d.dataset = h.dataset AND b.bin = h.bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY dataset) AS total, sum(n) OVER (PARTITION BY dataset ORDER BY bin) AS cum FROM g)
SELECT c.dataset, bin, n, n / total AS share, median_bin, within FROM c JOIN (SELECT dataset, min(bin) AS median_bin FROM c WHERE cum >= total / 2 GROUP BY dataset) USING (dataset) JOIN (SELECT dataset, avg(CASE WHEN sp <= 5 THEN 1 WHEN sp > 5 THEN 0 END) AS within FROM r GROUP BY dataset) USING (dataset)""")
def a6_sp_histogram(t):
    return profile.sp_histogram(t.fx_catalog, "dataset", (C("s") - C("p")) / 100, 0.5, 20, 5.0)


@query("""SELECT dataset, count(*) AS n, count(DISTINCT source_id) AS n_events, min(km) AS dist_min, max(km) AS dist_max, quantile_cont(mag, 0.5) AS mag_median, stddev_samp(mag) AS mag_std, mode(line ORDER BY line) AS dominant_rate,
 list_sort(list(DISTINCT line)) AS rates, avg(CASE WHEN p IS NULL THEN 0 ELSE 1 END) AS p_frac, avg(CASE WHEN s IS NULL THEN 0 ELSE 1 END) AS s_frac, min(depth) AS lat_min, max(depth) AS lat_max, min(price) AS lon_min, max(price) AS lon_max,
 quantile_cont(km, 0.1) AS dist_p10, quantile_cont(km, 0.5) AS dist_p50, quantile_cont(km, 0.9) AS dist_p90 FROM {fx_catalog} GROUP BY dataset""".replace("mode(line ORDER BY line)", "(SELECT arg_min(line, (-n, line)) FROM (SELECT line, count(*) AS n FROM {fx_catalog} i WHERE i.dataset = o.dataset GROUP BY line))").replace("FROM {fx_catalog} GROUP BY dataset", "FROM {fx_catalog} o GROUP BY dataset"))
def a7_dataset_profile(t):
    return profile.dataset_profile(t.fx_catalog, "dataset", "source_id", "km", "mag", "line", "p", "s", "depth", "price")


@query("SELECT dataset, category, count(*) AS n FROM {fx_catalog} GROUP BY ALL")
def a7b_mix_long(t):
    return profile.mix(t.fx_catalog, "dataset", "category").select("dataset", F.explode("mix").alias("category", "n"))


@query("SELECT category, count(km) AS count, avg(km) AS mean, stddev_samp(km) AS std, min(km) AS min, max(km) AS max, quantile_cont(km, 0.25) AS q25, quantile_cont(km, 0.5) AS q50, quantile_cont(km, 0.75) AS q75 FROM {fx_catalog} GROUP BY category")
def a8_describe(t):
    return profile.describe(t.fx_catalog, ["category"], "km")


@query("SELECT dataset, category, count(*) AS n, avg(km) AS km, max(mag) AS mag, count(DISTINCT station) AS stations FROM {fx_catalog} GROUP BY ALL ORDER BY n DESC")
def a9_multi_aggregate(t):
    return profile.summary(t.fx_catalog, ["dataset", "category"], distinct={"stations": "station"}, km=F.avg("km"), mag=F.max("mag"))


@query("SELECT CAST(year(shipped) AS INTEGER) AS year, quantile_cont(km, 0.5) AS median FROM {fx_catalog} GROUP BY 1")
def a10_median_by_year(t):
    return profile.median_by(t.fx_catalog.select(F.year("shipped").alias("year"), "km"), ["year"], "km")


@query("SELECT dataset, " + ", ".join(f"count(*) FILTER (distance_bin = '{b}') AS {b}" for b in BINS) + ", count(*) AS total FROM {fx_binned} GROUP BY dataset")
def a11_pivot_counts(t):
    return profile.pivot_counts(t.fx_binned, "dataset", "distance_bin", BINS)


@query("SELECT CAST(floor(km / 200) AS BIGINT) AS bin, (floor(km / 200) + 0.5) * 200 AS centre, avg(mag) AS mean, stddev_samp(mag) AS std, count(mag) AS n FROM {fx_catalog} WHERE km IS NOT NULL AND mag IS NOT NULL GROUP BY ALL")
def a12_binned_stats(t):
    return profile.binned_stats(t.fx_catalog, C("km"), "mag", 200.0)


@query("SELECT dataset, regr_slope(s, km) AS slope, regr_intercept(s, km) AS intercept, regr_r2(s, km) AS r2, regr_count(s, km) AS n, sqrt((regr_syy(s, km) - regr_sxy(s, km) * regr_sxy(s, km) / regr_sxx(s, km)) / (regr_count(s, km) - 2) / regr_sxx(s, km)) AS slope_err FROM {fx_catalog} GROUP BY dataset")
def a13_regression(t):
    return profile.regression(t.fx_catalog, "s", "km", ["dataset"])


@query("SELECT dataset, corr(km, s) AS r FROM {fx_catalog} GROUP BY dataset")
def a14_correlation(t):
    df = t.fx_catalog.where("km IS NOT NULL AND s IS NOT NULL")
    return df.groupBy("dataset").agg(F.corr("km", "s").alias("r"))


@query("""WITH m AS (SELECT mag * 0.7 + CAST(source_id % 13 AS DOUBLE) / 10 AS m FROM {fx_catalog}), h AS (SELECT CASE WHEN m = 5.9 THEN 68 ELSE floor((m + 1) / 0.1) END AS bin, count(*) AS n FROM m GROUP BY 1),
g AS (SELECT round(-1 + (b.bin + 0.5) * 0.1, 6) AS centre, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 69)) AS bin) b LEFT JOIN h ON b.bin = h.bin),
l AS (SELECT regr_slope(log10(n), centre) AS a, regr_intercept(log10(n), centre) AS c FROM g WHERE centre BETWEEN 1.5 AND 4.0 AND n > 0)
SELECT -a AS b, coalesce((SELECT max(centre) FROM g WHERE centre < 2.0 AND n / (pow(10.0, a * centre + c) + 1e-10) < 0.9), 1.5) AS mc FROM l""")
def a15_gutenberg_richter(t):
    m = C("mag") * 0.7 + (C("source_id") % 13).cast("double") / 10
    return profile.gutenberg_richter(t.fx_catalog.withColumn("m", m), C("m"))


def _phase_sql(x: str) -> str:
    true, seen = f"{x}_in_window >= 0", f"{x}_in_window >= 0 AND {x}_prob >= 0.3"
    share = lambda t: f"avg(CASE WHEN {x}_prob >= {t} THEN 1 ELSE 0 END) FILTER ({true})"
    out = [f"count(*) FILTER ({true}) AS n_{x}_traces", f"count(*) FILTER ({seen}) AS n_{x}_detected", f"{share(0.3)} AS {x}_recall", f"quantile_cont({x}_prob, 0.5) FILTER ({true}) AS {x}_med_prob"]
    out += [f"{share(t)} AS {x}_recall_t{round(t * 10):02d}" for t in metrics.RECALL_THRESHOLDS]
    for suffix, rows in (("", true), ("_cond", seen)):
        r = f"abs({x}_residual_s)"
        big = lambda k: f"avg(CASE WHEN {r} > {k} THEN 1 WHEN {r} <= {k} THEN 0 END) FILTER ({rows})"  # noqa: B023, E731
        out += [f"avg({r}) FILTER ({rows}) AS {x}_mae_s{suffix}", f"sqrt(avg({r} * {r}) FILTER ({rows})) AS {x}_rmse_s{suffix}", f"{big(1.5)} AS {x}_outlier{suffix}", f"{big(1.0)} AS {x}_outlier_1s{suffix}"]
    return ", ".join(out)


def metrics_sql(source: str, by: str) -> str:
    both = "p_in_window >= 0 AND s_in_window >= 0"
    n, a, b = (f"count(*) FILTER ({both}{x})" for x in ("", " AND p_prob > s_prob", " AND s_prob > p_prob"))
    mcc = f"CASE WHEN {n} >= 5 THEN CASE WHEN ({a} + {b}) * (2 * {n} - {a} - {b}) = 0 THEN 0.0 ELSE ({a} - {b}) / sqrt(({a} + {b}) * (2 * {n} - {a} - {b})) END END"
    return f"SELECT {by}, count(*) AS n_traces, {_phase_sql('p')}, {_phase_sql('s')}, {mcc} AS mcc, CAST(1.5 AS DOUBLE) AS outlier_thr_s FROM {source} GROUP BY {by}"


@query(metrics_sql("{fx_results}", "weight, dist_bin"))
def a16_pick_metrics(t):
    return metrics.pick_metrics(t.fx_results, ["weight", "dist_bin"])


def _columns(names: str):
    return lambda t: metrics.pick_metrics(t.fx_results, ["weight"]).select("weight", *names.split())


def _part(suffix: str, names: str):
    make = _columns(names)
    make.__name__ = suffix
    query(f"SELECT weight, {', '.join(names.split())} FROM ({metrics_sql('{fx_results}', 'weight')})")(make)


_part("a16a_counts", "n_traces n_p_traces n_s_traces n_p_detected n_s_detected")
_part("a16b_recall", "p_recall s_recall " + " ".join(f"{x}_recall_t{k}" for x in "ps" for k in ("01", "02", "03", "05", "07")))
_part("a16c_median_probability", "p_med_prob s_med_prob")
_part("a16d_errors", "p_mae_s p_rmse_s s_mae_s s_rmse_s")
_part("a16e_outliers", "p_outlier s_outlier p_outlier_1s s_outlier_1s")
_part("a16f_conditional", "p_mae_s_cond p_rmse_s_cond s_mae_s_cond s_rmse_s_cond p_outlier_cond s_outlier_cond p_outlier_1s_cond s_outlier_1s_cond")
_part("a17_phase_mcc", "mcc")


@query("""WITH c AS (SELECT weight, sum(CASE WHEN p_prob >= 0.5 AND s_prob >= 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p_prob < 0.5 AND s_prob >= 0.5 THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN p_prob >= 0.5 AND s_prob < 0.5 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p_prob < 0.5 AND s_prob < 0.5 THEN 1 ELSE 0 END) AS tn FROM {fx_results} GROUP BY weight)
SELECT weight, (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c""")
def a18_at_position_mcc(t):
    p, s = C("p_prob") >= 0.5, C("s_prob") >= 0.5
    return t.fx_results.groupBy("weight").agg(metrics.mcc(F.count_if(p & s), F.count_if(~p & s), F.count_if(p & ~s), F.count_if(~p & ~s)).alias("mcc"))


_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
_MIX = [("z", "xor(z, z >> 16) * 2246822507 % 4294967296"), ("z", "xor(z, z >> 13) * 3266489909 % 4294967296"), ("z", "xor(z, z >> 16)")]


def _mixed_sql(source: str, first: str) -> str:
    """A chain of subqueries that finalises z, which is made from the source's columns."""
    out = f"SELECT weight, v, i, b, {first} AS z FROM {source}"
    for name, step in _MIX:
        out = f"SELECT weight, v, i, b, {step} AS {name} FROM ({out})"
    return out


@query(f"""WITH d AS (SELECT weight, abs(p_residual_s) AS v, md5(concat_ws('|', '42', trace_id)) AS h FROM {{fx_results}} WHERE p_residual_s IS NOT NULL),
r AS (SELECT weight, v, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS b FROM d), k AS (SELECT CAST(i AS UBIGINT) * 2654435769 % 4294967296 AS t, i FROM range(1, 1001) x(i)),
one AS ({_mixed_sql('(SELECT r.*, k.* FROM r CROSS JOIN k)', '(a + t) % 4294967296')}), two AS ({_mixed_sql('one', 'xor(z, b)')}),
w AS (SELECT weight, v, i, {" + ".join(f"CAST((z + 0.5::DOUBLE) / 4294967296 > {x!r}::DOUBLE AS INTEGER)" for x in _POISSON)} AS w FROM two),
m AS (SELECT weight, i, sum(v * w) / sum(w) AS mean, count(*) AS n FROM w GROUP BY weight, i)
SELECT weight, max(n) AS n, quantile_cont(mean, 0.025) AS ci_lo, quantile_cont(mean, 0.975) AS ci_hi FROM m GROUP BY weight""")
def a19_bootstrap_ci(t):
    return metrics.bootstrap_ci(t.fx_results.withColumn("r", F.abs("p_residual_s")), ["weight"], "r", ["trace_id"])


#: (key, i, w): the Poisson weights of a table's keys, as a common table expression.
DRAWS_SQL = f"""words AS (SELECT DISTINCT {{key}}, CAST('0x' || substr(md5(concat_ws('|', '42', {{key}})), 1, 8) AS UBIGINT) AS a, CAST('0x' || substr(md5(concat_ws('|', '42', {{key}})), 9, 8) AS UBIGINT) AS b FROM {{source}}),
turns AS (SELECT CAST(i AS UBIGINT) * 2654435769 % 4294967296 AS t, i FROM range(1, 1001) x(i)), z0 AS (SELECT {{key}}, i, b, (a + t) % 4294967296 AS z FROM words CROSS JOIN turns),
{", ".join(f"z{k + 1} AS (SELECT {{key}}, i, b, {step} AS z FROM z{k})" for k, step in enumerate([s for _, s in _MIX] + ["xor(z, b)"] + [s for _, s in _MIX]))},
draws AS (SELECT {{key}}, i, {" + ".join(f"CAST((z + 0.5::DOUBLE) / 4294967296 > {x!r}::DOUBLE AS INTEGER)" for x in _POISSON)} AS w FROM z7)"""
_BOTH = "(p_in_window >= 0 AND s_in_window >= 0)"


@query(f"""WITH d AS (SELECT weight, abs(p_residual_s) AS v, CAST({_BOTH} AS INTEGER) AS n, CAST({_BOTH} AND p_prob > s_prob AS INTEGER) AS x, CAST({_BOTH} AND s_prob > p_prob AS INTEGER) AS y, md5(concat_ws('|', '42', trace_id)) AS h FROM {{fx_results}}),
r AS (SELECT weight, struct_pack(v := v, n := n, x := x, y := y) AS v, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS b FROM d), k AS (SELECT CAST(i AS UBIGINT) * 2654435769 % 4294967296 AS t, i FROM range(1, 1001) x(i)),
one AS ({_mixed_sql('(SELECT r.*, k.* FROM r CROSS JOIN k)', '(a + t) % 4294967296')}), two AS ({_mixed_sql('one', 'xor(z, b)')}),
w AS (SELECT weight, v.v AS v, v.n AS n, v.x AS x, v.y AS y, i, {" + ".join(f"CAST((z + 0.5::DOUBLE) / 4294967296 > {x!r}::DOUBLE AS INTEGER)" for x in _POISSON)} AS w FROM two),
s AS (SELECT weight, i, sum(w * n) AS n, sum(w * x) AS x, sum(w * y) AS y FROM w GROUP BY weight, i), mcc AS (SELECT weight, CASE WHEN n > 0 THEN CASE WHEN (x + y) * (2 * n - x - y) = 0 THEN 0.0 ELSE (x - y) / sqrt((x + y) * (2 * n - x - y)) END END AS m FROM s),
g AS (SELECT weight, i, v, sum(w) AS w FROM w WHERE v IS NOT NULL AND w > 0 GROUP BY weight, i, v), u AS (SELECT *, sum(w) OVER (PARTITION BY weight, i ORDER BY v) AS upto, (sum(w) OVER (PARTITION BY weight, i) - 1) / 2 AS place FROM g),
q AS (SELECT weight, i, (min(v) FILTER (upto > floor(place)) + min(v) FILTER (upto > ceil(place))) / 2 AS m FROM u GROUP BY weight, i)
SELECT weight, mcc_ci_lo, mcc_ci_hi, median_ci_lo, median_ci_hi, mcc_n, median_n FROM (SELECT weight, quantile_cont(m, 0.025) AS mcc_ci_lo, quantile_cont(m, 0.975) AS mcc_ci_hi FROM mcc GROUP BY weight)
 JOIN (SELECT weight, quantile_cont(m, 0.025) AS median_ci_lo, quantile_cont(m, 0.975) AS median_ci_hi FROM q GROUP BY weight) USING (weight) JOIN (SELECT weight, sum(n) AS mcc_n, count(v) AS median_n FROM d GROUP BY weight) USING (weight)""")
def a19_bootstrap_statistics(t):
    """Intervals of the P-against-S correlation, a function of counts, and of the median error."""
    return bootstrap.intervals(t.fx_results, ["weight"], {"mcc": metrics.mcc_of_sums(), "median": bootstrap.Quantile(F.abs("p_residual_s"))}, ["trace_id"])


@query("SELECT weight, coalesce(avg(CASE WHEN p_prob >= 0.3 THEN 1 ELSE 0 END) > 0.5 AND avg(abs(p_residual_s)) > 2, false) AS degenerate FROM {fx_results} GROUP BY weight")
def a20_degenerate_scorers(t):
    return metrics.degenerate_scorers(t.fx_results, recall=0.5)


def _sweep_sql(values: str, columns: str) -> str:
    true = "p_in_window >= 0"
    return f"""SELECT weight, dist_bin, threshold, {columns} FROM (SELECT weight, dist_bin, CAST(t AS DOUBLE) AS threshold, count(*) FILTER ({true} AND p_prob >= t) AS n_detected, avg(CASE WHEN p_prob >= t THEN 1 ELSE 0 END) FILTER ({true}) AS recall,
 avg(abs(p_residual_s)) FILTER ({true} AND p_prob >= t) AS mae_cond, median(abs(p_residual_s)) FILTER ({true} AND p_prob >= t) AS median_cond, avg(CASE WHEN abs(p_residual_s) > 1.5 THEN 1 ELSE 0 END) FILTER ({true} AND p_prob >= t) AS outlier_cond FROM {{fx_results}} CROSS JOIN ({values}) x(t) GROUP BY ALL)"""


_SWEEP = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]


@query(_sweep_sql("VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _SWEEP), "n_detected, recall, mae_cond, outlier_cond, median_cond"))
def a21_threshold_sweep(t):
    return metrics.threshold_sweep(t.fx_results, ["weight", "dist_bin"], _SWEEP, medians=True)


@query(_sweep_sql("SELECT round(i * 0.04, 6)::DOUBLE FROM range(0, 26) r(i)", "recall, n_detected"))
def a22_recall_curve(t):
    return metrics.recall_curve(t.fx_results, ["weight", "dist_bin"])


@query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (p_prob > {x} OR s_prob > {x}) AS over_{k}" for k, x in (("01", 0.1), ("03", 0.3), ("05", 0.5), ("07", 0.7))) + " FROM {fx_results}")
def a26_noise_screen(t):
    return profile.over_thresholds(t.fx_results, [C("p_prob"), C("s_prob")], {"over_01": 0.1, "over_03": 0.3, "over_05": 0.5, "over_07": 0.7})


@query("SELECT dataset, count(*) AS n, count(*) FILTER (p_prob > 0.3) AS flagged, avg(CASE WHEN p_prob > 0.3 THEN 1 ELSE 0 END) AS rate FROM {fx_results} GROUP BY dataset")
def a27_contamination_rate(t):
    return profile.contamination(t.fx_results, "dataset", C("p_prob") > 0.3)


@query("SELECT segment, count(*) AS before, count(*) FILTER (NOT coalesce(p_prob > 0.3, false)) AS after FROM {fx_geo} LEFT JOIN {fx_results} ON id = trace_id GROUP BY segment")
def a28_before_after(t):
    joined = t.fx_geo.join(t.fx_results.select(C("trace_id").alias("id"), "p_prob"), "id", "left")
    return profile.before_after(joined, "segment", C("p_prob") > 0.3)


@query("SELECT a.dataset, b.distance_bin, coverage FROM (SELECT DISTINCT dataset FROM {fx_binned}) a CROSS JOIN (SELECT DISTINCT distance_bin FROM {fx_binned}) b LEFT JOIN (SELECT dataset, distance_bin, avg(CASE WHEN s IS NULL THEN 0 ELSE 1 END) AS coverage FROM {fx_binned} GROUP BY ALL) USING (dataset, distance_bin)")
def a29_coverage(t):
    return profile.coverage(t.fx_binned, ["dataset", "distance_bin"], "s")


@query("SELECT dataset, category, n, n / sum(n) OVER (PARTITION BY dataset) AS share FROM (SELECT dataset, category, count(*) AS n FROM {fx_catalog} GROUP BY ALL)")
def a30_share_within(t):
    return profile.share_within(t.fx_catalog, "dataset", "category")


@query("""WITH h AS (SELECT weight, CASE WHEN r = 2 THEN 39 ELSE floor((r + 2) / 0.1) END AS bin, count(*) AS n FROM (SELECT weight, greatest(-2.0, least(2.0, p_residual_s)) AS r FROM {fx_results} WHERE p_residual_s IS NOT NULL) GROUP BY ALL),
g AS (SELECT w.weight, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT weight FROM {fx_results}) w CROSS JOIN (SELECT unnest(range(0, 40)) AS bin) b LEFT JOIN h ON w.weight = h.weight AND b.bin = h.bin) SELECT weight, bin, n, n / sum(n) OVER (PARTITION BY weight) / 0.1 AS density FROM g""")
def a31_clipped_density(t):
    return profile.clipped_density(t.fx_results, "weight", C("p_residual_s"), 2.0, 40)


@query("SELECT weight, " + ", ".join(f"quantile_cont(p_residual_s, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", quantile_cont(p_residual_s, 0.75) - quantile_cont(p_residual_s, 0.25) AS iqr, avg(p_residual_s) AS mean, count(p_residual_s) AS n FROM {fx_results} GROUP BY weight")
def a32_box_summary(t):
    return metrics.box_summary(t.fx_results, ["weight"], "p_residual_s")


@query("SELECT *, cross_value / in_value AS degradation FROM (SELECT weight, avg(abs(p_residual_s)) FILTER (contains(trained_models, 'ds1')) AS in_value, avg(abs(p_residual_s)) FILTER (NOT contains(trained_models, 'ds1')) AS cross_value FROM {fx_results} GROUP BY weight)")
def a33_ratios(t):
    return metrics.domain_ratio(t.fx_results, C("trained_models").contains("ds1"), F.abs("p_residual_s"))


@query("""WITH w AS (SELECT dataset, round_even(p * 100.0 / 40.0, 0) AS pos, round_even((km + 1000) * 100.0 / 40.0, 0) AS n FROM {fx_catalog} WHERE km IS NOT NULL), f AS (SELECT dataset, greatest(0, 2000 - pos) AS l, greatest(0, pos - 2000 + 6000 - n) AS r FROM w)
SELECT dataset, CASE WHEN l = 0 AND r = 0 THEN 'clean' WHEN l > 0 AND r > 0 THEN 'pad_both' WHEN l > 0 THEN 'pad_left' ELSE 'pad_right' END AS status, count(*) AS n, CAST(max(l) AS BIGINT) AS max_left, avg(r) AS mean_right FROM f GROUP BY ALL""")
def a34_window_feasibility(t):
    out = profile.window_feasibility(t.fx_catalog.where("km IS NOT NULL"), C("p"), C("km") + 1000, F.lit(40.0))
    return out.groupBy("dataset", "status").agg(F.count("*").alias("n"), F.max("pad_left").alias("max_left"), F.avg("pad_right").alias("mean_right"))


@query("""WITH r AS (SELECT source, sha256(concat_ws('|', source, doc_id, coalesce(lang, ''))) AS d FROM documents),
b AS (SELECT source, d[1:5] AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM r GROUP BY ALL),
c AS (SELECT source, b[1:2] AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM b GROUP BY source, b[1:2])
SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, chr(10) ORDER BY b)) AS sha256 FROM c GROUP BY source""")
def a35_fingerprint(t):
    return profile.fingerprint(t.documents, "source", ["source", "doc_id", "lang"])


_LINE = "concat_ws('|', " + ", ".join(f"coalesce(length(CAST({c} AS STRING)) || ':' || CAST({c} AS STRING), '-')" for c in ("doc_id", "lang", "n_chars")) + ")"


@query(f"""WITH d AS (SELECT source, sha256({_LINE}) AS d FROM documents), s AS (SELECT source, count(*) AS n, {", ".join(f"CAST(sum(CAST('0x' || d[{15 * i + 1}:{15 * i + 15}] AS HUGEINT)) % ((1::HUGEINT << 61) - 1) AS BIGINT) AS h{i}" for i in range(4))} FROM d GROUP BY source)
SELECT source, n AS n_rows, sha256(concat_ws('|', n, h0, h1, h2, h3)) AS digest FROM s""")
def a35_multiset_digest(t):
    """The digest of each source from the states of its languages' parts."""
    parts = profile.multiset_states(t.documents, ["source", "lang"], ["doc_id", "lang", "n_chars"])
    return profile.multiset_digest(profile.merged_states(parts, ["source"]), ["source"])


@query("SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'short:' || user_id WHEN 1 THEN 'flat' ELSE 'nan:x:y' END AS reason FROM events) GROUP BY 1")
def a36_skip_reasons(t):
    reason = F.when(C("event_id") % 3 == 0, F.concat(F.lit("short:"), "user_id")).when(C("event_id") % 3 == 1, "flat").otherwise("nan:x:y")
    return profile.skip_reasons(t.events, reason)


@query("SELECT count(*) AS groups, quantile_cont(n, 0.5) AS median, avg(n) AS mean, min(n) AS min, max(n) AS max FROM (SELECT count(*) AS n FROM {fx_catalog} GROUP BY station)")
def a37_group_sizes(t):
    return profile.group_sizes(t.fx_catalog, "station")


@query("SELECT unnest(['km', 's', 'mag']) AS name, unnest([avg(CASE WHEN km IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN s IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN mag IS NULL THEN 1 ELSE 0 END)]) AS null_rate FROM {fx_catalog}")
def a38_null_rates(t):
    return profile.null_rates(t.fx_catalog, ["km", "s", "mag"])


@query("SELECT weight, round(avg(p_prob) FILTER (dist_bin LIKE 'local%'), 3) AS local_prob, round(avg(p_prob) FILTER (dist_bin LIKE 'regional%'), 3) AS regional_prob, max(value) FILTER (dist_bin LIKE 'local%') AS local_value, max(value) FILTER (dist_bin LIKE 'regional%') AS regional_value FROM {fx_results} GROUP BY weight")
def a40_metric_pivot(t):
    short = F.split_part("dist_bin", F.lit(" "), F.lit(1))
    return t.fx_results.withColumn("b", short).groupBy("weight").pivot("b", ["local", "regional"]).agg(F.round(F.avg("p_prob"), 3).alias("prob"), F.max("value").alias("value"))


@query("SELECT category, avg(CASE WHEN km > 1500 THEN 1 ELSE 0 END) * 100 AS pct FROM {fx_catalog} GROUP BY category")
def a41_filter_rate(t):
    return profile.filter_rate(t.fx_catalog, "category", C("km") > 1500)


@query("SELECT truth, count(*) AS n, avg(CASE WHEN truth = pred THEN 1 ELSE 0 END) AS accuracy FROM (SELECT label % 3 AS truth, list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS pred FROM embeddings) GROUP BY truth")
def a42_class_accuracy(t):
    head = F.slice("embedding", 1, 3)
    pred = F.array_position(head, F.array_max(head)) - 1
    return metrics.class_accuracy(t.embeddings.select((C("label") % 3).alias("truth"), pred.alias("pred")), "truth", "pred")


@query("SELECT pool, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM (SELECT 'a' AS pool, c_acctbal AS v FROM customer UNION ALL SELECT 'b', s_acctbal FROM supplier) GROUP BY pool")
def a43_pool_summary(t):
    a = t.customer.select(F.lit("a").alias("pool"), C("c_acctbal").alias("v"))
    return profile.describe(a.unionByName(t.supplier.select(F.lit("b").alias("pool"), C("s_acctbal").alias("v"))), ["pool"], "v")


@query("SELECT dataset, count(DISTINCT trace_name) AS traces, count(DISTINCT source_id) AS events FROM {fx_catalog} GROUP BY dataset")
def a44_distinct_counts(t):
    return profile.summary(t.fx_catalog, ["dataset"], distinct={"traces": "trace_name", "events": "source_id"}).drop("n")


@query("SELECT dataset, CAST(floor(log10(km + 0.1) / 0.1) AS BIGINT) AS x, CAST(floor(mag / 0.25) AS BIGINT) AS y, count(*) AS n FROM {fx_catalog} WHERE km IS NOT NULL AND mag IS NOT NULL GROUP BY ALL")
def a45_density_cells(t):
    return profile.density_cells(t.fx_catalog, "dataset", C("km"), C("mag"))


@query("SELECT distance_bin, count(*) AS n, count(DISTINCT dataset) AS datasets, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS names FROM {fx_binned} GROUP BY distance_bin")
def a46_contributors(t):
    return profile.contributors(t.fx_binned, "distance_bin", "dataset")


@query("SELECT dataset, line, n, n / sum(n) OVER (PARTITION BY dataset) AS share FROM (SELECT a.dataset, b.line, coalesce(n, 0) AS n FROM (SELECT DISTINCT dataset FROM {fx_catalog}) a CROSS JOIN (SELECT DISTINCT line FROM {fx_catalog}) b LEFT JOIN (SELECT dataset, line, count(*) AS n FROM {fx_catalog} GROUP BY ALL) USING (dataset, line))")
def a47_share_matrix(t):
    return profile.share_matrix(t.fx_catalog, "dataset", "line")


@query("SELECT distance_bin, count(*) FILTER (km IS NOT NULL AND s IS NOT NULL) AS p_and_s, count(*) FILTER (km IS NOT NULL AND s IS NULL) AS p_only, count(*) FILTER (km IS NULL AND s IS NOT NULL) AS s_only, count(*) FILTER (km IS NULL AND s IS NULL) AS \"none\" FROM {fx_binned} GROUP BY distance_bin")
def a48_pick_type_pivot(t):
    return profile.pick_type_pivot(t.fx_binned, "distance_bin", "km", "s")

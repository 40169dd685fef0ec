"""T1-T18, W1-W6 and A23."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, metrics, order, profile, sampling, splits
from .base import SPLIT_SQL, query

C = F.col
_H = "md5(concat_ws('|', '{s}', rid))"
H0, H1, H0P, H0Q = (_H.format(s=s) for s in ("0", "1", "0+", "0''"))


@query("SELECT weight, avg(p_prob) AS mean, count(*) AS n FROM {fx_results} GROUP BY weight ORDER BY mean, weight")
def t1_leaderboard(t):
    return metrics.ranking(t.fx_results, "p_prob")


@query("SELECT trace_id, p_residual_s FROM {fx_results} WHERE p_residual_s IS NOT NULL ORDER BY p_residual_s, trace_id LIMIT 25")
def t2_top_k(t):
    return metrics.smallest(t.fx_results, "p_residual_s", "trace_id", 25).select("trace_id", "p_residual_s")


@query(f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n, count(*) OVER (PARTITION BY dataset, distance_bin) AS c, row_number() OVER (PARTITION BY dataset, distance_bin ORDER BY {H0}, rid) AS r FROM {{fx_shared}}),
p AS (SELECT *, CASE WHEN n <= 500 THEN c ELSE least(c, greatest(1, CAST(round_even(500 * c / n, 0) AS BIGINT))) END AS take FROM b),
s AS (SELECT dataset, 500 - sum(take) AS short FROM (SELECT DISTINCT dataset, distance_bin, take FROM p) GROUP BY dataset),
m AS (SELECT p.*, short, row_number() OVER (PARTITION BY p.dataset, r > take ORDER BY {H0P}, rid) AS more FROM p JOIN s ON p.dataset IS NOT DISTINCT FROM s.dataset)
SELECT rid, dataset, distance_bin FROM m WHERE r <= take OR (n > 500 AND more <= short)""")
def t3_proportional_cap(t):
    return sampling.proportional_cap(t.fx_shared, 500, "distance_bin", ["rid"], 0, "dataset")


_FRACTIONS = {"local": 0.40, "regional": 0.25, "teleseismic": 0.25, "unknown": 0.10}


@query(f"""WITH f(distance_bin, f) AS (VALUES ('local', 0.40::DOUBLE), ('regional', 0.25::DOUBLE), ('teleseismic', 0.25::DOUBLE), ('unknown', 0.10::DOUBLE)),
c AS (SELECT distance_bin, count(*) AS c FROM {{fx_binned}} GROUP BY distance_bin), tot AS (SELECT least(min(CAST(floor(c / f) AS BIGINT)), (SELECT sum(c) FROM c)) AS total FROM c JOIN f USING (distance_bin)),
r AS (SELECT rid, distance_bin, row_number() OVER (PARTITION BY distance_bin ORDER BY {H0}, rid) AS r FROM {{fx_binned}})
SELECT rid, r.distance_bin FROM r JOIN f ON r.distance_bin = f.distance_bin, tot WHERE r <= round_even(total * f, 0)""")
def t4_rebalance(t):
    return sampling.rebalance(t.fx_binned.select("rid", "distance_bin"), _FRACTIONS, "distance_bin", ["rid"], 0)


@query(f"""WITH a AS (SELECT rid, dataset, distance_bin, row_number() OVER (PARTITION BY distance_bin, dataset ORDER BY {H0}, rid) AS r FROM {{fx_binned}}),
b AS (SELECT *, row_number() OVER (PARTITION BY distance_bin ORDER BY {_H.format(s="0''")}, rid) AS q FROM a WHERE r <= 200) SELECT rid, dataset, distance_bin FROM b WHERE q <= 600""")
def t5_two_level_cap(t):
    return sampling.two_level_cap(t.fx_binned.select("rid", "dataset", "distance_bin"), "distance_bin", "dataset", 200, 600, ["rid"], 0)


@query(f"SELECT rid, station FROM (SELECT rid, station, row_number() OVER (PARTITION BY station ORDER BY {H0}, rid) AS r FROM {{fx_catalog}}) WHERE r <= 5")
def t6_per_key_cap(t):
    return sampling.sample_in_groups(t.fx_catalog.select("rid", "station"), ["station"], 5, ["rid"], 0)


@query(f"SELECT rid FROM {{fx_catalog}} ORDER BY {H0}, rid LIMIT 1000")
def t7_flat_sample(t):
    return sampling.sample(t.fx_catalog.select("rid"), 1000, ["rid"], 0)


@query(f"SELECT rid FROM {{fx_catalog}} ORDER BY -ln((CAST('0x' || substr({H0}, 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / pow(10.0, -mag), rid LIMIT 500")
def t8_weighted_sample(t):
    return sampling.weighted_sample(t.fx_catalog.select("rid", "mag"), 500, F.pow(F.lit(10.0), -C("mag")), ["rid"], 0).select("rid")


_G = "md5(concat_ws('|', '0', id))"


@query(f"""WITH b AS (SELECT id, lat, CASE WHEN lat >= -90 AND lat < 90 THEN CAST(floor((lat + 90) / 30) AS BIGINT) END AS band FROM {{fx_geo}}),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_G}, id) AS r FROM b) SELECT id, lat FROM r ORDER BY (band IS NOT NULL AND r <= 50) DESC, {_G}, id LIMIT 300""")
def t9_latitude_bands(t):
    return sampling.latitude_bands(t.fx_geo.select("id", "lat"), "lat", 300, ["id"], 0)


@query(f"SELECT rid FROM {{fx_catalog}} ORDER BY {H1}, rid LIMIT 2000")
def t10_random_cap(t):
    return sampling.cap(t.fx_catalog.select("rid"), 2000, ["rid"], 1)


@query(f"""WITH p AS (SELECT rid, row_number() OVER (ORDER BY {H0}, rid) AS r, count(*) OVER () AS n FROM {{fx_binned}} WHERE distance_bin = 'regional')
SELECT rid, count(*) AS copies FROM (SELECT rid FROM {{fx_binned}} UNION ALL SELECT rid FROM p UNION ALL SELECT rid FROM p WHERE r <= round_even(0.5 * n, 0)) GROUP BY rid""")
def t11_oversample(t):
    out = sampling.oversample(t.fx_binned.select("rid", "distance_bin"), C("distance_bin") == "regional", 2.5, ["rid"], 0)
    return out.groupBy("rid").agg(F.count("*").alias("copies"))


@query(f"SELECT rid, CASE WHEN row_number() OVER (ORDER BY {H0}, rid) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'val' END AS split FROM {{fx_catalog}}")
def t12_ratio_split(t):
    return sampling.ratio_split(t.fx_catalog.select("rid"), 0.9, ["rid"], 0)


@query(f"{SPLIT_SQL} SELECT rid, split FROM dealt")
def t13_event_grouped_split(t):
    return splits.event_grouped_split(t.fx_keys.select("rid", "vendor"), t.fx_rowkeys, 0.1, 0.1).select("rid", "split")


@query(f"SELECT rid, row_number() OVER (ORDER BY {H0}, rid) AS at FROM {{fx_catalog}}")
def t15_shuffle(t):
    """The position of every row in the shuffle."""
    return sampling.fraction_ranked(t.fx_catalog.select("rid"), ["rid"], 0).select("rid", C("_rank").cast("long").alias("at"))


@query("SELECT rid, station, CAST(ceil(row_number() OVER (PARTITION BY station ORDER BY rid) / 10) AS INTEGER) AS batch FROM {fx_catalog}")
def t16_batches(t):
    return order.in_batches(t.fx_catalog.select("rid", "station"), "station", 10, ["rid"])


@query(f"SELECT rid, category FROM (SELECT rid, category, row_number() OVER (PARTITION BY category ORDER BY {H1}, rid) AS r FROM {{fx_catalog}}) WHERE r <= 3")
def t17_examples_per_class(t):
    return sampling.sample_in_groups(t.fx_catalog.select("rid", "category"), ["category"], 3, ["rid"], 1)


@query("SELECT station, min(rid) AS rid, arg_min(price, rid) AS price FROM {fx_catalog} GROUP BY station")
def t18_first_per_key(t):
    return joins.first_by(t.fx_catalog.select("station", "rid", "price"), ["station"], ["rid"])


@query(f"SELECT rid, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {H0}, rid) AS rank FROM {{fx_catalog}}")
def w1_random_rank(t):
    return sampling.ranked_in_groups(t.fx_catalog.select("rid", "dataset"), ["dataset"], ["rid"], 0, "rank").select("rid", "dataset", C("rank").cast("long").alias("rank"))


@query("WITH c AS (SELECT dataset, floor(p / 500) AS bin, count(*) AS n FROM {fx_catalog} GROUP BY ALL), k AS (SELECT dataset, bin, sum(n) OVER (PARTITION BY dataset ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY dataset) AS total FROM c) SELECT dataset, CAST(min(bin) AS BIGINT) AS median_bin FROM k WHERE cum >= total / 2 GROUP BY dataset")
def w2_median_bin(t):
    return profile.median_bin(t.fx_catalog, "dataset", C("p"), 500)


@query("SELECT dataset, distance_bin, n / sum(n) OVER (PARTITION BY dataset) AS share FROM (SELECT dataset, distance_bin, count(*) AS n FROM {fx_binned} GROUP BY ALL)")
def w3_share(t):
    counts = t.fx_binned.groupBy("dataset", "distance_bin").agg(F.count("*").alias("n"))
    return counts.select("dataset", "distance_bin", (C("n") / F.sum("n").over(Window.partitionBy("dataset"))).alias("share"))


_WIDTH = "CAST(greatest(10, count(*) OVER ({over}) // 100) AS BIGINT)"


@query(f"""WITH w AS (SELECT event_type, event_id, value, {_WIDTH.format(over="PARTITION BY event_type")} AS w, {_WIDTH.format(over="")} AS w_all FROM events)
SELECT event_type, event_id, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW) AS smooth,
  avg(value) OVER (ORDER BY event_id ROWS BETWEEN w_all - 1 PRECEDING AND CURRENT ROW) AS smooth_all FROM w""")
def w4_rolling_mean(t):
    """Over the last hundredth of each type's events, ten at least, and over all events as one group."""
    width = F.greatest(F.lit(10), F.floor(C("_size") / 100))
    one = order.rolling_mean(t.events.select("event_type", "event_id", "value"), ["event_type"], ["event_id"], "value", width)
    return order.rolling_mean(one, [], ["event_id"], "value", width, "smooth_all").drop("value")


@query("WITH m AS (SELECT weight, avg(p_prob) AS recall, avg(abs(p_residual_s)) AS mae FROM {fx_results} GROUP BY weight) SELECT 'recall' AS metric, arg_max(weight, recall) AS best, max(recall) AS value FROM m UNION ALL SELECT 'mae', arg_min(weight, mae), min(mae) FROM m")
def w5_best_per_metric(t):
    m = t.fx_results.groupBy("weight").agg(F.avg("p_prob").alias("recall"), F.avg(F.abs("p_residual_s")).alias("mae"))
    return metrics.best_per_metric(m, "weight", higher=["recall"], lower=["mae"])


@query("""WITH g AS (SELECT l_orderkey, count(*) AS size FROM {fx_keys} GROUP BY l_orderkey), r AS (SELECT *, sum(size) OVER (ORDER BY md5(concat_ws('|', '0', CAST(l_orderkey AS STRING))), CAST(l_orderkey AS STRING)) - size AS before FROM g)
SELECT CAST(l_orderkey AS STRING) AS group_id, size, CASE WHEN before < 300 THEN 'val' ELSE 'train' END AS split FROM r""")
def w6_greedy_fill(t):
    groups = t.fx_keys.groupBy(C("l_orderkey").cast("string").alias("group_id")).agg(F.count("*").alias("size"))
    return splits.greedy_fill(groups, [("val", F.lit(300).cast("long"))], "train", 0)


@query("SELECT weight, slice_bin, split, count(*) AS n, avg(p_prob) AS mean FROM (SELECT *, unnest([dist_bin, 'all']) AS slice_bin FROM {fx_results}), (VALUES ('every'), ('even')) s(split) WHERE split = 'every' OR user_id % 2 = 0 GROUP BY ALL")
def a23_slices(t):
    which = F.when(C("user_id") % 2 == 0, F.array(F.lit("every"), F.lit("even"))).otherwise(F.array(F.lit("every")))
    return splits.expand_slices(t.fx_results, splits=which).groupBy("weight", "slice_bin", "split").agg(F.count("*").alias("n"), F.avg("p_prob").alias("mean"))

"""Whole jobs: manifests from ragged catalogs, noise merge, leakage audit by family, waveform preparation, weight registry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans import audit, build, corpus, noise, waveforms
from ..plans import evaluation as evaluation_plan
from ..sources import catalogs, registry
from ..sources.scratch import new_folder, written
from .aggregates import BINS, DRAWS_SQL, metrics_sql
from .base import query
from .jobs import _flatten
from .waveforms import _absent, _energy, _picky, _scaled, _text, _text_sql

C = F.col

_PLANS = [build.CatalogPlan("one", 1500), build.CatalogPlan("two", 1200, use_s=False)]


def _ragged(t, place: str) -> dict:
    """Two catalogs as CSV shards: other column names and orders, gaps, events and vendor splits that some rows lack."""
    df = t.fx_catalog.withColumn("source_id", F.when(C("source_id") % 13 != 0, C("source_id"))).withColumn("vendor", F.when(C("vendor") == "F", " Train").when(C("vendor") == "O", "DEV"))
    shared = ["rid", "trace_name", "source_id", C("chunk").alias("trace_chunk")]
    one = df.where("line <= 3").select(*shared, C("p").alias("trace_p_arrival_sample"), C("s").alias("trace_s_arrival_sample"), C("km").alias("path_ep_distance_km"), C("vendor").alias("split"))
    two = df.where("line > 3").select(C("km").alias("source_distance_km"), *shared, (C("p") + 1).alias("trace_Pg_arrival_sample"), F.when(C("line") != 5, C("p")).alias("trace_P_arrival_sample"), C("vendor").alias("trace_split"))
    put = lambda part, name: part.write.mode("append").option("header", True).option("compression", "gzip").csv(f"{place}/{name}")
    put(two.where("line <> 4"), "two")
    put(two.where("line = 4").select(*reversed(two.columns)), "two")
    put(one, "one")
    return {n: catalogs.read_ragged(t.spark, catalogs.csv_files(t.spark, f"{place}/{n}")) for n in ("one", "two")}


_BUILT = f"""WITH c AS (SELECT rid, CASE WHEN line <= 3 THEN 'one' ELSE 'two' END AS dataset, trace_name, chunk, CASE WHEN line = 5 THEN p + 1 ELSE p END AS p, CASE WHEN line <= 3 THEN s END AS s, km,
  CASE vendor WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE '' END AS vendor, CASE WHEN source_id % 13 <> 0 THEN source_id END AS ev, source_id FROM {{fx_catalog}}),
bench AS (SELECT DISTINCT dataset, trace_name FROM c WHERE source_id % 4999 = 0), bad AS (SELECT DISTINCT dataset, trace_name FROM c WHERE source_id % 3001 = 1),
gone AS (SELECT DISTINCT dataset, ev FROM c SEMI JOIN bench USING (dataset, trace_name) WHERE ev IS NOT NULL),
ok AS (SELECT *, CASE WHEN km IS NULL OR km < 0 THEN 'unknown' WHEN km < 150 THEN 'local' WHEN km < 1500 THEN 'regional' ELSE 'teleseismic' END AS distance_bin, CASE dataset WHEN 'one' THEN 1500 ELSE 1200 END AS cap
  FROM c WHERE p >= 0 AND (dataset = 'two' OR s IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM bench b WHERE b.dataset = c.dataset AND b.trace_name = c.trace_name) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.dataset = c.dataset AND b.trace_name = c.trace_name)
  AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.dataset = c.dataset AND g.ev = c.ev)),
k AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n, count(*) OVER (PARTITION BY dataset, distance_bin) AS c, row_number() OVER (PARTITION BY dataset, distance_bin ORDER BY md5(concat_ws('|', '0', rid)), rid) AS r FROM ok),
q AS (SELECT *, CASE WHEN n <= cap THEN c ELSE least(c, greatest(1, CAST(round_even(cap * c / n, 0) AS BIGINT))) END AS take FROM k),
short AS (SELECT dataset, any_value(cap) - sum(take) AS short FROM (SELECT DISTINCT dataset, distance_bin, take, cap FROM q) GROUP BY dataset),
more AS (SELECT q.*, short, row_number() OVER (PARTITION BY q.dataset, r > take ORDER BY md5(concat_ws('|', '0+', rid)), rid) AS more FROM q JOIN short ON q.dataset = short.dataset),
pool AS (SELECT * FROM more WHERE r <= take OR (n > cap AND more <= short)),
named AS (SELECT *, ev IS NULL AND vendor <> '' AS placed, CASE WHEN ev IS NULL THEN 'row:' || rid ELSE min(rid) OVER (PARTITION BY dataset, ev) END AS group_id FROM pool),
g AS (SELECT group_id, count(*) AS size FROM named WHERE NOT placed GROUP BY group_id), m AS (SELECT sum(size) AS m FROM g),
run AS (SELECT group_id, size, sum(size) OVER (ORDER BY md5(concat_ws('|', '0', group_id)), group_id) - size AS before FROM g),
v AS (SELECT coalesce(max(before + size), 0) AS stop FROM run, m WHERE before < floor(0.1 * m)),
s AS (SELECT group_id, CASE WHEN before < floor(0.1 * m) THEN 'val' WHEN before >= stop AND before < stop + floor(0.1 * m) THEN 'test' ELSE 'train' END AS split FROM run, m, v),
dealt AS (SELECT named.*, CASE WHEN placed THEN vendor ELSE s.split END AS split FROM named LEFT JOIN s ON named.group_id = s.group_id),
cnt AS (SELECT distance_bin, count(*) AS c FROM dealt WHERE split = 'train' GROUP BY distance_bin), tot AS (SELECT least(min(CAST(floor(c / 0.25) AS BIGINT)), sum(c)) AS total FROM cnt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split, distance_bin ORDER BY md5(concat_ws('|', '0', rid)), rid) AS pos FROM dealt),
built AS (SELECT dataset AS dataset_name, trace_name, chunk, p AS p_arrival_sample, CASE WHEN distance_bin <> 'teleseismic' THEN s END AS s_arrival_sample, km AS distance_km, distance_bin,
  CASE dataset WHEN 'one' THEN 'trace_p_arrival_sample' ELSE 'trace_P_arrival_sample' END AS p_col, CASE dataset WHEN 'one' THEN 'trace_s_arrival_sample' END AS s_col, split FROM ranked, tot WHERE split <> 'train' OR pos <= round_even(total * 0.25, 0))"""


def _build(t, place: str):
    raw = _ragged(t, f"{place}/raw")
    named = t.fx_catalog.select(F.when(C("line") <= 3, "one").otherwise("two").alias("dataset"), "trace_name", "source_id")
    bench, bad = (named.where(rule).select("dataset", "trace_name").distinct() for rule in ("source_id % 4999 = 0", "source_id % 3001 = 1"))
    return build.build_manifests(raw, _PLANS, bench, bad, {b: 0.25 for b in BINS}, 0.1, 0.1, place)


@query(f"{_BUILT} SELECT * FROM built")
def corpus_manifests(t):
    """From CSV shards to the written manifest."""
    return _build(t, new_folder(t.spark))


@query(f"""{_BUILT}, counts AS (SELECT split, dataset_name, distance_bin, count(*) AS n, count(s_arrival_sample) AS n_with_s FROM built GROUP BY ALL)
SELECT a.split, b.dataset_name, d.distance_bin, coalesce(n, 0) AS n, coalesce(n_with_s, 0) AS n_with_s FROM (SELECT DISTINCT split FROM counts) a CROSS JOIN (SELECT DISTINCT dataset_name FROM counts) b CROSS JOIN (SELECT DISTINCT distance_bin FROM counts) d LEFT JOIN counts USING (split, dataset_name, distance_bin)""")
def corpus_composition(t):
    """The composition summary that the build writes beside its manifest."""
    place = new_folder(t.spark)
    _build(t, place)
    return t.spark.read.parquet(f"{place}/composition_summary")


@query(f"""{_BUILT} SELECT dataset, count(*) AS n_before, count(*) FILTER (flagged) AS n_removed, round_even(100 * count(*) FILTER (flagged) / count(*), 2) AS pct_removed
FROM (SELECT c.dataset, EXISTS (SELECT 1 FROM bad b WHERE b.dataset = c.dataset AND b.trace_name = c.trace_name) AS flagged FROM c WHERE p >= 0 AND NOT EXISTS (SELECT 1 FROM bench b WHERE b.dataset = c.dataset AND b.trace_name = c.trace_name)) GROUP BY dataset""")
def corpus_removals(t):
    """The label-error report that the build writes beside its manifest."""
    place = new_folder(t.spark)
    _build(t, place)
    return t.spark.read.parquet(f"{place}/removal_report")


@query("""WITH n AS (SELECT 'n' || id AS trace_name FROM {fx_geo} WHERE id IN (SELECT trace_id FROM {fx_results} WHERE p_prob < 0.5 AND s_prob < 0.5)),
d AS (SELECT trace_name, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', trace_name)), trace_name) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'val' END AS split FROM n)
SELECT 'noise_global' AS dataset_name, trace_name, 'noise' AS distance_bin, split, CAST(NULL AS DOUBLE) AS p FROM d UNION ALL SELECT dataset, trace_name, distance_bin, CASE WHEN line = 1 THEN 'train' ELSE 'val' END, p FROM {fx_binned} WHERE line <= 2""")
def noise_merge(t):
    """Clean noise joins a written manifest; the second run finds nothing left to add."""
    place = new_folder(t.spark)
    df = t.fx_binned.where("line <= 2").select(C("dataset").alias("dataset_name"), "trace_name", "chunk", C("p").alias("p_arrival_sample"), C("s").alias("s_arrival_sample"), C("km").alias("distance_km"), "distance_bin", F.lit("p").alias("p_col"), F.lit("s").alias("s_col"), F.when(C("line") == 1, "train").otherwise("val").alias("split"))
    catalogs.write_manifest(df, f"{place}/manifest")
    noise = t.fx_geo.select(F.concat(F.lit("n"), "id").alias("trace_name"))
    screened = t.fx_results.select(F.concat(F.lit("n"), "trace_id").alias("trace_name"), C("p_prob").alias("max_p"), C("s_prob").alias("max_s"))
    for _ in range(2):
        build.merge_noise(noise, screened, place, 0.5, 0.5)
    return build.read_manifest(t.spark, place).select("dataset_name", "trace_name", "distance_bin", "split", C("p_arrival_sample").alias("p"))


_FAMILIES = {"narrow": 7, "wide": 11}


def _audit(t):
    rows = t.fx_keys.where("l_orderkey % 5 = 0").select("rid", "dataset", "trace_name", "k1", "k2")
    frames = {d: rows.where(C("dataset") == d).select("trace_name", F.array_compact(F.array("k1", "k2")).alias("event_keys")) for d in (f"{r}{s}" for r in "ANR" for s in "FO")}
    frames["lost"] = rows.select("rid")  # no columns to derive keys from

    def derive(df, name):
        return df.select("trace_name", "event_keys")

    bench, errors = audit.derived_keys(frames, derive, ["trace_name"])
    errors = {n: "error: unreadable" for n in errors}
    parts = [t.fx_rowkeys.where(f"l_orderkey % {m} = {k}").select(F.lit(name).alias("manifest_family"), F.lit(part).alias("part"), "dataset", "event_key") for name, m in _FAMILIES.items() for k, part in enumerate(("train", "val"))]
    trained = parts[0]
    for p in parts[1:]:
        trained = trained.union(p)
    weights = t.fx_results.select("weight").distinct().select(F.when(C("weight") < "d", "narrow").otherwise("wide").alias("manifest_family"), "weight")
    return audit.audit_families(bench, trained, weights, errors)


_MASKS = """WITH w AS (SELECT manifest_family, string_agg(weight, ',' ORDER BY weight) AS weights FROM (SELECT DISTINCT CASE WHEN weight < 'd' THEN 'narrow' ELSE 'wide' END AS manifest_family, weight FROM {fx_results}) GROUP BY manifest_family),
b AS (SELECT k.dataset, k.trace_name, r.event_key FROM {fx_keys} k LEFT JOIN {fx_rowkeys} r ON k.rid = r.rid WHERE k.l_orderkey % 5 = 0),
t AS (SELECT DISTINCT CASE x.m WHEN 7 THEN 'narrow' ELSE 'wide' END AS manifest_family, CASE l_orderkey % x.m WHEN 0 THEN 'train' ELSE 'val' END AS part, dataset, event_key FROM {fx_rowkeys}, (VALUES (7), (11)) x(m) WHERE l_orderkey % x.m < 2),
h AS (SELECT w.manifest_family, b.*, t.event_key IS NOT NULL AS hit FROM b CROSS JOIN w LEFT JOIN t ON t.manifest_family = w.manifest_family AND t.part = 'train' AND t.dataset = b.dataset AND t.event_key = b.event_key),
masks AS (SELECT manifest_family, dataset, trace_name, bool_or(event_key IS NOT NULL) AS verifiable, bool_or(hit) AS leaked FROM h GROUP BY ALL)"""


@query(f"""{_MASKS}, r AS (SELECT manifest_family, dataset, count(*) AS n_benchmark_rows, count(*) FILTER (NOT verifiable) AS n_unverifiable, count(*) FILTER (leaked) AS n_benchmark_rows_leaked FROM masks GROUP BY ALL),
e AS (SELECT manifest_family, dataset, count(DISTINCT event_key) AS n_benchmark_events, count(DISTINCT event_key) FILTER (hit) AS n_events_leaked_into_train FROM h GROUP BY ALL),
p AS (SELECT manifest_family, dataset, count(*) FILTER (tr) AS n_train_events, count(*) FILTER (va) AS n_val_events, count(*) FILTER (tr AND va) AS n_train_val_event_overlap FROM (SELECT manifest_family, dataset, event_key, bool_or(part = 'train') AS tr, bool_or(part = 'val') AS va FROM t GROUP BY ALL) GROUP BY ALL)
SELECT r.*, n_benchmark_events, n_events_leaked_into_train, coalesce(n_train_events, 0) AS n_train_events, coalesce(n_val_events, 0) AS n_val_events, coalesce(n_train_val_event_overlap, 0) AS n_train_val_event_overlap, weights, 'event keys' AS method_used,
 n_events_leaked_into_train / nullif(n_benchmark_events, 0) AS leaked_event_frac, n_unverifiable / n_benchmark_rows AS unverifiable_row_frac
FROM r JOIN e USING (manifest_family, dataset) LEFT JOIN p USING (manifest_family, dataset) JOIN w USING (manifest_family)
UNION ALL BY NAME SELECT manifest_family, weights, 'lost' AS dataset, 'error: unreadable' AS method_used FROM w""")
def leakage_audit(t):
    """Every manifest family against every benchmark dataset; one that cannot be read is reported."""
    return _audit(t)[0]


@query(f"{_MASKS} SELECT weight, h.dataset, count(*) AS n, count(*) FILTER (verifiable AND NOT leaked) AS clean FROM masks h JOIN (SELECT DISTINCT weight FROM {{fx_results}}) x ON h.manifest_family = CASE WHEN weight < 'd' THEN 'narrow' ELSE 'wide' END GROUP BY ALL")
def leakage_masks(t):
    """Row masks as they are written and read for each weight's family."""
    masks = audit.write_masks(_audit(t)[1], new_folder(t.spark))
    weights = t.fx_results.select("weight").distinct().withColumn("manifest_family", F.when(C("weight") < "d", "narrow").otherwise("wide"))
    return masks.join(weights, "manifest_family").groupBy("weight", "dataset").agg(F.count("*").alias("n"), F.count_if(C("verifiable") & ~C("leaked")).alias("clean"))


def _prepared(t):
    k = C("vec_id") % 5
    spoilt = F.when(k == 0, F.array_repeat(F.lit(float("nan")), 64)).when(k == 1, F.array_repeat(F.lit(0.0), 64)).when(k == 2, F.array_repeat(F.lit(1.0), 64)).otherwise(C("c1"))
    wave = t.fx_wave3.where("vec_id % 7 <> 0").select("vec_id", F.array("c0", spoilt, "c2").alias("wf"), F.when(C("vec_id") % 11 != 0, 100.0).otherwise(0.0).alias("rate"))
    return waveforms.prepare_waveforms(t.fx_wave3.select("vec_id", C("pick").cast("int").alias("pick")), wave, ["vec_id"], 20, 100.0, 30, 100, 20)


_WINDOWS = "SELECT vec_id, pick, start, c0, c1, c2, c0[start + 1:start + 20] AS a, c1[start + 1:start + 20] AS b, c2[start + 1:start + 20] AS c FROM (SELECT *, least(greatest(0, pick - 6), greatest(0, 64 - 20)) AS start FROM {fx_wave3} WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 5 > 2)"
_DB = lambda c: f"20 * log10(sqrt(list_avg([x * x FOR x IN {c}[pick + 1:least(64, pick + 20)]])) / sqrt(list_avg([x * x FOR x IN {c}[greatest(0, pick - 20) + 1:pick]])) + 1e-12)"
_CLIPPED = lambda c: _text_sql("[greatest(-10, least(10, y)) FOR y IN " + _scaled(c, "1e-6") + "]", "1e5")


@query(f"""SELECT vec_id, pick - start AS "offset", concat_ws(';', {_CLIPPED('a')}, {_CLIPPED('b')}, {_CLIPPED('c')}) AS wf, CASE WHEN pick > 0 THEN round(({_DB('c0')} + {_DB('c1')} + {_DB('c2')}) / 3, 6) END AS snr_db FROM ({_WINDOWS})""")
def waveform_preparation(t):
    out = _prepared(t)[0]
    return out.select("vec_id", C("offset").cast("long").alias("offset"), F.concat_ws(";", *[_text(C("wf")[k], 1e5) for k in range(3)]).alias("wf"), F.round("snr_db", 6).alias("snr_db"))


@query("""SELECT vec_id, CASE WHEN why IS NULL THEN 'ok' ELSE 'skipped' END AS status, why AS skip_reason FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing_waveform' WHEN vec_id % 11 = 0 THEN 'wrong_rate'
 WHEN vec_id % 5 = 0 THEN 'contains_nan' WHEN vec_id % 5 = 1 THEN 'too_many_zeros' WHEN vec_id % 5 = 2 THEN 'flat_component_1' END AS why FROM {fx_wave3})""")
def waveform_index(t):
    return _prepared(t)[1]


@query("""WITH w AS (SELECT DISTINCT weight FROM {fx_results} UNION ALL SELECT 'bare') SELECT CASE WHEN weight = 'bare' THEN weight ELSE 'net_ft_' || weight END AS weight, CASE WHEN weight IN ('bare', 'view') THEN 'old/train.csv' ELSE 'm/' || weight || '/train.csv' END AS train_manifest,
 CASE WHEN weight IN ('bare', 'view') THEN 'old/val.csv' ELSE 'm/' || weight || '/val.csv' END AS val_manifest, CASE WHEN weight NOT IN ('bare', 'view') THEN weight || '__train' END AS manifest_family FROM w""")
def weight_registry(t):
    """Configurations of training runs give each weight its manifests; one lacks a setting, and a weight without any takes the old pair."""
    place = new_folder(t.spark)
    weights = t.fx_results.select("weight").distinct()
    body = F.concat(F.lit("name: x\ndata:\n  train_manifest: m/"), "weight", F.lit("/train.csv  # all\n"), F.when(C("weight") != "view", F.concat(F.lit("  val_manifest: 'm/"), "weight", F.lit("/val.csv'\n"))).otherwise(""))
    weights.select(body.alias("value"), C("weight").alias("k")).repartition(5, "k").write.partitionBy("k").text(f"{place}/by")
    _flatten(t.spark, f"{place}/by", f"{place}/configs", "finetune_net_", "txt", ".yaml")
    found = registry.weight_manifests(t.spark, f"{place}/configs", "net")
    every = weights.select(F.concat(F.lit("net_ft_"), "weight").alias("weight")).union(t.spark.range(1).select(F.lit("bare")))
    return registry.resolved(every, found, "old/train.csv", "old/val.csv").join(registry.families(found), "weight", "left")


_CORPORA = {"clicks": "event_type = 'click'", "few": "event_id % 40 = 0"}
_MET = """EXISTS (SELECT 1 FROM {{fx_points}} c WHERE ({which}) AND c.ts BETWEEN b.ts - INTERVAL 300 SECOND AND b.ts + INTERVAL 300 SECOND
 AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(c.lat) - radians(b.lat)) / 2), 2) + cos(radians(b.lat)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(b.lon)) / 2), 2)))) <= 500)"""
_PARENTS = "masks AS (" + " UNION ALL ".join(f"SELECT '{n}' AS corpus, event_type AS dataset, event_id AS trace_name, event_id % 11 <> 0 AS verifiable, event_id % 11 <> 0 AND {_MET.format(which='c.' + w)} AS leaked FROM {{fx_points}} b" for n, w in _CORPORA.items()) + ")"


def _parents(t):
    p = t.fx_points
    bench = p.select(C("event_type").alias("dataset"), C("event_id").cast("string").alias("trace_name"), "ts", "lat", F.when(C("event_id") % 11 != 0, C("lon")).alias("lon"))
    return audit.audit_parents(bench, {**{n: p.where(w) for n, w in _CORPORA.items()}, "elsewhere": None}, 300, 500)


@query(f"""WITH {_PARENTS}, s AS (SELECT corpus, dataset, count(*) AS n_benchmark_rows, count(*) FILTER (verifiable) AS n_verifiable, count(*) FILTER (leaked) AS n_leaked FROM masks GROUP BY ALL)
SELECT *, 1 - n_verifiable / n_benchmark_rows AS unverifiable_row_frac, n_leaked / nullif(n_verifiable, 0) AS leaked_row_frac FROM s UNION ALL BY NAME SELECT 'elsewhere' AS corpus""")
def parent_audit(t):
    """Benchmark rows against the corpora of public weights by time and place; a corpus that is not at hand is listed."""
    return _parents(t)[0]


_DEALT = """results AS (SELECT *, weight < 'm' AS own, contains(trained_models, 'ds1') AS inside, CASE WHEN weight < 'p' THEN 'clicks' ELSE 'elsewhere' END AS corpus FROM {fx_results}),
marked AS (SELECT r.*, own AND trace_id % 7 <> 0 AND trace_id % 5 <> 0 AS clean, NOT own AND r.corpus = 'clicks' AND NOT inside AND trace_id % 11 <> 0 AND trace_id % 3 <> 0 AS parent_clean FROM results r),
sliced AS (SELECT * EXCLUDE (dist_bin), unnest([dist_bin, 'all']) AS dist_bin FROM (SELECT *, unnest(list_filter(['all', CASE WHEN inside THEN 'in_domain' ELSE 'cross_domain' END, CASE WHEN clean THEN 'clean_holdout' END, CASE WHEN parent_clean THEN 'cross_domain_clean' END], lambda x: x IS NOT NULL)) AS split FROM marked))"""
_ASKED = {"p_mae_s": ("abs(p_residual_s)", "p_in_window >= 0"), "s_mae_s": ("abs(s_residual_s)", "s_in_window >= 0"), "p_recall": ("CAST(p_prob >= 0.3 AS INTEGER)", "p_in_window >= 0"), "s_recall": ("CAST(s_prob >= 0.3 AS INTEGER)", "s_in_window >= 0")}
_BOTH_SQL = "(p_in_window >= 0 AND s_in_window >= 0)"
_STATES = ", ".join([f"CASE WHEN {w} THEN {v} END AS v_{n}" for n, (v, w) in _ASKED.items()] + [f"CAST({_BOTH_SQL} AS INTEGER) AS m_n", f"CAST({_BOTH_SQL} AND p_prob > s_prob AS INTEGER) AS m_a", f"CAST({_BOTH_SQL} AND s_prob > p_prob AS INTEGER) AS m_b"])
_MEANS = ", ".join(f"sum(w * v_{n}) / nullif(sum(w) FILTER (v_{n} IS NOT NULL), 0) AS {n}" for n in _ASKED)
_ENDS = ", ".join(f"CASE WHEN any_value(c_{n}) >= 5 THEN quantile_cont({n}, {q}) END AS {n}_ci_{e}" for n in (*_ASKED, "mcc") for q, e in ((0.025, "lo"), (0.975, "hi")))
_HELD = ", ".join([f"count(v_{n}) AS c_{n}" for n in _ASKED] + ["sum(m_n) AS c_mcc"])


@query(f"""WITH {_DEALT}, {DRAWS_SQL.format(source="results", key="trace_id")},
states AS (SELECT weight, split, dist_bin, trace_id, {_STATES} FROM sliced), sizes AS (SELECT weight, split, dist_bin, {_HELD} FROM states GROUP BY ALL),
boots AS (SELECT weight, split, dist_bin, i, {_MEANS}, sum(w * m_n) AS n, sum(w * m_a) AS a, sum(w * m_b) AS b FROM states JOIN draws USING (trace_id) GROUP BY ALL),
each AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN (a + b) * (2 * n - a - b) = 0 THEN 0.0 ELSE (a - b) / sqrt((a + b) * (2 * n - a - b)) END END AS mcc FROM boots),
ends AS (SELECT weight, split, dist_bin, {_ENDS} FROM each JOIN sizes USING (weight, split, dist_bin) GROUP BY ALL)
SELECT m.*, e.* EXCLUDE (weight, split, dist_bin), degenerate FROM ({metrics_sql("sliced", "weight, split, dist_bin")}) m JOIN ends e USING (weight, split, dist_bin)
 JOIN (SELECT weight, coalesce(avg(CASE WHEN p_prob >= 0.3 THEN 1 ELSE 0 END) > 0.99 AND avg(abs(p_residual_s)) > 2, false) AS degenerate FROM {{fx_results}} GROUP BY weight) USING (weight)""")
def clean_leaderboard(t):
    """All five splits with bootstrap intervals of errors, recalls and the correlation."""
    r = t.fx_results
    own_mask = r.select("weight", "trace_id", (C("trace_id") % 7 != 0).alias("verifiable"), (C("trace_id") % 5 == 0).alias("leaked"))
    parents = r.select(F.lit("clicks").alias("corpus"), "trace_id", (C("trace_id") % 11 != 0).alias("verifiable"), (C("trace_id") % 3 == 0).alias("leaked")).distinct()
    kinds = F.when(C("weight") < "p", "clicks").otherwise("elsewhere")
    return corpus.clean_leaderboard(r, C("trained_models").contains("ds1"), C("weight") < "m", own_mask, ["weight", "trace_id"], parents, ["trace_id"], kinds, ["trace_id"]).drop("corpus")


def _edges():
    return lambda block: (np.abs(block[:, 2]), np.abs(block[:, 0]))


def _index(t):
    picks = [F.when(C("vec_id") % 10 == 0, -1).otherwise(C("pick")).cast("int").alias("p_in_window"), F.when(C("vec_id") % 4 == 0, -1).otherwise(63 - C("pick")).cast("int").alias("s_in_window")]
    return t.fx_wave3.select("vec_id", *picks, F.concat(F.lit("bin"), C("vec_id") % 3).alias("dist_bin"), F.when(C("vec_id") % 13 == 0, "skipped").otherwise("ok").alias("status"))


def _waves(t):
    return t.fx_wave3.select("vec_id", F.array("c0", "c1", "c2").alias("wf"))


_NORMAL = lambda c: f"[CAST((x - list_avg({c})) / (CASE WHEN list_stddev_pop({c}) < 1e-10 THEN 1 ELSE list_stddev_pop({c}) END) AS FLOAT) FOR x IN {c}]"
_SCORES = f"""n AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE pick END AS p_in_window, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE 63 - pick END AS s_in_window, 'bin' || (vec_id % 3) AS dist_bin,
 [abs(y) FOR y IN {_NORMAL('c0')}] AS a, [abs(y) FOR y IN {_NORMAL('c1')}] AS b, [abs(y) FOR y IN {_NORMAL('c2')}] AS c FROM {{fx_wave3}} WHERE vec_id % 13 <> 0),
curves AS (SELECT vec_id, p_in_window, s_in_window, dist_bin, 'energy' AS weight, a AS p, b AS s FROM n UNION ALL SELECT vec_id, p_in_window, s_in_window, dist_bin, 'edges', c, a FROM n)"""


def _picked_sql(source: str) -> str:
    held = lambda x: f"list_slice({x}, greatest(0, {x}_in_window - 10) + 1, least(64, {x}_in_window + 10))"
    columns = [f"CAST(CASE WHEN {x}_in_window >= 0 THEN list_max({held(x)}) ELSE 0 END AS DOUBLE) AS {x}_prob, CASE WHEN {x}_in_window >= 0 THEN (list_position({held(x)}, list_max({held(x)})) - 1 + greatest(0, {x}_in_window - 10) - {x}_in_window) / 100 END AS {x}_residual_s" for x in "ps"]
    return f"SELECT vec_id, weight, dist_bin, p_in_window, s_in_window, {', '.join(columns)} FROM {source}"


@query(f"WITH {_SCORES} SELECT * FROM ({_picked_sql('curves')})")
def evaluation(t):
    """Two runs into one store: the first with one scorer and one that cannot be made, the second scores what is missing."""
    place = new_folder(t.spark)
    index = _index(t)
    evaluation_plan.evaluate(index, _waves(t), {"energy": _energy, "absent": _absent}, f"{place}/r", ["vec_id"], 64, 10)
    evaluation_plan.evaluate(index, _waves(t), {"energy": _picky, "edges": _edges, "absent": _absent}, f"{place}/r", ["vec_id"], 64, 10)
    return catalogs.read_results(t.spark, f"{place}/r").select("vec_id", "weight", "dist_bin", "p_in_window", "s_in_window", "p_prob", "p_residual_s", "s_prob", "s_residual_s")


_SETS = {"even": {"energy": 1.0, "edges": 1.0}, "edgy": {"energy": 1.0, "edges": 3.0}, "one": {"edges": 2.0}, "lacking": {"energy": 1.0, "absent": 1.0}}


def _blended_sql(name: str, members: dict[str, float]) -> str:
    curve = {"energy": "e", "edges": "d"}
    columns = [f"[({' + '.join(f'{members[m]} * CAST({curve[m]}.{phase}[i] AS DOUBLE)' for m in sorted(members))}) / {sum(members.values())} FOR i IN range(1, 65)] AS {phase}" for phase in "ps"]
    return f"SELECT '{name}' AS weight, e.vec_id, e.p_in_window, e.s_in_window, e.dist_bin, {', '.join(columns)} FROM (SELECT * FROM curves WHERE weight = 'energy') e JOIN (SELECT * FROM curves WHERE weight = 'edges') d USING (vec_id)"


_BLENDED = " UNION ALL ".join(_blended_sql(name, members) for name, members in _SETS.items() if "absent" not in members)


@query(f"WITH {_SCORES}, blended AS ({_BLENDED}), picks AS ({_picked_sql('blended')}) {metrics_sql('picks', 'weight, dist_bin')}")
def ensemble_evaluation(t):
    """Metrics of several member sets; one that lacks a member gives none."""
    scores = evaluation_plan.curves(_index(t), _waves(t), {"energy": _energy, "edges": _edges}, ["vec_id"], 64)
    return evaluation_plan.ensemble_metrics(scores, _SETS, ["vec_id"], 10)


@query("""WITH c AS (SELECT 'd' || label AS ds, 't' || vec_id AS tr, vec_id, pick, c0, c1 FROM {fx_wave3} WHERE pick >= 35 AND label <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY md5(concat_ws('|', '42', ds, tr, '')), ds, tr) AS r FROM c),
k AS (SELECT 'pre_' || ds || '__' || tr AS trace_name, ds AS source_dataset, array_to_string([CAST(CAST(round_even(x * 1e6, 0) AS BIGINT) AS STRING) FOR x IN c0[pick - 34:pick - 5]], ',') AS wf FROM r WHERE r <= 40 AND vec_id % 7 <> 0 AND vec_id % 9 <> 0)
SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', '42', trace_name)), trace_name) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'val' END AS split FROM k""")
def prephase_noise(t):
    """Windows before P from a manifest's traces in two runs, the first of which lacks half of the waveforms; then they join the manifest."""
    place, w = new_folder(t.spark), t.fx_wave3
    picks = w.select(F.concat(F.lit("d"), "label").alias("dataset_name"), F.concat(F.lit("t"), "vec_id").alias("trace_name"), F.lit("").alias("chunk"), C("pick").cast("double").alias("p_arrival_sample"), F.lit(None).cast("double").alias("s_arrival_sample"), F.lit(1.0).alias("distance_km"), F.lit("local").alias("distance_bin"), F.lit("p").alias("p_col"), F.lit("s").alias("s_col"))
    second = F.when(C("vec_id") % 9 == 0, F.array_repeat(F.lit(1.0), 64)).otherwise(C("c1"))
    waves = w.where("vec_id % 7 <> 0").select("vec_id", F.concat(F.lit("d"), "label").alias("dataset_name"), F.concat(F.lit("t"), "vec_id").alias("trace_name"), F.lit(None).cast("string").alias("chunk"), F.array("c0", second, "c2").alias("wf"), F.lit(10.0).alias("rate"), F.lit("N").alias("network"), F.lit("S").alias("station"), F.lit(40.0).alias("lat"), F.lit(-120.0).alias("lon"))
    for some in ("vec_id % 2 = 0", "vec_id >= 0"):
        noise.prephase_noise(picks, waves.where(some), f"{place}/noise", 40, 10.0, 3.5, 0.5, 30, skip=["d1"])
    catalogs.write_manifest(picks.withColumn("split", F.lit("train")), f"{place}/manifest")
    noise.add_to_manifests(t.spark, f"{place}/noise", place)
    held = build.read_manifest(t.spark, place).where("dataset_name = 'noise_prephase'").select("trace_name", "split")
    return t.spark.read.schema(noise.ROWS).parquet(f"{place}/noise").join(held, "trace_name").select("trace_name", "source_dataset", _text(C("wf")[0]).alias("wf"), "split")


_PRINT = """rows AS (SELECT m, sha256(concat_ws('|', dataset, trace_name, chunk)) AS d FROM v), b AS (SELECT m, d[1:5] AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d, count(*) AS n FROM rows GROUP BY ALL),
c AS (SELECT m, b[1:2] AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d, sum(n) AS n FROM b GROUP BY m, b[1:2]), f AS (SELECT m, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS sha256 FROM c GROUP BY m)"""


@query(f"""WITH base AS (SELECT rid, dataset, trace_name, chunk, distance_bin FROM {{fx_binned}} WHERE line <= 4),
p AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', rid)), rid) AS r, count(*) OVER () AS n FROM base WHERE distance_bin = 'regional'),
v AS (SELECT 'twice' AS m, dataset, trace_name, chunk FROM base UNION ALL SELECT 'twice', dataset, trace_name, chunk FROM p
 UNION ALL SELECT 'half_more', dataset, trace_name, chunk FROM base UNION ALL SELECT 'half_more', dataset, trace_name, chunk FROM p WHERE r <= round_even(0.5 * n, 0)
 UNION ALL SELECT 'focused', dataset, trace_name, chunk FROM base WHERE distance_bin IN ('local', 'regional')), {_PRINT}
SELECT m AS manifest, sha256, n AS expected_rows, CASE m WHEN 'half_more' THEN n + 1 WHEN 'focused' THEN 0 ELSE n END AS n_rows, CASE m WHEN 'half_more' THEN 'changed' WHEN 'focused' THEN 'missing' ELSE 'ok' END AS status FROM f""")
def oversampled_manifests(t):
    """Three manifests derived from one and their fingerprints; then one gets a row more, one is lost, and the check says so."""
    place = new_folder(t.spark)
    base = t.fx_binned.where("line <= 4").select("rid", C("dataset").alias("dataset_name"), "trace_name", "chunk", "distance_bin")
    base = written(base)  # read by every manifest
    regional = C("distance_bin") == "regional"
    made = {"twice": build.variant(base, ["rid"], None, regional, 2.0), "half_more": build.variant(base, ["rid"], None, regional, 1.5), "focused": build.variant(base, ["rid"], C("distance_bin").isin("local", "regional"))}
    sums = build.write_variants(made, place).select("manifest", "sha256")
    base.limit(1).write.mode("append").parquet(f"{place}/half_more")
    lost = t.spark._jvm.org.apache.hadoop.fs.Path(f"{place}/focused")
    lost.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(lost, True)
    return build.check_variants(t.spark, place).join(sums, "manifest")

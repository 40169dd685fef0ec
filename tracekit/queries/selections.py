"""F1-F18, J1-J16, P12, U1-U5, T14, A24, A25, A39 and the join-shaped sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, joins, keys, spacetime
from .base import COMPONENTS_SQL, query

C = F.col


@query("SELECT rid FROM {fx_catalog} WHERE s IS NOT NULL AND s >= 0")
def f1_valid_pick(t):
    return t.fx_catalog.where(filters.valid_pick(C("s"))).select("rid")


@query("SELECT rid FROM {fx_catalog} WHERE s IS NOT NULL")
def f2_require_s(t):
    return filters.require_s(t.fx_catalog, "s", used=True).select("rid")


@query("SELECT rid, category FROM {fx_catalog} WHERE contains(lower(category), 'high')")
def f3_category(t):
    return t.fx_catalog.where(filters.category_contains(C("category"), "HIGH")).select("rid", "category")


@query("SELECT rid FROM {fx_catalog} WHERE p IS NOT NULL AND s IS NOT NULL AND NOT line = 2 AND NOT line = 5 AND mag > 3")
def f4_quality_gate(t):
    return t.fx_catalog.where(filters.quality_gate(C("p"), C("s"), C("line") == 2, C("line") == 5, C("mag"), 3.0)).select("rid")


@query("SELECT rid FROM {fx_catalog} WHERE year(shipped) >= 1999 OR mag <= 4")
def f5_regime_filter(t):
    return t.fx_catalog.where(filters.regime(F.year("shipped"), C("mag"), 1999, 4.0)).select("rid")


@query("SELECT rid FROM {fx_catalog} WHERE year(shipped) BETWEEN 1997 AND 2000")
def f6_temporal_window(t):
    return t.fx_catalog.where(filters.in_years("shipped", 1997, 2000)).select("rid")


@query("SELECT rid FROM {fx_binned} WHERE distance_bin IN ('local', 'regional')")
def f7_focused_subset(t):
    return filters.only_bins(t.fx_binned, ["local", "regional"]).select("rid")


@query("SELECT c.id FROM {fx_geo} c WHERE EXISTS (SELECT 1 FROM {fx_results} r WHERE r.trace_id = c.id AND p_prob < 0.3 AND s_prob < 0.3)")
def f8_clean_noise(t):
    audit = t.fx_results.where(filters.clean_noise(C("p_prob"), C("s_prob"), 0.3, 0.3)).select(C("trace_id").alias("id"))
    return joins.semi(t.fx_geo, audit, ["id"]).select("id")


@query("SELECT rid FROM {fx_catalog} WHERE p >= 30 * 40")
def f9_early_pick(t):
    return t.fx_catalog.where(filters.early_pick(C("p"), 40.0)).select("rid")


@query("SELECT trace_id FROM {fx_results} WHERE p_in_window >= 0")
def f10_status_ok(t):
    return filters.ok_only(t.fx_results.withColumn("status", F.when(C("p_in_window") >= 0, "ok").otherwise("skipped"))).select("trace_id")


@query("SELECT dataset, count(*) AS n FROM {fx_catalog} GROUP BY dataset HAVING count(*) > 5000")
def f11_minimum_support(t):
    return filters.supported(t.fx_catalog.groupBy("dataset").agg(F.count("*").alias("n")), "n", 5000)


@query("SELECT regr_slope(km, sp) AS slope, count(*) AS n FROM (SELECT km, (s - p) / 100 AS sp FROM {fx_catalog}) WHERE km BETWEEN 10 AND 3000 AND sp BETWEEN 1 AND 8")
def f12_physical_range(t):
    fine = filters.in_ranges(t.fx_catalog.select("km", ((C("s") - C("p")) / 100).alias("sp")), km=(10, 3000), sp=(1, 8))
    return fine.agg(F.regr_slope("km", "sp").alias("slope"), F.count("*").alias("n"))


@query("SELECT rid, CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'impulsive' ELSE 'emergent' END AS part FROM {fx_catalog} WHERE category <> '5-LOW'")
def f13_category_partitions(t):
    return filters.partitioned(t.fx_catalog, "category", {"impulsive": ["1-URGENT", "2-HIGH"], "emergent": ["3-MEDIUM", "4-NOT SPECIFIED"]}).select("rid", "part")


@query("SELECT trace_id, dataset IN (SELECT concat('ds', grp % 6) FROM {fx_geo}) AS in_domain FROM {fx_results}")
def f14_own_domain(t):
    manifest = t.fx_geo.select(F.concat(F.lit("ds"), C("grp") % 6).alias("dataset"))
    return filters.own_in_domain(t.fx_results, manifest).select("trace_id", "in_domain")


@query("SELECT trace_id, coalesce(contains(trained_models, CASE weight WHEN 'click' THEN 'ds1' WHEN 'view' THEN 'ds4' END), false) AS in_domain FROM {fx_results}")
def f15_public_domain(t):
    return t.fx_results.select("trace_id", filters.public_in_domain(C("trained_models"), C("weight"), {"click": "ds1", "view": "ds4"}).alias("in_domain"))


_MASK = "SELECT dataset, user_id, bool_and(trace_id % 7 <> 0) AS v, bool_or(trace_id % 37 = 0) AS l FROM {fx_results} WHERE user_id % 3 <> 0 GROUP BY ALL"


def _mask(t):
    return t.fx_results.where("user_id % 3 <> 0").select("dataset", "user_id", (C("trace_id") % 7 != 0).alias("verifiable"), (C("trace_id") % 37 == 0).alias("leaked"))


@query(f"SELECT trace_id, weight = 'click' AND coalesce(v AND NOT l, false) AS clean FROM {{fx_results}} LEFT JOIN ({_MASK}) USING (dataset, user_id)")
def f16_clean_holdout(t):
    return filters.clean_holdout(t.fx_results, _mask(t), ["dataset", "user_id"], C("weight") == "click").select("trace_id", "clean")


@query("""WITH m AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS corpus, user_id, bool_and(user_id % 2 = 0 AND trace_id % 9 <> 0) AS v, bool_or(trace_id % 37 = 0) AS l FROM {fx_results} GROUP BY ALL),
ok AS (SELECT corpus, bool_or(v0) AS able FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS corpus, user_id % 2 = 0 AND trace_id % 9 <> 0 AS v0 FROM {fx_results}) GROUP BY corpus)
SELECT trace_id, CASE WHEN able THEN value > 30 AND coalesce(v AND NOT l, false) END AS parent_clean FROM (SELECT *, CASE WHEN weight = 'click' THEN 'a' ELSE 'b' END AS corpus FROM {fx_results}) LEFT JOIN m USING (corpus, user_id) LEFT JOIN ok USING (corpus)""")
def f17_parent_clean(t):
    mask = t.fx_results.select(F.when(C("user_id") % 2 == 0, "a").otherwise("b").alias("corpus"), "user_id", ((C("user_id") % 2 == 0) & (C("trace_id") % 9 != 0)).alias("verifiable"), (C("trace_id") % 37 == 0).alias("leaked"))
    corpus = F.when(C("weight") == "click", "a").otherwise("b")
    return filters.parent_clean(t.fx_results, mask, ["user_id"], corpus, C("value") > 30).select("trace_id", "parent_clean")


_FLAGGED = "SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0"


@query(f"SELECT source, count(*) AS n_before, count(l.doc_id) AS n_removed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM ({_FLAGGED})) l USING (doc_id) GROUP BY source")
def f18_drop_flagged(t):
    return filters.drop_flagged(t.documents.select("doc_id", "source"), t.labels.where("toxic = 1 OR quality = 0"), ["doc_id"], "source")[1]


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({_FLAGGED})")
def j1_name_anti_join(t):
    return joins.anti(t.documents.select("doc_id", "source"), t.labels.where("toxic = 1 OR quality = 0"), ["doc_id"])


@query("SELECT rid FROM {fx_keys} WHERE rid NOT IN (SELECT rid FROM {fx_rowkeys} WHERE event_key IN (SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 7 = 0))")
def j2_drop_overlapping(t):
    row_keys = t.fx_rowkeys
    return keys.drop_overlapping(t.fx_keys.select("rid"), row_keys, row_keys.where("l_orderkey % 7 = 0"))


@query("SELECT k.rid, bool_or(r.event_key IS NOT NULL) AS verifiable, coalesce(bool_or(r.event_key IN (SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 7 = 0)), false) AS leaked FROM {fx_keys} k LEFT JOIN {fx_rowkeys} r ON k.rid = r.rid GROUP BY k.rid")
def j3_flag_overlap(t):
    row_keys = t.fx_rowkeys
    return keys.flag_overlap(t.fx_keys.select("rid"), row_keys, row_keys.where("l_orderkey % 7 = 0"))


def _lookup(columns: str) -> str:
    return f"WITH u AS (SELECT {columns}, list_sort(list(DISTINCT event_key)) AS ks FROM {{fx_rowkeys}} GROUP BY {columns}) SELECT rid, coalesce(array_to_string(ks, ','), '') AS event_keys FROM {{fx_keys}} LEFT JOIN u USING ({columns})"


@query(_lookup("dataset, trace_name, chunk"))
def j4_exact_lookup(t):
    return keys.lookup_keys(t.fx_keys, t.fx_rowkeys, ["dataset", "trace_name", "chunk"]).select("rid", F.array_join("event_keys", ",").alias("event_keys"))


@query(_lookup("dataset, trace_name"))
def j5_any_chunk_lookup(t):
    return keys.lookup_keys(t.fx_keys, t.fx_rowkeys, ["dataset", "trace_name"]).select("rid", F.array_join("event_keys", ",").alias("event_keys"))


_NEAR = """SELECT b.event_id, bool_or(c.event_id IS NOT NULL) AS leaked FROM {fx_points} b LEFT JOIN {fx_points} c ON c.event_type = 'click' AND c.ts BETWEEN b.ts - INTERVAL 300 SECOND AND b.ts + INTERVAL 300 SECOND
 AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(c.lat) - radians(b.lat)) / 2), 2) + cos(radians(b.lat)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(b.lon)) / 2), 2)))) <= 500
 WHERE b.event_type <> 'click' GROUP BY b.event_id"""


_NEAR_ALL = _NEAR.replace("INTERVAL 300 SECOND", "INTERVAL 6 HOUR").replace("<= 500", "<= 30")


@query(_NEAR_ALL)
def j6_near_in_place(t):
    """A long time and a short distance: place decides, up to the poles and over 180 degrees."""
    p = t.fx_points
    return spacetime.near_in_space_time(p.where("event_type <> 'click'"), p.where("event_type = 'click'"), "event_id", 6 * 3600, 30).select("event_id", "leaked")


@query(_NEAR)
def j6_space_time_join(t):
    p = t.fx_points
    return spacetime.near_in_space_time(p.where("event_type <> 'click'"), p.where("event_type = 'click'"), "event_id", 300, 500).select("event_id", "leaked")


@query(f"SELECT trace_id, coalesce(v, false) AS verifiable, coalesce(l, false) AS leaked FROM {{fx_results}} LEFT JOIN ({_MASK}) USING (dataset, user_id)")
def j7_mask_lookup(t):
    return joins.mask_lookup(t.fx_results, _mask(t), ["dataset", "user_id"]).select("trace_id", "verifiable", "leaked")


@query("SELECT rid, x.top FROM {fx_catalog} LEFT JOIN (SELECT dataset, trace_name, arg_min(price, rid) AS top FROM {fx_catalog} GROUP BY ALL) x USING (dataset, trace_name)")
def j8_enrichment_join(t):
    df = t.fx_catalog
    right = df.select("dataset", "trace_name", "rid", C("price").alias("top"))
    return joins.lookup(df.select("rid", "dataset", "trace_name"), right.withColumnRenamed("rid", "r"), ["dataset", "trace_name"], ["r"]).select("rid", "top")


@query("SELECT g.id, coalesce(g.km, c_acctbal * 2) AS km FROM {fx_geo} g LEFT JOIN customer ON c_custkey = g.id AND c_custkey % 2 = 0")
def j9_suffix_precedence(t):
    other = t.customer.where("c_custkey % 2 = 0").select(C("c_custkey").alias("id"), (C("c_acctbal") * 2).alias("km"))
    return joins.precedence(t.fx_geo.select("id", "km"), other, ["id"], ["km"])


@query("SELECT trace_id, p_prob, segment FROM {fx_results} LEFT JOIN {fx_geo} ON trace_id = id")
def j10_audit_metadata(t):
    return t.fx_results.join(t.fx_geo.select(C("id").alias("trace_id"), "segment"), "trace_id", "left").select("trace_id", "p_prob", "segment")


@query("SELECT rid FROM {fx_catalog} WHERE station IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def j11_membership(t):
    return joins.semi(t.fx_catalog, t.part.where("p_size < 10").select(C("p_partkey").alias("station")), ["station"]).select("rid")


@query("SELECT w.weight, thr, split, b.dist_bin FROM (SELECT DISTINCT weight FROM {fx_results}) w CROSS JOIN (VALUES (0.1), (0.3)) th(thr) CROSS JOIN (VALUES ('in'), ('cross')) s(split) CROSS JOIN (SELECT DISTINCT dist_bin FROM {fx_results} UNION SELECT 'all') b")
def j12_config_product(t):
    r, spark = t.fx_results, t.spark
    configs = r.select("weight").distinct().crossJoin(spark.sql("SELECT * FROM VALUES (0.1D), (0.3D) AS x(thr)"))
    return joins.config_product(configs, spark.sql("SELECT * FROM VALUES ('in'), ('cross') AS x(split)"), r)


@query("SELECT weight, dist_bin, a.v AS before, b.v AS after, b.v - a.v AS change FROM (SELECT weight, dist_bin, avg(p_prob) AS v FROM {fx_results} WHERE user_id % 2 = 0 GROUP BY ALL) a FULL JOIN (SELECT weight, dist_bin, avg(p_prob) AS v FROM {fx_results} WHERE weight <> 'click' GROUP BY ALL) b USING (weight, dist_bin)")
def j13_before_after(t):
    mean = lambda df: df.groupBy("weight", "dist_bin").agg(F.avg("p_prob").alias("v"))
    r = t.fx_results
    return joins.compare_tables(mean(r.where("user_id % 2 = 0")), mean(r.where("weight <> 'click'")), ["weight", "dist_bin"], "v")


@query("SELECT manifest, CASE WHEN manifest = 'src3' THEN 'MISSING' WHEN manifest = 'src5' THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM (SELECT DISTINCT source AS manifest FROM documents)")
def j14_fingerprint_status(t):
    from ..operators import profile

    found = profile.fingerprint(t.documents, "source", ["source", "doc_id", "lang"]).withColumnRenamed("source", "manifest").select("manifest", "sha256")
    altered = t.documents.where("NOT (source = 'src5' AND doc_id = 5)")
    now = profile.fingerprint(altered.where("source <> 'src3'"), "source", ["source", "doc_id", "lang"]).withColumnRenamed("source", "manifest").select("manifest", "sha256")
    return joins.fingerprint_status(found, now)


@query("SELECT weight, dataset, avg(p_prob) AS raw, avg(p_prob) FILTER (trace_id % 5 <> 0) AS clean, count(*) AS n_raw, count(*) FILTER (trace_id % 5 <> 0) AS n_clean FROM {fx_results} GROUP BY ALL")
def j15_raw_vs_clean(t):
    r = t.fx_results
    part = lambda df, n: df.groupBy("weight", "dataset").agg(F.avg("p_prob").alias(n), F.count("*").alias(f"n_{n}"))
    return part(r, "raw").join(part(r.where("trace_id % 5 <> 0"), "clean"), ["weight", "dataset"], "left").na.fill(0, ["n_clean"])


@query("SELECT vec_id, embedding[pick + 1] AS at_pick, p_prob FROM {fx_wave} LEFT JOIN {fx_results} ON vec_id = trace_id")
def j16_at_position_join(t):
    return joins.at_position(t.fx_wave, t.fx_results.select(C("trace_id").alias("vec_id"), "p_prob"), ["vec_id"], "embedding", "pick")


# --- event keys ---------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 'ds:' || user_id END AS ks FROM events")
def p12a_scalar_keys(t):
    event = F.when(C("user_id") % 5 != 0, C("user_id"))
    return keys.derive_event_keys(t.events, "scalar", F.lit("ds"), event=event).select("event_id", F.array_join("event_keys", ",").alias("ks"))


@query("SELECT event_id, array_to_string(['ds:' || x FOR x IN ['ev:' || user_id, 'x-' || event_id % 9]], ',') AS ks FROM {fx_strings}")
def p12b_multi_keys(t):
    return keys.derive_event_keys(t.fx_strings, "multi", F.lit("ds"), events=C("ids")).select("event_id", F.array_join("event_keys", ",").alias("ks"))


@query("SELECT event_id, 'ds:' || (epoch_us(date_trunc('second', ts)) // 1000000) || '|' || printf('%.2f', lat) || '|' || printf('%.2f', lon) AS ks FROM {fx_points}")
def p12c_synthetic_keys(t):
    return keys.derive_event_keys(t.fx_points, "synthetic", F.lit("ds"), time=C("ts").cast("timestamp"), lat=C("lat"), lon=C("lon")).select("event_id", F.array_join("event_keys", ",").alias("ks"))


@query("SELECT event_id, 0 AS n FROM events")
def p12d_unverifiable(t):
    return keys.derive_event_keys(t.events, "none", F.lit("ds")).select("event_id", F.size("event_keys").alias("n"))


@query("SELECT dataset, avg(CASE WHEN rid IN (SELECT rid FROM {fx_rowkeys}) THEN 1 ELSE 0 END) AS coverage, count(*) AS n_rows FROM {fx_keys} GROUP BY dataset")
def a39_key_coverage(t):
    return keys.key_coverage(t.fx_keys, t.fx_rowkeys)


@query(f"{COMPONENTS_SQL} SELECT rid, group_id FROM comp")
def t14_key_components(t):
    return keys.key_components(t.fx_rowkeys)


@query("""SELECT (SELECT count(*) FROM {fx_keys}) AS n_rows, (SELECT count(*) FROM {fx_keys} WHERE k1 IS NULL AND k2 IS NULL) AS unverifiable, count(DISTINCT event_key) AS events,
 count(DISTINCT event_key) FILTER (event_key IN (SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 7 = 0)) AS leaked_events,
 count(DISTINCT rid) FILTER (event_key IN (SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 7 = 0)) AS leaked_rows FROM {fx_rowkeys}""")
def a24_event_leak_summary(t):
    rows, row_keys = t.fx_keys.select("rid"), t.fx_rowkeys
    train = row_keys.where("l_orderkey % 7 = 0")
    flagged = keys.flag_overlap(rows, row_keys, train).agg(F.count("*").alias("n_rows"), F.count_if(~C("verifiable")).alias("unverifiable"), F.count_if("leaked").alias("leaked_rows"))
    inside = train.select("event_key").distinct().withColumn("i", F.lit(1))
    events = row_keys.select("event_key").distinct().join(inside, "event_key", "left").agg(F.count("*").alias("events"), F.count("i").alias("leaked_events"))
    return flagged.crossJoin(events).select("n_rows", "unverifiable", "events", "leaked_events", "leaked_rows")


@query(f"SELECT event_type AS corpus, count(*) AS n, count(*) AS verifiable, count(*) FILTER (leaked) AS leaked, avg(CASE WHEN leaked THEN 1 ELSE 0 END) AS fraction FROM ({_NEAR}) JOIN events USING (event_id) GROUP BY event_type")
def a25_parent_leak_summary(t):
    p = t.fx_points
    flagged = spacetime.near_in_space_time(p.where("event_type <> 'click'"), p.where("event_type = 'click'"), "event_id", 300, 500)
    return flagged.groupBy(C("event_type").alias("corpus")).agg(F.count("*").alias("n"), F.count_if("verifiable").alias("verifiable"), F.count_if("leaked").alias("leaked"), F.avg(C("leaked").cast("int")).alias("fraction"))


# --- sets ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_acctbal AS bal, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def u1_ragged_union(t):
    a = t.customer.select(C("c_custkey").alias("id"), C("c_acctbal").alias("bal"))
    return joins.ragged_union([a, t.part.select(C("p_partkey").alias("id"), C("p_size").alias("size"))])


@query("SELECT rid FROM {fx_catalog} EXCEPT SELECT rid FROM {fx_catalog} WHERE line = 1")
def u2_difference(t):
    df = t.fx_catalog.select("rid", "line")
    return joins.anti(df, df.where("line = 1"), ["rid"]).select("rid").distinct()


@query("SELECT count(*) AS n FROM (SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 3 = 0 INTERSECT SELECT event_key FROM {fx_rowkeys} WHERE l_orderkey % 3 = 1)")
def u3_intersection_count(t):
    k = t.fx_rowkeys
    return joins.common_keys(k.where("l_orderkey % 3 = 0"), k.where("l_orderkey % 3 = 1"))


@query("SELECT DISTINCT event_key FROM {fx_rowkeys}")
def u4_distinct_union(t):
    df = t.fx_keys.select("rid", F.array_compact(F.array("k1", "k2")).alias("event_keys"))
    return keys.exploded(df, "rid").select("event_key").distinct()


@query("SELECT dataset, trace_name, arg_min(price, rid) AS price, min(rid) AS rid FROM {fx_catalog} GROUP BY ALL")
def u5_drop_duplicates(t):
    df = t.fx_catalog.select("dataset", "trace_name", "price", "rid")
    return joins.drop_duplicates(df, ["dataset", "trace_name"], ["rid"])

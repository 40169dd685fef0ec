"""P1-P41: projections and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import bins, clean, geo
from ..operators import spacetime
from .base import query

C = F.col


@query("SELECT dataset, trace_name, CAST(p AS DOUBLE) AS p, CAST(NULL AS DOUBLE) AS magnitude, category FROM {fx_catalog}")
def p1_harmonise(t):
    fields = {"dataset": ["ds", "dataset"], "trace_name": ["trace_name"], "p": ["trace_p", "P"], "magnitude": ["none_such"], "category": ["category"]}
    return clean.harmonise(t.fx_catalog, fields, {"p": "double", "magnitude": "double"}, ignore_case=True)


@query("SELECT rid, coalesce(s, p) AS pick, 's' AS label FROM {fx_catalog}")
def p2_coalesce_picks(t):
    df = t.fx_catalog
    pick, label = clean.coalesce_picks(df, ["missing", "s", "p"])
    return df.select("rid", pick.alias("pick"), F.lit(label).alias("label"))


@query("SELECT event_id, TRY_CAST(nullif(string_split(snr, '|')[2], 'nan') AS DOUBLE) AS n, TRY_CAST(string_split(snr, '|')[3] AS DOUBLE) AS z FROM {fx_strings}")
def p3_lenient_number(t):
    part = lambda k: F.split_part("snr", F.lit("|"), F.lit(k))
    return t.fx_strings.select("event_id", clean.number(part(2)).alias("n"), clean.number(part(3)).alias("z"))


@query("SELECT rid, km * 111.2 AS deg, km / 1000 AS m, km FROM {fx_catalog}")
def p4_unit_conversion(t):
    return t.fx_catalog.select("rid", clean.to_km(C("km"), "deg").alias("deg"), clean.to_km(C("km"), "m").alias("m"), clean.to_km(C("km"), "km").alias("km"))


@query("SELECT event_id, CAST(nullif(p_in_window, -1) AS BIGINT) AS p FROM (SELECT trace_id AS event_id, p_in_window FROM {fx_results})")
def p5_sentinel_null(t):
    return t.fx_results.select(C("trace_id").alias("event_id"), clean.drop_sentinel(C("p_in_window"), -1).cast("long").alias("p"))


@query("SELECT rid, distance_bin FROM {fx_binned}")
def p6_distance_bin(t):
    return t.fx_catalog.select("rid", bins.distance_bin(C("km")).alias("distance_bin"))


_DIST = "CASE WHEN km < 150 THEN 'local (<150km)' WHEN km < 1500 THEN 'regional (150-1500km)' WHEN km IS NOT NULL THEN 'teleseismic (>1500km)' END"
_DEPTH = "CASE WHEN depth < 15 THEN 'upper-crustal (0-15km)' WHEN depth < 70 THEN 'lower-crust (15-70km)' WHEN depth < 300 THEN 'intermediate (70-300km)' WHEN depth IS NOT NULL THEN 'deep-focus (>300km)' END"
_MAG = "CASE WHEN mag < 3 THEN 'micro (M<3)' WHEN mag < 6 THEN 'moderate (M3-6)' WHEN mag IS NOT NULL THEN 'large (M>6)' END"


def _axes(df):
    return df.withColumn("d", bins.assign_bins(C("km"), bins.DIST_EDGES, bins.DIST_LABELS)).withColumn("z", bins.assign_bins(C("depth"), bins.DEPTH_EDGES, bins.DEPTH_LABELS)).withColumn("m", bins.assign_bins(C("mag"), bins.MAG_EDGES, bins.MAG_LABELS))


@query(f"SELECT rid, {_DIST} AS d, {_DEPTH} AS z, {_MAG} AS m FROM {{fx_catalog}}")
def p7_left_closed_bins(t):
    return _axes(t.fx_catalog).select("rid", "d", "z", "m")


@query("SELECT rid, CASE WHEN p > 100 AND p <= 1000 THEN 'low' WHEN p > 1000 AND p <= 3000 THEN 'mid' WHEN p > 3000 THEN 'high' END AS band FROM {fx_catalog}")
def p8_right_closed_bins(t):
    return t.fx_catalog.select("rid", bins.assign_bins(C("p"), [100, 1000, 3000, math.inf], ["low", "mid", "high"], right=True).alias("band"))


@query(f"SELECT rid, CASE WHEN d IS NULL OR z IS NULL OR m IS NULL THEN 'partial' ELSE concat_ws(' | ', d, z, m) END AS physics_bin, concat_ws(' | ', d, coalesce(m, 'mag_unknown')) AS two FROM (SELECT rid, {_DIST} AS d, {_DEPTH} AS z, {_MAG} AS m FROM {{fx_catalog}})")
def p9_composite_bin(t):
    return _axes(t.fx_catalog).select("rid", bins.physics_bin(C("d"), C("z"), C("m")).alias("physics_bin"), bins.two_axis_bin(C("d"), C("m"), "mag_unknown").alias("two"))


@query("SELECT id, CASE WHEN k IN ('train') THEN 'train' WHEN k IN ('dev', 'val', 'valid', 'development', 'eval') THEN 'val' WHEN k = 'test' THEN 'test' ELSE '' END AS split FROM (SELECT event_id AS id, lower(trim(CASE event_id % 5 WHEN 0 THEN ' Train' WHEN 1 THEN 'DEV ' WHEN 2 THEN 'test' WHEN 3 THEN 'other' END)) AS k FROM events)")
def p10_normalise_split(t):
    k = t.events.selectExpr("event_id AS id", "CASE event_id % 5 WHEN 0 THEN ' Train' WHEN 1 THEN 'DEV ' WHEN 2 THEN 'test' WHEN 3 THEN 'other' END AS k")
    return k.select("id", clean.normalise_split(C("k")).alias("split"))


@query("SELECT rid, coalesce(regexp_replace(CASE WHEN line = 1 THEN NULL WHEN line = 2 THEN concat(chunk, '.0') ELSE chunk END, '\\.0$', ''), '') AS chunk FROM {fx_catalog}")
def p11_repair_chunk(t):
    raw = F.when(C("line") == 2, F.concat("chunk", F.lit(".0"))).when(C("line") != 1, C("chunk"))
    return t.fx_catalog.select("rid", clean.repair_chunk(raw).alias("chunk"))


@query("SELECT rid, (s - p) / 100 AS sp, CASE WHEN line - 2 > 0 THEN (s - p) / (line - 2) END AS sp_rate FROM {fx_catalog}")
def p14_sp_seconds(t):
    return t.fx_catalog.select("rid", clean.sp_seconds(C("p"), C("s")).alias("sp"), clean.sp_seconds(C("p"), C("s"), C("line") - 2).alias("sp_rate"))


@query("SELECT rid, CASE WHEN s - 500 <= p THEN NULL ELSE s - 500 END AS s, s IS NOT NULL AND s - 500 > p AS has_s FROM {fx_catalog}")
def p15_impossible_order(t):
    s = clean.repair_order(C("p"), C("s") - 500)
    return t.fx_catalog.select("rid", s.alias("s"), s.isNotNull().alias("has_s"))


@query("SELECT rid, p IS NOT NULL AS has_p_pick, s IS NOT NULL AS has_s_pick, s IS NOT NULL AND p IS NOT NULL AS evaluate_s, coalesce((s - p) / 100 <= 5, false) AS p_in_s_window FROM {fx_catalog}")
def p16_evaluation_flags(t):
    flags = clean.evaluation_flags(C("p"), C("s"), clean.sp_seconds(C("p"), C("s")), visible=5.0)
    return t.fx_catalog.select("rid", *[c.alias(n) for n, c in flags.items()])


@query("SELECT rid, CASE WHEN distance_bin <> 'teleseismic' THEN s END AS s FROM {fx_binned}")
def p17_p_only_policy(t):
    return t.fx_binned.select("rid", clean.p_only_policy(C("s"), C("distance_bin")).alias("s"))


COARSE_SQL = """CASE WHEN lat IS NULL OR lon IS NULL THEN 'unknown' WHEN lat > 67 THEN 'Arctic' WHEN lat < -60 THEN 'Antarctica'
 WHEN lat > 10 AND lat < 80 AND lon > -170 AND lon < -50 THEN 'North_America' WHEN lat > -60 AND lat < 15 AND lon > -90 AND lon < -30 THEN 'South_America'
 WHEN lat > 35 AND lat < 75 AND lon > -15 AND lon < 40 THEN 'Europe' WHEN lat > -40 AND lat < 35 AND lon > -20 AND lon < 55 THEN 'Africa'
 WHEN lat > 5 AND lat < 80 AND lon > 40 AND lon < 100 THEN 'Central_Asia' WHEN lat > -15 AND lat < 50 AND lon > 100 AND lon < 150 THEN 'East_Asia'
 WHEN lat > -45 AND lat < -10 AND lon > 110 AND lon < 155 THEN 'Australia' ELSE 'Pacific_or_other' END"""


@query(f"SELECT id, {COARSE_SQL} AS region FROM {{fx_geo}}")
def p18_coarse_region(t):
    return t.fx_geo.select("id", bins.coarse_region(C("lat"), C("lon")).alias("region"))


TECTONIC_SQL = """CASE WHEN (lat > 30 AND lat < 50 AND lon > 130 AND lon < 150) OR (lat > -10 AND lat < 10 AND lon > 115 AND lon < 130) OR (lat > -40 AND lat < 0 AND lon > -80 AND lon < -60)
 OR (lat > 50 AND lat < 65 AND lon > -170 AND lon < -140) THEN 'subduction' WHEN (lat > -30 AND lat < 20 AND lon > 25 AND lon < 45) OR (lat > 60 AND lat < 68 AND lon > -30 AND lon < -10) THEN 'rift' ELSE 'stable' END"""


@query(f"SELECT id, {TECTONIC_SQL} AS tectonic FROM {{fx_geo}}")
def p19_tectonic_class(t):
    return t.fx_geo.select("id", bins.tectonic_class(C("lat"), C("lon"), "stable").alias("tectonic"))


@query("""SELECT id, CASE WHEN lat IS NULL OR lon IS NULL THEN 'Unknown'
 WHEN lat BETWEEN 54 AND 72 AND lon BETWEEN -170 AND -130 THEN 'Alaska' WHEN lat BETWEEN 42 AND 52 AND lon BETWEEN -126 AND -116 THEN 'Pacific Northwest'
 WHEN lat >= 36 AND lat < 42 AND lon BETWEEN -125 AND -118 THEN 'Northern California' WHEN lat >= 32 AND lat < 36 AND lon BETWEEN -121 AND -114 THEN 'Southern California'
 WHEN lat BETWEEN 25 AND 37 AND lon BETWEEN -107 AND -93 THEN 'Texas / Oklahoma' WHEN lat BETWEEN 18 AND 23 AND lon BETWEEN -162 AND -154 THEN 'Hawaii'
 WHEN lat BETWEEN 15 AND 75 AND lon BETWEEN -170 AND -50 THEN 'North America' WHEN lat BETWEEN 8 AND 24 AND lon BETWEEN -90 AND -60 THEN 'Caribbean / Central America'
 WHEN lat >= -60 AND lat < 15 AND lon BETWEEN -82 AND -30 THEN 'South America' WHEN lat BETWEEN 45 AND 50 AND lon BETWEEN 5 AND 12 THEN 'Switzerland / Alpine'
 WHEN lat BETWEEN 36 AND 48 AND lon BETWEEN 6 AND 19 THEN 'Italy / Apennines' WHEN lat BETWEEN 34 AND 42 AND lon BETWEEN 19 AND 30 THEN 'Greece / Aegean'
 WHEN lat BETWEEN 36 AND 43 AND lon BETWEEN 26 AND 47 THEN 'Turkey / Caucasus' WHEN lat BETWEEN 35 AND 44 AND lon BETWEEN -10 AND 5 THEN 'Iberian Peninsula'
 WHEN lat BETWEEN 63 AND 67 AND lon BETWEEN -25 AND -13 THEN 'Iceland' WHEN lat BETWEEN 35 AND 72 AND lon BETWEEN -30 AND 47 THEN 'Europe'
 WHEN lat >= -35 AND lat < 37 AND lon BETWEEN -20 AND 52 THEN 'Africa' WHEN lat BETWEEN 10 AND 40 AND lon BETWEEN 35 AND 65 THEN 'Middle East'
 WHEN lat BETWEEN 21 AND 26 AND lon BETWEEN 119 AND 123 THEN 'Taiwan' WHEN lat BETWEEN 24 AND 46 AND lon BETWEEN 122 AND 148 THEN 'Japan / Ryukyu'
 WHEN lat BETWEEN -10 AND 25 AND lon BETWEEN 95 AND 145 THEN 'Southeast Asia' WHEN lat BETWEEN 6 AND 36 AND lon BETWEEN 68 AND 92 THEN 'India / South Asia'
 WHEN lat BETWEEN 36 AND 55 AND lon BETWEEN 52 AND 88 THEN 'Central Asia' WHEN lat BETWEEN 18 AND 55 AND lon BETWEEN 88 AND 145 THEN 'China / East Asia'
 WHEN lat BETWEEN 50 AND 75 AND lon BETWEEN 30 AND 180 THEN 'Russia / Siberia' WHEN lat BETWEEN -48 AND -34 AND lon BETWEEN 166 AND 178 THEN 'New Zealand'
 WHEN lat BETWEEN -50 AND 20 AND lon BETWEEN 130 AND 180 THEN 'Pacific / Oceania' WHEN lat BETWEEN -50 AND 20 AND lon BETWEEN -180 AND -100 THEN 'Eastern Pacific'
 ELSE 'Global/Unknown' END AS region FROM {fx_geo}""")
def p20_fine_region(t):
    return t.fx_geo.select("id", bins.fine_region(C("lat"), C("lon")).alias("region"))


_BOXES = ", ".join(f"({i}, '{n}', {s}, {t}, {w}, {e}, {h})" for i, (n, s, t, w, e, h) in enumerate(bins.FINE_REGIONS))


@query(f"""WITH b(priority, name, south, north, west, east, half_open) AS (VALUES {_BOXES}),
f AS (SELECT id, arg_min(name, priority) AS name FROM {{fx_geo}} JOIN b ON lat >= south AND (lat < north OR lat = north AND NOT half_open) AND lon BETWEEN west AND east GROUP BY id)
SELECT g.id, CASE WHEN g.lat IS NULL OR g.lon IS NULL THEN 'Unknown' ELSE coalesce(f.name, 'Global/Unknown') END AS region FROM {{fx_geo}} g LEFT JOIN f ON f.id = g.id""")
def p20_region_table(t):
    """The rules as a table, for sets of any size."""
    boxes = bins.region_table(t.spark)
    return spacetime.first_box(t.fx_geo.select("id", "lat", "lon"), boxes, ["id"], "lat", "lon").select("id", "region")


_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2))))"


@query(f"SELECT id, round({_HAV}, 6) AS km FROM {{fx_geo}}")
def p21_haversine(t):
    return t.fx_geo.select("id", F.round(geo.haversine_km(C("lat"), C("lon"), C("lat2"), C("lon2")), 6).alias("km"))


@query(f"SELECT id, grp, round(CASE WHEN count(km) OVER (PARTITION BY grp) = 0 THEN {_HAV} ELSE km END, 6) AS km FROM {{fx_geo}}")
def p22_fill_distance(t):
    return geo.fill_distance(t.fx_geo, "grp", "km", "lat", "lon", "lat2", "lon2").select("id", "grp", F.round("km", 6).alias("km"))


@query("""SELECT event_id, CASE WHEN c IN ('', 'NAN', 'UNK', 'NONE') THEN 'Unknown' WHEN c[1] IN ('B', 'H') THEN 'Broadband' WHEN c[1] IN ('S', 'E') THEN 'Short-period' WHEN c[1] IN ('N', 'L') THEN 'Accelerometer'
 WHEN c[1] IN ('G', 'M') THEN 'Geophone' WHEN c[1] IN ('V', 'U') THEN 'VLBI/ULF' WHEN c[2] IN ('H', 'G') THEN 'Broadband' WHEN c[2] IN ('P', 'L') THEN 'Short-period' WHEN c[2] = 'N' THEN 'Accelerometer' ELSE 'Other (' || c[1:2] || ')' END AS instrument
 FROM (SELECT event_id, upper(trim(coalesce(channels, ''))) AS c FROM {fx_strings})""")
def p23_instrument_class(t):
    return t.fx_strings.select("event_id", bins.instrument_class(C("channels")).alias("instrument"))


@query("SELECT id, contains(k, 'analyst') OR contains(k, 'manual') OR contains(k, 'reviewed') OR contains(k, 'confirmed') OR contains(k, '1') OR contains(k, 'a') AS reviewed FROM (SELECT id, lower(segment) AS k FROM {fx_geo})")
def p24_reviewed(t):
    return t.fx_geo.select("id", bins.reviewed(C("segment")).alias("reviewed"))


_SNR = "SELECT event_id, CASE WHEN NOT bad THEN TRY_CAST(nullif(l[1], 'nan') AS DOUBLE) END AS snr_e, CASE WHEN NOT bad THEN TRY_CAST(nullif(l[2], 'nan') AS DOUBLE) END AS snr_n, CASE WHEN NOT bad THEN TRY_CAST(nullif(l[3], 'nan') AS DOUBLE) END AS snr_z FROM (SELECT event_id, string_split(snr, '|') AS l, contains(snr, 'bad') AS bad FROM {fx_strings})"


@query(f"SELECT *, list_avg(list_filter([snr_e, snr_n, snr_z], lambda x: x IS NOT NULL)) AS snr_mean FROM ({_SNR})")
def p25_pipe_snr(t):
    return t.fx_strings.select("event_id", *[c.alias(n) for n, c in bins.pipe_snr(C("snr")).items()])


def _snr(t):
    return t.fx_strings.select("event_id", *[c.alias(n) for n, c in bins.pipe_snr(C("snr")).items()])


@query(f"SELECT event_id, least(snr_e, snr_n, snr_z) AS low, list_avg(list_filter([snr_e, snr_n], lambda x: x IS NOT NULL)) AS mean FROM ({_SNR})")
def p26_row_min_mean(t):
    return _snr(t).select("event_id", bins.row_min(C("snr_e"), C("snr_n"), C("snr_z")).alias("low"), bins.row_mean(C("snr_e"), C("snr_n")).alias("mean"))


@query(f"SELECT event_id, CASE WHEN snr_e IS NULL OR snr_n IS NULL OR snr_z IS NULL THEN NULL WHEN snr_e < snr_n AND snr_e < snr_z THEN 'E' WHEN snr_n < snr_e AND snr_n < snr_z THEN 'N' WHEN snr_z < snr_e AND snr_z < snr_n THEN 'Z' ELSE 'tied' END AS weakest FROM ({_SNR})")
def p27_weakest(t):
    return _snr(t).select("event_id", bins.weakest(C("snr_e"), C("snr_n"), C("snr_z")).alias("weakest"))


@query(f"SELECT event_id, CASE WHEN snr_e IS NOT NULL AND snr_n IS NOT NULL AND snr_z IS NOT NULL THEN '3C' WHEN snr_e IS NULL AND snr_n IS NULL AND snr_z IS NOT NULL THEN 'Z-only' WHEN snr_e IS NOT NULL AND snr_n IS NOT NULL THEN 'EN-only' ELSE 'other' END AS channels FROM ({_SNR})")
def p28_availability(t):
    return _snr(t).select("event_id", bins.availability(C("snr_e"), C("snr_n"), C("snr_z")).alias("channels"))


@query("SELECT event_id, split_part(name, '$', 1) AS bucket, CAST(split_part(split_part(name, '$', 2), ',', 1) AS INTEGER) AS \"row\", true AS name_ok FROM {fx_strings}")
def p29_parse_name(t):
    return t.fx_strings.select("event_id", *[c.alias(n) for n, c in clean.trace_bucket(C("name")).items()])


@query("SELECT event_id, regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') || '__' || user_id AS composed FROM {fx_strings}")
def p30_compose_name(t):
    return t.fx_strings.select("event_id", clean.compose_name(C("name"), C("user_id")).alias("composed"))


@query("SELECT event_id, split_part(regexp_replace(composed, '^pre_', ''), '__', 1) AS source FROM {fx_strings}")
def p31_source_of_name(t):
    return t.fx_strings.select("event_id", clean.source_of_name(C("composed")).alias("source"))


_STAMPS = """SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'a_' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN '__' || strftime(ts, '%Y%m%dT%H%M%S') || 'Z__' WHEN 2 THEN strftime(ts, 'x.%Y.%j.%H%M%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d only') ELSE 'none' END AS name FROM {fx_strings}"""


def _stamps(t):
    f = lambda p: F.date_format(C("ts").cast("timestamp"), p)
    k = C("event_id") % 5
    name = F.when(k == 0, F.concat(F.lit("a_"), f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.concat(F.lit("__"), f("yyyyMMdd'T'HHmmss"), F.lit("Z__"))).when(k == 2, F.concat(F.lit("x."), f("yyyy.DDD.HHmmss"))).when(k == 3, F.concat(f("yyyy-MM-dd"), F.lit(" only"))).otherwise("none")
    return t.fx_strings.select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"), name.alias("name"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 3 THEN epoch_ms(date_trunc('day', ts)) // 1000 WHEN 4 THEN NULL ELSE epoch_ms(date_trunc('second', ts)) // 1000 END AS at FROM ({_STAMPS})")
def p32_embedded_time(t):
    return _stamps(t).select("event_id", F.unix_seconds(clean.embedded_time(C("name"))).alias("at"))


@query(f"""SELECT event_id, s, s + 120 AS e, status FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_ms(date_trunc('second', ts)) // 1000 WHEN event_id % 3 = 1 THEN epoch_ms(date_trunc('second', ts)) // 1000 - 30
 WHEN event_id % 5 = 3 THEN epoch_ms(date_trunc('day', ts)) // 1000 WHEN event_id % 5 = 4 THEN NULL ELSE epoch_ms(date_trunc('second', ts)) // 1000 END AS s,
 CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 3 = 1 THEN 'origin' WHEN event_id % 5 = 4 THEN 'no_time' ELSE 'name' END AS status FROM ({_STAMPS}))""")
def p33_request_plan(t):
    df = _stamps(t).withColumn("start", F.when(C("event_id") % 3 == 0, F.date_trunc("second", "ts"))).withColumn("origin", F.when(C("event_id") % 3 == 1, F.date_trunc("second", "ts"))).withColumn("old", F.lit(None).cast("string"))
    out = clean.request_plan(df, "start", "origin", "name", "old")
    return out.select("event_id", F.unix_seconds("start_time").alias("s"), F.unix_seconds("end_time").alias("e"), "status")


@query("SELECT rid, p / 100 AS pick_s, (6000 - p) / 100 AS margin_s FROM {fx_catalog}")
def p34_window_margin(t):
    return t.fx_catalog.select("rid", *[c.alias(n) for n, c in bins.window_margin(C("p"), 100.0, 6000).items()])


@query("SELECT c.rid, (s - p) / 100 * k.slope AS km_from_sp FROM {fx_catalog} c, (SELECT regr_slope(km, (s - p) / 100) AS slope FROM {fx_catalog}) k")
def p35_wadati(t):
    df = t.fx_catalog
    slope = df.agg(F.regr_slope("km", (C("s") - C("p")) / 100).alias("slope"))
    return df.crossJoin(F.broadcast(slope)).select("rid", bins.wadati_km((C("s") - C("p")) / 100, C("slope")).alias("km_from_sp"))


@query("SELECT trace_id, CASE WHEN weight = 'click' THEN 'base' WHEN weight LIKE 'p%' THEN 'own' ELSE 'other' END AS tier FROM {fx_results}")
def p36_tier(t):
    return t.fx_results.select("trace_id", bins.tier(C("weight"), {"click": "base"}, {"p": "own"}).alias("tier"))


@query("SELECT rid, CAST(year(shipped) AS INTEGER) AS year, chunk[1:2] AS prefix FROM {fx_catalog}")
def p37_year_prefix(t):
    return t.fx_catalog.select("rid", F.year("shipped").alias("year"), F.substring("chunk", 1, 2).alias("prefix"))


@query("SELECT rid, w, w / sum(w) OVER (PARTITION BY dataset) AS share FROM (SELECT rid, dataset, pow(10.0, -mag) AS w FROM {fx_catalog})")
def p38_gr_weight(t):
    df = t.fx_catalog.select("rid", "dataset", bins.gr_weight(C("mag")).alias("w"))
    total = df.groupBy("dataset").agg(F.sum("w").alias("total"))  # combined before the shuffle, unlike a window
    return df.join(total, "dataset").select("rid", "w", (C("w") / C("total")).alias("share"))


@query("SELECT id, CASE WHEN lat IS NULL THEN '' ELSE printf('%.4f', lat) END AS lat, printf('%.4f', lon) AS lon FROM {fx_geo}")
def p39_fixed_coordinates(t):
    return t.fx_geo.select("id", clean.fixed_coordinate(C("lat")).alias("lat"), clean.fixed_coordinate(C("lon")).alias("lon"))


@query("SELECT trace_id, CASE WHEN p_in_window < 0 THEN -1 ELSE CAST(round_even(p_in_window * 40.0 / (user_id % 90 + 10), 0) AS INTEGER) END AS p FROM {fx_results}")
def p40_rescale_sample(t):
    return t.fx_results.select("trace_id", clean.rescale_sample(C("p_in_window"), 40.0, C("user_id") % 90 + 10).alias("p"))


@query("SELECT trace_id, CASE regexp_replace(weight, '^eqt_', '') WHEN 'click' THEN 'corpus_a' WHEN 'view' THEN 'corpus_b' END AS corpus FROM {fx_results}")
def p41_corpus_of_weight(t):
    name = F.when(C("trace_id") % 2 == 0, F.concat(F.lit("eqt_"), "weight")).otherwise(C("weight"))
    return t.fx_results.select("trace_id", clean.corpus_of_weight(name, {"click": "corpus_a", "view": "corpus_b"}).alias("corpus"))

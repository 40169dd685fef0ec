"""Labelled bins and ordered rules, generated as CASE chains from tables of edges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Edges and labels.
DIST_EDGES = [0, 150, 1500, math.inf]
DIST_LABELS = ["local (<150km)", "regional (150-1500km)", "teleseismic (>1500km)"]
DEPTH_EDGES = [0, 15, 70, 300, math.inf]
DEPTH_LABELS = ["upper-crustal (0-15km)", "lower-crust (15-70km)", "intermediate (70-300km)", "deep-focus (>300km)"]
MAG_EDGES = [-math.inf, 3.0, 6.0, math.inf]
MAG_LABELS = ["micro (M<3)", "moderate (M3-6)", "large (M>6)"]
SHORT_DIST = {"local": DIST_LABELS[0], "regional": DIST_LABELS[1], "teleseismic": DIST_LABELS[2]}

# Coarse regions, strict bounds (south, north, west, east), first match wins.
REGIONS = [
    ("Arctic", 67, None, None, None),
    ("Antarctica", None, -60, None, None),
    ("North_America", 10, 80, -170, -50),
    ("South_America", -60, 15, -90, -30),
    ("Europe", 35, 75, -15, 40),
    ("Africa", -40, 35, -20, 55),
    ("Central_Asia", 5, 80, 40, 100),
    ("East_Asia", -15, 50, 100, 150),
    ("Australia", -45, -10, 110, 155),
]
# Tectonic boxes, strict bounds.
TECTONIC = [
    ("subduction", 30, 50, 130, 150),
    ("subduction", -10, 10, 115, 130),
    ("subduction", -40, 0, -80, -60),
    ("subduction", 50, 65, -170, -140),
    ("rift", -30, 20, 25, 45),
    ("rift", 60, 68, -30, -10),
]
# Fine regions, inclusive bounds; the last field marks a half-open northern edge.
FINE_REGIONS = [
    ("Alaska", 54, 72, -170, -130, False),
    ("Pacific Northwest", 42, 52, -126, -116, False),
    ("Northern California", 36, 42, -125, -118, True),
    ("Southern California", 32, 36, -121, -114, True),
    ("Texas / Oklahoma", 25, 37, -107, -93, False),
    ("Hawaii", 18, 23, -162, -154, False),
    ("North America", 15, 75, -170, -50, False),
    ("Caribbean / Central America", 8, 24, -90, -60, False),
    ("South America", -60, 15, -82, -30, True),
    ("Switzerland / Alpine", 45, 50, 5, 12, False),
    ("Italy / Apennines", 36, 48, 6, 19, False),
    ("Greece / Aegean", 34, 42, 19, 30, False),
    ("Turkey / Caucasus", 36, 43, 26, 47, False),
    ("Iberian Peninsula", 35, 44, -10, 5, False),
    ("Iceland", 63, 67, -25, -13, False),
    ("Europe", 35, 72, -30, 47, False),
    ("Africa", -35, 37, -20, 52, True),
    ("Middle East", 10, 40, 35, 65, False),
    ("Taiwan", 21, 26, 119, 123, False),
    ("Japan / Ryukyu", 24, 46, 122, 148, False),
    ("Southeast Asia", -10, 25, 95, 145, False),
    ("India / South Asia", 6, 36, 68, 92, False),
    ("Central Asia", 36, 55, 52, 88, False),
    ("China / East Asia", 18, 55, 88, 145, False),
    ("Russia / Siberia", 50, 75, 30, 180, False),
    ("New Zealand", -48, -34, 166, 178, False),
    ("Pacific / Oceania", -50, 20, 130, 180, False),
    ("Eastern Pacific", -50, 20, -180, -100, False),
]
# Band letters and instrument letters of channel codes.
BANDS = [("Broadband", "BH"), ("Short-period", "SE"), ("Accelerometer", "NL"), ("Geophone", "GM"), ("VLBI/ULF", "VU")]
INSTRUMENTS = [("Broadband", "HG"), ("Short-period", "PL"), ("Accelerometer", "N")]
REVIEWED = ["analyst", "manual", "reviewed", "confirmed", "1", "a"]


def _chain(cases, default=None) -> Column:
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(default) if default is not None else out.otherwise(F.lit(None))


def distance_bin(km: Column, default: str = "unknown") -> Column:
    return _chain([(km.isNull() | F.isnan(km) | (km < 0), default), (km < 150, "local"), (km < 1500, "regional")], "teleseismic")


def assign_bins(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Left-closed bins; ``right`` closes the other end, which leaves the lowest edge out."""
    cases = []
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        inside = ((c > low) if right else (c >= low)) if low != -math.inf else F.lit(True)
        if high != math.inf:
            inside &= (c <= high) if right else (c < high)
        cases.append((c.isNotNull() & inside, label))
    return _chain(cases)


def physics_bin(dist: Column, depth: Column, mag: Column) -> Column:
    whole = dist.isNotNull() & depth.isNotNull() & mag.isNotNull()
    return F.when(whole, F.concat_ws(" | ", dist, depth, mag)).otherwise("partial")


def two_axis_bin(dist: Column, other: Column, missing: str) -> Column:
    return F.concat_ws(" | ", dist, F.coalesce(other, F.lit(missing)))


def _box(lat, lon, south, north, west, east):
    parts = [lat > south if south is not None else None, lat < north if north is not None else None, lon > west if west is not None else None, lon < east if east is not None else None]
    out = F.lit(True)
    for p in parts:
        out = out if p is None else out & p
    return out


def coarse_region(lat: Column, lon: Column) -> Column:
    return _chain([(lat.isNull() | lon.isNull(), "unknown"), *((_box(lat, lon, *b), n) for n, *b in REGIONS)], "Pacific_or_other")


def tectonic_class(lat: Column, lon: Column, default: str) -> Column:
    return _chain([(lat.isNull() | lon.isNull(), default), *((_box(lat, lon, *b), n) for n, *b in TECTONIC)], default)


def fine_region(lat: Column, lon: Column) -> Column:
    cases = [(lat.isNull() | lon.isNull(), "Unknown")]
    for name, south, north, west, east, half_open in FINE_REGIONS:
        cases.append(((lat >= south) & ((lat < north) if half_open else (lat <= north)) & (lon >= west) & (lon <= east), name))
    return _chain(cases, "Global/Unknown")


def region_table(spark: SparkSession) -> DataFrame:
    """The regions as the rules of ``operators.spacetime.first_box``."""
    rows = [(n, *map(float, edges), half_open, i) for i, (n, *edges, half_open) in enumerate(FINE_REGIONS)]
    return spark.createDataFrame(rows, "name string, south double, north double, west double, east double, half_open boolean, priority int")


def instrument_class(channel: Column) -> Column:
    code = F.upper(F.trim(F.coalesce(channel, F.lit(""))))
    band, kind = F.substring(code, 1, 1), F.substring(code, 2, 1)
    cases = [(code.isin("", "NAN", "UNK", "NONE"), "Unknown")]
    cases += [(band.isin(*letters), name) for name, letters in BANDS] + [(kind.isin(*letters), name) for name, letters in INSTRUMENTS]
    return _chain(cases, F.concat(F.lit("Other ("), F.substring(code, 1, 2), F.lit(")")))


def reviewed(quality: Column, keywords: Sequence[str] = tuple(REVIEWED)) -> Column:
    low = F.lower(F.coalesce(quality, F.lit("nan")))
    out = F.lit(False)
    for k in keywords:
        out |= low.contains(k)
    return out


def pipe_snr(c: Column) -> dict[str, Column]:
    """``E|N|Z`` -> components and the mean of those present; a malformed part voids the whole string."""
    parts = F.split(c, r"\|")
    blank = lambda x: x.isin("", "nan", "None")
    broken = F.exists(parts, lambda x: ~blank(x) & x.try_cast("double").isNull())
    at = lambda i: F.when(~broken & ~blank(F.get(parts, F.lit(i))), F.get(parts, F.lit(i)).try_cast("double"))
    e, n, z = at(0), at(1), at(2)
    return {"snr_e": e, "snr_n": n, "snr_z": z, "snr_mean": row_mean(e, n, z)}


def row_mean(*cs: Column) -> Column:
    held = F.filter(F.array(*cs), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))


def row_min(*cs: Column) -> Column:
    return F.least(*cs)


def weakest(e: Column, n: Column, z: Column) -> Column:
    """Strictly weakest component, else tied; null where one is missing."""
    return _chain([(e.isNull() | n.isNull() | z.isNull(), F.lit(None)), ((e < n) & (e < z), "E"), ((n < e) & (n < z), "N"), ((z < e) & (z < n), "Z")], "tied")


def availability(e: Column, n: Column, z: Column) -> Column:
    e, n, z = e.isNotNull(), n.isNotNull(), z.isNotNull()
    return _chain([(e & n & z, "3C"), (~e & ~n & z, "Z-only"), (e & n & ~z, "EN-only")], "other")


def window_margin(sample: Column, rate: float, length: int) -> dict[str, Column]:
    return {"pick_s": sample / rate, "margin_s": (length - sample) / rate}


def wadati_km(sp: Column, slope: Column | float) -> Column:
    return sp * slope


def tier(weight: Column, tiers: dict[str, str], prefixes: dict[str, str], default: str = "other") -> Column:
    cases = [(weight == k, v) for k, v in tiers.items()] + [(weight.startswith(k), v) for k, v in prefixes.items()]
    return _chain(cases, default)


def gr_weight(mag: Column, b: float = 1.0) -> Column:
    """Gutenberg-Richter weight 10^(-b M); 1 where the magnitude is missing."""
    w = F.pow(F.lit(10.0), -b * mag)
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == math.inf), 1.0).otherwise(w)

"""Cleaning of ragged catalog metadata: every raw value arrives as a string."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pick columns by priority.
P_PRIORITY = ["trace_p_arrival_sample", "trace_P_arrival_sample", "trace_Pg_arrival_sample", "trace_Pn_arrival_sample", "trace_P1_arrival_sample", "trace_PmP_arrival_sample"]
S_PRIORITY = ["trace_s_arrival_sample", "trace_S_arrival_sample", "trace_Sg_arrival_sample", "trace_Sn_arrival_sample", "trace_S1_arrival_sample"]
# Vendor names of splits.
SPLIT_NAMES = {"train": ["train"], "val": ["dev", "val", "valid", "development", "eval"], "test": ["test"]}
KM_PER_DEGREE = 111.2


def best_col(columns: Sequence[str], priority: Sequence[str], ignore_case: bool = False) -> str | None:
    """First name of ``priority`` among ``columns``; with ``ignore_case`` an exact match still wins."""
    exact = next((p for p in priority if p in columns), None)
    if exact or not ignore_case:
        return exact
    folded = {c.lower(): c for c in reversed(columns)}
    return next((folded[p.lower()] for p in priority if p.lower() in folded), None)


def harmonise(df: DataFrame, fields: dict[str, Sequence[str]], types: dict[str, str] | None = None, ignore_case: bool = False) -> DataFrame:
    """One select from a ragged catalog to canonical fields; what is absent becomes a typed null."""
    out = []
    for field, priority in fields.items():
        kind, name = (types or {}).get(field, "string"), best_col(df.columns, priority, ignore_case)
        value = F.lit(None) if name is None else F.col(f"`{name}`")
        out.append((number(value) if kind == "double" and name else value.cast(kind)).alias(field))
    return df.select(*out)


def number(c: Column | str) -> Column:
    """Lenient numeric cast: what is no number, and NaN, becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def coalesce_picks(df: DataFrame, priority: Sequence[str]) -> tuple[Column, str | None]:
    """Row-wise first number over the present columns, and the name of the first one present."""
    present = [c for c in priority if c in df.columns]
    if not present:
        return F.lit(None).cast("double"), None
    return F.coalesce(*[number(F.col(f"`{c}`")) for c in present]), present[0]


def to_km(c: Column, unit: str) -> Column:
    return c * KM_PER_DEGREE if unit == "deg" else c / 1000.0 if unit == "m" else c


def drop_sentinel(c: Column, sentinel: float = -9999) -> Column:
    return F.when(c != sentinel, c)


def normalise_split(c: Column) -> Column:
    name = F.lower(F.trim(c))
    cases = reduce(lambda w, kv: w.when(name.isin(kv[1]), kv[0]), SPLIT_NAMES.items(), F)
    return cases.otherwise("")


def repair_chunk(c: Column) -> Column:
    """Digit tags that were read as floats lose their ``.0``; null becomes empty."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"\.0$", ""), F.lit(""))


def sp_seconds(p: Column, s: Column, rate: Column | float = 100.0) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(rate > 0, (s - p) / rate)


def repair_order(p: Column, s: Column) -> Column:
    """S picks that do not follow P are dropped."""
    return F.when(p.isNotNull() & s.isNotNull() & (s <= p), F.lit(None)).otherwise(s)


def evaluation_flags(p: Column, s: Column, seconds: Column, visible: float = 15.0) -> dict[str, Column]:
    has_p, has_s = p.isNotNull(), s.isNotNull()
    return {"has_p_pick": has_p, "has_s_pick": has_s, "evaluate_s": has_p & has_s, "p_in_s_window": F.coalesce(has_p & has_s & (seconds <= visible), F.lit(False))}


def p_only_policy(s: Column, distance_bin: Column) -> Column:
    return F.when(distance_bin == "teleseismic", F.lit(None)).otherwise(s)


def trace_bucket(name: Column) -> dict[str, Column]:
    """``bucket$row[,...]`` -> bucket and row; null where the name has another form."""
    form = r"^([^$]+)\$(\d+)(?:,.*)?$"
    valid = F.coalesce(name.rlike(form), F.lit(False))
    return {"bucket": F.when(valid, F.regexp_extract(name, form, 1)), "row": F.when(valid, F.regexp_extract(name, form, 2).try_cast("int")), "name_ok": valid}


def sanitise(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def compose_name(*parts: Column, sep: str = "__") -> Column:
    return F.concat_ws(sep, *[sanitise(p.cast("string")) for p in parts])


def source_of_name(c: Column, prefix: str = "pre_", sep: str = "__") -> Column:
    return F.split_part(F.regexp_replace(c, f"^{prefix}", ""), F.lit(sep), F.lit(1))


def embedded_time(c: Column) -> Column:
    """Timestamp inside a string: ISO, compact ISO, year.day-of-year.time, or a date; first that parses."""

    def first(pattern, layout, glue):
        hit = [F.regexp_extract(c, pattern, i + 1) for i in range(glue.count("{}"))]
        return F.when(c.rlike(pattern), F.try_to_timestamp(F.format_string(glue.replace("{}", "%s"), *hit), F.lit(layout)))

    doy = r"(\d{4})\.(\d{3})\.(\d{6})"
    year = F.try_to_timestamp(F.concat(F.regexp_extract(c, doy, 1), F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    part = lambda g, a, n: F.substring(F.regexp_extract(c, doy, g), a, n).try_cast("int")
    seconds = (part(2, 1, 3) - 1) * 86400 + part(3, 1, 2) * 3600 + part(3, 3, 2) * 60 + part(3, 5, 2)
    by_day = F.when(c.rlike(doy), F.timestamp_micros(F.unix_micros(year) + seconds.cast("long") * 1000000))
    return F.coalesce(
        first(r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})", "yyyy-MM-dd HH:mm:ss", "{} {}"),
        first(r"(\d{8})T(\d{6})", "yyyyMMdd HHmmss", "{} {}"),
        by_day,
        first(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd", "{}"),
    )


def channel_pattern(c: Column) -> Column:
    """First two letters of the first channel and a wildcard; HH? without channels."""
    return F.when(c.isNull(), "HH?").otherwise(F.concat(F.substring(F.split_part(F.replace(c, F.lit(";"), F.lit(",")), F.lit(","), F.lit(1)), 1, 2), F.lit("?")))


def request_plan(df: DataFrame, start: str, origin: str, name: str, original: str, buffer_s: float = 30.0, duration_s: float = 120.0) -> DataFrame:
    """Adds start_time, end_time and status: start column, then origin minus buffer, then a time in either name."""
    shift = lambda c, s: F.timestamp_micros(F.unix_micros(c) + F.lit(int(s * 1e6)))
    at = F.coalesce(F.col(start), shift(F.col(origin), -buffer_s), embedded_time(F.col(name)), embedded_time(F.col(original)))
    status = F.when(F.col(start).isNotNull(), "start").when(F.col(origin).isNotNull(), "origin").when(embedded_time(F.col(name)).isNotNull(), "name").when(embedded_time(F.col(original)).isNotNull(), "original").otherwise("no_time")
    return df.withColumn("start_time", at).withColumn("end_time", shift(F.col("start_time"), duration_s)).withColumn("status", status)


def fixed_coordinate(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string("%.4f", c))


def rescale_sample(sample: Column, target: float, original: Column) -> Column:
    """Half-even rounding; -1 stays the mark for no pick."""
    return F.when(sample < 0, -1).otherwise(F.bround(sample * target / original)).cast("int")


def corpus_of_weight(weight: Column, corpora: dict[str, str], prefix: str = "eqt_") -> Column:
    """Training corpus of a weight name after its family prefix; null where unknown."""
    bare = F.regexp_replace(weight, f"^{prefix}", "")
    table = F.create_map(*[F.lit(x) for kv in corpora.items() for x in kv])
    return F.try_element_at(table, bare)

"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], prefix: str = "_g_") -> Column | None:
    """Null-safe equality of the group columns with those of a table that carries them under a prefix."""
    return reduce(lambda a, b: a & b, [left[b].eqNullSafe(right[f"{prefix}{b}"]) for b in by]) if by else None


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(by, quantiles): linearly interpolated quantiles of each group, in the order of ``at``; NaN is no value, and groups
    without values have no row.

    A percentile aggregate holds every distinct value of a group in one task. Here a mergeable sketch with a rank error of
    1/accuracy brackets each quantile, one pass counts what lies below a bracket, and only the values inside it, a few
    ten-thousandths of the group, are ranked.
    """
    by, slack = list(by), 3 / accuracy
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where("_v IS NOT NULL")
    ends = [min(max(q + s, 0.0), 1.0) for q in at for s in (-slack, slack)]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.approx_percentile("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("_n") * slack < 4  # a bracket must hold the ranks on both sides of the quantile; so few values are ranked as they are
    low = lambda i: F.col("_lo") if ends[2 * i] == 0 else F.when(few, F.col("_lo")).otherwise(F.col("_m")[2 * i])
    high = lambda i: F.col("_hi") if ends[2 * i + 1] == 1 else F.when(few, F.col("_hi")).otherwise(F.col("_m")[2 * i + 1])
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high"), ((F.col("_n") - 1) * F.lit(float(q))).alias("place")) for i, q in enumerate(at)])
    brackets = sketch.select(*[F.col(b).alias(f"_g_{b}") for b in by], brackets.alias("_b"))
    joined = rows.join(brackets, same_group(rows, brackets, by)) if by else rows.crossJoin(F.broadcast(brackets))  # one row
    # what lies below a bracket counts with the smallest key, the values inside under their own
    inside = joined.select(*by, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["high"])).alias("b"))
    key = F.when(F.col("_v") >= F.col("b.low"), F.col("_v"))
    counts = inside.groupBy(*by, F.col("b.i").alias("_i"), F.col("b.place").alias("_place"), key.alias("_key")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w))
    reach = lambda rank: F.min(F.when(F.col("_key").isNotNull() & (F.col("_upto") > rank), F.col("_key")))
    found = ranked.groupBy(*by, "_i", "_place").agg(reach(F.floor("_place")).alias("_a"), reach(F.ceil("_place")).alias("_z"))
    share = F.col("_place") - F.floor("_place")
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", ((1 - share) * F.col("_a") + share * F.col("_z")).alias("q")))), lambda s: s["q"]).alias("quantiles"))


def with_quantiles(out: DataFrame, df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Adds the exact quantiles of ``df``'s groups to ``out``, its aggregate by the same columns; ``at`` gives them names."""
    q = exact_quantiles(df, by, value, list(at.values()))
    q = q.select(*[F.col(b).alias(f"_g_{b}") for b in by], *[F.col("quantiles")[i].alias(k) for i, k in enumerate(at)])
    joined = out.join(q, same_group(out, q, by), "left") if by else out.crossJoin(F.broadcast(q))  # one row each
    return joined.drop(*[f"_g_{b}" for b in by])

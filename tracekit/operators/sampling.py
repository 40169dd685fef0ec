"""Deterministic sampling: every draw is a rank of md5(seed, unique key), so results depend on neither order nor partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .quantiles import same_group


def draw(seed: int | str, *keys: str) -> Column:
    """The random number of a row as 32 hexadecimal digits; order it as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def uniform(seed: int | str, *keys: str) -> Column:
    """The same draw as a number in (0, 1)."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def _ranked(df: DataFrame, group: list[str], key: list[str], seed, name: str = "_rank") -> DataFrame:
    """Ranks under a literal limit only; ``ranked_in_groups`` is for whole groups."""
    return df.withColumn("_draw", draw(seed, *key)).withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy("_draw", *key))).drop("_draw")


def _ranges(dealt: DataFrame, group: list[str]) -> DataFrame:
    """Counts of 4096 ranges of the draw in each group, and how many rows lie in the ranges before."""
    sizes = dealt.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("_before", before)


def _dealt(df: DataFrame, key: list[str], seed) -> DataFrame:
    return df.withColumn("_draw", draw(seed, *key)).withColumn("_p", F.substring("_draw", 1, 3))


def ranked_in_groups(df: DataFrame, group: list[str], key: list[str], seed=0, name: str = "_rank") -> DataFrame:
    """Adds the row's number in the order of the draw inside its group, whatever the group's size: ranks inside 4096 ranges of
    the draw, plus the counts of the ranges before."""
    dealt = _dealt(df, key, seed)
    before = _ranges(dealt, group).select(*[F.col(g).alias(f"_g_{g}") for g in [*group, "_p"]], "_before")
    short = dealt.withColumn("_draw", F.unhex("_draw"))  # the same order in half the bytes
    inside = short.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_draw", *key)))
    joined = inside.join(before, same_group(inside, before, [*group, "_p"]))
    return joined.withColumn(name, F.col("_i") + F.col("_before")).select(*df.columns, name)


def divided(df: DataFrame, group: list[str], take: DataFrame, key: list[str], seed=0) -> tuple[DataFrame, DataFrame]:
    """(taken, left): the first ``_take`` rows of each group in the order of the draw, and its other rows.

    ``take(group, _take)``; groups that it lacks are in neither. Ranges of the draw that lie wholly before the
    cut are taken as they are and those behind it left; only the one range of a group that the cut falls into is ranked.
    """
    dealt = _dealt(df, key, seed)
    ranges = _ranges(dealt, group)
    named = take.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_take").cast("long").alias("_take"))
    room = F.least(F.col("_c"), F.greatest(F.lit(0), F.col("_take") - F.col("_before")))
    held = ranges.join(named, same_group(ranges, named, group)).select(*[F.col(g).alias(f"_g_{g}") for g in [*group, "_p"]], "_c", room.alias("_room"))
    held = written(held)  # the planner knows that it is small, so the rows stay where they are
    rows = dealt.join(held, same_group(dealt, held, [*group, "_p"]))
    inside = F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_draw", *key))
    cut = rows.where("_room > 0 AND _room < _c").withColumn("_i", inside)
    taken = rows.where("_room = _c").select(*df.columns).unionByName(cut.where("_i <= _room").select(*df.columns))
    return taken, rows.where("_room = 0").select(*df.columns).unionByName(cut.where("_i > _room").select(*df.columns))


def sample_in_groups(df: DataFrame, group: list[str], n: int, key: list[str], seed=0) -> DataFrame:
    """At most n rows a group. Row numbers under a limit let Spark cut each partition to n before the shuffle."""
    return _ranked(df, group, key, seed).where(F.col("_rank") <= n).drop("_rank")


def sample(df: DataFrame, n: int, key: list[str], seed=0) -> DataFrame:
    """n rows of all: a distributed top-n."""
    return df.withColumn("_draw", draw(seed, *key)).orderBy("_draw", *key).limit(n).drop("_draw")


def cap(df: DataFrame, n: int, key: list[str], seed=0) -> DataFrame:
    """All rows, or n of them where there are more (a top-n does both)."""
    return sample(df, n, key, seed)


def proportional_cap(df: DataFrame, limit: int, stratum: str, key: list[str], seed=0, dataset: str | None = None) -> DataFrame:
    """Stratified cap of each dataset: ``max(1, round(limit * share))`` rows a stratum, topped up to the limit from the rest.

    Rounding is half-even and may exceed the limit; datasets within the limit stay whole; a null dataset or stratum is one like others.
    """
    group = [dataset] if dataset else []
    df = written(df, "zstd")  # counted, ranged and taken from
    sizes = df.groupBy(*group, stratum).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.groupBy(*group).agg(F.sum("_c").alias("_n"))
    beside = lambda left, right: left.join(right, same_group(left, right, group)).drop(*[f"_g_{g}" for g in group]) if group else left.crossJoin(F.broadcast(right))  # one row
    joined = beside(sizes, totals.withColumnsRenamed({g: f"_g_{g}" for g in group}))
    take = F.least("_c", F.greatest(F.lit(1), F.bround(limit * F.col("_c") / F.col("_n")).cast("long")))
    plan = joined.withColumn("_take", F.when(F.col("_n") <= limit, F.col("_c")).otherwise(take))
    short = plan.groupBy(*group).agg((F.lit(limit) - F.sum("_take")).alias("_short"))
    plan = beside(plan, short.withColumnsRenamed({g: f"_g_{g}" for g in group}))
    taken, left = divided(df, [*group, stratum], plan.select(*group, stratum, "_take"), key, seed)
    # groups within the limit have no rest
    lacking = plan.where((F.col("_n") > limit) & (F.col("_short") > 0)).select(*group, "_short").distinct()
    if group:
        more = divided(left, group, lacking.withColumnRenamed("_short", "_take"), key, f"{seed}+")[0]  # a rank over the rest would put a dataset into one task
    else:
        best = left.withColumn("_draw", draw(f"{seed}+", *key)).orderBy("_draw", *key).limit(limit)
        more = best.withColumn("_more", F.row_number().over(Window.orderBy("_draw", *key))).crossJoin(F.broadcast(lacking)).where(F.col("_more") <= F.col("_short"))  # one row
    return taken.select(*df.columns).unionByName(more.select(*df.columns))


def rebalance(df: DataFrame, fractions: dict[str, float], stratum: str, key: list[str], seed=0) -> DataFrame:
    """Down-samples strata to target fractions: the total is the least ``int(count / fraction)`` of the strata present.

    Strata below their share stay whole; the share of an absent stratum is not given to others; strata without a
    target go.
    """
    spark = df.sparkSession
    rows = [(k, float(v)) for k, v in fractions.items() if v > 0]
    target = spark.createDataFrame(rows, f"`{stratum}` string, _f double")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    available = sizes.agg(F.sum("_c").alias("_all"))
    known = sizes.join(F.broadcast(target), stratum)  # a configuration table
    total = known.agg(F.min(F.floor(F.col("_c") / F.col("_f"))).alias("_t")).crossJoin(available).select(F.least("_t", "_all").alias("_total"))
    plan = known.crossJoin(F.broadcast(total)).select(stratum, F.bround(F.col("_total") * F.col("_f")).alias("_take"))
    return divided(df, [stratum], plan, key, seed)[0]


def two_level_cap(df: DataFrame, outer: str, inner: str, inner_cap: int, outer_cap: int, key: list[str], seed=0) -> DataFrame:
    """At most ``inner_cap`` rows of an (outer, inner) pair, then at most ``outer_cap`` of an outer group."""
    return sample_in_groups(sample_in_groups(df, [outer, inner], inner_cap, key, seed), [outer], outer_cap, key, f"{seed}'")


def weighted_sample(df: DataFrame, n: int, weight: Column, key: list[str], seed=0) -> DataFrame:
    """Without replacement, chances in proportion to the weight: the n smallest of -ln(u) / w."""
    return df.withColumn("_key", -F.log(uniform(seed, *key)) / weight).orderBy("_key", *key).limit(n).drop("_key")


def latitude_bands(df: DataFrame, lat: str, limit: int, key: list[str], seed=0) -> DataFrame:
    """``limit // 6`` rows of each 30-degree band, then any rows up to the limit; 90 degrees and null only as fill."""
    band = F.when((F.col(lat) >= -90) & (F.col(lat) < 90), F.floor((F.col(lat) + 90) / 30))
    each = max(1, limit // 6)
    banded = df.withColumn("_band", band)
    first = sample_in_groups(banded.where("_band IS NOT NULL"), ["_band"], each, key, seed)  # ``limit`` rows at most
    fill = sample(banded.join(first.select(*key), key, "left_anti"), limit, key, seed)
    both = first.withColumn("_first", F.lit(True)).unionByName(fill.withColumn("_first", F.lit(False)))
    return both.withColumn("_draw", draw(seed, *key)).orderBy(F.desc("_first"), "_draw", *key).limit(limit).select(*df.columns)


def oversample(df: DataFrame, stratum: Column, factor: float, key: list[str], seed=0) -> DataFrame:
    """The table and another ``factor - 1`` times the stratum: whole copies, then a draw of round(rest * n)."""
    if factor <= 1:
        raise ValueError("the factor must be above 1")
    part, whole = df.where(stratum), int(factor - 1)
    size = part.agg(F.bround((factor - 1 - whole) * F.count(F.lit(1))).alias("_n"))
    ranked = fraction_ranked(part, key, seed)
    extra = ranked.crossJoin(F.broadcast(size)).where(F.col("_rank") <= F.col("_n")).select(*df.columns)  # one row
    out = df
    for _ in range(whole):
        out = out.unionByName(part)
    return out.unionByName(extra)


def fraction_ranked(df: DataFrame, key: list[str], seed=0) -> DataFrame:
    """Adds _rank over all rows without a single-partition window: ranks inside 4096 ranges of the draw, plus the counts before."""
    dealt = df.withColumn("_draw", draw(seed, *key)).withColumn("_p", F.substring("_draw", 1, 3))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # 4096 rows at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_draw", *key))
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn("_rank", F.col("_i") + F.col("_before")).drop("_i", "_p", "_before", "_draw")


def ratio_split(df: DataFrame, ratio: float, key: list[str], seed=0) -> DataFrame:
    """Adds split: train for the first int(n * ratio) rows of a shuffle, val for the rest."""
    size = df.agg(F.floor(F.count(F.lit(1)) * ratio).alias("_n"))
    ranked = fraction_ranked(df, key, seed).crossJoin(F.broadcast(size))  # one row
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.col("_n"), "train").otherwise("val")).drop("_rank", "_n")


def shuffled(df: DataFrame, key: list[str], seed=0) -> DataFrame:
    """Sorted by the draw, for export."""
    return df.withColumn("_draw", draw(seed, *key)).orderBy("_draw", *key).drop("_draw")


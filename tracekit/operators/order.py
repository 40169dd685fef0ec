"""Order by value without whole groups in one task: ranges between sampled splitters, and counts of the rows before each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .quantiles import same_group

#: Rows of a group that one window sorts at once.
PIECE = 65536


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "_at") -> DataFrame:
    """Adds the row's number, from 1, in its group's order (nulls first); rows that tie are numbered in any order.

    Rows are dealt to ranges of (group, order), sorted there and written once with the range and the row's place in it; the rows of a
    group before each range are sums over (group, range), a table of at most groups + ranges rows. A group may fill
    any number of ranges. Rows that tie in everything share a range: put what tells rows apart at the end of ``order``.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    # partition number and place in it; written, so a task that runs again changes neither
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)))
    sizes = placed.groupBy(*group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_range").alias("_g__range"), (before - F.col("_first") + 1).alias("_shift"))
    joined = placed.join(starts, same_group(placed, starts, [*group, "_range"]))
    return joined.withColumn(name, F.col("_place") + F.col("_shift")).select(*df.columns, name)


def in_batches(df: DataFrame, group: str, size: int, order: Sequence[str], name: str = "batch") -> DataFrame:
    """Batches of ``size`` consecutive rows of each group."""
    return numbered(df, [group], order, "_at").withColumn(name, F.ceil(F.col("_at") / size).cast("int")).drop("_at")


def rolling_mean(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, width: Column | int, name: str = "smooth", least: int = 1) -> DataFrame:
    """Mean of the last ``width`` rows up to each row in its group's order, over values that are not null (NaN counts as null); null
    where fewer than ``least`` are left.

    ``width`` may depend on the group's size, column ``_size``. Groups are cut into blocks of one width: a window is the front of
    its own block and the rear of the block before, so two running sums a block and one equi-join give every mean, with additions only
    and in one pass, however wide the window. Running sums stop at ``PIECE`` rows; sums over pieces carry on.
    """
    at = numbered(df.withColumn("_v", F.nanvl(F.col(value).cast("double"), F.lit(None))), group, order)
    sizes = at.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).select(*[F.col(g).alias(f"_g_{g}") for g in group], (width if isinstance(width, Column) else F.lit(width)).cast("long").alias("_width"))
    rows = (at.join(sizes, same_group(at, sizes, group)) if group else at.crossJoin(F.broadcast(sizes))).drop(*[f"_g_{g}" for g in group])  # one row
    rows = rows.withColumn("_block", F.floor((F.col("_at") - 1) / F.col("_width"))).withColumn("_o", (F.col("_at") - 1) % F.col("_width")).withColumn("_piece", F.floor(F.col("_o") / PIECE))
    blocks, pieces = [*group, "_block"], [*group, "_block", "_piece"]
    front, rear = (Window.partitionBy(*pieces).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("_o"), F.desc("_o")))
    total, held = F.coalesce(F.sum("_v"), F.lit(0.0)), F.count("_v")
    sums = rows.groupBy(*pieces).agg(total.alias("_sum"), held.alias("_held"))
    sides = {"front": Window.partitionBy(*blocks).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1), "rear": Window.partitionBy(*blocks).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)}
    carried = sums.select(*[F.col(c).alias(f"_g_{c}") for c in pieces], *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{side}") for side, w in sides.items() for c in ("_sum", "_held")])
    run = rows
    for side, w in (("front", front), ("rear", rear)):
        run = run.withColumn(f"_s_{side}", F.coalesce(F.sum("_v").over(w), F.lit(0.0))).withColumn(f"_n_{side}", F.count("_v").over(w))
    run = run.join(carried, same_group(run, carried, pieces))
    run = written(run.select(*df.columns, "_block", "_o", *[(F.col(f"{a}_{s}") + F.col(f"{b}_{s}")).alias(f"{a}_{s}") for s in sides for a, b in (("_s", "_sum"), ("_n", "_held"))]))
    last = run.where("_o > 0").select(*[F.col(g).alias(f"_g_{g}") for g in group], (F.col("_block") + 1).alias("_g__block"), (F.col("_o") - 1).alias("_g__o"), F.col("_s_rear").alias("_s"), F.col("_n_rear").alias("_n"))
    both = run.join(last, same_group(run, last, [*group, "_block", "_o"]), "left")
    n = F.col("_n_front") + F.coalesce("_n", F.lit(0))
    mean = (F.col("_s_front") + F.coalesce("_s", F.lit(0.0))) / n
    return both.select(*df.columns, F.when(n >= max(least, 1), mean).alias(name))

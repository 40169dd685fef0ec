"""Event-grouped splits and slices of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .keys import key_firsts, key_labels, key_links, row_ends
from .sampling import draw


def fill_cuts(groups: DataFrame, targets: list[tuple[str, Column | DataFrame]], seed=0) -> DataFrame:
    """One row with the column ``_cut_<name>`` for each target: draw and id of the last group that it takes.

    Groups in shuffled order fill the targets one after another, so each target takes a stretch of that order and two cuts
    tell all. Totals of 4096 ranges of the shuffle show the range that a cut falls into, and only its groups are summed
    up one by one. Groups are read once for the ranges and once a target, and not shuffled.
    """
    dealt = groups.withColumn("_draw", draw(seed, "group_id")).withColumn("_p", F.substring("_draw", 1, 3))
    ranges = dealt.groupBy("_p").agg(F.sum("size").alias("_s"))  # 4096 rows at most
    before = lambda size, w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(ranges.select("_p", before("_s", Window.orderBy("_p")).alias("_before")))
    order = Window.partitionBy("_p").orderBy("_draw", "group_id")
    one = groups.sparkSession.range(1)
    start, cuts = one.select(F.lit(0).cast("long").alias("_start")), one.select()
    for name, target in targets:
        goal = start.crossJoin(target if isinstance(target, DataFrame) else one.select(target.alias("_target"))).select((F.col("_start") + F.col("_target")).alias("_goal"))
        edge = ranges.crossJoin(F.broadcast(goal)).where("_before < _goal").orderBy(F.desc("_p")).limit(1)
        inside = dealt.join(F.broadcast(edge), "_p").withColumn("_sum", before("size", order) + F.col("_before")).where("_sum < _goal")
        cut = written(inside.agg(F.max(F.struct("_draw", "group_id")).alias(f"_cut_{name}"), F.coalesce(F.max(F.col("_sum") + F.col("size")), F.lit(0)).alias("_start")))
        start, cuts = cut.select("_start"), cuts.crossJoin(cut.select(f"_cut_{name}"))
    return cuts


def split_of(group_id: Column | str, names: list[str], rest: str, seed=0) -> Column:
    """The target that a group goes to, beside the row of ``fill_cuts``."""
    at, out = F.struct(draw(seed, group_id).alias("_draw"), (F.col(group_id) if isinstance(group_id, str) else group_id).alias("group_id")), None
    for name in names:
        out = F.when(at <= F.col(f"_cut_{name}"), name) if out is None else out.when(at <= F.col(f"_cut_{name}"), name)
    return out.otherwise(rest)


def greedy_fill(groups: DataFrame, targets: list[tuple[str, Column | DataFrame]], rest: str, seed=0) -> DataFrame:
    """``groups(group_id, size)`` in shuffled order fill the targets one after another; each takes groups while it is short.

    A split starts where the one before it stopped (see ``fill_cuts``). Other columns of the groups stay.
    """
    groups = written(groups)
    cuts = fill_cuts(groups, targets, seed)
    return groups.crossJoin(F.broadcast(cuts)).select(*groups.columns, split_of("group_id", [n for n, _ in targets], rest, seed).alias("split"))  # one row


def event_grouped_split(df: DataFrame, row_keys: DataFrame | None, val: float, test: float, row: str = "rid", vendor: str = "vendor", seed=0) -> DataFrame:
    """Adds split. Rows without keys keep a vendor split; all others are grouped by connected keys and dealt whole.

    Targets are fractions of the rows that the vendor did not place. No key ends up in two splits. Keys come from
    ``row_keys(row, event_key)``, or, if that is None, from the list ``event_keys`` of ``df``, which does not come back; such a table is read
    several times (so it should be a written one) and shuffled once.
    """
    columns = [c for c in df.columns if row_keys is not None or c != "event_keys"]
    own = F.coalesce(F.col(vendor).isin("train", "val", "test"), F.lit(False))
    if row_keys is None:
        named = df.withColumns({"_in": F.lit(True), "_low": F.array_min("event_keys")}).withColumn("_placed", F.col("_low").isNull() & own)
        found = key_labels(None, links=key_links(df))
        listed = named.select(F.col(row).alias("_r"), "_low", F.explode(F.array_distinct("event_keys")).alias("key")).where("key IS NOT NULL")
        firsts = listed.groupBy("key").agg(F.min("_r").alias("first"), F.count_if(F.col("key") == F.col("_low")).alias("_c"))
    else:
        ends = row_ends(row_keys, row).withColumnsRenamed({c: f"_{c}" for c in ("a", "low", "high", "n")})
        both = df.withColumn("_in", F.lit(True)).join(ends, F.col(row) == F.col("_a"), "full")  # rows outside the table link keys too
        named = written(both.withColumn("_placed", F.col("_low").isNull() & own).withColumn("_a", F.when(F.col("_n") > 2, F.col("_a"))))
        found = key_labels(row_keys, row, ends=named.select(*[F.col(f"_{c}").alias(c) for c in ("a", "low", "high", "n")]))
        counts = named.where("_in AND _low IS NOT NULL").groupBy("_low").agg(F.count(F.lit(1)).alias("_c"))
        firsts = key_firsts(row_keys, row).join(counts, F.col("key") == F.col("_low"), "left").select("key", "first", F.coalesce("_c", F.lit(0)).alias("_c"))
    by_key = written(firsts.join(found.select(F.col("key").alias("_k"), "label"), F.col("key") == F.col("_k"), "left").select("key", "label", "first", "_c"), "zstd")
    linked = by_key.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("group_id"), F.sum("_c").alias("size")).where("size > 0")
    bare = F.concat(F.lit("row:"), F.col(row))
    alone = named.where("_in AND _low IS NULL AND NOT _placed").groupBy(bare.alias("group_id")).agg(F.count(F.lit(1)).alias("size"))
    few = written(linked.unionByName(alone, allowMissingColumns=True), "zstd")
    single = by_key.where("label IS NULL AND _c > 0")  # most keys: a group of its own
    groups = few.select("group_id", "size").unionByName(single.select(F.col("first").alias("group_id"), F.col("_c").alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_m"))
    part = lambda f: total.select(F.floor(f * F.col("_m")).cast("long").alias("_target"))
    cuts = F.broadcast(fill_cuts(groups, [("val", part(val)), ("test", part(test))], seed))  # one row
    dealt = lambda group_id: split_of(group_id, ["val", "test"], "train", seed)
    of_groups = few.where("label IS NOT NULL").crossJoin(cuts).select("label", dealt("group_id").alias("_split"))
    of_keys = single.crossJoin(cuts).select("key", dealt("first").alias("_split")).unionByName(by_key.where("label IS NOT NULL AND _c > 0").join(of_groups, "label").select("key", "_split"))
    # a letter tells keys from rows without one, which find nothing
    place = F.coalesce(F.concat(F.lit("k:"), "_low"), F.concat(F.lit("r:"), F.col(row)))
    given = F.when(F.col("_placed"), F.col(vendor)).when(F.col("_low").isNull(), dealt(bare))
    rows = named.where("_in").crossJoin(cuts).select(*columns, given.alias("_given"), place.alias("_at"))
    out = rows.join(of_keys.select(F.concat(F.lit("k:"), "key").alias("_of"), "_split"), F.col("_at") == F.col("_of"), "left")
    return out.select(*columns, F.coalesce("_given", "_split").alias("split"))


def expand_slices(df: DataFrame, dist_bin: str = "dist_bin", splits: Column | None = None) -> DataFrame:
    """Each row once for its bin and once for "all", and once for each of its splits."""
    out = df.withColumn("slice_bin", F.explode(F.array(F.col(dist_bin), F.lit("all"))))
    return out.withColumn("split", F.explode(splits)) if splits is not None else out

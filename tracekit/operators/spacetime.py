"""Joins by place and time: neighbours within tolerances, and the first of many boxes that holds a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_KM, haversine_km

WIDE = 4  # tolerances in the side of a cell


class Cells:
    """Cells of time, latitude bands and stretches of longitude that widen towards the poles.

    A stretch is ``WIDE`` times what a distance of ``km`` can span in longitude at the band's far edge; bands that reach a pole are one
    stretch, and stretches run on over 180 degrees. So what lies within the tolerances of a row is in one or two cells a dimension.
    """

    def __init__(self, seconds: float, km: float):
        self.micros = max(int(seconds * 1_000_000), 0)
        self.length = max(WIDE * self.micros, 1)
        self.reach = math.degrees(km / RADIUS_KM) * (1 + 1e-9) + 1e-9  # degrees of arc
        self.height = min(WIDE * self.reach, 180.0)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.height)

    def span(self, band: Column) -> Column:
        """Degrees of longitude within reach of any point near the band; null where that is all of them."""
        edge = F.greatest(F.abs(band * self.height - 90), F.abs((band + 1) * self.height - 90)) + self.reach
        near_pole = edge + self.reach >= 90
        inside = F.sin(F.radians(F.lit(self.reach))) / F.cos(F.radians(F.when(~near_pole, edge)))
        return F.degrees(F.asin(F.least(F.lit(1.0), inside)))

    def stretches(self, band: Column) -> Column:
        return F.coalesce(F.greatest(F.lit(1).cast("long"), F.floor(360 / (WIDE * self.span(band)))), F.lit(1).cast("long"))

    def stretch(self, lon: Column, band: Column) -> Column:
        n = self.stretches(band)
        return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n), n)

    def near_stretches(self, lon: Column, band: Column) -> Column:
        n, east, span = self.stretches(band), F.pmod(lon + 180, F.lit(360.0)), self.span(band) * (1 + 1e-9) + 1e-9
        at = lambda x: F.floor(x / 360 * n)
        found = F.transform(F.sequence(at(east - span), at(east + span)), lambda c: F.pmod(c, n))
        return F.when(n == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(found))


def near_in_space_time(rows: DataFrame, corpus: DataFrame, row: str, seconds: float, km: float, time: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds leaked: a corpus event lies within both tolerances (bounds included). Rows without time or place are not verifiable.

    Corpus events are made distinct and lie in one cell each; a row looks into the cells that its tolerances touch, about three of
    them, so the range predicate is an equi-join with a residual, and a semi-join returns each row once and stops at its
    first event. Very many events at one time are told apart by place, and the other way round; rows that crowd in a cell are AQE's to split.
    """
    cells = Cells(seconds, km)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    events = corpus.select(micros(time).alias("_t"), number(lat).alias("_lat"), number(lon).alias("_lon")).where("_t IS NOT NULL AND _lat IS NOT NULL AND _lon IS NOT NULL").distinct()
    events = events.withColumn("_b", F.floor(F.col("_t") / cells.length)).withColumn("_band", cells.band(F.col("_lat")))
    events = events.withColumn("_cell", cells.stretch(F.col("_lon"), F.col("_band")))
    df = rows.withColumn("_at", micros(time))
    verifiable = F.col("_at").isNotNull() & number(lat).isNotNull() & number(lon).isNotNull()
    probe = df.where(verifiable).select(row, "_at", number(lat).alias("_y"), number(lon).alias("_x"))
    both = lambda x, by: F.explode(F.sequence(by(x[0]), by(x[1])))
    probe = probe.withColumn("_pb", both((F.col("_at") - cells.micros, F.col("_at") + cells.micros), lambda x: F.floor(x / cells.length)))
    probe = probe.withColumn("_pband", both((F.col("_y") - cells.reach, F.col("_y") + cells.reach), cells.band))
    probe = probe.withColumn("_pcell", F.explode(cells.near_stretches(F.col("_x"), F.col("_pband"))))
    close = (F.abs(F.col("_at") - F.col("_t")) <= cells.micros) & (haversine_km(F.col("_y"), F.col("_x"), F.col("_lat"), F.col("_lon")) <= km)
    same = (F.col("_pb") == F.col("_b")) & (F.col("_pband") == F.col("_band")) & (F.col("_pcell") == F.col("_cell"))
    hit = probe.join(events, same & close, "left_semi").select(F.col(row).alias("_hit")).distinct()
    joined = df.withColumn("verifiable", verifiable).join(hit, F.col(row) == F.col("_hit"), "left")
    return joined.withColumn("leaked", F.col("_hit").isNotNull()).drop("_hit", "_at")


def first_box(points: DataFrame, boxes: DataFrame, key: list[str], lat: str, lon: str, name: str = "region", unknown: str = "Unknown", outside: str = "Global/Unknown") -> DataFrame:
    """Adds the name of the first box (by ``priority``, then name) that holds a point; ``unknown`` without a place, ``outside`` if none does.

    ``boxes(name, south, north, west, east, half_open, priority)``; bounds are inclusive, the northern one not where half_open. A box
    lies on a grid whose cells are as wide as itself (1, 2, 4 ... degrees), so it fills four cells at most, and a point looks up its
    cell on each grid in use, ten at most. What grows with the rules is the table of boxes, what grows with the points is not. ``key`` are
    unique columns of a point.
    """
    extent = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(1.0))
    whole = boxes.where("south <= north AND west <= east").withColumn("_grid", F.ceil(F.log2(extent)).cast("int"))
    grids = sorted(r[0] for r in whole.select("_grid").distinct().collect())  # 0 to 9
    if not grids:
        return points.withColumn(name, F.when(F.col(lat).isNull() | F.col(lon).isNull(), unknown).otherwise(outside))
    side = F.pow(F.lit(2.0), F.col("_grid"))
    cell = lambda c: F.floor(F.col(c) / side)
    dealt = whole.withColumn("_cy", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("_cx", F.explode(F.sequence(cell("west"), cell("east"))))
    dealt = dealt.select(F.col("_grid").alias("_g"), F.col("_cy").alias("_gy"), F.col("_cx").alias("_gx"), "south", "north", "west", "east", "half_open", F.struct("priority", F.col("name").alias("n")).alias("_rank"))
    placed = points.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.nanvl(F.col(lat).cast("double"), F.lit(None)).alias("_y"), F.nanvl(F.col(lon).cast("double"), F.lit(None)).alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    probe = placed.withColumn("_grid", F.explode(F.array(*map(F.lit, grids)))).withColumn("_py", cell("_y")).withColumn("_px", cell("_x"))
    inside = (F.col("_y") >= F.col("south")) & F.when(F.col("half_open"), F.col("_y") < F.col("north")).otherwise(F.col("_y") <= F.col("north")) & F.col("_x").between(F.col("west"), F.col("east"))
    held = probe.join(dealt, (F.col("_grid") == F.col("_g")) & (F.col("_py") == F.col("_gy")) & (F.col("_px") == F.col("_gx")) & inside)
    first = held.groupBy(*[f"_k_{k}" for k in key]).agg(F.min("_rank").alias("_first"))
    joined = points.join(first, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], "left")
    found = F.when(F.nanvl(F.col(lat).cast("double"), F.lit(None)).isNull() | F.nanvl(F.col(lon).cast("double"), F.lit(None)).isNull(), unknown).otherwise(F.coalesce(F.col("_first.n"), F.lit(outside)))
    return joined.withColumn(name, found).select(*points.columns, name)

"""Event keys: derivation, overlap joins, lookups, key-connected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .components import smallest_labels

NONE = "array<string>"
FEW = 200_000  # linking keys among which no crowded one is sought


def scalar_key(dataset: Column, event: Column) -> Column:
    return F.when(event.isNotNull(), F.array(F.concat_ws(":", dataset, event.cast("string")))).otherwise(F.array().cast(NONE))


def multi_key(dataset: Column, events: Column) -> Column:
    """Tokens of a delimited list, each once; a null list has no key."""
    tokens = F.array_distinct(F.regexp_extract_all(events, F.lit(r"[A-Za-z0-9_.:-]+"), F.lit(0)))
    return F.coalesce(F.transform(tokens, lambda x: F.concat(dataset, F.lit(":"), x)), F.array().cast(NONE))


def synthetic_key(dataset: Column, time: Column, lat: Column, lon: Column) -> Column:
    """Origin second and position to 0.01 degree (half-even)."""
    fine = time.isNotNull() & lat.isNotNull() & lon.isNotNull()
    place = lambda c: F.format_string("%.2f", F.bround(c, 2) + F.lit(0.0))
    text = F.concat_ws("|", F.unix_seconds(F.date_trunc("second", time)).cast("string"), place(lat), place(lon))
    return F.when(fine, F.array(F.concat(dataset, F.lit(":"), text))).otherwise(F.array().cast(NONE))


def unverifiable_key() -> Column:
    return F.array().cast(NONE)


def derive_event_keys(df: DataFrame, method: str, dataset: Column, **cols: Column) -> DataFrame:
    make = {"scalar": lambda: scalar_key(dataset, cols["event"]), "multi": lambda: multi_key(dataset, cols["events"]), "synthetic": lambda: synthetic_key(dataset, cols["time"], cols["lat"], cols["lon"]), "none": unverifiable_key}
    return df.withColumn("event_keys", make[method]())


def key_method(columns: list[str]) -> str:
    """The best derivation that the columns allow."""
    if "source_id_list" in columns:
        return "multi"
    if {"source_id", "event_id", "source_event_id"} & set(columns):
        return "scalar"
    timed = {"source_origin_time", "source_latitude_deg", "source_longitude_deg"}
    return "synthetic" if timed <= set(columns) else "none"


def exploded(df: DataFrame, row: str, keys: str = "event_keys") -> DataFrame:
    return df.select(row, F.explode(keys).alias("event_key"))


def drop_overlapping(df: DataFrame, row_keys: DataFrame, excluded: DataFrame, row: str = "rid") -> DataFrame:
    """Rows that share no key with the exclusion set. ``row_keys(row, event_key)``; the set is made distinct, so a hot key does not fan out."""
    hit = row_keys.join(excluded.select("event_key").distinct(), "event_key", "left_semi").select(row).distinct()
    return df.join(hit, row, "left_anti")


def flag_overlap(df: DataFrame, row_keys: DataFrame, train: DataFrame, row: str = "rid") -> DataFrame:
    """Adds verifiable (the row has keys) and leaked (any of them is in the training set)."""
    known = train.select("event_key").distinct().withColumn("_in", F.lit(True))
    per_row = row_keys.join(known, "event_key", "left").groupBy(row).agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("_leaked"))
    joined = df.join(per_row, row, "left")
    return joined.withColumn("verifiable", F.col("_leaked").isNotNull()).withColumn("leaked", F.coalesce("_leaked", F.lit(False))).drop("_leaked")


def key_unions(row_keys: DataFrame, on: list[str]) -> DataFrame:
    """The sorted union of keys over equal lookup columns, as event_keys."""
    return row_keys.groupBy(*on).agg(F.sort_array(F.collect_set("event_key")).alias("event_keys"))


def lookup_keys(df: DataFrame, row_keys: DataFrame, on: list[str]) -> DataFrame:
    """Adds event_keys, the sorted union of keys over equal lookup columns; empty where unknown."""
    return df.join(key_unions(row_keys, on), on, "left").withColumn("event_keys", F.coalesce("event_keys", unverifiable_key()))


def key_coverage(df: DataFrame, row_keys: DataFrame, row: str = "rid", dataset: str = "dataset") -> DataFrame:
    keyed = row_keys.select(row).distinct().withColumn("_k", F.lit(1))
    return df.join(keyed, row, "left").groupBy(dataset).agg(F.avg(F.coalesce("_k", F.lit(0))).alias("coverage"), F.count(F.lit(1)).alias("n_rows"))


def row_ends(row_keys: DataFrame, row: str = "rid") -> DataFrame:
    """(a, low, high, n): each row with its smallest and largest key (null if they are one) and how many it lists."""
    low, high = F.min("event_key"), F.max("event_key")
    return row_keys.groupBy(F.col(row).alias("a")).agg(low.alias("low"), F.nullif(high, low).alias("high"), F.count("event_key").alias("n"))


def key_links(df: DataFrame, keys: str = "event_keys") -> DataFrame:
    """(a, b): the smallest key of each row that lists several, and each of its others."""
    low = F.array_min(keys)
    return df.where(low != F.array_max(keys)).select(low.alias("a"), F.explode(keys).alias("b")).where("a <> b")


def key_labels(row_keys: DataFrame | None, row: str = "rid", known: DataFrame | None = None, ends: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(key, label) of the keys that rows link to other keys, label being the smallest key of theirs; all other keys stand alone.

    Only rows with two keys or more link keys, a small part of most corpora, so components are sought on this small graph
    and not on all rows. ``known`` are the labels of rows before these: their components enter as one vertex each, and
    the result is that of all rows together. ``ends`` is the table of ``row_ends`` if it is at hand; ``links`` (see ``key_links``) stand for ``row_keys``.
    """
    if links is None:
        several = (row_ends(row_keys, row) if ends is None else ends).where("low <> high")
        links = several.select(F.col("low").alias("a"), F.col("high").alias("b"))
        more = several.where("n > 2").select(F.col("a").alias("_a"), "low")  # their other keys are looked up
        if more.limit(1).count():
            others = row_keys.select(F.col(row).alias("_r"), F.col("event_key").alias("b")).join(more, F.col("_r") == F.col("_a")).where("b <> low")
            links = links.unionByName(others.select(F.col("low").alias("a"), "b"))
    links = written(links.distinct())
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    if known is None:
        return smallest_labels(ends, links, few=FEW).select(F.col("id").alias("key"), F.col("component").alias("label"))
    old = known.select(F.col("key").alias("_k"), F.col("label").alias("_l"))
    mapped = lambda df, c: df.join(old, F.col(c) == F.col("_k"), "left").withColumn(c, F.coalesce("_l", c)).drop("_k", "_l")
    whole = smallest_labels(mapped(ends, "id").distinct(), mapped(mapped(links, "a"), "b").where("a <> b").distinct(), few=FEW)
    whole = written(whole.select(F.col("id").alias("_id"), F.col("component").alias("_c")))
    moved = known.join(whole, F.col("label") == F.col("_id"), "left").select("key", F.coalesce("_c", "label").alias("label"))
    fresh = ends.join(old, F.col("id") == F.col("_k"), "left_anti").join(whole, F.col("id") == F.col("_id")).select(F.col("id").alias("key"), F.col("_c").alias("label"))
    return moved.unionByName(fresh)


def key_components(row_keys: DataFrame, row: str = "rid", labels: DataFrame | None = None) -> DataFrame:
    """(row, group_id): rows connected through shared keys; the group is named by its smallest row.

    Every row belongs to the component of its smallest key (``labels``, see ``key_labels``; found here if not given). Names are minima
    that are combined before their shuffle, so a key with very many rows costs one row each and no pairs. Components are
    named on the table of keys; rows are shuffled twice, for their ends and for the name.
    """
    ends = written(row_ends(row_keys, row))
    found = (labels if labels is not None else key_labels(row_keys, row, ends=ends)).select(F.col("key").alias("_k"), "label")
    firsts = key_firsts(row_keys, row).join(found, F.col("key") == F.col("_k"), "left")
    held = written(firsts.select("key", F.coalesce("label", "key").alias("label"), "first"))
    names = held.groupBy(F.col("label").alias("_l")).agg(F.min("first").alias("group_id"))
    named = held.join(names, F.col("label") == F.col("_l")).select("key", "group_id")
    return ends.select("a", "low").join(named, F.col("low") == F.col("key")).select(F.col("a").alias(row), "group_id")


def key_firsts(row_keys: DataFrame, row: str) -> DataFrame:
    """(key, first): every key with the smallest of its rows."""
    return row_keys.where("event_key IS NOT NULL").groupBy(F.col("event_key").alias("key")).agg(F.min(row).alias("first"))

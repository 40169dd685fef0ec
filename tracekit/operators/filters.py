"""Filters and predicates of corpus building and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_pick(pick: Column) -> Column:
    return F.coalesce(pick.isNotNull() & ~F.isnan(pick) & (pick >= 0), F.lit(False))


def require_s(df: DataFrame, s: str, used: bool) -> DataFrame:
    """Rows with an S pick, but only for catalogs that use S."""
    return df.where(F.col(s).isNotNull()) if used else df


def category_contains(c: Column, part: str) -> Column:
    return F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))


def quality_gate(p: Column, s: Column, offset: Column, channels_missing: Column, snr_min: Column, least: float = 10.0) -> Column:
    return p.isNotNull() & s.isNotNull() & ~F.coalesce(offset, F.lit(False)) & ~F.coalesce(channels_missing, F.lit(False)) & (snr_min > least)


def regime(year: Column, uncertainty: Column, before: int, most: float) -> Column:
    """An uncertainty limit that holds only before a year."""
    return (year >= before) | (uncertainty <= most)


def in_years(time: Column | str, first: int, last: int) -> Column:
    return F.year(time).between(first, last)


def only_bins(df: DataFrame, bins: list[str], column: str = "distance_bin") -> DataFrame:
    """A focused subset of labelled bins."""
    return df.where(F.col(column).isin(*bins))


def ok_only(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status) == "ok")


def supported(df: DataFrame, n: str, more_than: int) -> DataFrame:
    """Rows of an aggregate that enough rows stand behind."""
    return df.where(F.col(n) > more_than)


def in_ranges(df: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Rows whose columns lie in physical ranges, ends included; nulls go."""
    for column, (low, high) in ranges.items():
        df = df.where(F.col(column).between(low, high))
    return df


def partitioned(df: DataFrame, category: str, parts: dict[str, list[str]], name: str = "part") -> DataFrame:
    """Rows whose category belongs to one of the named parts, which is added."""
    table = F.create_map(*[F.lit(x) for part, values in parts.items() for v in values for x in (v, part)])
    return df.withColumn(name, F.try_element_at(table, F.col(category))).where(F.col(name).isNotNull())


def drop_flagged(df: DataFrame, flagged: DataFrame, keys: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """(rows that no report flags, n_before and n_removed by a column)."""
    marked = df.join(flagged.select(*keys).distinct().withColumn("_bad", F.lit(True)), keys, "left")
    counts = marked.groupBy(by).agg(F.count(F.lit(1)).alias("n_before"), F.count("_bad").alias("n_removed"))
    return marked.where("_bad IS NULL").drop("_bad"), counts


def clean_noise(max_p: Column, max_s: Column, p_limit: float, s_limit: float) -> Column:
    return (max_p < p_limit) & (max_s < s_limit)


def early_pick(p: Column, rate: Column | float, seconds: float = 30.0) -> Column:
    return p >= seconds * (rate if isinstance(rate, Column) else F.lit(rate))


# --- domains of scorers -------------------------------------------------------------------------------------


def public_in_domain(trained_models: Column, weight: Column, corpora: dict[str, str], prefix: str = "eqt_") -> Column:
    """The weight's corpus is part of the label (a literal, unanchored match); unknown corpora and null labels are not."""
    table = F.create_map(*[F.lit(x) for kv in corpora.items() for x in kv])
    corpus = F.try_element_at(table, F.regexp_replace(weight, f"^{re.escape(prefix)}", ""))
    return F.coalesce(F.contains(trained_models, corpus), F.lit(False))


def own_in_domain(df: DataFrame, manifest: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Adds in_domain: the dataset is one of the manifest's. A missing column is an error, never "clean"."""
    if dataset not in df.columns:
        raise ValueError(f"own-model weights need the column {dataset!r}")
    known = manifest.select(F.col("dataset").alias("_known")).distinct()
    return df.join(known, F.col(dataset) == F.col("_known"), "left").withColumn("in_domain", F.col("_known").isNotNull()).drop("_known")


def clean_holdout(df: DataFrame, mask: DataFrame, keys: list[str], own: Column) -> DataFrame:
    """Adds clean: own weight, verifiable and not leaked. Rows without a mask are not clean."""
    once = mask.groupBy(*keys).agg(F.bool_and("verifiable").alias("_v"), F.bool_or("leaked").alias("_l"))
    return df.join(once, keys, "left").withColumn("clean", own & F.coalesce(F.col("_v") & ~F.col("_l"), F.lit(False))).drop("_v", "_l")


def parent_clean(df: DataFrame, mask: DataFrame, keys: list[str], corpus: Column, cross: Column) -> DataFrame:
    """Adds parent_clean for the weight's corpus; null where the corpus cannot be verified at all."""
    rows = mask.groupBy("corpus", *keys).agg(F.bool_and("verifiable").alias("_v"), F.bool_or("leaked").alias("_l"))
    able = mask.groupBy(F.col("corpus").alias("_able")).agg(F.bool_or("verifiable").alias("_any"))
    df = df.withColumn("corpus", corpus).join(rows, ["corpus", *keys], "left").join(able, F.col("corpus") == F.col("_able"), "left")
    value = F.when(F.coalesce("_any", F.lit(False)), cross & F.coalesce(F.col("_v") & ~F.col("_l"), F.lit(False)))
    return df.withColumn("parent_clean", value).drop("_v", "_l", "_any", "_able")

"""Poisson bootstrap of any statistic whose state adds up: functions of weighted sums, and weighted quantiles.

Each row gets one Poisson(1) weight a replicate, drawn from two words of an MD5 of its key that are mixed with the replicate's
number (the finaliser of MurmurHash3, once a word). A task keeps, for each group it meets, one vector of ``n_boot`` sums for each summed
expression; vectors are added after one shuffle. All functions of sums share one pass; no row is copied.

A quantile of a replicate is found in two passes. The first adds up weights over a few cells of the value near the sample's own
quantile (and one cell on either side), which tells for every replicate which cell holds its quantile and how much weight lies before;
the second lists the weighted values of those cells only, for the replicates that need them. Results are exact, also where a
replicate falls outside; the cells only decide how few rows the second pass lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import same_group

CELLS = 64
CHUNK = 2000  # rows that are weighted at once
_LIMITS = np.cumsum([np.exp(-1) / f for f in np.cumprod([1, *range(1, 12)])])


@dataclass(frozen=True)
class OfSums:
    """A statistic of weighted sums: ``value(sums)`` gets one column for each of ``terms``; ``counts`` marks the rows that count as its values."""

    terms: tuple[Column, ...]
    value: Callable[[list[Column]], Column]
    counts: Column


@dataclass(frozen=True)
class Quantile:
    value: Column
    at: float = 0.5


def ratio(above: Column, below: Column) -> OfSums:
    """A ratio of two sums over rows in which both are there."""
    held = above.isNotNull() & below.isNotNull()
    return OfSums((F.when(held, above), F.when(held, below)), lambda s: s[0] / F.nullif(s[1], F.lit(0.0)), held)


def mean(value: Column) -> OfSums:
    return ratio(value.cast("double"), F.when(value.isNotNull(), F.lit(1.0)))


def _finalised(z: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 32-bit words."""
    z = (z ^ (z >> np.uint32(16))) * np.uint32(2246822507)
    z = (z ^ (z >> np.uint32(13))) * np.uint32(3266489909)
    return z ^ (z >> np.uint32(16))


def _weights(pdf: pd.DataFrame, turns: np.ndarray) -> np.ndarray:
    """Rows x replicates."""
    first, second = (pdf[c].to_numpy(np.int64).astype(np.uint32)[:, None] for c in ("_a", "_b"))
    z = _finalised(_finalised(first + turns[None, :]) ^ second)
    return np.searchsorted(_LIMITS, (z + 0.5) / 2.0**32).astype(float)


def _turns(n_boot: int) -> np.ndarray:
    return np.arange(1, n_boot + 1, dtype=np.uint32) * np.uint32(2654435769)


def _words(key: Sequence[str], seed: int) -> list[Column]:
    """The two words of a row's draw."""
    word = lambda at: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key)), at, 8), 16, 10).cast("long")
    return [word(1).alias("_a"), word(9).alias("_b")]


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema)


def weighted_sums(rows: DataFrame, by: Sequence[str], terms: Sequence[str], n_boot: int) -> DataFrame:
    """(by, _term, _sums): for each group and term the ``n_boot`` weighted sums. ``rows`` holds the words _a and _b."""
    names, terms = list(by), list(terms)

    def partial(frames):
        held: dict[tuple, np.ndarray] = {}
        turns = _turns(n_boot)
        for pdf in frames:
            if not len(pdf):
                continue
            grouped = pdf.groupby(names, sort=False, dropna=False) if names else None
            code = grouped.ngroup().to_numpy() if names else np.zeros(len(pdf), np.int64)
            pdf = pdf.iloc[np.argsort(code, kind="stable")]
            code = np.sort(code, kind="stable")
            for at in range(0, len(pdf), CHUNK):
                part, own = pdf.iloc[at : at + CHUNK], code[at : at + CHUNK]
                w, starts = _weights(part, turns), np.flatnonzero(np.diff(own, prepend=-1))
                firsts = part[names].iloc[starts].itertuples(index=False, name=None) if names else [()]
                values = part[terms].to_numpy(float).T
                for group, low, high in zip(firsts, starts, [*starts[1:], len(part)], strict=True):
                    s = values[:, low:high] @ w[low:high]
                    group = tuple(None if pd.isna(g) else g for g in group)
                    held[group] = held[group] + s if group in held else s
        out = [[*g, k, list(v)] for g, s in held.items() for k, v in enumerate(s)]
        if out:
            yield pd.DataFrame(out, columns=[*names, "_term", "_sums"])

    parts = rows.select(*names, *terms, "_a", "_b").mapInPandas(partial, f"{_kinds(rows, names)}_term int, _sums array<double>")
    return parts.groupBy(*names, "_term").agg(vector_to_array(Summarizer.sum(array_to_vector("_sums"))).alias("_sums"))


def _ends(values: Column, level: float) -> tuple[Column, Column]:
    """Linearly interpolated ends of an interval of an array's values, nulls apart."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))

    def end(q: float) -> Column:
        place = (F.size(kept) - 1) * F.lit(float(q))
        low, high = F.get(kept, F.floor(place).cast("int")), F.get(kept, F.ceil(place).cast("int"))
        return F.when(F.size(kept) > 0, low + (high - low) * (place - F.floor(place)))

    return end((1 - level) / 2), end((1 + level) / 2)


def intervals(df: DataFrame, by: Sequence[str], statistics: dict[str, OfSums | Quantile], key: Sequence[str], n_boot: int = 1000, level: float = 0.95, seed: int = 42, least: int = 5) -> DataFrame:
    """(by, name_n, name_ci_lo, name_ci_hi for each statistic): percentile intervals; null where a statistic has fewer than ``least`` values.

    ``key`` is a row's unique key. Groups without rows give none.
    """
    by = list(by)
    sums = {n: s for n, s in statistics.items() if isinstance(s, OfSums)}
    ranks = {n: s for n, s in statistics.items() if isinstance(s, Quantile)}
    counts = [F.count_if(s.counts if n in sums else s.value.isNotNull()).alias(f"{n}_n") for n, s in statistics.items()]
    out = df.groupBy(*by).agg(*counts)
    found = [_of_sums(df, by, sums, key, n_boot, level, seed)] if sums else []
    found += [_of_ranks(df, by, n, s, key, n_boot, level, seed) for n, s in ranks.items()]
    for part in found:
        part = part.select(*[F.col(b).alias(f"_g_{b}") for b in by], *[c for c in part.columns if c not in by])
        out = (out.join(part, same_group(out, part, by), "left") if by else out.crossJoin(part)).drop(*[f"_g_{b}" for b in by])  # one row each
    ends = [F.when(F.col(f"{n}_n") >= least, F.col(f"{n}_{e}")).alias(f"{n}_{e}") for n in statistics for e in ("ci_lo", "ci_hi")]
    return out.select(*by, *[f"{n}_n" for n in statistics], *ends)


def _of_sums(df: DataFrame, by: list[str], statistics: dict[str, OfSums], key: Sequence[str], n_boot: int, level: float, seed: int) -> DataFrame:
    terms = [(n, k, t) for n, s in statistics.items() for k, t in enumerate(s.terms)]
    held = df.select(*by, *_words(key, seed), *[F.coalesce(t.cast("double"), F.lit(0.0)).alias(f"_t{i}") for i, (_, _, t) in enumerate(terms)])
    vectors = weighted_sums(held, by, [f"_t{i}" for i in range(len(terms))], n_boot)
    wide = vectors.groupBy(*by).agg(*[F.first(F.when(F.col("_term") == i, F.col("_sums")), ignorenulls=True).alias(f"_t{i}") for i in range(len(terms))])
    ends = []
    for name, s in statistics.items():
        own = [i for i, (n, _, _) in enumerate(terms) if n == name]
        wide = wide.withColumn(f"_v_{name}", _apply(own, s.value))
        ends += [e.alias(f"{name}_{c}") for e, c in zip(_ends(F.col(f"_v_{name}"), level), ("ci_lo", "ci_hi"), strict=True)]
    return wide.select(*by, *ends)


def _apply(own: list[int], value: Callable[[list[Column]], Column]) -> Column:
    return F.transform(F.arrays_zip(*[F.col(f"_t{i}") for i in own]), lambda z: value([z[f"_t{i}"] for i in own]))


def _of_ranks(df: DataFrame, by: list[str], name: str, statistic: Quantile, key: Sequence[str], n_boot: int, level: float, seed: int) -> DataFrame:
    q = statistic.at
    rows = df.select(*by, *_words(key, seed), F.nanvl(statistic.value.cast("double"), F.lit(None)).alias("_v")).where("_v IS NOT NULL")
    # cells between two sample quantiles around q, as far apart as replicates stray from it
    steps = [0.3 / 10 ** (k / 2) for k in range(8)]
    marks = [F.lit(float(min(max(q + s, 0.0), 1.0))) for d in steps for s in (-d, d)]
    near = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.approx_percentile("_v", F.array(*marks), F.lit(10_000)).alias("_m"))
    which = F.least(F.lit(len(steps) - 1), F.greatest(F.lit(0), F.floor(2 * F.log10(F.sqrt("_n") / 10)).cast("int")))
    near = near.select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col("_m")[2 * which].alias("_low"), F.col("_m")[2 * which + 1].alias("_high"))
    dealt = rows.join(near, same_group(rows, near, by)) if by else rows.crossJoin(F.broadcast(near))  # one row
    inner = F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * CELLS).cast("int")
    cell = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), CELLS + 1).otherwise(F.coalesce(inner, F.lit(0)))
    dealt = dealt.select(*by, "_a", "_b", "_v", cell.alias("_cell"), F.lit(1.0).alias("_one"))
    weights = weighted_sums(dealt, [*by, "_cell"], ["_one"], n_boot)
    long = weights.select(*by, "_cell", F.posexplode("_sums").alias("_r", "_w"))
    whole = Window.partitionBy(*by, "_r")  # a row a cell
    long = long.withColumn("_before", F.coalesce(F.sum("_w").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_place", q * (F.sum("_w").over(whole) - 1))
    ranks = [F.floor("_place"), F.ceil("_place")]
    needed = long.where((F.col("_place") >= 0) & (F.col("_before") <= ranks[1]) & (ranks[0] < F.col("_before") + F.col("_w")))
    needed = needed.groupBy(*[F.col(b).alias(f"_g_{b}") for b in [*by, "_cell"]]).agg(F.collect_list(F.struct("_r", "_before", "_place")).alias("_need"))  # n_boot at most
    asked = dealt.join(needed, same_group(dealt, needed, [*by, "_cell"])).select(*by, "_cell", "_a", "_b", "_v", F.transform("_need", lambda s: s["_r"]).alias("_rs"))

    def listed(frames):
        turns = _turns(n_boot)
        for pdf in frames:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                w = _weights(part, turns)
                size = part["_rs"].map(len).to_numpy()
                row, turn = np.repeat(np.arange(len(part)), size), np.concatenate([np.asarray(r, int) for r in part["_rs"]]) if size.sum() else np.zeros(0, int)
                got = w[row, turn]
                keep = got > 0
                out = part.iloc[row[keep]][[*by, "_cell", "_v"]].reset_index(drop=True)
                yield out.assign(_r=turn[keep], _w=got[keep])

    values = asked.mapInPandas(listed, f"{_kinds(rows, by)}_cell int, _v double, _r int, _w double").groupBy(*by, "_cell", "_r", "_v").agg(F.sum("_w").alias("_w"))
    places = needed.select(*[F.col(f"_g_{b}") for b in [*by, "_cell"]], F.inline("_need")).withColumnsRenamed({"_r": "_g__r"})
    ranked = values.join(places, same_group(values, places, [*by, "_cell", "_r"]))
    upto = F.col("_before") + F.sum("_w").over(Window.partitionBy(*by, "_cell", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_upto", upto)
    reach = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    each = ranked.groupBy(*by, "_r", "_place").agg(reach(ranks[0]).alias("_x"), reach(ranks[1]).alias("_y"))
    share = F.col("_place") - F.floor("_place")
    each = each.withColumn("_q", (1 - share) * F.col("_x") + share * F.col("_y"))
    gathered = each.groupBy(*by).agg(F.collect_list("_q").alias("_qs"))  # n_boot values
    ends = _ends(F.col("_qs"), level)
    return gathered.select(*by, ends[0].alias(f"{name}_ci_lo"), ends[1].alias(f"{name}_ci_hi"))

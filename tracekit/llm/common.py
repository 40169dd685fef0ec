"""Helpers shared by the text operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import smallest_labels  # noqa: F401
from ..sources.scratch import checkpointed, shared_folder, written  # noqa: F401

#: ASCII white space: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, however often it is used (inside lambdas too)."""
    return F.transform(F.array(value), use)[0]


def offsets(lengths: Column, chunk: int = 256) -> Column:
    """Where each of some consecutive parts begins: running sums of an array of lengths, as long numbers.

    An array only grows by copying, so sums run inside chunks and over the chunks' totals: linear for arrays of any
    practical length.
    """
    run = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda i: run(F.slice(a, i * chunk + 1, F.lit(chunk))))
    moved = lambda parts, bases: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(bases, i))))
    whole = lambda a: let(chunks(a), lambda parts: let(run(F.transform(parts, lambda p: F.element_at(p, -1))), lambda bases: moved(parts, bases)))
    return let(lengths, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast("array<bigint>")))


def peaks(values: Column, chunk: int = 256) -> Column:
    """The largest value so far at each place of an array, in chunks as ``offsets``."""
    run = lambda a: F.aggregate(a, F.slice(a, 1, 0), lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.try_element_at(acc, F.lit(-1))))))
    chunks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda i: run(F.slice(a, i * chunk + 1, F.lit(chunk))))
    moved = lambda parts, tops: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: F.greatest(x, F.get(tops, i - 1)))))
    whole = lambda a: let(chunks(a), lambda parts: let(run(F.transform(parts, lambda p: F.element_at(p, -1))), lambda tops: moved(parts, tops)))
    return let(values, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(a))


def below(ordered: Column, value: Column) -> Column:
    """How many values of an ascending array are smaller than ``value``, by halving."""

    def halve(acc, _):
        mid = F.shiftright(acc["l"] + acc["h"], 1)
        upper = F.struct((mid + 1).alias("l"), acc["h"].alias("h"))
        return F.when(acc["l"] >= acc["h"], acc).when(F.get(ordered, mid) < value, upper).otherwise(F.struct(acc["l"].alias("l"), mid.alias("h")))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(ordered)))), F.struct(F.lit(0).alias("l"), F.size(ordered).alias("h")), halve)["l"]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the named columns."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def text_slices(batches, column: int, size: int):
    """Arrow batches cut into pieces of about ``size`` bytes of one text column."""
    for batch in batches:
        if batch.num_rows:
            whole = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = [*(np.flatnonzero(np.diff(whole // size)) + 1), batch.num_rows]
            for low, high in zip([0, *ends], ends, strict=False):
                yield batch.slice(low, high - low)

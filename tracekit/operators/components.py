"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

CROWD = 64  # rows that look up one value: from here on the value is offered to all tasks


def led(rows: DataFrame, column: str, values: DataFrame, crowded: DataFrame | None, to: str) -> DataFrame:
    """``rows`` with ``values(key, value)`` of ``column`` in its place as ``to``; what has no value stays.

    ``crowded(key, value)``, a written table, holds those of them that very many rows ask for, if there are any. The planner knows its
    size and broadcasts it while it is small, so that those rows do not meet in one task; where it is not small, a skewed join is
    split by AQE.
    """
    rest = [c for c in rows.columns if c != column]
    few = values.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    found = lambda df, other, how: df.join(other, F.col(column) == F.col("_k"), how)
    named = lambda df: df.select(*rest, F.coalesce("_v", column).alias(to))
    if crowded is None:
        return named(found(rows, few, "left"))
    many = crowded.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    cold = found(rows, many.select("_k"), "left_anti")
    return named(found(rows, many, "inner")).unionByName(named(found(cold, few, "left")))


def _crowded(counts: DataFrame, values: DataFrame, enough: bool) -> DataFrame | None:
    """The values of keys that ``counts(key, n)`` says are asked for by a crowd, as a written table; None if there are none, or not
    ``enough`` rows ask at all."""
    if not enough:
        return None
    many = counts.where(F.col("n") >= CROWD).select("key")
    return written(many.join(values, "key", "left").select("key", "value")) if many.limit(1).count() else None


def smallest_labels(vertices: DataFrame, edges: DataFrame, seed: int = 7, few: int = 0) -> DataFrame:
    """``vertices(id)`` with ``edges(a, b)`` -> ``(id, component)``, the smallest id reachable. Ids are of any type that orders.

    Every round each vertex moves into the first of its neighbours and itself, and the links are rewritten to
    where their ends have gone. "First" is the smallest id in the first two rounds, which settle stars and small groups, and
    then the smallest of a hash that is new every round (Bögeholz, Brand and Todor, 2018). Whatever the shape of a
    component or the order of its ids, that removes a constant share of its vertices in expectation, so the number of rounds
    is logarithmic and needs no limit: a round without progress is followed by one with other hashes.

    Links only shrink, the driver sees only whether any are left, and minima are combined before their shuffle. A vertex
    with very many links, or the root of a giant component, is looked up by broadcast (see ``led``); in tables of up to ``few``
    rows, which any task holds, such vertices are not sought. Null ids have no links and are components of their own.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    links = written(both.where("a <> b").distinct())
    moves: list[tuple[DataFrame, int]] = []
    while True:
        turn = len(moves)
        if turn < 2:
            first = F.least("a", F.min("b"))
        else:
            drawn = lambda c: F.struct(F.xxhash64(F.lit(seed + turn), c).alias("draw"), F.col(c).alias("id"))  # noqa: B023, E731
            first = F.least(drawn("a"), F.min(drawn("b")))["id"]
        counted = written(links.groupBy(F.col("a").alias("key")).agg(first.alias("value"), F.count(F.lit(1)).alias("n")))
        size = counted.count()
        if not size:
            break
        move = counted.select("key", "value")
        crowded = _crowded(counted, move, size > few)
        moves.append((move, size))
        moved = led(led(links, "a", move, crowded, "a"), "b", move, crowded, "b")
        links = written(moved.where("a <> b").distinct())
    whole = vertices.select("id").distinct()
    if not moves:
        return whole.select("id", F.col("id").alias("component"))
    root = moves[-1][0]
    asked = lambda rows: rows.groupBy(F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    for move, size in reversed(moves[:-1]):
        root = written(led(move, "value", root, _crowded(asked(move), root, size > few), "value"))
    if len(moves) > 2:  # rounds by hash end at any vertex of a component
        low = written(root.groupBy(F.col("value").alias("key")).agg(F.min("key").alias("value")))
        root = led(root, "value", low, _crowded(asked(root), low, moves[0][1] > few), "value")
    found = root.select(F.col("key").alias("id"), F.col("value").alias("component"))
    return whole.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

"""Embedding near-duplicates by a pivot-permutation index.

Every label (and dimension) has its own reference points ("pivots"): vectors drawn by hash, ``per_root`` times the square root
of the label's number of vectors and ``most_pivots`` at most, thinned so that no two of them are alike (a hot group of
near-copies would otherwise fill the nearest places of its members with arbitrary twins). A vector is described by its
``top`` nearest pivots in order (four, plus the logarithm of the pivots to base 2); all vectors are indexed.

Vectors that share ``shared`` pivots or more are candidates. Such a pair has its first common pivot, in one order for all, among
the first ``top - shared + 1`` of both, so the inverted lists hold just those places and a pair counts only in the list of
its first common pivot. Lists carry ids and descriptions; members are compared by their number of shared pivots, and
vectors travel only for members that have a candidate, to be verified by cosine in double precision. With the square-root rule a
list grows with the square root of its label, and so does the work a vector. At cosine 0.93 random pairs share five
pivots with a chance above 0.99 for 32 to 4096 pivots; recall against brute force is tested (at least 0.9; 1 on the given
tables).

Lists longer than ``block`` are cut into blocks and every pair of blocks is a task of its own, so no task holds a whole
list. A task returns one row a vector (its links there and the smallest id of its part), never pairs. Equal vectors are one
class, carried as its smallest id and its number of copies.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
nothing (0 links, own component, kept); repeated ids count as vectors of their own but share the id's component; dimensions
may differ (they never link across); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, smallest_labels, written

ALIKE = 0.8  # pivots at this cosine or more are one
SLICE = 8192  # vectors described at once
SHORT = 16  # lists of one block that share a task's call


def _usable():
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    whole = table.column(column).combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _long(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64)


def thinned(table: pa.Table) -> pa.Table:
    """A label's pivots without those that are like an earlier one, rarely nearest ones first (their lists are short)."""
    table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
    u = unit(_matrix(table, "v"))
    alike, drop = u @ u.T, np.zeros(len(u), bool)
    for i in range(len(u)):
        if not drop[i]:
            drop[i + 1 :] |= alike[i, i + 1 :] >= ALIKE
    kept = np.flatnonzero(~drop)
    near = np.argsort(-alike[:, kept], axis=1, kind="stable")[:, : top_of(len(kept))]
    often = np.bincount(near.ravel(), minlength=len(kept))
    order = kept[np.argsort(often, kind="stable")]
    return table.take(pa.array(order)).append_column("k", pa.array(np.arange(len(order)), pa.int32())).select(["label", "dim", "slices", "k", "v"])


def top_of(pivots: int) -> int:
    return min(pivots, 4 + int(np.log2(max(pivots, 1))))


def described(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
    """Adds ``near``, the numbers of the nearest pivots, nearest first."""
    p = unit(_matrix(pivots.sort_by("k"), "v"))
    top = top_of(len(p))
    near = np.argsort(-(unit(_matrix(vectors, "v")) @ p.T), axis=1, kind="stable")[:, :top].astype(np.int16) if vectors.num_rows else np.empty((0, top), np.int16)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * top, pa.int32()), pa.array(near.ravel()))
    return vectors.select(["label", "dim", "h1", "h2"]).append_column("near", lists)


def _lists(table: pa.Table):
    """The lists of one call, block pair by block pair: places in the table, multi-hot descriptions and the pairs' candidates."""
    p, block = _long(table, "p"), _long(table, "b")
    near = _matrix(table, "near").astype(np.int64)
    by = np.argsort(p, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(p[by])) + 1), len(by)]
    two = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    for low, high in zip(edges, edges[1:], strict=False):
        at = by[low:high]
        used, column = np.unique(near[at], return_inverse=True)
        column = column.reshape(len(at), -1)
        has = np.zeros((len(at), len(used)), np.float32)
        np.put_along_axis(has, column, 1, 1)
        before = has[:, : np.searchsorted(used, p[at[0]])]
        yield at, block[at], has, before, two


def _candidates(has: np.ndarray, before: np.ndarray, block: np.ndarray, two: bool, shared: int, width: int) -> np.ndarray:
    """Pairs that share enough pivots, this list's pivot being the first of them."""
    found = (has @ has.T) >= min(shared, width)
    if before.shape[1]:
        found &= (before @ before.T) == 0
    np.fill_diagonal(found, False)
    if two:
        found &= block[:, None] != block[None, :]
    return found


def surviving(table: pa.Table, shared: int) -> pa.Table:
    """Members of the lists of one call that have a candidate there."""
    width, keep = _matrix(table, "near").shape[1], []
    for at, block, has, before, two in _lists(table):
        keep.append(at[_candidates(has, before, block, two, shared, width).any(1)])
    return table.take(pa.array(np.sort(np.concatenate(keep))))


def _parts(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each vector's part under the links of one task."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1))
        new = np.minimum(new, np.where(linked, new[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def verified(table: pa.Table, least: float, shared: int) -> pa.Table:
    """One row for each member with links there: rep, links (copies counted) and part."""
    ids, copies, width = _long(table, "rep"), _long(table, "copies"), _matrix(table, "near").shape[1]
    every, out = unit(_matrix(table, "v")), []
    for at, block, has, before, two in _lists(table):
        u = every[at]
        linked = _candidates(has, before, block, two, shared, width) & ((u @ u.T) >= least)
        n = linked @ copies[at]
        hit = n > 0
        if hit.any():
            out.append((ids[at][hit], n[hit], _parts(linked, ids[at])[hit]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "part"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, per_root: int = 8, most_pivots: int = 4096, shared: int = 5, block: int = 512) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    kind = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"  # floats travel as floats
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.select("vec_id", "label", "v", _usable().alias("usable"), F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    classes = rows.where("usable").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = checkpointed(classes.withColumn("dim", F.size("v")))

    group = ["label", "dim"]
    pivots = F.least(F.lit(most_pivots), F.greatest(F.lit(32), F.lit(per_root) * F.ceil(F.sqrt("n"))))
    sizes = classes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes.select(*group, (pivots / F.col("n")).alias("chance"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))  # a row a label
    sized = classes.join(sizes, group)
    draw = F.pmod(F.xxhash64("h2", "h1", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = sized.where(draw < F.col("chance")).select(*group, "slices", "h1", "h2", "v")
    kept = drawn.groupBy(*group).applyInArrow(thinned, f"label string, dim int, slices int, k int, v array<{kind}>")
    spread = kept.select(*group, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "k", "v")
    sliced = sized.select(*group, F.pmod("h1", F.col("slices")).cast("int").alias("slice"), "h1", "h2", "v")
    described_by = sliced.groupBy(*group, "slice").cogroup(spread.groupBy(*group, "slice"))
    entries = checkpointed(described_by.applyInArrow(described, "label string, dim int, h1 long, h2 long, near array<smallint>"))

    places = F.slice(F.array_sort("near"), F.lit(1), F.size("near") - F.least(F.lit(shared), F.size("near")) + 1)
    keys = entries.select(*group, "h1", "h2", "near", F.explode(places).alias("p"))
    at = [*group, "p"]
    held = keys.groupBy(*at).agg(F.count(F.lit(1)).alias("held")).where("held > 1").select(*at, F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    dealt = keys.join(held, at).withColumn("b", F.pmod(F.xxhash64("h1", "h2", "p"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack = F.when(F.col("blocks") == 1, -1 - F.floor(F.col("p") / SHORT)).otherwise(F.col("p")).cast("int")
    dealt = dealt.select(*at, "h1", "h2", "near", "b", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), pack.alias("pack"))
    call = [*group, "pack", "i", "j"]
    some = dealt.groupBy(*call).applyInArrow(lambda t: surviving(t, shared), dealt.schema)
    full = some.join(classes.select("label", "h1", "h2", "rep", "copies", "v"), ["label", "h1", "h2"])
    found = checkpointed(full.groupBy(*call).applyInArrow(lambda t: verified(t, least, shared), "rep long, links long, part long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = smallest_labels(classes.select(F.col("rep").alias("id")), found.select(F.col("rep").alias("a"), F.col("part").alias("b")).where("a <> b"))
    named = classes.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep")
    named = named.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.col("component").alias("c"), F.lit(True).alias("usable"))
    out = rows.select("vec_id", "label", "usable", "h1", "h2").join(named, ["label", "h1", "h2", "usable"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
reach AS (SELECT a AS id, a AS other FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.other = l.a),
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(comp.c, e.vec_id) AS component_id, coalesce(comp.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""

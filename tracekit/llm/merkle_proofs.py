"""Merkle dataset manifest: leaves, trees, and a proof for every row by pointer jumping.

``H`` is the lowercase hex SHA-256 of its inputs joined, digests as hex text. A row's leaf is H of its fields, each ``-`` if null, else
its length in UTF-8 bytes, ``:`` and the value. The leaves of a group (``by``, a language) stand in the order of their ids; while
several nodes remain, every ``fan`` consecutive ones become their H, the last run may be shorter. What remains is the group's
subroot; the subroots, by group (null first, bytewise), make the top tree in the same way, up to the root.

Order. Positions come from ``operators.order.numbered``: sorted ranges and counts before each, so a language with most
of the rows is many ranges. Trees grow by blocks of about ``BLOCK`` nodes: the levels inside a block are array expressions on one row,
so ten thousand million leaves take four shuffles, each a thousandth of the one before.

Proofs. Every node but the root starts with its own siblings and its parent as ancestor. A round joins a node with its ancestor, adds the
ancestor's segment to its own and takes over the ancestor's ancestor: distances double, so depth 40 takes six rounds. Only nodes
that later rounds can ask for are kept (in round k the levels divisible by 2^k, and the top tree), so rounds cost what their segments weigh.
The ancestors of a round, a few once they stand far up and are shared by very many leaves, are broadcast when their measured
size is below ``SMALL`` bytes; when they are more, each serves a small share of the rows.

Every round is a table in the shared folder, so a lost executor costs tasks, not rounds.

Defined cases: nulls are fields of their own; null ids come first; repeated ids follow by leaf, repeated rows have one leaf at several
places; a single row is its own subroot and root with an empty proof (``proof_sha256`` is H of nothing); an empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = 1024  # nodes that one row holds while a tree grows
SMALL = 16_000_000  # bytes of ancestors that a round may broadcast
TOP = -1  # group number of the top tree
NODE = ("g", "level", "idx")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: its length in bytes and its value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column] | Sequence[str]) -> Column:
    """The leaf of a row with the given fields."""
    return digest(*[field(v) for v in (values.values() if isinstance(values, dict) else map(F.col, values))])


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _height(n: Column, fan: int) -> Column:
    """Levels above n leaves: the digits of n - 1 to the base ``fan`` (up to 36), none for one leaf."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, fan))).otherwise(0).cast("int")


def _grow(nodes: DataFrame, largest: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Trees of many groups at once: (g, height, idx, digest) -> their nodes below the root (g, height, level, idx, before, after), with
    the joined digests of the run before and behind each, and the roots (g, digest).
    """
    step = next(s for s in range(64, 0, -1) if s == 1 or fan**s <= BLOCK and fan ** (s - 1) < largest)
    now, level, parts, roots = nodes, 0, [], []

    def runs(level_below: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(level_below), F.lit(fan))
        return F.transform(starts, lambda i: digest(F.array_join(F.slice(level_below, i, F.lit(fan)), "")))

    while True:
        whole = now.groupBy("g", "height", F.floor(F.col("idx") / fan**step).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("digest").alias("d")))).alias("_m"))
        whole = whole.withColumn("_up", F.least(F.lit(step), F.col("height") - level)).withColumn("_l0", F.transform("_m", lambda s: _hex(s["d"])))
        for k in range(step):
            whole = whole.withColumn(f"_l{k + 1}", F.when(F.col("_up") > k, runs(F.col(f"_l{k}"))))

        def entries(k: int) -> Column:
            run = F.col(f"_l{k}")
            others = lambda start, size: F.unhex(F.array_join(F.slice(run, start, size), ""))
            entry = lambda d, j: F.struct(F.lit(level + k).alias("level"), (F.col("block") * fan ** (step - k) + j).alias("idx"), F.unhex(d).alias("digest"), others(j - j % fan + 1, j % fan).alias("before"), others(j + 2, F.lit(fan - 1) - j % fan).alias("after"))
            return F.when(F.col("_up") > k, F.transform(run, entry)).otherwise(F.array().cast("array<struct<level:int,idx:bigint,digest:binary,before:binary,after:binary>>"))

        top = F.unhex(F.coalesce(*[F.col(f"_l{k}") for k in range(step, -1, -1)])[0])
        held = written(whole.select("g", "height", "block", F.concat(*[entries(k) for k in range(step)]).alias("inside"), top.alias("digest")))
        parts.append(held.select("g", "height", F.explode("inside").alias("n")).select("g", "height", "n.*"))
        level += step
        roots.append(held.where(F.col("height") <= level).select("g", "digest"))
        if fan**level >= largest:
            return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, roots)
        now = held.where(F.col("height") > level).select("g", "height", F.col("block").alias("idx"), "digest")


def manifest(leaves: DataFrame, by: str, order: Sequence[str], leaf_col: str = "leaf", fan: int = 2) -> tuple[DataFrame, DataFrame, str | None]:
    """(rows, links, root). rows: the given ones with their node (g, level, idx), in which leaves that are alone in their group stand
    in the top tree; links: every node but the root with ``up`` (its parent, null for the root), ``segment`` (its siblings) and ``subroot``
    (its digest, of the nodes that are subroots); root: hex.

    ``leaf_col`` holds digests as bytes.
    """
    if not 2 <= fan <= 36:
        raise ValueError("fan: 2 to 36")
    placed = numbered(leaves, [by], [*order, leaf_col], "_at")
    groups = written(numbered(placed.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), [], [by], "_g").withColumn("_h", _height(F.col("_n"), fan)))
    sizes = groups.agg(F.max("_n").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
    if not sizes["groups"]:
        links = leaves.sparkSession.createDataFrame([], "g long, level int, idx long, up struct<g:long,level:int,idx:long>, segment array<struct<before:binary,after:binary>>, subroot binary")
        return leaves.select("*", F.lit(0).cast("long").alias("g"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx")), links, None
    named = groups.select(F.col(by).alias("_by"), (F.col("_g") - 1).alias("g"), F.col("_h").alias("height"))
    rows = written(placed.join(named, placed[by].eqNullSafe(named["_by"])).withColumn("idx", F.col("_at") - 1).drop("_by", "_at"))
    nodes, subroots = _grow(rows.select("g", "height", "idx", F.col(leaf_col).alias("digest")), sizes["largest"], fan)
    top = written(subroots.select(F.lit(TOP).cast("long").alias("g"), F.col("g").alias("idx"), "digest").withColumn("height", _height(F.lit(sizes["groups"]), fan)))
    above, root = _grow(top, sizes["groups"], fan)
    node = lambda g, level, idx: F.struct(g.cast("long").alias("g"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))
    parent = node(F.col("g"), F.col("level") + 1, F.floor(F.col("idx") / fan))
    segment, nothing = F.array(F.struct("before", "after")).alias("segment"), F.lit(None).cast("binary")
    last = F.col("level") + 1 == F.col("height")
    above_subroot = F.when(F.lit(sizes["groups"] > 1), node(F.lit(TOP), F.lit(0), F.col("g")))  # a lone subroot is the root
    low = nodes.select(*NODE, F.when(~last, parent).otherwise(above_subroot).alias("up"), segment, nothing.alias("subroot"))
    high = above.select(*NODE, F.when(~last, parent).alias("up"), segment, F.when(F.col("level") == 0, F.col("digest")).alias("subroot"))
    alone = F.col("height") == 0
    rows = rows.select(*leaves.columns, F.when(alone, TOP).otherwise(F.col("g")).cast("long").alias("g"), F.lit(0).alias("level"), F.when(alone, F.col("g")).otherwise(F.col("idx")).alias("idx"))
    return rows, low.unionByName(high), root.select(_hex(F.col("digest")).alias("d")).first()["d"]


def proofs(links: DataFrame) -> DataFrame:
    """(g, level, idx, segment, subroot) of every leaf and every node of the top tree: its siblings up to the root."""
    now, found, k = written(links), [], 0
    while True:
        starts = F.col("level") == 0
        found.append(now.where(starts & F.col("up").isNull() & (F.col("g") != TOP)))
        left = now.where(F.col("up").isNotNull())
        if not left.limit(1).count():
            found.append(now.where(F.col("g") == TOP))
            return reduce(DataFrame.unionByName, found).select(*NODE, "segment", "subroot")
        needed = (F.col("g") == TOP) | (F.col("level") % 2 ** (k + 1) == 0)
        targets = now.where((F.col("g") == TOP) | (F.col("level") % 2 ** (k + 1) == 2**k))
        size = targets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("segment", F.lit(0), lambda a, s: a + 24 + F.octet_length(s["before"]) + F.octet_length(s["after"]))).alias("b")).first()
        ancestors = targets.select(F.struct(*NODE).alias("_node"), F.col("up").alias("_up"), F.col("segment").alias("_more"), F.col("subroot").alias("_sub"))
        if 100 * size["n"] + (size["b"] or 0) <= SMALL:
            ancestors = F.broadcast(ancestors)  # counted above
        on = (F.col("up.g") == F.col("_node.g")) & (F.col("up.level") == F.col("_node.level")) & (F.col("up.idx") == F.col("_node.idx"))
        jumped = left.where(needed).join(ancestors, on).select(*NODE, F.col("_up").alias("up"), F.concat("segment", "_more").alias("segment"), F.coalesce("subroot", "_sub").alias("subroot"))
        now = written(jumped.unionByName(now.where(F.col("up").isNull() & needed & ~(starts & (F.col("g") != TOP)))))
        k += 1


def folded(start: Column, segment: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    return F.aggregate(segment, start, lambda acc, s: digest(_hex(s["before"]), acc, _hex(s["after"])))


def proof_digest(segment: Column) -> Column:
    return digest(F.array_join(F.transform(segment, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


def with_proofs(leaves: DataFrame, by: str, order: Sequence[str], leaf_col: str = "leaf", fan: int = 2) -> DataFrame:
    """The given rows with ``proof`` (array of siblings before and behind, from the leaf up), ``subroot`` and ``root`` (hex)."""
    rows, links, root = manifest(leaves, by, order, leaf_col, fan)
    own = proofs(links).select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("segment").alias("proof"), "subroot")
    joined = rows.join(own, (F.col("g") == F.col("_g")) & (F.col("level") == F.col("_level")) & (F.col("idx") == F.col("_idx")), "left")
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    return joined.select(*leaves.columns, F.coalesce("proof", empty).alias("proof"), F.coalesce(_hex(F.col("subroot")), F.lit(root)).alias("subroot"), F.lit(root).cast("string").alias("root"))


def manifest_check(docs: DataFrame, changed: Column, change: dict[str, Column], by: str = "lang", order: Sequence[str] = ("doc_id",), fields: Sequence[str] = FIELDS, fan: int = 2) -> DataFrame:
    """Every row's leaf, roots and proof, and what its proof makes of the row as it is now: where ``changed`` holds, its fields have
    become those of ``change``. ``verified`` says whether that is still the root."""
    now = {f: change.get(f, F.col(f)) for f in fields}
    held = docs.select(*order, by, F.unhex(leaf(fields)).alias("leaf"), F.when(changed, F.unhex(leaf(now))).alias("_now"))
    out = with_proofs(written(held), by, order, fan=fan)
    out = out.withColumn("folded_root", folded(_hex(F.coalesce("_now", "leaf")), F.col("proof")))
    return out.select(*order, _hex(F.col("leaf")).alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, with one added to n_chars of those whose id's CRC-32 is divisible by seven."""
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    return manifest_check(docs, changed, {"n_chars": F.col("n_chars") + 1})


def _fields_sql(more: str = "") -> str:
    values = {f: f"CAST({f}{more if f == 'n_chars' else ''} AS VARCHAR)" for f in FIELDS}
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for f, v in values.items()) + "))"


#: CRC-32 of an id's digits: eight shifts for every character.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

#: The same in SQL: levels by recursion, proofs by climbing one level at a time.
ORACLE = f"""WITH RECURSIVE hashed AS (SELECT doc_id, lang, {_fields_sql()} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_fields_sql(" + 1")} ELSE {_fields_sql()} END AS now FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes(lang, level, idx, d, n) AS (SELECT lang, 0, idx, leaf, n FROM leaves
  UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n),
subs AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(level, idx, d, n) AS (SELECT 0, g, d, n FROM subs UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
climb(doc_id, lang, leaf, level, idx, n, path, acc) AS (SELECT doc_id, lang, leaf, 0, idx, n, '', now FROM leaves
  UNION ALL SELECT c.doc_id, c.lang, c.leaf, c.level + 1, c.idx // 2, (c.n + 1) // 2, c.path || coalesce(s.d, ''), sha256(CASE WHEN c.idx % 2 = 0 THEN c.acc || coalesce(s.d, '') ELSE s.d || c.acc END)
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.idx = xor(c.idx, 1::BIGINT) WHERE c.n > 1),
over(doc_id, leaf, subroot, level, idx, n, path, acc) AS (SELECT c.doc_id, c.leaf, s.d, 0, s.g, s.n, c.path, c.acc FROM climb c JOIN subs s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.idx // 2, (c.n + 1) // 2, c.path || coalesce(s.d, ''), sha256(CASE WHEN c.idx % 2 = 0 THEN c.acc || coalesce(s.d, '') ELSE s.d || c.acc END)
  FROM over c LEFT JOIN top s ON s.level = c.level AND s.idx = xor(c.idx, 1::BIGINT) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(path) AS proof_sha256, acc AS folded_root, acc = r.d AS verified FROM over o, top r WHERE o.n = 1 AND r.n = 1"""

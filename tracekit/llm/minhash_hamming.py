"""MinHash near-duplicates by a multi-index Hamming join.

Signature: ``CODES`` MinHash values of a document's shingle set, each cut to 16 bits. The distance of two signatures is the
number of codes that differ. Signatures are split into ``CHUNKS`` chunks of four codes; by pigeonhole two signatures
within ``2 * CHUNKS - 1`` have a chunk with one error at most, so enumerating for each chunk the keys that leave one code
out finds every pair within that distance (at similarity 0.8 a pair lies beyond it with a probability of 2e-5).

Links are confirmed on the full shingle sets. Nothing emits all pairs of a group:

1. equal sets are one class, kept as its smallest id;
2. each key list compares its members with one pivot only, the member that lies in the most and longest lists (the
   original that many edited copies share), which is linear in the keys. A member first meets the nearest of its
   pivots, one pair a member; its other pivots follow only where they are still in another component;
3. only lists that still hold several components are compared further, and only across components. Members of small
   components are joined by key, with size, signature distance, the bound of ``odd_table`` and "their first common key"
   inside the join condition; a list of more than ``LIST`` of them is dealt to blocks whose pairs are keys of their own, so no
   task holds a whole list. The bound loses no link and leaves only pairs that are linked or close to it: the members of a
   family at similarity 0.6 meet inside the join and make no rows.
   Members beside a large component (``large`` or more) are compared with all of it on full sets, in blocks of
   ``BLOCK`` by ``BLOCK`` that return at most one link a member. That is the exact way for the rest: afterwards every
   pair within reach that shares a key is either compared or already in one component. ``large`` sets only which of the two
   exact ways is taken.

What is looked up by component (a row for each large component) is a written table: the planner knows its size and broadcasts
it while it is small, so that the members of one huge component do not meet in a task.

Defined cases: text that is null or has no words gives an empty set that links with nothing; one word is one shingle;
rows with a null id link with nothing and are their own component (null, kept); repeated ids each take the component of
their own text; a text of any length is one set; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, smallest_labels, text_slices, written

CHUNKS, IN_CHUNK = 10, 4
CODES = CHUNKS * IN_CHUNK
REACH = 2 * CHUNKS - 1
LARGE, BLOCK, LIST = 32, 128, 512
SPREAD = 1  # bits for a shingle in odd_table, at least: rejects what lies below similarity 0.75 or so
BYTES = 4_000_000  # of text hashed at once

_MULTIPLY = np.random.default_rng(20240607).integers(1, 2**63, CODES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and where each text's begin (one more than texts)."""
    split = [(t or "").encode().lower().split() for t in texts]  # bytes: ASCII letters and white space only
    n = np.array([len(w) for w in split], dtype=np.int64)
    if not n.sum():
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    flat = np.empty(n.sum(), dtype=object)
    flat[:] = [w for ws in split for w in ws]
    h = pd.util.hash_array(flat, categorize=True)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    length = np.minimum(n, width)[owner]  # a shorter sequence is one shingle
    starts = at + length <= n[owner]
    acc = np.zeros(len(h), np.uint64)
    for k in range(width):
        ahead = np.minimum(np.arange(len(h)) + k, len(h) - 1)
        acc = np.where(k < length, _mix(acc + h[ahead] + np.uint64(k + 1)), acc)
    owner, acc = owner[starts], acc[starts]
    order = np.lexsort((acc, owner))
    owner, acc = owner[order], acc[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    owner, acc = owner[first], acc[first]
    return acc, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, CODES) codes; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, CODES), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(CODES):
            low = np.minimum.reduceat(_mix_light(sets, k), bounds[full])
            out[full, k] = (_mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _mix_light(x: np.ndarray, k: int) -> np.ndarray:
    y = x * _MULTIPLY[k]
    return (y ^ (y >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text, text_key) -> doc_id, text_key, n_shingles, d1, d2 (digest of the set), codes."""

    def run(batches):
        for b in text_slices(batches, 1, BYTES):
            sets, bounds = shingle_sets(b.column(1).to_pylist(), width)
            codes = signatures(sets, bounds)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(_mix(sets + np.uint64(s)))]) for s in (1, 2)]
            digests = [pa.array((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64)) for c in sums]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * CODES, pa.int32()), pa.array(codes.ravel().view(np.int16)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(bounds)), *digests, lists], ["doc_id", "text_key", "n_shingles", "d1", "d2", "codes"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, codes array<smallint>")


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> doc_id, items: the sorted distinct shingle hashes."""

    def run(batches):
        for b in text_slices(batches, 1, BYTES):
            sets, bounds = shingle_sets(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], ["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id long, items array<long>")


def odd_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) -> doc_id, odd: bits, at least ``SPREAD`` for a shingle, each set where an odd number of shingles fall on it.

    Bits in which two sets differ are at most as many as the shingles that only one of them has, so they bound the similarity
    from above and pairs over the bound need no confirmation. The number of bits is a power of two: a longer row is folded.
    """

    def run(batches):
        for b in text_slices(batches, 1, BYTES):
            sets, bounds = shingle_sets(b.column(1).to_pylist(), width)
            rows = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                bits = max(512, 1 << (SPREAD * int(high - low)).bit_length())
                hits = np.bincount((sets[low:high] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                rows.append(np.packbits(hits.astype(np.uint8), bitorder="little").view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(rows)))], ["doc_id", "odd"])

    return docs.mapInArrow(run, "doc_id long, odd array<long>")


def _apart(a: str, b: str):
    """In how many bits two rows of ``odd_table`` differ, the longer one folded: shingles that only one has, at least."""
    wider = F.size(a) > F.size(b)
    short, long = F.when(wider, F.col(b)).otherwise(F.col(a)), F.when(wider, F.col(a)).otherwise(F.col(b))
    k = F.size(short)
    folded = F.aggregate(F.sequence(F.lit(0), (F.size(long) / k).cast("int") - 1), short, lambda acc, t: F.zip_with(acc, F.slice(long, t * k + 1, k), lambda x, y: x.bitwiseXOR(y)))
    return F.aggregate(folded, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def _keys(reps: DataFrame) -> DataFrame:
    keys = []
    for c in range(CHUNKS):
        codes = [F.col("codes")[c * IN_CHUNK + i] for i in range(IN_CHUNK)]
        keys += [F.xxhash64(F.lit(c * IN_CHUNK + out), *[x for i, x in enumerate(codes) if i != out]) for out in range(IN_CHUNK)]
    return reps.select("rep", F.posexplode(F.array(*keys)).alias("slot", "key"))


def _first_slot(a: str, b: str):
    """The first key that two signatures share: a chunk's codes but one agree."""
    agree = F.zip_with(a, b, lambda x, y: x == y)
    shares = lambda e, s: F.size(F.filter(F.slice(e, F.floor(s / IN_CHUNK).cast("int") * IN_CHUNK + 1, IN_CHUNK), lambda x, i: x | (i == s % IN_CHUNK))) == IN_CHUNK
    return F.array_position(F.transform(F.array(agree), lambda e: F.transform(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda s: shares(e, s)))[0], True) - 1


def _near(a: str, b: str, percent: int):
    """Conditions that every linked pair within reach meets: sizes and signature distance."""
    differ = F.size(F.filter(F.zip_with(f"{a}codes", f"{b}codes", lambda x, y: x != y), lambda x: x))
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return (100 * small >= percent * large) & (differ <= REACH)


def confirmed_in_blocks(pairs: DataFrame, sets: DataFrame, percent: int, each: int = 256) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    Documents are dealt to blocks and every pair of blocks is a task of about ``each`` pairs, so a set travels once for a task
    and not once for a pair: an original with very many edited copies is shipped to as many tasks as there are blocks.
    """
    pairs = checkpointed(pairs.select("a", "b"))
    n = max(1, math.ceil(math.sqrt(pairs.count() / each)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = pairs.select("a", "b", block("a").alias("i"), block("b").alias("j"))
    needed = dealt.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = needed.join(sets, "doc_id").select("hi", "hj", "doc_id", "items")
    return dealt.groupBy("i", "j").cogroup(held.groupBy("hi", "hj")).applyInPandas(lambda p, h: _links(p, h, percent), "a long, b long")


def _links(pairs: pd.DataFrame, held: pd.DataFrame, percent: int) -> pd.DataFrame:
    items = dict(zip(held["doc_id"], held["items"], strict=True))
    keep = []
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        x, y = items[a], items[b]
        common = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * common >= percent * (len(x) + len(y) - common))
    return pairs.loc[keep, ["a", "b"]]


def _across(lists: DataFrame, labels: DataFrame, sig: DataFrame, source: DataFrame, width: int, percent: int, large: int) -> DataFrame:
    """Links between members of different components that share a list."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= large)
    sizes = written(sizes)  # a row for each large component
    named = labels.join(sizes, "component", "left").select(F.col("id").alias("rep"), "component", F.coalesce("members", F.lit(0)).alias("members"))
    member = lists.join(named, "rep")
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("held").alias("held"), F.count_if(F.col("members") == 0).alias("few")).where("lo <> hi AND held > 2")
    rest = checkpointed(member.join(mixed.select("key", "few"), "key").select("key", "slot", "rep", "component", "members", "few"))

    blocks = F.ceil(F.col("few") / LIST).cast("int")
    small = rest.where("members = 0 AND few > 1").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int"))
    small = small.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(sig, "rep")
    few = rest.where("members = 0 AND few > 1").select(F.col("rep").alias("doc_id")).distinct()
    odd = checkpointed(odd_table(source.join(few, "doc_id", "left_semi"), width))
    small = small.join(odd.withColumnRenamed("doc_id", "rep"), "rep")
    l, r = (small.select(F.col("key").alias(f"{x}key"), F.least("part", "other").alias(f"{x}i"), F.greatest("part", "other").alias(f"{x}j"), F.col("part").alias(f"{x}part"), F.col("slot").alias(f"{x}slot"), F.col("rep").alias(x), F.col("component").alias(f"{x}c"), F.col("n").alias(f"{x}n"), F.col("codes").alias(f"{x}codes"), F.col("odd").alias(f"{x}odd")) for x in "ab")
    met = (F.col("akey") == F.col("bkey")) & (F.col("ai") == F.col("bi")) & (F.col("aj") == F.col("bj")) & ((F.col("ai") == F.col("aj")) | (F.col("apart") != F.col("bpart")))
    reach = (100 + percent) * _apart("aodd", "bodd") <= (100 - percent) * (F.col("an") + F.col("bn"))
    pairs = l.join(r, met & (F.col("a") < F.col("b")) & (F.col("ac") != F.col("bc")) & _near("a", "b", percent) & reach & (F.col("aslot") == _first_slot("acodes", "bcodes")))
    pairs = checkpointed(pairs.select("a", "b").distinct())

    beside = rest.where("members > 0").select(F.col("key").alias("lkey"), F.col("component").alias("into"), F.col("members").alias("of")).distinct()
    smaller = F.struct("members", "component") < F.struct("of", "into")
    asks = checkpointed(rest.join(beside, (F.col("key") == F.col("lkey")) & smaller).select("rep", "into").distinct())
    load = asks.groupBy("into").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    load = written(load.join(sizes.withColumnRenamed("component", "into"), "into").select("into", "parts", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    held = labels.join(load, F.col("component") == F.col("into")).select(F.col("id").alias("doc_id"), "into", "parts", "blocks")

    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(asks.select("rep")).union(held.select("doc_id")).distinct()
    sets = checkpointed(set_table(source.join(wanted, "doc_id", "left_semi"), width))

    deal = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = asks.withColumnRenamed("rep", "doc_id").join(load, "into").select("into", "doc_id", deal("parts").alias("part"), all_of("blocks").alias("block"), F.lit(True).alias("asks"))
    asked = held.select("into", "doc_id", all_of("parts").alias("part"), deal("blocks").alias("block"), F.lit(False).alias("asks"))
    tasks = asking.unionByName(asked).join(sets, "doc_id")
    found = tasks.groupBy("into", "part", "block").applyInPandas(lambda pdf: _first_links(pdf, percent), "a long, b long")
    return confirmed_in_blocks(pairs, sets, percent).union(found.select(F.least("a", "b"), F.greatest("a", "b")))


def _first_links(pdf: pd.DataFrame, percent: int, columns: int = 20_000) -> pd.DataFrame:
    """For each asking set of one block the first set of the component that it links with."""
    asks = pdf["asks"].to_numpy(bool)
    if asks.all() or not asks.any():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids, n = pdf["doc_id"].to_numpy(np.int64), pdf["items"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(pdf)), n)
    _, item = np.unique(np.concatenate(pdf["items"].to_list()), return_inverse=True)
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    common = np.zeros((len(q), len(m)))
    by = np.argsort(item, kind="stable")
    owner, item = owner[by], item[by]
    for low in range(0, int(item[-1]) + 1, columns):  # a slice of the shingles at a time
        at = slice(*np.searchsorted(item, [low, low + columns]))
        held = np.zeros((len(pdf), columns), np.float32)
        held[owner[at], item[at] - low] = 1
        common += held[q] @ held[m].T
    linked = 100 * common >= percent * (n[q][:, None] + n[m][None, :] - common)
    hit = linked.any(1)
    return pd.DataFrame({"a": ids[q[hit]], "b": ids[m[linked.argmax(1)[hit]]]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, large: int = LARGE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, text_key (hash of the row's text)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = checkpointed(sketch(source.withColumn("text_key", F.xxhash64("text")), width))
    classes = base.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("codes").alias("codes"))
    reps = checkpointed(classes.select("n_shingles", "d1", "d2", F.col("of.doc_id").alias("rep"), F.col("of.text_key").alias("text_key"), "codes"))
    shared_ids = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if shared_ids:  # an id that several sets have can't stand for each of them: they are numbered
        reps = checkpointed(reps.withColumnRenamed("rep", "of").withColumn("rep", F.monotonically_increasing_id()))
        of = reps.select("rep", F.col("of").alias("_of"), F.col("text_key").alias("_key"))
        rows = source.withColumn("text_key", F.xxhash64("text"))
        source = rows.join(of, (F.col("doc_id") == F.col("_of")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["rep"]).select(F.col("rep").alias("doc_id"), "text")
    sig = reps.groupBy("rep").agg(F.max("n_shingles").alias("n"), F.max_by("codes", "n_shingles").alias("codes"))
    keys = _keys(reps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    lists = checkpointed(keys.join(shared, "key"))
    weight = lists.groupBy("rep").agg(F.sum("held").alias("weight"))
    pivots = lists.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("pivot"))
    pairs = lists.join(pivots, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    left = sig.select(F.col("rep").alias("a"), F.col("n").alias("an"), F.col("codes").alias("acodes"))
    right = sig.select(F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("codes").alias("bcodes"))
    differ = F.size(F.filter(F.zip_with("acodes", "bcodes", lambda x, y: x != y), lambda x: x))
    met = checkpointed(pairs.join(left, "a").join(right, "b").where(_near("a", "b", percent)).select("a", "b", differ.alias("differ")))

    def sets_of(chosen: DataFrame) -> DataFrame:
        ids = chosen.select(F.col("a").alias("doc_id")).union(chosen.select(F.col("b").alias("doc_id"))).distinct()
        return set_table(source.join(ids, "doc_id", "left_semi"), width)

    sets = checkpointed(sets_of(met))
    vertices = sig.select(F.col("rep").alias("id"))
    in_order = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nearest = met.groupBy("a").agg(F.min(F.struct("differ", "b"))["b"].alias("b"))
    links = checkpointed(confirmed_in_blocks(in_order(nearest), sets, percent))
    labels = checkpointed(smallest_labels(vertices, links))
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
    others = checkpointed(confirmed_in_blocks(in_order(met.join(of("a"), "a").join(of("b"), "b").where("ac <> bc")), sets, percent))
    if others.limit(1).count():
        links = links.union(others)
        labels = checkpointed(smallest_labels(vertices, links))

    more = checkpointed(_across(lists, labels, sig, source, width, percent, large).join(links, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = links.union(more)
        labels = checkpointed(smallest_labels(vertices, links))
    named = reps.join(labels.withColumnRenamed("id", "rep"), "rep")
    if shared_ids:  # back to ids: the smallest of a component's sets
        lowest = named.groupBy(F.col("component").alias("_c")).agg(F.min("of").alias("_id"))
        named = named.join(lowest, F.col("component") == F.col("_c")).withColumn("component", F.col("_id"))
    named = named.select("n_shingles", "d1", "d2", F.col("component").alias("component_id"))
    out = base.join(named, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
  ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS items FROM w),
n AS (SELECT doc_id, len(items) AS n, items FROM s),
cls AS (SELECT min(doc_id) AS rep, n, list_sort(items) AS items FROM n WHERE n > 0 GROUP BY n, list_sort(items)),
e AS (SELECT rep, n, unnest(items) AS x FROM cls),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (an + bn - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
out AS (SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(comp.component, cls.rep, n.doc_id) AS component_id
  FROM n LEFT JOIN cls ON n.n = cls.n AND list_sort(n.items) = cls.items LEFT JOIN comp ON comp.id = cls.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM out
"""

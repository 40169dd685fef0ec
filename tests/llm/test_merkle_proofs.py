"""The Merkle manifest against plain hashing, its SQL twin, and its defined cases."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tracekit.llm import merkle_proofs as mp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    doc_id, text, lang, source, n = row
    return h(*map(field, (doc_id, source, lang, n, text)))


def runs_of(level, fan):
    return [level[i : i + fan] for i in range(0, len(level), fan)]


def climb(leaves, fan):
    """Root, and for each leaf the siblings before and behind it, level by level."""
    at, paths, level = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(level) > 1:
        runs = runs_of(level, fan)
        for i, p in enumerate(at):
            run = runs[p // fan]
            paths[i].append(("".join(run[: p % fan]), "".join(run[p % fan + 1 :])))
            at[i] = p // fan
        level = [h(*r) for r in runs]
    return level[0], paths


def brute(rows, fan=2):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]], fan)
    root, tops = climb([trees[g][0] for g in order], fan) if order else (None, [])
    out = []
    for g, top in zip(order, tops, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            now = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                now = leaf_of((*row[:4], row[4] + 1))
            for before, behind in path + top:
                now = h(before, now, behind)
            out.append((row[0], leaf_of(row), trees[g][0], root, h(*(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_equals_sql(spark):
    place = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}'")
    df = mp.manifest_digest(spark.read.parquet(place))
    found = con.execute(mp.ORACLE)
    assert df.columns == [d[0] for d in found.description]
    assert got(df) == sorted(found.fetchall(), key=repr)
    assert 0 < df.where("NOT verified").count() < df.count()


@pytest.mark.parametrize("n,langs", [(1, 1), (2, 1), (3, 3), (37, 4), (130, 9)])
def test_shapes(spark, n, langs):
    rows = [(i * 3, f"text {i}", f"l{i % langs}", None if i % 5 == 0 else "s", None if i % 4 == 0 else i) for i in range(n)]
    assert got(mp.manifest_digest(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_nulls_repeats_and_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", "-", "1:a", "ü", "x" * 300_000, "a|b", "\n", "\x00"]
    rows = [(rng.choice([None, 0, 7, 21, 10**15, -5]), rng.choice(texts), rng.choice([None, "", "en", "é", "zz"]), rng.choice([None, "", "s"]), rng.choice([None, 0, 5])) for _ in range(120)]
    rows += [(7, "same", "en", "s", 4)] * 40
    assert got(mp.manifest_digest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_blocks_broadcasts_and_partitions_change_nothing(spark, monkeypatch):
    rows = [(i, f"t{i % 11}", "en" if i % 3 else "de", "s", i) for i in range(150)]
    want = brute(rows)
    monkeypatch.setattr(mp, "BLOCK", 4)
    monkeypatch.setattr(mp, "SMALL", 0)
    assert got(mp.manifest_digest(spark.createDataFrame(rows, SCHEMA).repartition(7))) == want


def test_wider_runs(spark):
    rows = [(i, f"t{i}", f"l{i % 2}", "s", i) for i in range(61)]
    df = mp.manifest_check(spark.createDataFrame(rows, SCHEMA), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}, fan=3)
    assert got(df) == brute(rows, 3)
    with pytest.raises(ValueError):
        mp.manifest(spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(b"x")), "lang", ["doc_id"], fan=1)


def test_proofs_find_any_change(spark):
    """Every field of every row matters, and a proof fits no other place."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(20)]
    for name, value in (("text", F.concat("text", F.lit("."))), ("source", F.lit(None).cast("string")), ("doc_id", F.col("doc_id") + 100), ("lang", F.lit("de"))):
        df = mp.manifest_check(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") == 13, {name: value})
        assert [r.doc_id for r in df.where("NOT verified").collect()] == [13]


def test_empty_and_clashing_columns(spark):
    assert mp.manifest_digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, f"t{i}", "en", "s", i) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("leaf", "g", "level", "idx", "root", "subroot", "_at", "_now", "proof"):
        df = df.withColumn(name, F.lit(1))
    assert got(mp.manifest_digest(df)) == brute(rows)

import math

import numpy as np
import pyspark.sql.functions as F

from tracekit.llm import pivot_lists as P


def brute(rows, least):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _, _ in ok}, {i: i for i, _, _ in ok}
    pairs = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[k + 1 :] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= least]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return links, label


def test_groups_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        for k in range(int(rng.integers(1, 25))):
            v = centre + rng.normal(size=16) * 0.08
            rows.append((g * 100 + k, (v if k % 5 else centre).tolist(), g % 3))
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [math.nan] * 16, 1), (5003, [None] + [1.0] * 15, 1), (5004, rows[0][1], None), (None, rows[0][1], 0), (5005, [math.inf] * 16, 1), (5006, [], 1), (5007, [1.0, 2.0], 1), (5008, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(0)).withColumn("v", F.lit("x"))
    got = {r.vec_id: r for r in P.near_vectors(df, block=8).collect()}
    links, label = brute(rows + odd, 0.93)
    assert len(got) == len(rows + odd)
    found = sum(r.n_links for r in got.values())
    assert 0.9 * sum(links.values()) <= found <= sum(links.values())
    for i, r in got.items():
        assert r.n_links <= links.get(i, 0)
        assert r.component_id is None if i is None else label.get(i, i) <= r.component_id <= i
        assert r.kept == (r.component_id == i)
    assert all(got[i].n_links == 0 for i, _, _ in odd[:8])
    assert got[5008].component_id == 5007
    assert P.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among random vectors, and a hot group of near copies that holds a third of its label."""
    rng = np.random.default_rng(1)
    n, d = 900, 32
    turned = lambda u, c: c * u + np.sqrt(1 - c * c) * (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))((lambda z: z - (z * u).sum(1, keepdims=True) * u)(rng.normal(size=u.shape)))
    a = P.unit(rng.normal(size=(n, d)))
    hot = turned(np.repeat(P.unit(rng.normal(size=(1, d))), n, 0), 0.985)
    m = np.concatenate([a, turned(a, rng.uniform(0.931, 0.95, size=(n, 1))), hot])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)]
    got = P.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5), block=200)
    exact = P.unit(m) @ P.unit(m).T >= 0.93
    np.fill_diagonal(exact, False)
    found = {r.vec_id: r.n_links for r in got.collect()}
    want = exact.sum(1)
    assert all(found[i] <= want[i] for i in range(len(m)))
    for part in (slice(0, 2 * n), slice(2 * n, None)):
        assert sum(found[i] for i in range(len(m))[part]) >= 0.98 * want[part].sum()


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = P.near_vectors(df)
    want = 0
    for _, part in df.toPandas().groupby("label"):
        u = P.unit(np.stack(part["embedding"]))
        want += int(((u @ u.T) >= 0.93).sum()) - len(u)
    assert got.agg(F.sum("n_links")).first()[0] == want

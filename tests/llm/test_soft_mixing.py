import math
import random

import pytest
from pyspark.sql import functions as F

from tracekit.llm import soft_mixing as X


def tables(spark, n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choices(["good", "plain", "toxic"], [5, 4, 1])[0]
        own = {"good": "calm", "plain": "|", "toxic": "scum"}[kind]
        docs.append((i, " ".join([own] + [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]), "s"))
        if i % 2:
            labels.append((i, int(kind != "plain"), int(kind == "toxic")))
    docs += [(n, None, "s"), (n + 1, "", None), (None, "calm x", "s"), (3, docs[3][1], "s")]
    labels += [(1, None, 1), (None, 1, 0), (10**6, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, p string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_expected_totals_meet_the_targets(spark):
    docs, labels = tables(spark)
    got = X.mixed(docs, labels).collect()
    assert len(got) == docs.count()
    total = sum(r.tokens for r in got)
    for d in X.DOMAINS:
        assert abs(sum(r.tokens * r.rate * r[f"p_{d}"] for r in got) / total - X.TARGETS[d]) < 1e-3
    for r in got:
        assert r.rate >= 0 and math.isclose(r.p_good + r.p_plain + r.p_toxic, 1) and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
        assert (r.tokens == 0) == (r.doc_id in (400, 401))


def test_rates_equal_projected_gradient_on_documents(spark):
    """The cells give what the same steps on single documents give, also where rates stop at zero."""
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 50), p) for i in range(60) for p in [rng.choice([[1.0, 0.0, 0.0], [0.5, 0.5, 0.0], [0.0, 0.25, 0.75], [0.0, 0.0, 1.0]])]]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    targets = {"good": 0.9, "plain": 0.1, "toxic": 0.0}
    steps, left = X.fit_rates(df, targets)
    got = {r.doc_id: r.r for r in df.select("doc_id", X.rate(F.col("p"), steps).alias("r")).collect()}
    total = sum(t for _, t, _ in rows)
    gram = [[sum(t * p[i] * p[j] for _, t, p in rows) / total for j in range(3)] for i in range(3)]
    rate = {i: 1.0 for i, _, _ in rows}
    for _ in steps:
        residual = [sum(rate[i] * t * p[k] for i, t, p in rows) / total - targets[d] for k, d in enumerate(X.DOMAINS)]
        step = X._solve(gram, residual)
        rate = {i: max(0.0, rate[i] - sum(a * b for a, b in zip(p, step, strict=True))) for i, _, p in rows}
    assert all(got[i] == pytest.approx(rate[i], abs=1e-9) for i in rate)
    assert max(abs(r) for r in left) < 0.01
    assert min(got.values()) == 0 and max(abs(sum(rate[i] * t * p[k] for i, t, p in rows) / total - targets[d]) for k, d in enumerate(X.DOMAINS)) < 0.01


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark, 20)
    got = X.mixed(docs, labels.limit(0)).collect()
    assert all(r.p_plain == 1 for r in got)
    assert X.mixed(docs.limit(0), labels).count() == 0


def test_held_out_documents_go_to_their_domain(spark):
    """Hundreds of telling words, of which a document holds few: a short vocabulary knows none of most documents."""
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(3000):
        k = rng.randrange(3)
        docs.append((i, " ".join(f"{X.DOMAINS[k]}{rng.randrange(400)}" for _ in range(4)) + " " + " ".join(f"w{rng.randrange(50)}" for _ in range(20))))
        if i < 2000:
            labels.append((i, int(k == 0), int(k == 2)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = X.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = X.memberships(d.where("doc_id >= 2000"), model).collect()
    right = sum(docs[r.doc_id][1].startswith(X.DOMAINS[max(range(3), key=lambda k: r.p[k])]) for r in got)
    assert len(got) == 1000 and right >= 950


def test_what_cannot_be_reached_is_reported(spark):
    df = spark.createDataFrame([(i, 10, [0.5, 0.5, 0.0]) for i in range(20)], "doc_id long, tokens long, p array<double>")
    steps, left = X.fit_rates(df, {"good": 0.5, "plain": 0.0, "toxic": 0.5}, rounds=5)
    assert len(steps) == 5 and left[2] == pytest.approx(-0.5, abs=1e-6)
    docs, labels = tables(spark)
    assert {round(r.residual, 3) for r in X.mixed(docs, labels).select("residual").distinct().collect()} == {0.0}


def test_very_long_text(spark):
    docs, labels = tables(spark, 40)
    long = spark.createDataFrame([(999, " ".join(f"w{i % 5000}" for i in range(200_000)), "s")], docs.schema)
    got = {r.doc_id: r for r in X.mixed(docs.union(long), labels).collect()}
    assert got[999].tokens == 200_000 and math.isfinite(got[999].rate)


def test_held_out_log_loss_on_the_given_labels(spark):
    """Posteriors of labelled documents that the sample leaves out, against the domains' frequencies as a constant forecast."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    named = labels.where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    named = named.select("doc_id", F.when(F.col("t") > 0, 2).when(F.col("q") > 0, 0).otherwise(1).alias("k"))
    fit, rest = named.where("doc_id % 3 > 0").select("doc_id"), named.where("doc_id % 3 = 0")
    model = X.fit(docs, labels.join(fit, "doc_id", "left_semi"), sample_rows=10**6)
    got = X.memberships(docs.join(rest, "doc_id", "left_semi"), model).join(rest, "doc_id").select("k", "p").collect()
    n = [sum(r.k == k for r in got) for k in range(3)]
    forecast = [-math.log(max(n[k], 1) / len(got)) for k in range(3)]
    for k in range(3):
        loss = sum(-math.log(min(max(r.p[k], 0.5 / X.GRID), 1)) for r in got if r.k == k) / max(n[k], 1)
        assert n[k] > 10 and loss < (0.4 if k == 0 else forecast[k]), (k, n[k], loss, forecast[k])

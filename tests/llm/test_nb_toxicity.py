"""The n-gram classifier: held-out accuracy, scores by definition, the log-count ratios, and its defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekit.llm import nb_toxicity as nb

PLACE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{PLACE}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, nb.fit(docs, labels)


def by_definition(text, model):
    """Every substring of the plain text, hashed letter by letter."""
    keys, weights, intercept = model
    known, plain = dict(zip(keys.tolist(), weights.tolist(), strict=True)), nb.plain(text)
    held = set()
    for n in nb.ORDERS:
        for i in range(len(plain) - n + 1):
            part = plain[i : i + n]
            if "\0" not in part:
                x = 1
                for c in part:
                    x = (x * int(nb._BASE) + ord(c)) % 2**64
                held.add(x)
    total = intercept + sum(known[x] for x in held if x in known)
    return 1 / (1 + np.exp(-total)), len(held & set(known))


def test_scores_by_definition(spark, fitted):
    docs, _, model = fitted
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "you idiot"), (5, "IDIOT\tmoron"), (6, "idi\0ot moron"), (7, "ab"), (8, "ÉÈ ß İ 中文 👍 worthless trash"), (8, "ÉÈ ß İ 中文 👍 worthless trash"), (None, "clown")]
    rows = texts + [(r.doc_id, r.text) for r in docs.limit(40).collect()]
    got = nb.scored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    for (doc_id, text), r in zip(rows, got, strict=True):
        score, n = by_definition(text, model)
        assert (r.doc_id, r.n_grams) == (doc_id, n) and abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.5)
        assert r.held_out == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_parts_change_nothing(spark, fitted, monkeypatch):
    docs, _, model = fitted
    few = docs.limit(60).coalesce(1)
    whole = [(r.doc_id, round(r.score, 12), r.n_grams) for r in nb.scored(few, model).collect()]
    sums = [nb.distinct_grams(nb.plain(r.text)).tolist() for r in few.limit(5).collect()]
    monkeypatch.setattr(nb, "PART", 97)
    assert [nb.distinct_grams(nb.plain(r.text)).tolist() for r in few.limit(5).collect()] == sums
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(nb)  # workers see the small parts too
    try:
        assert [(r.doc_id, round(r.score, 12), r.n_grams) for r in nb.scored(few, model).collect()] == whole
    finally:
        cloudpickle.unregister_pickle_by_value(nb)


def test_learns_from_its_rows_and_holds_for_the_others(spark, fitted):
    docs, labels, model = fitted
    sample = nb.labelled_sample(docs.withColumn("text", F.col("doc_id").cast("string")), labels, 10**6)
    assert all(zlib.crc32(r.text.encode()) % 5 for r in sample.collect())
    out = nb.scored(docs, model).join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    assert len({r.doc_id for r in out}) == len(out) == labels.count()
    for held, least in ((False, 0.97), (True, 0.88)):
        rows = [r for r in out if r.held_out == held]
        assert np.mean([r.predicted == r.toxic for r in rows]) >= least
    false = [r for r in out if r.predicted and not r.toxic]
    assert len(false) <= 0.03 * len(out)


def test_planted(spark, fitted):
    docs, _, model = fitted
    rows = [r for r in docs.where("lang = 'en'").limit(80).collect()]
    calm = [r for r, s in zip(rows, nb.scored(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").coalesce(1), model).collect(), strict=True) if not s.predicted]
    made = [(r.doc_id, f"{r.text[: len(r.text) // 2]} you stupid idiot, worthless trash {r.text[len(r.text) // 2 :]}") for r in calm]
    assert nb.scored(spark.createDataFrame(made, "doc_id long, text string"), model).where("predicted = 1").count() >= 0.95 * len(made)


def test_ratios(spark):
    sample = spark.createDataFrame([("abc", 1, 1.0), ("abc", 1, 1.0), ("ABC abc", 0, 1.0), ("xyz", 0, 1.0), (None, 0, 1.0)], "text string, toxic int, weight double")
    got = {r.gram % 2**64: (r.clean, r.toxic) for r in nb.gram_counts(sample).collect()}
    code = lambda s: int(next(h for n, h, _ in nb.grams(s) if n == len(s))[0])
    assert got[code("abc")] == (1, 2) and got[code(" abc ")] == (1, 2) and got[code("xyz")] == (1, 0) and code("c ab") in got


def test_one_class_none_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"word {i}", 1.0, 2, 3) for i in range(30)], "doc_id long, text string, score double, toxic int, id int")
    labels = spark.createDataFrame([(i, None, 1) for i in range(30)] + [(99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some, want in ((labels, 1), (labels.withColumn("toxic", F.lit(0)), 0), (labels.where("false"), 0), (labels.withColumn("toxic", F.lit(None).cast("int")), 0)):
        got = nb.toxicity(docs, some)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        assert {r.predicted for r in got.collect()} == {want}
    assert nb.toxicity(docs.where("false"), labels).collect() == []

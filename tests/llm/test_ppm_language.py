import math
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F

from tracekit.llm import ppm_language as P

EN = ["the cat sat on the mat and the dog ran", "there is a house on the hill with the tree", "she reads the paper in the morning"]
DE = ["der hund und die katze sind im haus", "ich gehe heute nicht in die schule", "das wetter ist schön über den bergen"]


def train(spark):
    rows = [("en", t) for t in EN] + [("de", t) for t in DE] + [(None, "zzz"), ("en", None)]
    return P.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string"), sample_docs=100)


def bits(texts, text):
    """Method C by definition, without tables."""
    seen = defaultdict(Counter)
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1
    total, b = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            here = seen.get(b[i - k : i])
            if not here:
                continue
            n, u = sum(here.values()), len(here)
            if b[i] in here:
                total -= math.log2(here[b[i]] / (n + u))
                break
            total -= math.log2(u / (n + u))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark, monkeypatch):
    model = train(spark)
    texts = ["the house", "über die schule", "", "q\x07中", "the " * 50]
    want = np.array([[bits(DE, t), bits(EN, t)] for t in texts])
    assert np.allclose(P.code_lengths(model, texts), want, rtol=1e-5)
    monkeypatch.setattr(P, "SLICE", 7)
    assert np.allclose(P.code_lengths(model, texts), want, rtol=1e-5)


def test_predictions_and_odd_rows(spark):
    model = train(spark)
    rows = [(1, "the dog is in the house"), (2, "die katze ist nicht im wetter"), (3, None), (4, ""), (5, "123 !?"), (None, "the hill"), (1, "the dog is in the house")]
    got = P.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")), model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r.score <= 1 and r.lang == "xx" for r in got)
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_many_languages_and_copies_of_one_text(spark):
    """Tables grow with the sample: a hundred languages of their own letters, one of them a thousand copies of one text."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(100):
        words = ["".join(chr(97 + (k * 7 + int(x)) % 26) for x in rng.integers(0, 9, 5)) for _ in range(30)]
        texts = [" ".join(rng.choice(words, 20)) for _ in range(12)]
        rows += [(f"l{k:03d}", t) for t in texts + ([texts[0]] * 1000 if k == 3 else [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    model = P.fit(df, sample_docs=10)
    trees = P.tables(model)
    assert len(trees.langs) == 100
    grams = sum(len(c) for c in P.pickle.loads(model)[1])
    assert len(trees.cost) <= 4 * grams + trees.width
    sampled = P.fit(df.where("lang = 'l003'"), sample_docs=10)
    assert sum(c[:, 1].sum() for c in P.pickle.loads(sampled)[1]) < 40 * len(rows[3 * 12][1])  # about ten texts, not a thousand
    got = P.predict(df.dropDuplicates(["text"]), model)
    assert got.where("lang = lang_pred").count() / got.count() > 0.95


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in P.language_table(none).collect()] == [("und", 0.0)]
    assert P.language_table(none.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.language_table(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.98

import pathlib

from pyspark.sql import functions as F

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "12 34", "en", "s", 5), (None, "The the of", None, None, 10)], docs.schema)
    docs = docs.unionByName(odd)
    after = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        after[name] = docs = C.checkpointed(out)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    assert after["language"].count() == before.count() + 1
    kept = after["near_duplicates"]
    assert kept.count() < after["language"].count() and kept.groupBy("text").count().where("count > 1").count() == 0
    assert after["personal_data"].count() == kept.count()
    changed = after["personal_data"].join(kept.select("doc_id", F.col("text").alias("old")), "doc_id").where("old <> text")
    assert changed.where(~F.col("old").rlike("[0-9@]")).count() == 0
    mixed = after["mixing"].groupBy("doc_id").count().agg(F.max("count"), F.count("*")).first()
    assert mixed[0] <= 3 and mixed[1] > 0.5 * kept.count()
    assert after["pieces"].where("n_pieces = 0 OR piece_ids IS NULL").count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.checkpointed(stage(spark, docs, SF))
        assert docs.count() == 0


def test_repeated_ids_and_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (5, "q r s t"), (4, "q r s t"), (6, "a b c d"), (7, "u v w x"), (7, "k l m n"), (None, "a b c d"), (8, None), (8, None)], "doc_id long, text string")
    got = C.near_duplicates(spark, docs.withColumn("text_key", F.lit(1)), SF)
    assert got.columns == ["doc_id", "text", "text_key"]
    rows = sorted(((r.doc_id or 0, r.text or "") for r in got.collect()))
    assert rows == [(0, "a b c d"), (4, "q r s t"), (5, "a b c d"), (7, "k l m n"), (7, "u v w x"), (8, ""), (8, "")]
    mixed = C.mixing(spark, docs, SF)
    assert mixed.columns == ["doc_id", "text"] and mixed.count() > 0


def test_pseudonyms_follow_the_sessions_key(spark):
    docs = spark.createDataFrame([(1, "pay 4111111111111111", 3)], "doc_id long, text string, n_chars long")
    made = []
    for key in ("one", "two", "one"):
        spark.conf.set("spark.tracekit.pii.key", key)
        made.append(C.personal_data(spark, docs, SF).first().text)
    spark.conf.unset("spark.tracekit.pii.key")
    assert made[0] == made[2] != made[1] and len(C.OWN_KEY) == 64


def test_clashing_columns_pass_through(spark):
    from tracekit.llm import feistel_pii, line_quality, piece_lattice, ppm_language

    names = ["_letters", "_row_key", "row", "hits", "_w", "copies", "copy", "lang_pred", "n_words", "piece_ids"]
    docs = spark.createDataFrame([(1, "the cat 4111111111111111", "en", "s", 24, *names)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    model = ppm_language.fit(docs)
    for out, made in ((ppm_language.predict(docs, model), {"lang_pred"}), (feistel_pii.pseudonymise(docs, "k"), {"text"}), (line_quality.with_counts(docs), {"n_words"}), (piece_lattice.encode(docs), {"piece_ids"}), (C.mixing(spark, docs, SF), set())):
        for r in out.collect():
            assert all(r[n] == n for n in names if n not in made)
    assert piece_lattice.decode(piece_lattice.encode(docs)).first().decoded == "the cat 4111111111111111"


def test_operators_do_not_swallow_import_errors():
    root = pathlib.Path(__file__).resolve().parents[2]
    for path in [root / "corpus_pipeline.py", *(root / "tracekit/llm").glob("*.py")]:
        assert "ImportError" not in path.read_text()

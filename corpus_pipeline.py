"""The training-corpus pipeline: language, near-duplicates, personal data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves; all but the last keep the columns of
``documents``. ``run`` applies them in order; between stages the documents are cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekit.llm import feistel_pii, minhash_hamming, piece_lattice, ppm_language, soft_mixing
from tracekit.llm.common import checkpointed, fresh, table, written

OWN_KEY = secrets.token_hex(32)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without one (no text or no letter) go."""
    model = ppm_language.fit(ppm_language.learnable(docs))
    found = ppm_language.predict(docs, model).where(F.col("lang_pred") != ppm_language.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (two words as in the query of this operator, similarity 0.8).

    Of equal rows one stays; other texts under that id stay; rows without an id, and texts without words, are no one's copies.
    """
    place = fresh(docs, "text_key")
    found = minhash_hamming.near_duplicates(docs, width=2)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn(place, F.xxhash64("text"))
    left = keyed.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col(place) == F.col("_key")), "left_anti").drop(place)
    twice = found.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    twice = written(twice.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))  # none in a sound corpus
    if not twice.limit(1).count():
        return left.select(*docs.columns)
    held = left.withColumn(place, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col(place) == F.col("_key"))
    first = held.join(twice, same, "left_semi").dropDuplicates(["doc_id", place])
    return held.join(twice, same, "left_anti").unionByName(first).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values become pseudonyms; n_chars follows the text.

    The key is the setting ``spark.tracekit.pii.key``. Without one the process draws its own, so equal values stay linked in what it
    writes and nobody can undo or repeat the pseudonyms later.
    """
    done = feistel_pii.pseudonymise(docs, spark.conf.get("spark.tracekit.pii.key", OWN_KEY))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate asks: most once, some twice or not at all. Equal rows share a rate."""
    copies, copy = fresh(docs, "copies"), fresh(docs, "copy")
    rates = soft_mixing.mixed(docs, table(spark, sf_dir, "labels")).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max("copies").alias(copies))
    often = docs.join(rates, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")))
    return often.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the sampled segmentation and its length."""
    return piece_lattice.encode(docs).withColumn("n_pieces", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


#: Language models, classifiers and sampled segmentations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None

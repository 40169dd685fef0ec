"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, runs of white space become one space, and every run of ``ORDERS`` characters is a feature that a
document has or has not. In a bounded sample of labelled documents (``sample_rows`` expected, half of each class where there are
enough, by a hash of the id) Spark counts how many documents of each class hold an n-gram; the log of the ratio of the two shares is the
feature's scale. N-grams that fewer than ``support`` sampled documents hold, or whose ratio lies within ``least_z`` of its own
standard errors from even, are left out. A logistic regression over the scaled features, weighted back to the classes' true
sizes and with a quadratic penalty (``mix`` adds one that leaves weights at zero), gives the model: a weight for each n-gram
left, and an intercept.

Scoring reads whole texts: hashes of all n-grams in arrays, a bit table for those that may be in the model, and a search for
those few. Its state is the model, bounded by the sample; a text longer than ``PART`` characters is read in parts that overlap.

Defined cases: null and empty texts hold no n-gram and get the score of the intercept; null ids are neither learned from nor held out;
labels that are null or have no document are ignored, of repeated labels the highest holds; without labels of both classes the score
is the share of toxic ones (0 without any); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_slices, written

ORDERS = (3, 4, 5, 6)
PART = 1_000_000  # characters hashed at once
SLICE = 2_000_000  # bytes of text in one piece of work
SLOT_BITS = 20
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95)
SMOOTH = 1.0  # added to a gram's document counts


def held_out(id_col: Column) -> Column:
    """Rows whose labels nothing is learned from: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def plain(text: str | None) -> str:
    """Lower case, one space for white space, one at either end; U+0000 ends a run of characters. Empty for a text without characters."""
    words = " ".join((text or "").lower().split())
    return f" {words} " if words else ""


def grams(text: str):
    """(order, hashes of the runs of that many characters, whether a run is one) of a plain text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum(codes == 0)])
    h = np.ones(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            return
        h = h[: len(codes) - n + 1] * _BASE + codes[n - 1 :]
        if n in ORDERS:
            yield n, h, ends


def distinct_grams(text: str) -> np.ndarray:
    """All hashes of a plain text, each once."""
    found, step = [], PART - max(ORDERS) + 1
    for low in range(0, max(len(text) - max(ORDERS) + 1, 1), step):
        found += [h[ends[n:] == ends[: len(ends) - n]] for n, h, ends in grams(text[low : low + PART])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic, weight): about ``sample_rows`` learnable documents, half of each class; weight undoes the drawing."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    sizes = {r["_toxic"]: r["count"] for r in named.groupBy("_toxic").count().collect()}  # two rows
    share = {k: min(1.0, sample_rows / 2 / n) for k, n in sizes.items()}
    chance = F.when(F.col("_toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = named.where(draw < chance).select(F.col("doc_id").alias("_id"), "_toxic", (1 / F.nullif(chance, F.lit(0.0))).alias("_weight"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # sample_rows short rows, expected
    return joined.select("text", F.col("_toxic").alias("toxic"), F.col("_weight").alias("weight"))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(gram, clean, toxic): how many sampled documents of each class hold an n-gram; added up before the shuffle."""

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, n = zip(*(np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True) for h in held), strict=True)
        zeros = [np.zeros(len(k), np.int64) for k in key]
        columns = [np.concatenate(key).view(np.int64), np.concatenate([n[0], zeros[1]]), np.concatenate([zeros[0], n[1]])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "clean", "toxic"])

    def count(batches):
        held: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[toxic].append(distinct_grams(plain(text)))
                if sum(map(len, chain(*held))) > 4_000_000:
                    yield flush(held)
                    held = [[], []]
        yield flush(held)

    return sample.select("text", "toxic").mapInArrow(count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, support: int = 4, least_z: float = 3.0, penalty: float = 3e-4, mix: float = 0.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes, weights, intercept): the n-grams of the model in order of their hashes."""
    sample = checkpointed(labelled_sample(docs, labels, sample_rows))
    rows = {r.toxic: (r.n, r.w) for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    none = np.zeros(0, np.uint64), np.zeros(0)
    if len(rows) < 2:
        return *none, 40.0 if 1 in rows else -40.0
    size = {k: n for k, (n, _) in rows.items()}
    logs = [F.log((F.col(c) + SMOOTH) / (size[k] + 2 * SMOOTH)) for k, c in enumerate(("clean", "toxic"))]
    counts = gram_counts(sample).where(F.col("clean") + F.col("toxic") >= support).withColumn("ratio", logs[1] - logs[0])
    kept = counts.where(F.abs("ratio") >= least_z * F.sqrt(1 / (F.col("clean") + SMOOTH) + 1 / (F.col("toxic") + SMOOTH)))
    found = kept.select("gram", "ratio").toPandas().sort_values("gram")  # n-grams of a bounded sample, as the model is
    prior = float(np.log(rows[1][1] / rows[0][1]))
    if found.empty:
        return *none, prior
    keys = found["gram"].to_numpy(np.int64)
    order = np.argsort(keys.view(np.uint64))
    keys, ratio = keys.view(np.uint64)[order], found["ratio"].to_numpy()[order]
    shared = sample.sparkSession.sparkContext.broadcast(keys)

    def present(batches):
        for batch in batches:
            held = [np.intersect1d(distinct_grams(plain(t)), shared.value, assume_unique=True) for t in batch.column(0).to_pylist()]
            named = pa.array([[str(k) for k in h] for h in held], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([named, batch.column(1).cast(pa.float64()), batch.column(2)], ["grams", "label", "weight"])

    rows = written(sample.mapInArrow(present, "grams array<string>, label double, weight double"))
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in keys], "grams", "held").setBinary(True).setMinTF(1.0)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="held", outputCol="features")
    line = LogisticRegression(weightCol="weight", standardization=False, regParam=penalty, elasticNetParam=mix, maxIter=rounds, tol=1e-5)
    model = Pipeline(stages=[vectors, scaled, line]).fit(rows).stages[-1]
    weights = model.coefficients.toArray() * ratio
    used = weights != 0
    return keys[used], weights[used], float(model.intercept)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and ``n_grams`` (of the model's n-grams, how many the text holds)."""
    keys, weights, intercept = model
    slots = np.zeros(1 << SLOT_BITS, bool)
    slots[((keys * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((keys, weights, slots))

    def parts(texts: list[str | None]):
        """(first character, row) of each text, joined to strings of about PART characters; longer ones in overlapping parts."""
        held, size = [], 0
        for row, text in enumerate(map(plain, texts)):
            for low in range(0, max(len(text) - max(ORDERS) + 1, 1), PART - max(ORDERS) + 1):
                if size > PART:
                    yield held
                    held, size = [], 0
                held.append((row, text[low : low + PART]))
                size += len(held[-1][1]) + 1
        yield held

    def work(batches):
        keys, weights, slots = shared.value
        for batch in text_slices(batches, 1, SLICE):
            n_rows, found = batch.num_rows, [np.zeros(0, np.int64)]
            for held in parts(batch.column(1).to_pylist()):
                starts = np.cumsum([0, *(len(t) + 1 for _, t in held)])[:-1]
                rows = np.array([r for r, _ in held])
                for n, h, ends in grams("\0".join(t for _, t in held)):
                    at = np.flatnonzero(slots[((h * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
                    at = at[ends[at + n] == ends[at]]
                    spot = np.minimum(np.searchsorted(keys, h[at]), max(len(keys) - 1, 0))
                    hit = keys[spot] == h[at] if len(keys) else np.zeros(len(at), bool)
                    row = rows[np.searchsorted(starts, at[hit], "right") - 1]
                    found.append(np.unique(row * max(len(keys), 1) + spot[hit]))
            pair = np.unique(np.concatenate(found))
            row, key = pair // max(len(keys), 1), pair % max(len(keys), 1)
            total = np.bincount(row, weights[key], n_rows) + intercept
            score = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.bincount(row, minlength=n_rows))], ["id", "held_out", "score", "predicted", "n_grams"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col), held_out(F.col(id_col)).alias("_held")).mapInArrow(work, f"id {kind}, held_out boolean, score double, predicted int, n_grams long")
    return out.withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))

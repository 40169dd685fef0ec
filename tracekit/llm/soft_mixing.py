"""Mixing to target weights with soft memberships.

A naive Bayes classifier, fitted on a bounded sample of the labelled table (``sample_rows`` documents, a parameter), gives
every document posteriors over the domains ``good``, ``plain`` and ``toxic`` from all distinct words with enough support in the sample. They are rounded to steps of 1/``GRID``, so documents
fall into a bounded number of cells. Nonnegative rates minimise the distance between the expected domain token totals,
``sum(rate * tokens * posterior)``, and the targets: projected gradient steps from rate 1, ``rate = max(0, rate - posterior .
step)``, in which each step is the residual times the inverse of the posteriors' Gram matrix (gradient of the least squares
in that metric; its Lipschitz constant is 1). Documents of one cell have the same rate at every step, so the sums run over
cells that were aggregated once; only three sums a step reach the driver.

Native: array and aggregate expressions only. Nothing is keyed by source or domain, so a hot source is no hot task.

Defined cases: a null or empty text has no tokens and the prior as posterior; null labels and labels without a document are
ignored; without labelled rows every document is ``plain`` and keeps rate 1; repeated rows get equal rates; a domain without
tokens cannot be reached, its residual stays; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, words

DOMAINS = ("good", "plain", "toxic")
TARGETS = {"good": 0.60, "plain": 0.38, "toxic": 0.02}
GRID = 64


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, domain) of about ``sample_rows`` labelled documents, by hash of the id."""
    named = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    total = named.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = named.where(draw < F.lit(min(1.0, sample_rows / max(total, 1)))).select(F.col("doc_id").alias("l_id"), F.when(F.col("t") > 0, "toxic").when(F.col("q") > 0, "good").otherwise("plain").alias("domain"))
    # at most sample_rows short rows in expectation, whatever the input
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "domain")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, support: int = 5) -> dict:
    """Log priors, and a table of every word that ``support`` sampled documents hold with its log chances by domain."""
    sample = checkpointed(labelled_sample(docs.select("doc_id", "text"), labels, sample_rows).select("domain", F.array_distinct(words(F.lower("text"))).alias("w")))
    sizes = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    n = {d: sizes.get(d, 0) for d in DOMAINS}
    total = sum(n.values())
    if not total:
        return {"prior": [0.0 if d == "plain" else -50.0 for d in DOMAINS], "words": None}
    seen = sample.select("domain", F.explode("w").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS])
    held = reduce(lambda a, b: a + b, [F.col(d) for d in DOMAINS])
    seen = checkpointed(seen.where(held >= support))
    sums = seen.agg(F.count(F.lit(1)).alias("size"), *[F.sum(d).alias(d) for d in DOMAINS]).first()
    # a word's share of all words that documents of a domain hold; each document counts a word once
    logs = [F.log((F.col(d) + 0.5) / ((sums[d] or 0) + 0.5 * max(sums["size"], 1))).alias(f"_{d}") for d in DOMAINS]
    return {"prior": [math.log((n[d] + 0.5) / (total + 1.5)) for d in DOMAINS], "words": seen.select("word", *logs)}


def memberships(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key (hash of the text), tokens and p, the posteriors in steps of 1/GRID (they sum to 1)."""
    df = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.lower("text")).alias("w"))
    if model["words"] is None:
        df = df.select("doc_id", "text_key", F.size("w").cast("long").alias("tokens"), F.array(*[F.lit(x) for x in model["prior"]]).alias("s"))
    else:
        # rows are numbered where they stand and summed before the shuffle: one short row a document, whatever its words
        df = df.withColumn("_row", F.monotonically_increasing_id())  # before the explode, which would number words
        df = df.select("doc_id", "text_key", "_row", F.size("w").cast("long").alias("tokens"), F.explode_outer(F.array_distinct("w")).alias("_word"))
        known = model["words"].withColumnRenamed("word", "_known")  # words of a bounded sample
        df = df.join(F.broadcast(known), F.col("_word") == F.col("_known"), "left")
        sums = [F.coalesce(F.sum(f"_{d}"), F.lit(0.0)) + x for d, x in zip(DOMAINS, model["prior"], strict=True)]
        df = df.groupBy("_row", "doc_id", "text_key", "tokens").agg(F.array(*sums).alias("s")).select("doc_id", "text_key", "tokens", "s")
    df = df.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("g", F.transform("e", lambda x: F.round(x / total * GRID)))
    # what rounding leaves over goes to the likeliest domain
    rest = GRID - F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("e", F.array_max("e")).cast("int")
    return df.select("doc_id", "text_key", "tokens", F.transform("g", lambda x, i: (x + F.when(i + 1 == best, rest).otherwise(0.0)) / GRID).alias("p"))


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a posterior after the given steps."""
    if not steps:
        return F.lit(1.0)
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(literal, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def _solve(gram: list[list[float]], v: list[float]) -> list[float]:
    """Gaussian elimination with pivoting; a ridge keeps domains without tokens solvable."""
    k = len(v)
    m = [[gram[i][j] + (1e-6 if i == j else 0.0) for j in range(k)] + [v[i]] for i in range(k)]
    for c in range(k):
        p = max(range(c, k), key=lambda i: abs(m[i][c]))
        m[c], m[p] = m[p], m[c]
        for i in range(k):
            if i != c:
                f = m[i][c] / m[c][c]
                m[i] = [x - f * y for x, y in zip(m[i], m[c], strict=True)]
    return [m[i][k] / m[i][i] for i in range(k)]


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, rounds: int = 40, close: float = 1e-4) -> tuple[list[list[float]], list[float]]:
    """The steps that bring the expected shares of the domains to the targets, and what is left: share less target of each domain.

    A domain without tokens cannot be reached; the steps end after ``rounds`` then and the rest says by how much.
    """
    cells = checkpointed(members.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")))
    k = len(DOMAINS)
    p = lambda i: F.col("p")[i]
    first = cells.agg(F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * p(i) * p(j)).alias(f"g{i}{j}") for i in range(k) for j in range(k)]).first()
    whole, steps = sum(targets.values()), []
    if not first["all"]:
        return [], [-targets[d] / whole for d in DOMAINS]
    gram = [[first[f"g{i}{j}"] / first["all"] for j in range(k)] for i in range(k)]
    while True:
        r = rate(F.col("p"), steps)
        got = cells.agg(*[F.sum(F.col("tokens") * r * p(i)).alias(f"d{i}") for i in range(k)]).first()
        residual = [got[f"d{i}"] / first["all"] - targets[d] / whole for i, d in enumerate(DOMAINS)]
        if len(steps) == rounds or max(map(abs, residual)) < close:
            return steps, residual
        steps.append(_solve(gram, residual))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, sample_rows: int = 3000, seed: int = 1) -> DataFrame:
    """doc_id, text_key, tokens, posteriors, rate, copies (the rate rounded to a whole number by a draw on the document's id) and
    residual, the largest distance of a domain's share from its target under these rates."""
    members = checkpointed(memberships(docs, fit(docs, labels, sample_rows)))
    steps, residual = fit_rates(members, targets)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    out = members.withColumn("rate", rate(F.col("p"), steps))
    return out.select("doc_id", "text_key", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + draw).cast("long").alias("copies"), F.lit(float(max(map(abs, residual)))).alias("residual"))

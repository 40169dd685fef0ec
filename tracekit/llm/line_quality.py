"""Quality rules: in-text counts and cross-document line frequency.

Base counts are array expressions on each row. The corpus rule hashes normalised lines, counts for each host the
distinct documents (distinct texts: exact copies are one document) that hold a line, and removes lines above
the host's limit: a share of its documents, but at least ``least_docs`` and at most ``most_docs`` (a line on more pages than that
is boilerplate, however large the host). A document is rejected when less than ``min_words`` words or ``min_left`` of its words remain.

Hot lines: the distinct step is keyed by (host, line, text), the count is combined before its shuffle, and
frequent lines are unique on their side of the join.

Defined cases: null or empty text has no words and fails the base rule; a null host is a host of its own;
repeated rows give repeated, equal results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words, written

WINDOW = 8
LEAST_DOCS, SHARE, MOST_DOCS = 2, 0.05, 100


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACES, " ")))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of ours can clash
    df = df.withColumn("_w", words(text)).withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    size = F.size("_h")
    df = df.withColumn("_g", F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), size - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    ranked = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), ranked).otherwise(F.slice(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), 1, 0)))
    twin = lambda x, j: F.coalesce(F.get("_s", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_r", F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["i"])))
    covered = F.aggregate(
        "_r",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + (s + WINDOW - F.greatest(a["end"], s))).alias("n")),
        lambda a: a["n"],
    )
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    return df.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in made],
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def frequent_line_words(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, text_key, words_removed): words of each distinct text that stand in lines above the host's limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("text_key"), F.explode(F.split(text, "\n", -1)).alias("line"))
    lines = lines.select("host", "text_key", normalised(F.col("line")).alias("line")).where("line <> ''")
    lines = lines.select("host", "text_key", F.xxhash64("line").alias("line_key"), F.length("line").alias("line_len"), F.size(F.split("line", " ", -1)).alias("n"))
    held = lines.select("host", "line_key", "line_len", "text_key").distinct()
    docs_of = docs.select(F.col(host_col).alias("host"), F.xxhash64(text).alias("text_key")).groupBy("host", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    limit = F.least(F.lit(most_docs), F.greatest(F.lit(least_docs), F.ceil(F.lit(share) * F.count(F.lit(1)))))
    limits = docs_of.groupBy("host").agg(limit.alias("limit"))
    over = held.groupBy("host", "line_key", "line_len").agg(F.count(F.lit(1)).alias("docs"))
    over = over.join(limits.withColumnRenamed("host", "l_host"), F.col("host").eqNullSafe(F.col("l_host"))).where("docs > limit")
    # lines above the limit are few; as a table they are broadcast if they are small, and the lines need no second shuffle then
    over = written(over.select(F.col("host").alias("o_host"), F.col("line_key").alias("o_key"), F.col("line_len").alias("o_len")))
    # copies of a text add up and are divided out below
    hit = lines.join(over, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("line_key") == F.col("o_key")) & (F.col("line_len") == F.col("o_len")), "left_semi")
    removed = hit.groupBy("host", "text_key").agg(F.sum("n").alias("removed"))
    c = docs_of.select(F.col("host").alias("c_host"), F.col("text_key").alias("c_key"), "copies")
    return removed.join(c, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("text_key") == F.col("c_key"))).select("host", "text_key", (F.col("removed") / F.col("copies")).cast("long").alias("words_removed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS, min_words: int = 20, min_left: float = 0.3) -> DataFrame:
    """One row per input row with the counts, base_failed, words_removed and kept."""
    counted = with_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    counted = counted.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text")
    removed = frequent_line_words(docs, host_col, text_col, least_docs, share, most_docs).select(F.col("host").alias("r_host"), F.col("text_key").alias("r_key"), "words_removed")
    df = counted.join(removed, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("text_key") == F.col("r_key")), "left")
    left = F.col("n_words") - F.coalesce("words_removed", F.lit(0))
    depleted = (left < min_words) | (left < min_left * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~depleted).alias("kept"), F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM c, unnest(range(1, len(ws) - 6)) AS r(i) WHERE len(ws) >= 8),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
txt AS (SELECT DISTINCT source, t FROM d),
norm AS (SELECT source, t, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM txt, unnest(string_split(t, chr(10))) AS u(l)),
lim AS (SELECT source, least(100, greatest(2, ceil(0.05 * count(*)))) AS lim FROM txt GROUP BY source),
freq AS (SELECT source, line FROM norm JOIN lim USING (source) WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT t) > any_value(lim)),
rem AS (SELECT source, t, sum(len(string_split(line, ' '))) AS n FROM norm JOIN freq USING (source, line) GROUP BY source, t),
o AS (SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(c.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(c.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(rem.n, 0) AS BIGINT) AS words_removed
  FROM c LEFT JOIN cov USING (doc_id) LEFT JOIN rem ON c.source = rem.source AND c.t = rem.t),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - words_removed >= 20 AND n_words - words_removed >= 0.3 * n_words AS kept, words_removed
FROM f
"""

"""Secret scans: base patterns plus multipart credential linking.

Three strong patterns are reported wherever they match. Weaker candidates (an account identifier, a loosely
named or high-entropy secret, an endpoint) mean little alone; they are reported only when a complementary part
stands within the same scope. A scope is a distance: parts of one text at most ``reach`` code points apart, across lines
and paragraphs, share one. The link is an interval join: weak parts are dealt to every scope
window they can reach, and a left-semi equi-join on (text, window) with the exact distance as its residual keeps
those that have a partner. No pairs are formed.

Defined cases: a null or empty text has no spans; repeated rows and equal ids each keep their own row (texts are
matched by id and content hash, null-safe); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, checkpointed, let, offsets, peaks

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""((?i)client_?id|user_?(?:name|id)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
LOOSE = r"""((?i)pwd|passphrase|private_?key|credential|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|sftp|ssh|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"

#: kind -> (order in the report, pattern, role, strong)
KINDS = {
    "assign": (0, ASSIGN, "secret", True),
    "access": (1, ACCESS, "ident", True),
    "hex": (2, HEX, "secret", True),
    "ident": (3, IDENT, "ident", False),
    "loose": (4, LOOSE, "secret", False),
    "endpoint": (5, ENDPOINT, "endpoint", False),
}
NAMED = r"""((?i)(?:secret_?access|access|secret|account|shared|client_?secret|signing|master)_?key(?:_?(?:id|value))?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
BARE = r"[A-Za-z0-9+/=_-]{20,}"
#: More weak parts, which give way to the others: key names that go on, and bare tokens of mixed classes.
WIDER = {"named": (6, NAMED, "secret", False), "bare": (7, BARE, "secret", False)}


def matches(text: Column, pattern: str, least: int = 0, fine=lambda hit: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as structs (start, end) in code points.

    The gaps between matches and the matches themselves alternate, so running lengths give the positions.
    ``least`` drops matches whose second group is shorter, ``fine`` those that it does not hold for. Texts without a match are read once.
    """
    long = lambda hit: F.length(F.regexp_extract(hit, pattern, 2)) >= least if least else fine(hit)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"), long(hit).alias("keep")))

    def placed(pairs):
        begins = offsets(F.transform(pairs, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))))
        spans = F.zip_with(pairs, begins, lambda x, at: F.struct((at + x["gap"]).cast("int").alias("start"), (at + x["gap"] + x["hit"]).cast("int").alias("end"), (x["hit"].isNotNull() & x["keep"]).alias("keep")))
        return F.transform(F.filter(spans, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _typed(kind: str, text: Column, fine=lambda hit: F.lit(True)) -> Column:
    order, pattern, role, strong = (KINDS | WIDER)[kind]
    found = matches(text, pattern, 6 if kind == "assign" else 0, fine)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(strong).alias("strong")))


def _mixed(hit: Column) -> Column:
    """A bare secret mixes upper and lower case and digits."""
    return hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")


def _without(df: DataFrame, tokens: list[str], spans: Column) -> DataFrame:
    """``df`` without those tokens of its span arrays that overlap one of the spans.

    Of the spans that start before a token's end the furthest end decides, so each token is a search by halving in a running
    maximum and not a pass over all spans. Columns that are used more than once are computed once a row.
    """
    asked = F.size(F.concat(*tokens)) > 0
    df = df.withColumn("_o", F.sort_array(F.transform(F.when(asked, spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    df = df.withColumn("_c", F.struct(F.transform("_o", lambda s: s["start"]).alias("starts"), peaks(F.transform("_o", lambda s: s["end"])).alias("ends")))
    free = lambda t: F.coalesce(F.get(F.col("_c.ends"), below(F.col("_c.starts"), t["end"]) - 1) <= t["start"], F.lit(True))
    return df.withColumns({t: F.when(asked, F.filter(t, free)).otherwise(F.col(t)) for t in tokens}).drop("_o", "_c")


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def link_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """``docs`` -> one row per input row: id, base (array), linked (array) of spans, ``reach`` code points apart at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.struct(F.xxhash64(F.col(id_col), text).alias("a"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("b")).alias("row_key"),  # 128 bits
        F.concat(*[_typed(k, text) for k in KINDS if KINDS[k][3]]).alias("base"),
        F.concat(*[_typed(k, text) for k in KINDS if not KINDS[k][3]]).alias("weak"),
        _typed("named", text).alias("named"),
        _typed("bare", text, _mixed).alias("bare"),
    )
    # key names that go on and bare tokens give way to what is known, bare tokens to those as well; what holds an access identifier is one already
    parts = _without(parts, ["named", "bare"], F.concat("base", "weak"))
    parts = _without(parts, ["bare"], F.col("named"))
    parts = checkpointed(parts.select("doc_id", "row_key", "base", F.concat("weak", "named", "bare").alias("weak")))
    window = lambda c: F.floor(c / reach)
    every = parts.where(F.size("weak") > 0).dropDuplicates(["row_key"])
    weak = every.select("row_key", F.explode("weak").alias("w")).select(
        "row_key", "w", F.explode(F.sequence(window(F.col("w.start") - reach), window(F.col("w.end") + reach))).alias("at")
    )
    other = every.select("row_key", F.explode(F.concat("base", "weak")).alias("o")).select(
        F.col("row_key").alias("o_key"), "o", F.explode(F.sequence(window(F.col("o.start")), window(F.col("o.end")))).alias("o_at")
    )
    near = (F.col("o.start") <= F.col("w.end") + reach) & (F.col("o.end") >= F.col("w.start") - reach)
    fits = (F.col("w.role") == "secret") != (F.col("o.role") == "secret")
    kept = weak.join(other, (F.col("row_key") == F.col("o_key")) & (F.col("at") == F.col("o_at")) & near & fits, "left_semi")
    linked = kept.select("row_key", "w").distinct().groupBy("row_key").agg(F.collect_list("w").alias("linked"))
    return parts.join(linked, "row_key", "left").select("doc_id", "base", F.coalesce("linked", F.slice("base", 1, 0)).alias("linked"))


def scan_digest(docs: DataFrame) -> DataFrame:
    """The contract columns: counts and digest of the base spans, and all spans."""
    found = link_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def hits(kinds: dict) -> str:
        return " UNION ALL ".join(
            f"SELECT doc_id, t, {order} AS ord, '{kind}' AS kind, '{role}' AS role, {str(strong).lower()} AS strong, {6 if kind == 'assign' else 0} AS least, string_split_regex(t, {quoted(pattern)}) AS g, regexp_extract_all(t, {quoted(pattern)}) AS m FROM d"
            for kind, (order, pattern, role, strong) in kinds.items()
        )

    placed = "SELECT doc_id, ord, kind, role, strong, coalesce(list_sum([length(x) FOR x IN g[1:k]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0) AS s, length(m[k]) AS n, m[k] AS token, least FROM"
    free = lambda other: f"NOT EXISTS (SELECT 1 FROM {other} o WHERE o.doc_id = x.doc_id AND o.s < x.s + x.n AND x.s < o.s + o.n)"
    named, bare = ({k: v} for k, v in WIDER.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS ({hits(KINDS)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM h),
known AS ({placed} i WHERE least = 0 OR length(regexp_extract(m[k], {quoted(ASSIGN)}, 2)) >= least),
hn AS ({hits(named)}), named AS (SELECT * FROM ({placed} (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hn)) x WHERE {free('known')}),
hb AS ({hits(bare)}), bare AS (SELECT * FROM ({placed} (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hb)) x
  WHERE regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]') AND {free('known')} AND {free('named')}),
p AS (SELECT * FROM known UNION ALL SELECT * FROM named UNION ALL SELECT * FROM bare),
w AS (SELECT * FROM p WHERE strong OR EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND (o.role = 'secret') <> (p.role = 'secret') AND o.s <= p.s + p.n + 200 AND o.s + o.n >= p.s - 200)),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT strong) AS n_linked,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord, n) FILTER (strong) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, ord, n) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()

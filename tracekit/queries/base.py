"""Registry of queries and their SQL twins, and the proxy views that both sides read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Views in the dialect that Spark and DuckDB share; names in braces are tables or earlier views.
VIEWS = {
    "fx_results": """SELECT event_type AS weight, event_id AS trace_id, ts, user_id, value,
  concat('ds', user_id % 12) AS dataset, concat('ds', user_id % 5, ',ds', user_id % 7) AS trained_models,
  CASE WHEN event_id % 10 = 0 THEN -1 ELSE 1500 END AS p_in_window, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1800 END AS s_in_window,
  CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id * 7919 % 1000 AS DOUBLE) / 1000 END AS p_prob,
  CASE WHEN event_id % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id * 104729 % 1000 AS DOUBLE) / 1000 END AS s_prob,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id * 31 % 1000 - 500 AS DOUBLE) / 100 END AS p_residual_s,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id * 17 % 1000 - 500 AS DOUBLE) / 100 END AS s_residual_s,
  CASE WHEN value < 20 THEN 'local (<150km)' WHEN value < 80 THEN 'regional (150-1500km)' ELSE 'teleseismic (>1500km)' END AS dist_bin
FROM {events}""",
    "fx_catalog": """SELECT concat(l_returnflag, l_linestatus) AS dataset, CAST(year(l_shipdate) AS STRING) AS chunk,
  concat('bucket', l_linenumber, '$', l_orderkey % 1000) AS trace_name, l_orderkey AS source_id, l_partkey AS station, l_suppkey AS channel,
  l_quantity * 100 AS p, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 100 + l_extendedprice / 100 END AS s,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice / 20 END AS km, l_discount * 80 AS mag, l_tax * 5000 AS depth, o_orderstatus AS vendor,
  o_orderpriority AS category, o_totalprice AS price, l_shipdate AS shipped, l_linenumber AS line,
  concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS rid
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_binned": """SELECT *, CASE WHEN km IS NULL OR km < 0 THEN 'unknown' WHEN km < 150 THEN 'local' WHEN km < 1500 THEN 'regional' ELSE 'teleseismic' END AS distance_bin FROM {fx_catalog}""",
    "fx_shared": """SELECT rid, CASE WHEN line = 7 THEN NULL ELSE dataset END AS dataset, CASE WHEN line = 6 THEN NULL ELSE distance_bin END AS distance_bin FROM {fx_binned}""",
    "fx_keys": """SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) AS rid,
  concat(l_returnflag, l_linestatus) AS dataset, concat('bucket', l_linenumber, '$', l_orderkey % 1000) AS trace_name, CAST(year(l_shipdate) AS STRING) AS chunk,
  CASE WHEN l_orderkey % 60 = 0 THEN NULL ELSE concat('o:', l_orderkey) END AS k1, CASE WHEN l_partkey % 50 = 0 THEN concat('p:', l_partkey) END AS k2, l_orderkey, l_partkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE '' END AS vendor
FROM {lineitem}""",
    "fx_rowkeys": """SELECT rid, dataset, trace_name, chunk, l_orderkey, k1 AS event_key FROM {fx_keys} WHERE k1 IS NOT NULL UNION ALL
SELECT rid, dataset, trace_name, chunk, l_orderkey, k2 FROM {fx_keys} WHERE k2 IS NOT NULL""",
    "fx_points": """SELECT event_id, event_type, ts, CAST(user_id * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(user_id * 73 % 360 - 180 AS DOUBLE) AS lon, user_id FROM {events}""",
    "fx_geo": """SELECT c_custkey AS id, CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 1800 AS DOUBLE) / 10 - 90 END AS lat, CAST(c_custkey * 73 % 3600 AS DOUBLE) / 10 - 180 AS lon,
  CAST(c_nationkey * 7 - 85 AS DOUBLE) AS lat2, CAST(c_nationkey * 14 - 170 AS DOUBLE) AS lon2, c_nationkey AS grp, c_mktsegment AS segment,
  CASE WHEN c_nationkey % 4 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS km FROM {customer}""",
    "fx_strings": """SELECT event_id, user_id, concat_ws('|', CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 90 AS STRING) END, CASE WHEN event_id % 11 = 0 THEN 'nan' ELSE CAST(event_id % 70 AS STRING) END, CASE WHEN event_id % 301 = 0 THEN 'bad' ELSE CAST(event_id % 50 AS STRING) END) AS snr,
  concat(event_type, '$', event_id, ',:3') AS name, concat('pre_', event_type, '__', user_id, '__', event_id) AS composed, concat('ev:', user_id, ' ', 'x-', event_id % 9, ';ev:', user_id) AS ids,
  CASE event_id % 4 WHEN 0 THEN 'HHZ,HHN' WHEN 1 THEN 'bnz;bne' WHEN 2 THEN 'XPZ' END AS channels, ts FROM {events}""",
    "fx_wave": """SELECT vec_id, label, vec_id % 64 AS pick, embedding FROM {embeddings}""",
    "fx_wave3": """SELECT a.vec_id, a.label, a.vec_id % 64 AS pick, CAST(a.embedding AS DOUBLE[]) AS c0, CAST(b.embedding AS DOUBLE[]) AS c1, CAST(c.embedding AS DOUBLE[]) AS c2
FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1 JOIN {embeddings} c ON c.vec_id = a.vec_id + 2""",
}
#: What only the spelling of a type sets apart.
SPARK_TYPES = {"DOUBLE[]": "ARRAY<DOUBLE>"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            for duck, own in SPARK_TYPES.items():
                text = text.replace(duck, own)
            return self.sql(text)
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def with_views(sql: str) -> str:
    """DuckDB form: the views that a statement names become common table expressions, with what they need before them."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    sql = plain(sql).strip()
    if not views:
        return sql
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {head[1] or ''}{views}, {sql[head.end():]}" if head else f"WITH {views} {sql}"


def query(oracle: str | None = None):
    """Registers a function of the tables under its name."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if oracle:
            ORACLES[make.__name__] = with_views(oracle)
        return make

    return register


#: Rows connected through shared keys, and the event-grouped split of T13, as common table expressions. Rows and keys pass on
#: the smallest row that they know of; a keyed recursion keeps one label for each.
COMPONENTS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT rid AS a, '~' || event_key AS b FROM {fx_rowkeys}), link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(id, label) USING KEY (id) AS (SELECT a, min(b) FROM (SELECT a, a AS b FROM link UNION ALL SELECT b, a FROM link) GROUP BY a
  UNION (SELECT u.id, min(v.label) AS label FROM recurring.cc u JOIN link ON link.a = u.id JOIN cc v ON v.id = link.b WHERE v.label < u.label GROUP BY u.id)),
comp AS (SELECT id AS rid, label AS group_id FROM cc WHERE id NOT LIKE '~%')"""
SPLIT_SQL = COMPONENTS_SQL + """,
named AS (SELECT k.rid, k.vendor, c.group_id IS NULL AND k.vendor <> '' AS placed, coalesce(c.group_id, 'row:' || k.rid) AS group_id FROM {fx_keys} k LEFT JOIN comp c ON k.rid = c.rid),
g AS (SELECT group_id, count(*) AS size FROM named WHERE NOT placed GROUP BY group_id), m AS (SELECT sum(size) AS m FROM g),
run AS (SELECT group_id, size, sum(size) OVER (ORDER BY md5(concat_ws('|', '0', group_id)), group_id) - size AS before FROM g),
v AS (SELECT coalesce(max(before + size), 0) AS stop FROM run, m WHERE before < floor(0.1 * m)),
s AS (SELECT group_id, CASE WHEN before < floor(0.1 * m) THEN 'val' WHEN before >= stop AND before < stop + floor(0.1 * m) THEN 'test' ELSE 'train' END AS split FROM run, m, v),
dealt AS (SELECT rid, CASE WHEN placed THEN vendor ELSE split END AS split FROM named LEFT JOIN s USING (group_id))"""

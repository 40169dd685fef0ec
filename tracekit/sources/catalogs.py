"""Sources and sinks: ragged catalogs, shards, reports, manifests, results."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keyindex import firsts

HEADERS = 32  # files whose headers are read at once

# Columns of a training manifest.
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("dataset_name", "trace_name", "chunk")] + [T.StructField(n, T.DoubleType()) for n in ("p_arrival_sample", "s_arrival_sample", "distance_km")] + [T.StructField(n, T.StringType()) for n in ("distance_bin", "p_col", "s_col")])


def read_catalog(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV catalog with every column as a string (inference turns digit tags into floats), or Parquet as it is."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return prune(df, columns) if columns else df


def prune(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only wanted columns that exist; the scan reads no others."""
    return df.select(*[f"`{c}`" for c in wanted if c in df.columns])


def csv_files(spark: SparkSession, pattern: str) -> list[str]:
    """Data files of a path, a folder or a glob, by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(pattern)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(place) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [x.getPath() for x in inside if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(x.toString() for x in found)


def csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of one file, read without its rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]))) if line else ()


def read_ragged(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """CSV files whose headers differ in names or order: one read for each header, united by name; strings, absent columns null. Adds _file."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADERS) as pool:  # first lines only; opening files takes waiting, not work
        headers = list(pool.map(lambda f: csv_header(spark, f), files))
    for f, header in zip(files, headers, strict=True):
        if header:
            by_header.setdefault(header, []).append(f)
    if not by_header:
        raise FileNotFoundError("no CSV file with a header")
    frames = []
    for header, paths in by_header.items():
        strings = T.StructType([T.StructField(n, T.StringType()) for n in header])
        frames.append(spark.read.schema(strings).option("header", True).csv(paths).select("*", F.col("_metadata.file_name").alias("_file")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_shards(spark: SparkSession, folder: str, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All complete CSV shards ``<prefix><tag>.csv`` with their tag as ``chunk``; partial files do not match. An error if there are none."""
    df = read_ragged(spark, csv_files(spark, f"{folder}/{prefix}*.csv"))
    df = df.withColumn("chunk", F.regexp_extract("_file", f"^{prefix}(.*)\\.csv$", 1)).drop("_file")
    return prune(df, [*columns, "chunk"]) if columns else df


def scan_and_filter(df: DataFrame, columns: Sequence[str], p: str, s: str, bad: DataFrame, require_p: bool = True, require_s: bool = False) -> DataFrame:
    """Column-pruned rows with the picks asked for and without bad names; partitions take the place of chunks."""
    out = prune(df, columns)
    for name, needed in ((p, require_p), (s, require_s)):
        if needed:
            out = out.where(F.col(name).isNotNull())
    return out.join(bad.select("trace_name").distinct(), "trace_name", "left_anti")


def label_reports(spark: SparkSession, paths: dict[str, str], flag: str = "multiplet") -> DataFrame:
    """(dataset, trace_name) of label reports, ``paths`` by dataset; only reports whose file name holds ``flag``."""
    frames = [read_ragged(spark, [f for f in csv_files(spark, p) if flag in f.rpartition("/")[2]]).select(F.lit(d).alias("dataset"), "trace_name") for d, p in paths.items()]
    return reduce(DataFrame.unionByName, frames).distinct()


def exclusions(benchmark: DataFrame, row_keys: DataFrame | None = None, row: str = "rid") -> tuple[DataFrame, DataFrame | None]:
    """Benchmark traces (dataset, trace_name) and, with keys at hand, their event keys."""
    traces = benchmark.select("dataset", "trace_name").distinct()
    events = row_keys.join(benchmark.select(row), row, "left_semi").select("event_key").distinct() if row_keys is not None else None
    return traces, events


def read_results(spark: SparkSession, path: str, weights: Sequence[str] = ()) -> DataFrame:
    """Results, partitioned by weight: the weights asked for are pruned before the scan."""
    df = spark.read.parquet(path)
    return df.where(F.col("weight").isin(*weights)) if weights else df


def write_manifest(df: DataFrame, path: str, columns: Sequence[str] = tuple(MANIFEST.names), csv: bool = False) -> None:
    """Projected manifest, one folder a split; null picks are empty in CSV."""
    out = df.select(*columns, "split").write.partitionBy("split").mode("overwrite")
    out.option("header", True).csv(path) if csv else out.parquet(path)


def write_results(df: DataFrame, path: str, key: str = "weight") -> None:
    """Replace by key: partitions of the keys at hand are overwritten, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the target does not hold; keys that repeat count once, by their smallest row.

    For one delivery into a table of keys; ``keyindex.append_new_keys`` is for a stream of them.
    """
    spark, df = df.sparkSession, firsts(df, keys)
    target = spark.read.schema(df.schema).parquet(path) if _exists(spark, path) else None
    fresh = df if target is None else df.join(target.select(*keys).distinct(), list(keys), "left_anti")
    fresh.select(*df.columns).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def datasets_of(manifest: DataFrame, column: str = "dataset_name") -> DataFrame:
    return manifest.select(column).distinct()

"""Which manifests a weight was trained on, read from the configurations of its training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weight_manifests(spark: SparkSession, folder: str, base: str, prefix: str = "finetune_", mark: str = "_ft") -> DataFrame:
    """(weight, train_manifest, val_manifest) of every configuration ``<prefix><base><rest>.yaml`` that names both.

    Its weight is ``<base><mark><rest>``; other files and settings are passed over.
    """
    texts = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True)
    named = texts.select("value", F.regexp_extract(F.col("_metadata.file_name"), f"^{prefix}{base}(.*)\\.yaml$", 1).alias("rest"), F.col("_metadata.file_name").startswith(f"{prefix}{base}").alias("ours"))
    setting = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^[ \t]+{name}[ \t]*:[ \t]*[\"']?([^\"'#\s]+)", 1), F.lit(""))
    found = named.where("ours").select(F.concat(F.lit(base + mark), "rest").alias("weight"), setting("train_manifest").alias("train_manifest"), setting("val_manifest").alias("val_manifest"))
    return found.where("train_manifest IS NOT NULL AND val_manifest IS NOT NULL")


def resolved(weights: DataFrame, registry: DataFrame, train: str, val: str) -> DataFrame:
    """Manifests of each weight, with the given pair for those without a configuration of their own."""
    out = weights.join(registry, "weight", "left")
    return out.withColumn("train_manifest", F.coalesce("train_manifest", F.lit(train))).withColumn("val_manifest", F.coalesce("val_manifest", F.lit(val)))


def families(registry: DataFrame) -> DataFrame:
    """(manifest_family, weight): weights that share a training manifest are one family, named by its path without folders or extension."""
    stem = F.regexp_replace(F.regexp_extract("train_manifest", r"([^/]+(?:/[^/]+)?)$", 1), r"\.[a-z]+$", "")
    return registry.select(F.replace(stem, F.lit("/"), F.lit("__")).alias("manifest_family"), "weight")

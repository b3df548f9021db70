"""Scans: whole texts, labelled corpora, prompt batteries, catalogs."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.operators.mining import Catalog

RECORD = "family string, prompt_id string, text string"
SAMPLE = "family string, provider string, model string, prompt_id string, source string, upstream string, harvested_at string, text string"
PROMPT = "prompt_id string, prompt string"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are: small tables come in one row group.

    A large table is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are passed over, a broken one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled texts; a missing prompt is empty, family and text are required."""
    rows = read_lines(spark, path, RECORD)
    required = F.when(F.col("family").isNull() | F.col("text").isNull(), F.raise_error(F.lit("a record needs family and text"))).otherwise(F.col("family"))
    return rows.select(required.alias("family"), F.coalesce("prompt_id", F.lit("")).alias("prompt_id"), "text")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, SAMPLE)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """A battery in its order: ``place, prompt_id, prompt``."""
    return read_lines(spark, path, PROMPT).withColumn("place", F.monotonically_increasing_id())


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """A catalog that ``write_catalog`` wrote; filters on a feature reach its files."""
    return Catalog(*(spark.read.parquet(f"{path}/{name}") for name in ("features", "weights", "families")))


def parse_catalog(spark: SparkSession, toml: str) -> Catalog:
    """A catalog from TOML, one table per feature with arrays parallel to the families."""
    data = tomllib.loads(toml)
    families = data["families"]
    blank = [0.0] * len(families)
    features = [(name, float(row["idf"]), float(row["base"])) for name, row in data.get("features", {}).items()]
    weights = [(name, f, float(rate), float(w)) for name, row in data.get("features", {}).items() for f, rate, w in zip(families, row["rate"], row.get("w") or blank, strict=True)]
    named = [(f, int(n), float(b)) for f, n, b in zip(families, data["samples"], data.get("bias") or blank, strict=True)]
    return Catalog(spark.createDataFrame(features, "feature string, idf double, base double"), spark.createDataFrame(weights, "feature string, family string, rate double, w double"), spark.createDataFrame(named, "family string, samples long, bias double"))

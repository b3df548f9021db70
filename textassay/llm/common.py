"""Helpers shared by the corpus operators: tables, batches, joins on frequent keys, names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.sources import scratch
from textassay.sources.scratch import discard, materialise, scratch_path, shared_dir, written

__all__ = ["bounded_batches", "discard", "free_name", "materialise", "pylists", "salted_join", "scratch_path", "shared_dir", "table", "text_or_empty", "written"]

#: Rows of an Arrow batch sent to a Python worker: texts may be very long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory (any store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of very long texts must fit a worker."""
    scratch.bounded_batches(spark, BATCH_ROWS)


#: A key is hot if it has more than one in so many of all rows; so at most as many keys are hot, and these are broadcast.
HOT_KEYS = 10_000
#: Rows of one key that a task takes at any size of the table.
COLD_ROWS = 1_000


def salted_join(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, spread: list, how: str = "inner", least: int = COLD_ROWS) -> DataFrame:
    """``rows`` joined to ``counted`` on ``keys``, where no key's rows are one task's.

    ``counted`` is a stored table with each key once and, in column ``n``, how many
    rows of ``rows`` have it.  A key that has more than its share is dealt over
    several tasks by a hash of the columns ``spread`` (names or columns; they only
    decide where a row goes), and its row of ``counted`` is
    repeated for them.  ``n`` is not part of the result.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    share = max(total // HOT_KEYS, least)
    counted = counted.withColumn("__salts", F.ceil(F.col(n) / share).cast("int")).drop(n)
    hot = counted.filter("__salts > 1").select(*keys, "__salts")
    if hot.isEmpty():
        return rows.join(counted.drop("__salts"), keys, how)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    repeated = counted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def pylists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield [c.to_pylist() for c in batch.columns]


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or that with underscores where a column has the name (in any case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted

"""Samples as a stream: an extension of the append-only corpus, not of the reference.

Files of JSON lines that arrive in a folder are taken once each, repeated
(family, prompt) pairs are dropped within the watermark, and every micro-batch
is linted (or attributed) with the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textassay.operators.lint import reports
from textassay.sources.packs import Engine
from textassay.sources.readers import SAMPLE

SEEN_FOR = "7 days"


def sample_stream(spark: SparkSession, folder: str, seen_for: str = SEEN_FOR) -> DataFrame:
    """New samples, the first of each (family, prompt_id) in any span of ``seen_for``: the state is bounded by it."""
    rows = spark.readStream.schema(SAMPLE).json(folder).withColumn("at", F.try_to_timestamp("harvested_at"))
    return rows.withColumn("at", F.coalesce("at", F.current_timestamp())).withWatermark("at", seen_for).dropDuplicatesWithinWatermark(["family", "prompt_id"])


def lint_stream(stream: DataFrame, out: str, checkpoint: str, engine: Engine | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Write the report of every new sample to ``out``; a batch that is run again overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        keyed = df.select(F.concat_ws("/", "family", "prompt_id").alias("sample"), "text")
        done = reports(keyed, engine, "sample")
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if then is not None:
            then(df, epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

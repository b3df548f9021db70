"""Derived inputs of the queries, as Spark frames and as the same SQL.

The tables hold no tells, so documents get a suffix that has some, by their ids;
labelled corpora are documents by language and by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.sources.readers import spread

#: One suffix for each remainder of the id by 12; Spark and DuckDB read the same text.
SUFFIX = """CASE doc_id % 12
 WHEN 1 THEN 'The team worked 2020 – 2024 — and it went well.'
 WHEN 2 THEN 'We leverage tools, Utilized data and DELVE deep.'
 WHEN 3 THEN 'the eval harness runs; we harness wind, a safety harness and They Harnessed it.'
 WHEN 4 THEN 'It is important to note that this works. That being said, we go at its core home.'
 WHEN 5 THEN 'This is a testament to a myriad of testaments, and a redeep dive into it; _delve_ delve2.'
 WHEN 6 THEN 'List:' || chr(10) || '- Built the api' || chr(10) || '- Built the app' || chr(10) || '* Built more' || chr(10) || '1. Built it. Twice' || chr(10) || '- built' || chr(10) || '- Other'
 WHEN 7 THEN 'red, green, and blue. one, two, and three. sun, moon, and stars.'
 WHEN 8 THEN chr(10) || '```' || chr(10) || 'delve leverage' || chr(10) || '```' || chr(10) || 'We delve.'
 WHEN 9 THEN 'See `leverage()` at https://example.com/delve and <b class="delve">we delve</b> there.'
 WHEN 10 THEN '“fine” work; it’s ‘good’; yes ,  no ;. ok.  and so'
 WHEN 11 THEN 'One two three four. Five six seven eight. One two three four. Five six seven eight. One two three four. Five six seven eight. One two three four. Five six seven eight. One two three four.'
 ELSE '' END"""

#: Every document with its own text and its suffix.
WHOLE_SQL = f"SELECT doc_id, text || ' ' || {SUFFIX} AS text FROM documents"
CORPUS_SQL = "SELECT doc_id, CASE WHEN lang = 'es' THEN 'unmatched' ELSE lang END AS family, CAST(doc_id % 50 AS VARCHAR) AS prompt_id, text FROM documents"
SCORED_SQL = """SELECT doc_id, CASE WHEN lang = 'es' THEN 'unmatched' ELSE lang END AS truth,
 CASE WHEN doc_id % 5 = 0 THEN CASE (doc_id * 7) % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'unmatched' END
      WHEN lang = 'es' THEN 'unmatched' ELSE lang END AS pred,
 CASE WHEN doc_id % 5 = 0 THEN ((doc_id * 37) % 600) / 1000.0e0 ELSE ((doc_id * 37) % 1000) / 1000.0e0 END AS confidence FROM documents"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, none left out or emptied."""
    return documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), F.expr(SUFFIX)).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("lang") == "es", "unmatched").otherwise(F.col("lang"))
    return documents(spark, sf_dir).select("doc_id", family.alias("family"), (F.col("doc_id") % 50).cast("string").alias("prompt_id"), "text")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents(spark, sf_dir).createOrReplaceTempView("__scored_documents")
    return spark.sql(SCORED_SQL.replace("FROM documents", "FROM __scored_documents").replace("AS VARCHAR", "AS STRING"))

"""Token counts through a cache of content digests.

A text's key is the digest of its content and of the tokenizer's file and
settings.  Keys are joined to the stored counts; only distinct texts that miss
are encoded, and their counts are appended to the store, a Parquet folder that
any number of runs share.  A store that several runs fill at once may hold a key
twice, with one count: readers take one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, salted_join, scratch_path, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
MOST = 4096
#: Missing digests (32 bytes each) that are broadcast to find their texts; more are joined.
SMALL_MISSES = 100_000

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The worker's counting function for a tokenizer file: .json by tokenizers, .model by sentencepiece."""
    if path not in _loaded:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            encode = Tokenizer.from_file(path)
            encode.no_truncation()
            encode.no_padding()
            _loaded[path] = lambda texts: [len(e.ids) for e in encode.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    return _loaded[path]


def tokenizer_version(path: str) -> str:
    """Digest of what decides the counts: the file and how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no specials, no truncation, no padding").hexdigest()


def count_partition(path: str, carry: bool = False) -> Callable:
    """Counts of a batch's texts; ``carry`` passes on how many rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text").to_pylist()
                found = [n for at in range(0, len(texts), 64) for n in count(texts[at : at + 64])]
                columns = [batch.column("digest").cast(pa.binary()), pa.array(found, pa.int64()), *([batch.column("n")] if carry else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_tokens", "n"][: len(columns)])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame | None:
    """The store, or None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, small_misses: int = SMALL_MISSES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``cache`` is the store's path in a folder that all machines share; without
    one a store in the shared scratch folder serves this call alone.  With a store,
    texts cross the network only if their digests miss: up to ``small_misses`` of
    those are broadcast, beyond them one text of each digest is shuffled.  A null text
    counts as empty: no bytes, no tokens.  Repeated rows and copies are encoded
    once; rows with a null id are counted like any others.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cache = cache or scratch_path(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    # The first of each digest: copies are dropped before the shuffle, then behind it.
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    stored = read_cache(spark, cache)
    if stored is not None:
        known = stored.filter(F.col("tokenizer") == version).select("digest")
        wanted = materialise(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digests")
        missing = materialise(wanted.join(known, "digest", "left_anti").select("digest"), "missing")
        if missing.count() <= small_misses:
            distinct = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            distinct = distinct.join(missing, "digest", "left_semi")
        encoded = distinct.select("digest", "text").mapInArrow(count_partition(tokenizer), "digest binary, n_tokens long")
        encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
        # A store that several runs fill may hold a key twice.
        counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counts = materialise(wanted.join(counts, "digest"), "counts")
    else:
        encoded = materialise(distinct.mapInArrow(count_partition(tokenizer, carry=True), "digest binary, n_tokens long, n long"), "counts")
        encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
        counts = encoded
    id_, bytes_ = F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")
    joined = salted_join(docs.select(id_, bytes_, digest.alias("digest")), counts, ["digest"], "n", [F.monotonically_increasing_id()])
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))

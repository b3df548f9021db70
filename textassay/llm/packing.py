"""Sequences packed by the sum-of-squares rule.

A document goes to the open sequence (or a new one) for which the sum over
gaps g of (number of open sequences with gap g) squared becomes smallest: no
gap may become common unless documents come that fill it.  Documents are placed
from the longest to the shortest, so that short ones fill what is left.

Placing is sequential, so rows are dealt to independent groups of about
``GROUP_ROWS`` pieces, by stored row numbers and not by content: no key can fill
a group.  A group wastes at most a few sequences of thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, pylists, text_or_empty
from .token_words import word_tokens

CAPACITY = 4096
#: Pieces that one task packs: bounds its memory and time.
GROUP_ROWS = 16_384

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut_documents(tokenizer: str, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = word_tokens(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for doc_ids, texts in pylists(batches):
            rows = []
            for i, raw in zip(doc_ids, words.ids(texts), strict=True):
                ids = raw + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its place in it; bins are numbered from 0.

    The rule may open a sequence while a document still fits another; whether that
    pays depends on the lengths.  Both ways are tried, the one with fewer is taken.
    """
    return min((placed(lengths, capacity, free) for free in (False, True)), key=lambda found: int(found[0].max(initial=-1)))


def placed(lengths: np.ndarray, capacity: int, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``sum_of_squares``; ``free``: a new sequence counts among the choices even where others fit."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    counts = np.zeros(capacity + 1, np.int64)  # open bins by gap; full ones don't count
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        new = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0
        gap = capacity
        if size < capacity:
            own = counts[size:capacity]
            change = 2 * (counts[: capacity - size] - own + 1)
            change[0] = 1 - 2 * own[0]  # filled: its gap goes and none comes
            change[own == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if own[best] and (change[best] <= new or not free):
                gap = size + best
        if gap == capacity:
            b, n = n, n + 1
        else:
            b = by_gap[gap].pop()
            counts[gap] -= 1
        bins[k], offsets[k] = b, capacity - gap
        left = gap - size
        if left:
            by_gap[left].append(b)
            counts[left] += 1
    return bins, offsets


def pack_group(capacity: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        group = int(pdf["group"].iloc[0])
        return pdf.assign(sequence_id=(group << 32) + bins, offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack the token ids of every document into sequences of at most ``capacity``.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A document is its ids and then ``end_id``; only one that is longer
    than a sequence is cut.  A null or empty text is one token long.  A null id
    and repeated rows are packed like any others, one by one.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(cut_documents(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialise(cut.withColumn("slot", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack_group(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

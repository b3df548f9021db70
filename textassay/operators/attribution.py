"""Attribution: scores of a catalog's families, a call or a refusal, and evidence.

A text is attributed in its own row: in Arrow batches of texts the catalog's features
are counted, which are multiplied with the catalog that every task holds.
Nothing is shuffled, and rows that share an id (or have none) stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mining import UNMATCHED, Catalog, Matrix, in_memory, texts_of

RECEIPTS = 8
MIN_CONFIDENCE, MIN_MATCHED = 0.30, 40

RANKED = "array<struct<family:string,probability:double,score:double>>"
EVIDENCE = "array<struct<feature:string,contribution:double,rate:double,baseline:double>>"


def softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def lists(offsets: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def attributed_batch(texts: pa.Array, m: Matrix, most: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Rankings, gaps of the first two, matched features and evidence of a batch of texts."""
    n, k = len(texts), len(m.families)
    rows, places, values = m.entries(texts)
    cells = m.weights[places] * values[:, None]
    scores = np.stack([np.bincount(rows, cells[:, f], n) for f in range(k)], axis=1) + m.bias if k else np.zeros((n, 0))
    matched = np.bincount(rows, minlength=n)
    odds = softmax(scores) if k else scores
    order = np.argsort(-np.round(odds, 9), axis=1, kind="stable")  # families are in the order of names: ties go by it
    line = np.arange(n)[:, None]
    ranked_odds, ranked_scores = odds[line, order], scores[line, order]
    gap = ranked_odds[:, 0] - ranked_odds[:, 1] if k > 1 else np.zeros(n)
    names = pa.array(m.families, pa.string())
    ranked = lists(np.arange(n + 1) * k, {"family": names.take(pa.array(order.ravel())), "probability": pa.array(ranked_odds.ravel()), "score": pa.array(ranked_scores.ravel())})
    if k < 2 or not most:
        return ranked, pa.array(gap), pa.array(matched), lists(np.zeros(n + 1), {"feature": names[:0], "contribution": pa.array([], pa.float64()), "rate": pa.array([], pa.float64()), "baseline": pa.array([], pa.float64())})
    lead = cells[np.arange(len(rows)), order[rows, 0]] - cells[np.arange(len(rows)), order[rows, 1]]
    by = np.lexsort((-np.round(lead, 9), rows))  # ties stay in the order of places, which is that of features
    first = np.cumsum(matched) - matched
    kept = by[np.arange(len(by)) - first[rows] < most]  # rows come sorted, so the place in a row's run is known
    top = order[rows[kept], 0]
    proof = lists(np.r_[0, np.cumsum(np.minimum(matched, most))], {"feature": m.features.take(pa.array(places[kept])), "contribution": pa.array(lead[kept]), "rate": pa.array(m.rates[places[kept], top]), "baseline": pa.array(m.base[places[kept]])})
    return ranked, pa.array(gap), pa.array(matched), proof


def attributed(df: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, most: int = RECEIPTS) -> DataFrame:
    """``id``, the columns ``carry``, ``ranked`` (families by probability; ties by name), ``confidence`` (the gap of the first two), ``matched`` and ``evidence``.

    One row for each row of ``df``.  Evidence is what the first family leads the
    second by, feature by feature; none with ``most`` of 0.  A text without a feature of the catalog scores
    the biases.
    """
    matrix = df.sparkSession.sparkContext.broadcast(in_memory(catalog))
    carry = {"id": F.col(id_col)} | (carry or {})
    texts = texts_of(df, carry, text_col)
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = attributed_batch(batch.column("__text"), matrix.value, most)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "ranked", "confidence", "matched", "evidence"])

    own = ", ".join(f"{name} {kinds[name]}" for name in carry)
    return texts.mapInArrow(run, f"{own}, ranked {RANKED}, confidence double, matched long, evidence {EVIDENCE}")


def scores(found: DataFrame) -> DataFrame:
    """``id, family, score, matched`` of attributed texts."""
    return found.select("id", "matched", F.explode("ranked").alias("r")).select("id", "r.family", "r.score", "matched")


def posteriors(found: DataFrame) -> DataFrame:
    """``id, family, probability, rank`` of attributed texts."""
    return found.select("id", F.posexplode("ranked").alias("at", "r")).select("id", "r.family", "r.probability", (F.col("at") + 1).alias("rank"))


def called(min_confidence: float, min_matched: int) -> Column:
    """The first family if enough matched and the gap is wide enough; null refuses, as does the rejection class."""
    top = F.get("ranked", 0)["family"]
    return F.when((F.col("matched") >= min_matched) & (F.col("confidence") >= min_confidence) & (top != UNMATCHED), top)


def decisions(found: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_matched: int = MIN_MATCHED) -> DataFrame:
    """``id, top, runner, confidence, matched, call``."""
    return found.select("id", F.get("ranked", 0)["family"].alias("top"), F.get("ranked", 1)["family"].alias("runner"), "confidence", "matched", called(min_confidence, min_matched).alias("call"))


def receipts(found: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_matched: int = MIN_MATCHED) -> DataFrame:
    """Evidence of each call: ``id, rank, feature, contribution, rate, baseline``."""
    rows = found.filter(called(min_confidence, min_matched).isNotNull()).select("id", F.posexplode("evidence").alias("at", "e"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), "e.*")


def who(df: DataFrame, catalog: Catalog, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE, min_matched: int = MIN_MATCHED) -> DataFrame:
    """One row per text: ``ranked, confidence, matched, call, receipts`` and the closed set ``catalog``."""
    found = attributed(df, catalog, id_col, text_col)
    shown = F.transform("ranked", lambda x: F.struct(x["family"].alias("family"), x["probability"].alias("probability")))
    call = called(min_confidence, min_matched)
    families = F.array_sort(F.transform("ranked", lambda x: x["family"]))
    return found.select(F.col("id").alias(id_col), shown.alias("ranked"), "confidence", "matched", call.alias("call"), F.when(call.isNotNull(), F.col("evidence")).otherwise(F.array().cast(EVIDENCE)).alias("receipts"), families.alias("catalog"))


def closest(df: DataFrame, most: int = 2) -> DataFrame:
    """The first families of each ranking, for texts that were refused."""
    return df.withColumn("closest", F.slice("ranked", 1, most))

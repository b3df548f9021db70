"""SQL functions for a session: ``assay_lint(text)`` and ``assay_who(text, margin)`` (JSON), ``assay_fix(text)``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textassay.operators.attribution import attributed_batch
from textassay.operators.mining import UNMATCHED, Catalog, in_memory
from textassay.sources.packs import Engine, default_engine

from . import exact

#: Matched features from which on ``assay_who`` calls; lower than the operator's own.
MIN_MATCHED = 20


def register(spark: SparkSession, engine: Engine | None = None) -> None:
    engine = engine or default_engine()

    def report(text: str) -> str:
        findings, words, total, score, band = exact.lint_text(text, engine)
        return json.dumps({"findings": findings, "words": words, "total_weight": total, "score": score, "band": band}, ensure_ascii=False)

    @F.pandas_udf("string")
    def assay_lint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(report, na_action="ignore")

    @F.pandas_udf("string")
    def assay_fix(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(lambda t: exact.fix_text(t, engine), na_action="ignore")

    spark.udf.register("assay_lint", assay_lint)
    spark.udf.register("assay_fix", assay_fix)


_loaded: set[int] = set()


def load_catalog(spark: SparkSession, catalog: Catalog, min_matched: int = MIN_MATCHED) -> None:
    """Register ``assay_who(text, margin)`` with this catalog; once for a session."""
    if id(spark) in _loaded:
        raise RuntimeError("a catalog is loaded once for a session")
    matrix = spark.sparkContext.broadcast(in_memory(catalog))

    @F.pandas_udf("string")
    def assay_who(texts: pd.Series, margins: pd.Series) -> pd.Series:
        ranked, gaps, matched, proof = (x.to_pylist() for x in attributed_batch(pa.array(texts, pa.string(), from_pandas=True), matrix.value, 8))
        out = []
        for text, margin, r, gap, n, p in zip(texts, margins, ranked, gaps, matched, proof, strict=True):
            call = r[0]["family"] if r and n >= min_matched and gap >= margin and r[0]["family"] != UNMATCHED else None
            shown = [{"family": x["family"], "probability": x["probability"]} for x in r]
            out.append(None if text is None or np.isnan(margin) else json.dumps({"ranked": shown, "confidence": gap, "matched": n, "call": call, "receipts": p if call else [], "catalog": matrix.value.families}, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    spark.udf.register("assay_who", assay_who)
    _loaded.add(id(spark))

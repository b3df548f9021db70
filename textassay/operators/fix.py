"""Deterministic rewriting keyed to the rules; masked regions are never touched."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.functions import exact
from textassay.sources.packs import Engine, default_engine

from .lint import over_texts


def fix(df: DataFrame, engine: Engine | None = None, text_col: str = "text", out_col: str = "fixed", steps: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with each text rewritten, segment by segment between its masked regions.

    ``steps`` (names of ``exact.STEPS``) does these alone.  A null text stays null.
    """
    engine = engine or default_engine()
    done = over_texts(df, text_col, {out_col: "string"}, lambda texts: [pa.array([exact.fix_text(t, engine, steps) for t in texts], pa.string())])
    return done.withColumn(out_col, F.when(F.col(text_col).isNotNull(), F.col(out_col)))


def guarantee(df: DataFrame, engine: Engine | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with the weight of each text before and after rewriting, and the fixable findings that are left."""
    engine = engine or default_engine()

    def build(texts: list[str]) -> list[pa.Array]:
        weight = lambda found: float(sum(exact.details(f[2], engine)[2] for f in found))
        before = [exact.findings_of(t, engine)[0] for t in texts]
        after = [exact.findings_of(exact.fix_text(t, engine), engine)[0] for t in texts]
        left = [sum(exact.details(f[2], engine)[4] for f in found) for found in after]
        return [pa.array(map(weight, before), pa.float64()), pa.array(map(weight, after), pa.float64()), pa.array(left, pa.int32())]

    return over_texts(df, text_col, {"before": "double", "after": "double", "fixable_left": "int"}, build)

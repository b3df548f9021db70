"""Evaluation: a split by prompt, a threshold sweep, the control and the confusion table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.functions import patterns as P
from textassay.functions.hashing import fnv1a_mod

from textassay.sources.scratch import materialise

from .attribution import attributed
from .mining import UNMATCHED
from .training import fit

STEPS = 100


def bucket(prompt: Column, text: Column) -> Column:
    """0 to 99 by the prompt, or by the text where there is none."""
    return fnv1a_mod(F.when(F.coalesce(prompt, F.lit("")) == "", F.coalesce(text, F.lit(""))).otherwise(prompt), 100)


def split_holdout(df: DataFrame, holdout: int = 20, prompt_col: str = "prompt_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``bucket`` and ``is_train``: all texts of a prompt fall on one side."""
    return df.withColumn("bucket", bucket(F.col(prompt_col), F.col(text_col))).withColumn("is_train", F.col("bucket") >= holdout)


def truncate_words(df: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """Texts of at least so many words, cut to their first ones, joined by single spaces."""
    pieces = F.filter(F.split(F.col(text_col), P.PY_SPACE + "+"), lambda w: w != "")
    cut = df.withColumn("__pieces", pieces).filter(F.size("__pieces") >= words)
    return cut.withColumn(text_col, F.array_join(F.slice("__pieces", 1, words), " ")).drop("__pieces")


def forced_choice(scored: DataFrame) -> DataFrame:
    """Accuracy without abstention over ``truth, pred, confidence`` rows of the catalog's families."""
    own = scored.filter(F.col("truth") != UNMATCHED)
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("hits"), F.avg((F.col("pred") == F.col("truth")).cast("double")).alias("accuracy"))


def sweep(scored: DataFrame) -> DataFrame:
    """``step, m, called, hits, precision, coverage`` for m = 0.00 to 0.99 while anything is called.

    Texts are counted by the last step that their confidence reaches; a hundred
    rows are then summed from above.
    """
    own = scored.filter(F.col("truth") != UNMATCHED)
    rough = F.floor(F.col("confidence") * STEPS).cast("int")
    at = F.when(F.col("confidence") >= (rough + 1) * 0.01, rough + 1).when(F.col("confidence") < rough * 0.01, rough - 1).otherwise(rough)
    speaks = F.col("pred") != UNMATCHED
    by_step = own.groupBy(F.least(at, F.lit(STEPS - 1)).alias("step")).agg(F.count_if(speaks).alias("c"), F.count_if(speaks & (F.col("pred") == F.col("truth"))).alias("h"), F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(STEPS).select(F.col("id").cast("int").alias("step"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = grid.join(by_step, "step", "left")
    summed = rows.select("step", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("called"), F.coalesce(F.sum("h").over(above), F.lit(0)).alias("hits"), F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(0)).alias("n"))
    return summed.filter("called > 0").select("step", (F.col("step") * 0.01).alias("m"), "called", "hits", (F.col("hits") / F.col("called")).alias("precision"), (F.col("called") / F.col("n")).alias("coverage"))


def threshold(swept: DataFrame, floor: float = 0.95) -> DataFrame:
    """The first step that holds the floor: one row, or none."""
    return swept.filter(F.col("precision") >= floor).orderBy("step").limit(1)


def control(scored: DataFrame, m: Column | float) -> DataFrame:
    """Calls among texts that are none of the families, at a threshold."""
    out = scored.filter(F.col("truth") == UNMATCHED)
    calls = F.count_if((F.col("confidence") >= m) & (F.col("pred") != UNMATCHED))
    return out.agg(F.count(F.lit(1)).alias("n"), calls.alias("called"), (calls / F.count(F.lit(1))).alias("false_positive_rate"))


def confusion(scored: DataFrame, families: list[str], m: Column | float) -> DataFrame:
    """Counts by truth (rows) and prediction (columns), and what abstains."""
    own = scored.filter(F.col("truth") != UNMATCHED)
    speaks = F.col("confidence") >= m
    counts = [F.count_if(speaks & (F.col("pred") == f)).alias(f) for f in families]
    return own.groupBy("truth").agg(*counts, F.count_if(~speaks).alias("abstain"))


def score_rows(df: DataFrame, catalog, id_col: str, family_col: str, text_col: str) -> DataFrame:
    """``truth, pred, confidence`` of each text."""
    found = attributed(df, catalog, id_col, text_col, {"truth": F.col(family_col)}, most=0)
    return found.select("truth", F.get("ranked", 0)["family"].alias("pred"), "confidence")


def evaluate(df: DataFrame, top_k: int = 2000, epochs: int = 12, floor: float = 0.95, holdout: int = 20, negatives: DataFrame | None = None, truncate: int = 0, id_col: str = "doc_id", family_col: str = "family", text_col: str = "text", prompt_col: str = "prompt_id", trainer: str = "lbfgs") -> dict[str, DataFrame]:
    """Split, fit, score and sweep: ``scored, accuracy, sweep, threshold, control, confusion``.

    The catalog, the scored rows and the sweep are stored in between: what is
    returned reads small tables.
    """
    rows = truncate_words(df, truncate, text_col) if truncate else df
    rows = split_holdout(rows, holdout, prompt_col, text_col)
    catalog = fit(rows.filter("is_train"), top_k, epochs, id_col, family_col, text_col, trainer)
    scored = score_rows(rows.filter("NOT is_train"), catalog, id_col, family_col, text_col)
    if negatives is not None:
        scored = scored.unionByName(score_rows(negatives.withColumn(family_col, F.lit(UNMATCHED)), catalog, id_col, family_col, text_col))
    scored = materialise(scored, "scored")
    swept = materialise(sweep(scored), "sweep")
    chosen = threshold(swept, floor)
    first = chosen.first()
    m = first.m if first else 0.0
    families = [r.family for r in catalog.families.select("family").orderBy("family").collect()]
    return {"scored": scored, "accuracy": forced_choice(scored), "sweep": swept, "threshold": chosen, "control": control(scored, m), "confusion": confusion(scored, families, m)}

"""Linting: findings with evidence, densities and bands, over a column of texts.

A text is linted in its own row, in Arrow batches and without a shuffle, in time
linear in its length.  (As native columns it was no faster once warm, and quadratic:
array functions copy their arrays for every match.)  What follows a finding is
native.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textassay.functions import exact
from textassay.sources.packs import Engine, default_engine
from textassay.sources.scratch import bounded_batches

FINDING = {"rule_id": "string", "rule_name": "string", "start": "int", "end": "int", "excerpt": "string", "weight": "double", "rationale": "string", "fixable": "boolean"}
FINDINGS = "array<struct<" + ",".join(f"{k}:{v}" for k, v in FINDING.items()) + ">>"
INTERVALS = "array<struct<start:int,end:int>>"
BANDS = ("clean", "seasoned", "heavy")


def over_texts(df: DataFrame, text_col: str, made: dict[str, str], build: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns ``made`` (name to type), which ``build`` makes of a batch's texts; a null text counts as empty."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *build(texts)], names=[*batch.schema.names, *made])

    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in made.items()))
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def structs(rows: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """Lists of tuples as an array of structs."""
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(fields)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields)))


def in_bytes(text: str, spans: list[tuple[int, int]]) -> dict[int, int]:
    """The ends of spans as UTF-8 offsets."""
    points = sorted({p for s in spans for p in s})
    return dict(zip(points, exact.places(text, points), strict=True))


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def with_mask(df: DataFrame, text_col: str = "text", mask_col: str = "mask") -> DataFrame:
    """``df`` with the masked regions of each text: byte intervals, sorted and disjoint."""

    def build(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            spans = exact.mask_spans(t)
            at = in_bytes(t, spans)
            rows.append([(at[a], at[b]) for a, b in spans])
        return [structs(rows, {"start": pa.int32(), "end": pa.int32()})]

    return over_texts(df, text_col, {mask_col: INTERVALS}, build)


def literal_spans(df: DataFrame, engine: Engine | None = None, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``df`` with the leftmost longest words and phrases of each text, before anything rejects them: byte offsets, the code point (from 1) and what stands there."""
    engine = engine or default_engine()

    def build(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            spans = exact.literal_spans(t, engine)
            at = in_bytes(t, spans)
            rows.append([(at[a], at[b], a + 1, t[a:b]) for a, b in spans])
        return [structs(rows, {"start": pa.int32(), "end": pa.int32(), "at": pa.int32(), "hit": pa.string()})]

    return over_texts(df, text_col, {out_col: "array<struct<start:int,end:int,at:int,hit:string>>"}, build)


def with_findings(df: DataFrame, engine: Engine | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``words`` (of prose) and ``findings`` (sorted by start, end; ties in the order of rules, those of the document last)."""
    engine = engine or default_engine()

    def build(texts: list[str]) -> list[pa.Array]:
        words, rows = [], []
        for t in texts:
            found, n = exact.findings_of(t, engine)
            at = in_bytes(t, [f[:2] for f in found])
            words.append(n)
            one = []
            for a, b, rule, said in found:
                rule_id, name, weight, why, fixable = exact.details(rule, engine)
                one.append((rule_id, name, at[a], at[b], said, weight, why, fixable))
            rows.append(one)
        return [pa.array(words, pa.int32()), structs(rows, {k: ARROW[v] for k, v in FINDING.items()})]

    return over_texts(df, text_col, {"words": "int", "findings": FINDINGS}, build)


def findings(df: DataFrame, engine: Engine | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: the id and the finding's fields."""
    found = with_findings(df.select(id_col, text_col), engine, text_col)
    return found.select(id_col, F.explode("findings").alias("f")).select(id_col, "f.*")


def reports(df: DataFrame, engine: Engine | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``n_findings, words, total_weight, score`` (weight per 1000 words) and ``band``.

    Only these numbers leave the worker.
    """
    engine = engine or default_engine()

    def build(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            found, words = exact.findings_of(t, engine)
            rows.append((len(found), words, *exact.score_of(found, words, engine)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True)]

    made = {"n_findings": "int", "words": "int", "total_weight": "double", "score": "double", "band": "string"}
    return over_texts(df.select(id_col, text_col), text_col, made, build).drop(text_col)


def json_reports(df: DataFrame, engine: Engine | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's report as JSON, findings and all."""
    engine = engine or default_engine()
    found = with_findings(df.select(id_col, text_col), engine, text_col)
    shaped = found.select(id_col, "findings", "words", F.aggregate("findings", F.lit(0.0), lambda a, f: a + f["weight"]).alias("total_weight"))
    score = F.when(F.col("words") == 0, 0.0).otherwise(F.col("total_weight") / (F.col("words") / 1000))
    return shaped.withColumn("score", score).select(id_col, F.to_json(F.struct("findings", "words", "total_weight", "score", band_of(F.col("score"), engine.bands).alias("band"))).alias("report"))


def sentence_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n`` sentences of three words or more, and ``cv``, how their lengths vary (null where there is none); code and URLs count too."""

    def build(texts: list[str]) -> list[pa.Array]:
        rows = [exact.sentence_sums(t) for t in texts]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([exact.sentence_cv(*r) if r[0] else None for r in rows], pa.float64())]

    return over_texts(df, text_col, {"n": "long", "cv": "double"}, build)


def band_of(score: Column, bands: tuple[float, float]) -> Column:
    return F.when(score >= bands[1], "heavy").when(score >= bands[0], "seasoned").otherwise("clean")


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), band).cast("int") - 1


def rule_rollup(found: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Findings per rule (within groups): how many, with what weight."""
    return found.groupBy(*group_cols, "rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def gate(reported: DataFrame, level: str) -> DataFrame:
    """One row: the worst band, and whether it reaches ``level``."""
    worst = F.max(band_rank(F.col("band")))
    return reported.agg(F.element_at(F.array(*map(F.lit, BANDS)), worst + 1).alias("worst"), (worst >= BANDS.index(level)).alias("fails"))

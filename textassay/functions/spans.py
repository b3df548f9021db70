"""Intervals of one row, in time linear in their number."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exact

INTERVALS = "array<struct<start:int,end:int>>"


def _pairs(spans) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans]


def _named(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _per_row(kind: str, work: Callable, columns: tuple[Column, ...]) -> Column:
    """``work`` of each row's intervals and numbers; null intervals give null."""

    @F.pandas_udf(kind)
    def applied(spans: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else work(_pairs(s), *map(int, r)) for s, *r in zip(spans, *rest, strict=True)], dtype=object)

    return applied(*columns)


def merged(intervals: Column) -> Column:
    """Intervals in order, those that overlap or touch made one."""
    return _per_row(INTERVALS, lambda spans: _named(exact.merge(spans)), (intervals,))


def complement(mask: Column, length: Column) -> Column:
    """What disjoint sorted intervals leave of a length, in order."""
    return _per_row(INTERVALS, lambda spans, n: _named(exact.prose_spans(n, spans)), (mask, length))


def covers(mask: Column, point: Column) -> Column:
    """Whether a point lies in one of disjoint sorted intervals."""
    return _per_row("boolean", exact.covers, (mask, point))


def overlaps(mask: Column, start: Column, end: Column) -> Column:
    """Whether a half-open span overlaps one of disjoint sorted intervals."""
    return _per_row("boolean", exact.overlaps, (mask, start, end))

"""Tokens and features of style as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Unicode's alphanumerics; the apostrophe belongs to words.
WORD_GAP = r"[^\p{IsAlphabetic}\p{N}']+"
MARK = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}']"
LONGEST_WORD = 32


WORD = P.PY_SPACE.replace("[", "[^", 1) + "+"


def words(text: Column) -> Column:
    """Words in order, lower-cased; those of 32 bytes or more and empty ones are left out."""
    kept = F.filter(F.split(text, WORD_GAP), lambda w: (F.octet_length(w) > 0) & (F.octet_length(w) < LONGEST_WORD))
    return F.transform(kept, F.lower)


def word_features(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.concat(F.lit("w:"), w))


def pair_features(ws: Column) -> Column:
    """Adjacent words, across sentences and lines."""
    n = F.size(ws)
    return F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit(" "), b))


def mark_features(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), lambda c: F.concat(F.lit("p:"), c))


def line_kind(body: Column, n: Column) -> Column:
    """What a line looks like, by what follows its leading blanks and how many words that has: markup first, then length."""
    return (
        F.when(F.startswith(body, F.lit("```")), "fence")
        .when(F.startswith(body, F.lit("#")), "heading")
        .when(F.startswith(body, F.lit("- ")) | F.startswith(body, F.lit("* ")), "bullet")
        .when(F.startswith(body, F.lit("**")), "boldlead")
        .when(F.contains(body, F.lit(". ")) & F.regexp_like(body, F.lit("^[0-9]")), "numlist")
        .when(body == "", "blank")
        .when(n < 10, "line_short")
        .when(n < 25, "line_mid")
        .when(n < 50, "line_long")
        .otherwise("line_para")
    )


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one doesn't count."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def layout_features(text: Column) -> Column:
    # A carriage return at a line's end changes no kind.  Bodies and counts are made in passes of their own: within a lambda nothing is shared.
    bodies = F.transform(lines(text), lambda x: F.ltrim(x, F.lit(P.SPACES)))
    counted = F.transform(bodies, lambda x: F.struct(x.alias("body"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return F.transform(counted, lambda x: F.concat(F.lit("s:"), line_kind(x["body"], x["n"])))

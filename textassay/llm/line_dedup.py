"""Repeated runs of lines, found by winnowing over line hashes.

Every window of ``window`` lines gives its smallest line hash as a fingerprint, so
any run that long which stands at two places has a fingerprint in common.
Fingerprints are counted by the places that were selected; only windows whose
fingerprint stands at several places go on.  Those are joined to the first place
where they stand, and matches of a text with the same earlier text that go on line
by line are chained: so a match is extended both ways as far as it goes.  The
later places of a repeated run are deleted.  Runs of fewer lines are winnowed
likewise, each length by itself, if they have ``passage_words`` words in all.

Native columns only.  A line travels as two 64-bit hashes, and runs are the same if
both hashes of their lines agree.  Groups are reduced to their first place before
the join, which is salted: a run that a third of the corpus shares costs a row
for each place and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, salted_join, text_or_empty

WINDOW = 4
PASSAGE_WORDS = 50


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


def hashed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, sha, a, b, words`` for each distinct (id, text): two hashes and the words of every line, none in an empty one.

    ``sha``, half of the text's SHA-256, tells rows with one id apart.
    """
    text = text_or_empty(text_col)
    lines = text_lines(text)
    words = lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), short_digest(text).alias("sha"), lines.alias("lines"))
    hashed = rows.select("id", "sha", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit("b"), x)).alias("b"), F.transform("lines", words).alias("words"))
    return hashed.groupBy("id", "sha").agg(*[F.first(c).alias(c) for c in ("a", "b", "words")])


def short_digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def run_windows(size: int, least: int | None) -> Column:
    """``start, size, at, fp`` of all runs of ``size`` lines (that have ``least`` words): ``at`` is the smallest hash's place, of equal ones the last."""
    line = lambda i, k: F.get("a", i + k)
    last = F.size("a") - size
    total = lambda i: sum((F.get("words", i + k) for k in range(1, size)), F.get("words", i))

    def window(i: Column) -> Column:
        low = F.least(*[line(i, k) for k in range(size)]) if size > 1 else line(i, 0)
        at = i
        for k in range(1, size):
            at = F.when(line(i, k) == low, i + k).otherwise(at)
        return F.struct(i.alias("start"), F.lit(size).alias("size"), at.alias("at"), low.alias("fp"))

    starts = F.sequence(F.lit(0), last)
    if least is not None:
        starts = F.filter(starts, lambda i: total(i) >= least)
    return F.when(last >= 0, F.transform(starts, window)).otherwise(F.array().cast("array<struct<start:int,size:int,at:int,fp:bigint>>"))


def shared_runs(lines: DataFrame, window: int, passage_words: int | None) -> DataFrame:
    """``id, sha, start, size, x, y``: runs whose fingerprint stands at several places, with the two hashes of their lines."""
    sizes = [(window, None), *((size, passage_words) for size in range(1, window) if passage_words is not None)]
    found = lines.select("id", "sha", "a", "b", F.concat(*[run_windows(*s) for s in sizes]).alias("runs"))
    # A place is selected once, however many windows in a row select it.
    selected = F.filter("runs", lambda r, i: (i == 0) | (F.get("runs", i - 1)["at"] != r["at"]) | (F.get("runs", i - 1)["size"] != r["size"]))
    spots = found.select(F.explode(F.transform(selected, lambda r: F.struct(r["size"], r["fp"]))).alias("s")).select("s.*")
    common = materialise(spots.groupBy("size", "fp").agg(F.count(F.lit(1)).alias("places")).filter("places > 1"), "fingerprints")
    hashes = lambda of, r: F.xxhash64(F.slice(of, r["start"] + 1, r["size"]))
    runs = found.select("id", "sha", F.explode(F.transform("runs", lambda r: F.struct(r["start"], r["size"], r["fp"], hashes(F.col("a"), r).alias("x"), hashes(F.col("b"), r).alias("y")))).alias("r")).select("id", "sha", "r.*")
    # A selected place has up to ``window`` runs.
    return salted_join(runs, common, ["size", "fp"], "places", ["x", "id"]).drop("fp")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """Maximal matches of later places with the first place of the runs they are made of.

    Returns ``id, sha, start, lines, first_id, first_sha, first_start``; a text is
    known by its id and half of its SHA-256, lines count from 0.  Matches with the
    same earlier text at the same distance that touch or overlap are one.
    """
    lines = materialise(hashed_lines(docs, id_col, text_col), "lines")
    runs = materialise(shared_runs(lines, window, passage_words), "runs")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "sha", "start")
    first = runs.groupBy("size", "x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = salted_join(runs, materialise(first, "first-places"), ["size", "x", "y"], "n", ["id", "sha", "start"]).filter(place != F.col("first"))
    matches = joined.select("id", "sha", "start", "size", F.col("first.id").alias("first_id"), F.col("first.sha").alias("first_sha"), (F.col("start") - F.col("first.start")).alias("apart"))
    own = Window.partitionBy("id", "sha", "first_id", "first_sha", "apart").orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    chained = matches.repartition("id", "sha").withColumn("fresh", F.when(F.col("start") <= reached, 0).otherwise(1)).withColumn("chain", F.sum("fresh").over(own))
    grown = chained.groupBy("id", "sha", "first_id", "first_sha", "apart", "chain").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    return grown.select("id", "sha", "start", (F.col("end") - F.col("start")).alias("lines"), "first_id", "first_sha", (F.col("start") - F.col("apart")).alias("first_start"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """Each document without the lines of runs that stand earlier in the corpus.

    Returns ``doc_id, text, n_lines, n_deleted``, one row per row of ``docs``.  A
    line goes if it is in a run of ``window`` lines, or in a shorter one that has
    ``passage_words`` words in all (None: no shorter ones), that also stands at an
    earlier place: in a row with a smaller id (null ids come last; of equal ids,
    the smaller SHA-256 of the text is earlier) or further up in the same text.
    Rows alike in id and text count as one document and come out alike.  A null
    text counts as one empty line and stays null.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    # Lines are split below the join, so that what picks from them doesn't split again.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).isNull().alias("none"), text_lines(text).alias("lines"), short_digest(text).alias("own"))
    gone = repeated_runs(docs, id_col, text_col, window, passage_words).groupBy("id", "sha").agg(F.collect_set(F.struct("start", "lines")).alias("runs"))
    deleted = gone.select("id", "sha", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1)))).alias("deleted"))
    joined = rows.join(deleted, (F.col("own") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("deleted", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select("doc_id", F.when(~F.col("none"), kept).alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"))

"""Corpora for comparisons: samples, pairs, replication, single rows, stamps."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mining import UNMATCHED, Catalog


def hash_sample(df: DataFrame, rows: int, group_col: str, key: Column, seed: str = "7") -> DataFrame:
    """At most ``rows`` of each group, those that come first by a keyed hash; the same for any partitioning."""
    order = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))
    own = Window.partitionBy(group_col).orderBy(order, key)
    return df.withColumn("__rank", F.row_number().over(own)).filter(F.col("__rank") <= rows).drop("__rank")


def with_rejection(groups: list[DataFrame], rejection: DataFrame | None, family_col: str = "family") -> DataFrame:
    """The groups one after another, and the rejection rows under their class."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    if rejection is not None:
        out = out.unionByName(rejection.withColumn(family_col, F.lit(UNMATCHED)).select(out.columns))
    return out


def era_corpora(df: DataFrame, rejection: DataFrame, families: dict[str, str], vendors: list[str], rows: int = 280, family_col: str = "family", key: str = "doc_id") -> dict[str, DataFrame]:
    """Matched corpora of one era: the catalog, the vendors, and every pair of vendors (without rejection rows)."""
    sample = hash_sample(df, rows, family_col, F.col(key), "11")
    of = lambda name: sample.filter(F.col(family_col) == families[name])
    spare = hash_sample(rejection.withColumn("__all", F.lit(1)), rows, "__all", F.col(key)).drop("__all")
    out = {"catalog": with_rejection([of(n) for n in families], spare, family_col), "vendors": with_rejection([of(n) for n in vendors], spare, family_col)}
    return out | {f"pair-{a}-{b}": with_rejection([of(a), of(b)], None, family_col) for a, b in combinations(vendors, 2)}


#: Names of which all pairs are made.
MOST_NAMES = 1000


def vendor_pairs(families: DataFrame, col: str = "family") -> DataFrame:
    """All pairs of a small set of names, each once; a larger one is refused."""
    names = [r[0] for r in families.select(col).distinct().orderBy(col).limit(MOST_NAMES + 1).collect() if r[0] is not None]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: all pairs are for small sets")
    return families.sparkSession.createDataFrame(list(combinations(names, 2)), "a string, b string")


def replication(ours: DataFrame, theirs: DataFrame, key_col: str = "prompt_id", n_col: str = "n_words") -> DataFrame:
    """Medians of both sides over the prompts that both have, and their ratio."""
    both = ours.select(key_col, F.col(n_col).alias("a")).join(theirs.select(key_col, F.col(n_col).alias("b")), key_col)
    return both.agg(F.count(F.lit(1)).alias("matched"), F.median("a").alias("ours"), F.median("b").alias("theirs"), (F.median("b") / F.median("a")).alias("ratio"))


def atlas_row(catalog: Catalog, feature: str) -> DataFrame:
    """One feature's rates by family, highest first."""
    return catalog.weights.filter(F.col("feature") == feature).select("feature", "family", "rate").orderBy(F.col("rate").desc(), "family")


def atlas_json(catalog: Catalog, feature: str) -> DataFrame:
    """The same as one JSON value: ``{"feature", "rows": [[family, rate], ...]}``."""
    rows = atlas_row(catalog, feature).agg(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("o"), "family", "rate"))).alias("r"))
    parts = F.transform("r", lambda x: F.concat(F.lit("["), F.to_json(F.array(x["family"])).substr(F.lit(2), F.char_length(F.to_json(F.array(x["family"]))) - 2), F.lit(", "), x["rate"].cast("string"), F.lit("]")))
    return rows.select(F.concat(F.lit(f'{{"feature": "{feature}", "rows": ['), F.array_join(parts, ", "), F.lit("]}")).alias("atlas"))


def stamp(content: Column) -> Column:
    """Eight hex digits that stand for a content."""
    return F.substring(F.sha2(content, 256), 1, 8)


def stamped(page: Column, attribute: str, asset: str, content: Column) -> Column:
    """A page whose references to an asset carry the content's stamp."""
    plain = asset.replace(".", r"\.")
    return F.regexp_replace(page, F.lit(rf'{attribute}="/{plain}(?:\?v=[0-9a-f]+)?"'), F.concat(F.lit(f'{attribute}="/{asset}?v='), stamp(content), F.lit('"')))

"""Sinks: reports, rewritten texts, catalogs, samples, single JSON values."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textassay.operators.lint import BANDS
from textassay.operators.mining import Catalog

#: Features up to which a catalog is written as one TOML text on the driver.
TOML_FEATURES = 200_000


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines; mode append adds to what is there."""
    df.write.mode(mode).json(path)


def append_samples(df: DataFrame, path: str) -> None:
    write_json(df, path, "append")


def write_fixed(df: DataFrame, path: str) -> None:
    """Rewritten texts to a new place; a source that is being read is never overwritten."""
    df.write.parquet(path)


def write_groups(df: DataFrame, path: str, group_col: str) -> None:
    """A corpus in one folder per group."""
    df.write.partitionBy(group_col).json(path)


def write_catalog(catalog: Catalog, path: str) -> None:
    for name in ("features", "weights", "families"):
        getattr(catalog, name).write.parquet(f"{path}/{name}")


def catalog_toml(catalog: Catalog, source: str = "") -> str:
    """The catalog as TOML; refused where it would not fit the driver."""
    if catalog.features.limit(TOML_FEATURES + 1).count() > TOML_FEATURES:
        raise ValueError(f"more than {TOML_FEATURES} features; write parquet")
    quote = lambda x: json.dumps(x, ensure_ascii=False)
    numbers = lambda xs: "[" + ", ".join(f"{x:.9g}" if x != int(x) else f"{x:.1f}" for x in xs) + "]"
    families = catalog.families.orderBy("family").collect()
    out = [f"source = {quote(source)}", f"families = [{', '.join(quote(r.family) for r in families)}]", f"samples = [{', '.join(str(r.samples) for r in families)}]", f"bias = {numbers([r.bias for r in families])}"]
    by_family = F.array_sort(F.collect_list(F.struct("family", "rate", "w")))
    rows = catalog.weights.groupBy("feature").agg(by_family.alias("x")).join(catalog.features, "feature").orderBy("feature")
    for r in rows.toLocalIterator():
        out += ["", f"[features.{quote(r.feature)}]", f"idf = {numbers([r.idf])[1:-1]}", f"base = {numbers([r.base])[1:-1]}", f"rate = {numbers([x.rate for x in r.x])}", f"w = {numbers([x.w for x in r.x])}"]
    return "\n".join(out) + "\n"


def report_lines(findings: list, words: int, score: float, band: str, name: str = "-") -> list[str]:
    """A report for people: every finding with its evidence, and a summary."""
    out = [f"{name}:{f['start']}-{f['end']}  {f['rule_id']} {f['rule_name']}{' (fixable)' if f['fixable'] else ''}\n    {f['excerpt']!r}: {f['rationale']}" for f in findings]
    return [*out, f"{len(findings)} findings in {words} words, density {score:.2f} per 1000, {band}"]


def attribution_lines(row) -> list[str]:
    """An attribution for people: the call or the closest two, the evidence, the closed set."""
    out = []
    if row["call"] is not None:
        out.append(f"{row['call']}  confidence {row['confidence']:.2f}, {row['matched']} features matched")
        out += [f"  +{r['contribution']:.3f}  {r['feature']}  {r['rate']:.2f} per 1000 against {r['baseline']:.2f}" for r in row["receipts"]]
    else:
        near = ", ".join(f"{c['family']} {c['probability']:.2f}" for c in row["ranked"][:2])
        out.append(f"no call: confidence {row['confidence']:.2f}, {row['matched']} features matched; closest {near}")
    return [*out, "out of: " + ", ".join(row["catalog"])]


def exit_code(band: str, fail_on: str | None) -> int:
    return int(fail_on is not None and BANDS.index(band) >= BANDS.index(fail_on))

"""Command line: lint, fix, mine, who, eval, harvest."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from datetime import UTC, datetime
from pathlib import Path

from textassay.functions import exact
from textassay.sources.packs import Engine, base_pack, parse_pack


def engine_of(paths: list[str]) -> Engine:
    return Engine.compile([base_pack(), *(parse_pack(Path(p).read_text(encoding="utf-8")) for p in paths)])


def text_of(path: str | None) -> str:
    return Path(path).read_text(encoding="utf-8") if path else sys.stdin.read()


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("textassay").getOrCreate()


def lint(a: argparse.Namespace) -> int:
    from textassay.sources.writers import exit_code, report_lines

    findings, words, total, score, band = exact.lint_text(text_of(a.file), engine_of(a.pack))
    if a.json:
        print(json.dumps({"findings": findings, "words": words, "total_weight": total, "score": score, "band": band}, indent=2, ensure_ascii=False))
    else:
        print("\n".join(report_lines(findings, words, score, band, a.file or "-")))
    return exit_code(band, a.fail_on)


def fix(a: argparse.Namespace) -> int:
    if a.write and not a.file:
        raise ValueError("--write needs a file")
    fixed = exact.fix_text(text_of(a.file), engine_of(a.pack))
    if a.write:
        Path(a.file).write_text(fixed, encoding="utf-8")
    else:
        sys.stdout.write(fixed)
    return 0


def mine(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from textassay.operators.training import fit
    from textassay.sources.readers import read_corpus
    from textassay.sources.writers import catalog_toml, write_catalog

    rows = read_corpus(session(), a.corpus).withColumn("doc_id", F.monotonically_increasing_id())
    catalog = fit(rows, a.top_k, a.epochs, trainer=a.trainer)
    if a.output.endswith(".toml"):
        Path(a.output).write_text(catalog_toml(catalog, a.corpus), encoding="utf-8")
    else:
        write_catalog(catalog, a.output)
    return 0


def who(a: argparse.Namespace) -> int:
    from textassay.operators.attribution import who as attribute
    from textassay.sources.readers import parse_catalog, read_catalog
    from textassay.sources.writers import attribution_lines

    spark = session()
    catalog = parse_catalog(spark, Path(a.catalog).read_text(encoding="utf-8")) if a.catalog.endswith(".toml") else read_catalog(spark, a.catalog)
    row = attribute(spark.createDataFrame([(0, text_of(a.file))], "doc_id long, text string"), catalog, min_confidence=a.margin, min_matched=a.min_matched).first().asDict(recursive=True)
    print(json.dumps({k: v for k, v in row.items() if k != "doc_id"}, indent=2, ensure_ascii=False) if a.json else "\n".join(attribution_lines(row)))
    return 0


def evaluate(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from textassay.operators.evaluation import evaluate as run
    from textassay.sources.readers import read_corpus

    spark = session()
    keyed = lambda path: read_corpus(spark, path).withColumn("doc_id", F.monotonically_increasing_id())
    found = run(keyed(a.corpus), a.top_k, a.epochs, a.floor, a.holdout, keyed(a.negatives) if a.negatives else None, a.truncate, trainer=a.trainer)
    for name, df in found.items():
        print(name)
        df.show(100, truncate=False)
    return 0


def harvest(a: argparse.Namespace) -> int:
    from textassay.operators import harvest as H
    from textassay.sources.chat import chat_transport
    from textassay.sources.readers import read_prompts, read_samples

    spark = session()
    data = tomllib.loads(Path(a.config).read_text(encoding="utf-8"))
    config = H.Config(**{k: v for k, v in data.items() if k != "models"}, models=tuple(H.Model(**m) for m in data["models"]))
    models = spark.createDataFrame([(k, m.family, m.target) for k, m in enumerate(config.models)], "model_idx int, family string, target int")
    done = H.done_pairs(read_samples(spark, a.corpus)) if Path(a.corpus).exists() else spark.createDataFrame([], "family string, prompt_id string")
    prompts = read_prompts(spark, a.prompts)
    if a.dry_run:
        for r in H.round_robin(H.pending(prompts, models, done), config.per_run).collect():
            print(f"would ask {config.models[r.model_idx].model} for {r.prompt_id}")
        return 0
    queues: list[list[tuple[str, str]]] = [[] for _ in config.models]
    owed = H.pending(prompts, models, done)
    for r in owed.join(prompts.select("prompt_id", "prompt"), "prompt_id").filter(f"turn <= {config.per_run + config.strikes}").orderBy("model_idx", "turn").collect():
        queues[r.model_idx].append((r.prompt_id, r.prompt))
    with open(a.corpus, "a", encoding="utf-8") as corpus:

        def append(line: str) -> None:
            corpus.write(line + "\n")
            corpus.flush()

        got = H.harvest(config, queues, chat_transport(config), append, a.at or datetime.now(UTC).isoformat(timespec="seconds"))
    for family, n in got.items():
        print(f"{family}: {n} samples")
    return 0


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="textassay")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for names, how in options:
            p.add_argument(*names, **how)

    file = (("file",), {"nargs": "?"})
    pack = (("--pack",), {"action": "append", "default": []})
    flag = lambda n: ((n,), {"action": "store_true"})
    number = lambda n, kind, value: ((n,), {"type": kind, "default": value})
    trainer = (("--trainer",), {"choices": ["lbfgs", "replay"], "default": "lbfgs"})
    command("lint", lint, file, pack, flag("--json"), (("--fail-on",), {"choices": ["seasoned", "heavy"]}))
    command("fix", fix, file, pack, flag("--write"))
    command("mine", mine, (("corpus",), {}), (("-o", "--output"), {"required": True}), number("--top-k", int, 2000), number("--epochs", int, 12), trainer)
    command("who", who, file, (("-c", "--catalog"), {"required": True}), number("--margin", float, 0.30), number("--min-matched", int, 40), flag("--json"))
    command("eval", evaluate, (("corpus",), {}), number("--top-k", int, 2000), number("--epochs", int, 12), number("--floor", float, 0.95), number("--holdout", int, 20), (("--negatives",), {}), number("--truncate", int, 0), trainer)
    command("harvest", harvest, (("config",), {}), (("--prompts",), {"required": True}), (("--corpus",), {"required": True}), (("--at",), {}), flag("--dry-run"))
    a = top.parse_args(args)
    try:
        return a.run(a)
    except (OSError, ValueError, KeyError) as error:
        print(f"textassay: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

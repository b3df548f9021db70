"""Rule packs: TOML in, a compiled engine out (driver side, small by design)."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rules beyond this number are refused: they travel inside every plan.
MOST_RULES = 5000
KINDS = ("word", "phrase", "regex")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    kind: str
    patterns: tuple[str, ...] = ()
    pattern: str | None = None
    weight: float = 1.0
    rationale: str = ""
    swaps: dict[str, str] = field(default_factory=dict)
    replace: str | None = None
    unless_preceded_by: tuple[str, ...] = ()

    @property
    def fixable(self) -> bool:
        return bool(self.swaps) or self.replace is not None


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    rules: tuple[Rule, ...] = ()
    bands: tuple[float, float] | None = None  # from where on a density is seasoned, heavy


def parse_pack(toml: str) -> Pack:
    """A pack from TOML; meta's name and version are required, unknown keys are passed over."""
    data = tomllib.loads(toml)
    meta = data["meta"]
    bands = data.get("bands")
    rules = []
    for r in data.get("rules", []):
        if r["kind"] not in KINDS:
            raise ValueError(f"rule {r['id']}: unknown kind {r['kind']}")
        rules.append(Rule(r["id"], r["name"], r["kind"], tuple(r.get("patterns", ())), r.get("pattern"), float(r.get("weight", 1.0)), r.get("rationale", ""), dict(sorted(r.get("swaps", {}).items())), r.get("replace"), tuple(r.get("unless_preceded_by", ()))))
    return Pack(meta["name"], str(meta["version"]), tuple(rules), (float(bands["seasoned"]), float(bands["heavy"])) if bands is not None else None)


PACK_FILE = Path(__file__).parent / "base_pack.toml"


def base_pack() -> Pack:
    return parse_pack(PACK_FILE.read_text(encoding="utf-8"))


def merge_rules(packs: list[Pack]) -> list[Rule]:
    """Later rules take the place of earlier ones with their id; new ids come at the end."""
    merged: dict[str, Rule] = {}
    for pack in packs:
        for rule in pack.rules:
            merged[rule.id] = rule
    return list(merged.values())


@dataclass(frozen=True)
class Engine:
    """Compiled rules.

    ``literals``: lower-case form to the rule it stands for (of rules that share a
    form the earlier one).  ``swaps``: form to replacement and rule (the later
    one).  ``fixes``: patterns with replacements, in rule order.
    """

    rules: tuple[Rule, ...]
    bands: tuple[float, float]
    literals: dict[str, int]
    regexes: tuple[tuple[int, str], ...]
    fixes: tuple[tuple[str, str], ...]
    swaps: dict[str, tuple[str, int]]

    @classmethod
    def compile(cls, packs: list[Pack] | None = None) -> Engine:
        packs = [base_pack()] if packs is None else packs
        rules = merge_rules(packs)
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} travel with a plan")
        bands = next((p.bands for p in reversed(packs) if p.bands), (2.0, 6.0))
        literals: dict[str, int] = {}
        swaps: dict[str, tuple[str, int]] = {}
        regexes, fixes = [], []
        for k, rule in enumerate(rules):
            if rule.kind == "regex":
                if rule.pattern is None:
                    raise ValueError(f"rule {rule.id}: regex kind needs a pattern")
                regexes.append((k, rule.pattern))
                if rule.replace is not None:
                    fixes.append((rule.pattern, rule.replace))
                continue
            forms = [*rule.swaps, *rule.patterns] if rule.kind == "word" else list(rule.patterns)
            for form in forms:
                literals.setdefault(form.lower(), k)
            if rule.kind == "word":
                for form, new in rule.swaps.items():
                    swaps[form.lower()] = (new, k)
            elif rule.replace is not None and rule.patterns:
                fixes.append((r"(?i)\b(?:" + "|".join(map(escape, rule.patterns)) + r")\b", rule.replace))
        return cls(tuple(rules), bands, literals, tuple(regexes), tuple(fixes), swaps)

    def fixable_ids(self) -> list[str]:
        return [r.id for r in self.rules if r.fixable]


def escape(form: str) -> str:
    """A literal for Python and RE2 alike."""
    return re.sub(r"([^\w\s\x80-\U0010ffff-])", r"\\\1", form)


def literal_regex(forms: list[str], ascii_case: bool = True) -> str:
    """An alternation in which the leftmost longest literal wins, shaped as a trie so that few branches are tried at a position."""
    tree: dict = {}
    for form in forms:
        node = tree
        for c in form:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        end = "" in node
        branches = []
        for c, below in sorted((c, b) for c, b in node.items() if c):
            branches.append(escape(c) + write(below))
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and not end else "(?:" + "|".join(branches) + ")"
        return body + "?" if end else body  # greedy: the longer form first

    return ("(?i)" if ascii_case else "") + write(tree)


def rules_frame(spark: SparkSession, packs: list[Pack]) -> DataFrame:
    """All rules of all packs with their places, before the merge."""
    rows = [(p, i, r.id, r.name, r.kind, list(r.patterns), r.pattern, r.weight, r.rationale, dict(r.swaps), r.replace, list(r.unless_preceded_by)) for p, pack in enumerate(packs) for i, r in enumerate(pack.rules)]
    return spark.createDataFrame(rows, "pack_idx int, rule_idx int, id string, name string, kind string, patterns array<string>, pattern string, weight double, rationale string, swaps map<string,string>, replace string, unless_preceded_by array<string>")


_extra: list[Pack] = []
_engine: list[Engine] = []


def set_pack(toml: str) -> None:
    """Add one pack to the base pack for the process; once, before the engine is first used."""
    if _extra or _engine:
        raise RuntimeError("a pack is set once, before the engine is first used")
    _extra.append(parse_pack(toml))


def default_engine() -> Engine:
    if not _engine:
        _engine.append(Engine.compile([base_pack(), *_extra]))
    return _engine[0]

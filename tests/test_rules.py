"""Packs, masks, linting and rewriting: golden cases, traps, and both paths alike."""

import json
import random
import re
import time

import pytest

from textassay.functions import exact
from textassay.functions import patterns as P
from textassay.operators import fix as fixing
from textassay.operators import lint
from textassay.sources import packs
from textassay.sources.packs import Engine, Pack, Rule, base_pack

ENGINE = Engine.compile([base_pack()])

FIXED = [
    ("I build software — and I ship it.", "I build software, and I ship it."),
    ("fast—reliable code", "fast, reliable code"),
    ("2020–2024", "2020 to 2024"),
    ("2007—2024", "2007 to 2024"),
    ("worked there 2020 – 2024 doing data", "worked there 2020 to 2024 doing data"),
    ("Data Manager | March 2021 – March 2026", "Data Manager | March 2021 to March 2026"),
    ("Engineer | June 2026 – Present", "Engineer | June 2026 to Present"),
    ("60 – 90 days", "60 to 90 days"),
    ("1–2–3", "1 to 2–3"),
    ("Architected a resilient framework", "Built a resilient framework"),
    ("leveraging Python to showcase results", "using Python to show results"),
    ("This underscores the meticulous work", "This highlights the careful work"),
    ("UTILIZE IT", "USE IT"),
    ("a robust, comprehensive architecture that is scalable", "a robust, comprehensive architecture that is scalable"),
    ("the role of caching", "the role of caching"),
    ("the eval harness runs nightly", "the eval harness runs nightly"),
    ("a test harness for the parser", "a test harness for the parser"),
    ("the wiring harness", "the wiring harness"),
    ("we harness Python daily", "we use Python daily"),
    ("They harnessed the data", "They used the data"),
    ("That being said, the system worked.", "The system worked."),
    ("It's worth noting that we shipped it.", "We shipped it."),
    ("This shed light on the issue.", "This shows the issue."),
    ("navigating the complex landscape of hiring", "work through hiring"),
    ("I fixed the timeout bug by chunking the API calls. It worked.", "I fixed the timeout bug by chunking the API calls. It worked."),
    ("", ""),
    ("call `leverage()` to leverage it", "call `leverage()` to use it"),
    ("We delve.\n```\ndelve — leverage\n```\nWe delve.", "We look.\n```\ndelve — leverage\n```\nWe look."),
    ("- a\n    - nested delve item\n", "- a\n    - nested look item\n"),
    ("a hard break  \nnext line", "a hard break  \nnext line"),
    ("collapsed  here", "collapsed here"),
    ("“fine” work, it’s good", "\"fine\" work, it's good"),
    ("It showcases a myriad of possibilities, a testament to synergy.", "It shows many possibilities, a sign of synergy."),
    ("Myriads of tools", "Many tools"),
    ("a myriad landscape", "a many landscape"),
    ('<a href="/x" class="leverage">We leverage it.</a>', '<a href="/x" class="leverage">We use it.</a>'),
    ("e.g. foo", "e.g. Foo"),
    ("delve2 édelve _spearheaded_", "look2 élook _spearheaded_"),
]

IDS = [
    ("We delve into a rich tapestry — a testament to synergy.", {"T013", "T033", "T001", "P043", "T036"}),
    ("redeep dive into", set()),
    ("_delve_ édelve delve2", {"T013"}),
    ("abc1 harness, thé harness", {"T016"}),
    ("Intro line.\n- Built the a\n- Built the b\n- Built c\n- Built d\n- Built e", {"S001"}),
    ("<p>We delve into the tapestry.</p>", {"T013", "T033"}),
    ('<div class="delve"><script>var leverage;</script><style>.robust{}</style><code>delve</code></div>', set()),
    ("see https://example.com/delve now", set()),
    ("red, green, and blue. one, two, and three. sun, moon, and stars.", {"S003"}),
    ("One two three four. " * 8, {"S002"}),
    ("```\ndelve", set()),
    ("ſhed light on", set()),
    ("", set()),
]


def test_golden_rewriting_by_both_paths(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in FIXED)), "doc_id long, text string")
    native = {r.doc_id: r.fixed for r in fixing.fix(df, ENGINE).collect()}
    for k, (before, after) in enumerate(FIXED):
        assert exact.fix_text(before, ENGINE) == after
        assert native[k] == after


def test_golden_findings_by_both_paths(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in IDS)), "doc_id long, text string")
    native = {}
    for r in lint.findings(df, ENGINE).collect():
        native.setdefault(r.doc_id, []).append((r.rule_id, r.start, r.end, r.excerpt))
    for k, (text, ids) in enumerate(IDS):
        found = exact.lint_text(text, ENGINE)[0]
        assert {f["rule_id"] for f in found} - {"T006"} == ids, text
        assert all(f["rationale"] for f in found)
        assert native.get(k, []) == [(f["rule_id"], f["start"], f["end"], f["excerpt"]) for f in found]
    assert exact.lint_text(IDS[0][0], ENGINE)[4] == "heavy"


WORDS = ["delve", "Leverage", "a testament to", "harness", "the", "—", " – ", "1–2", ";", "“x”", "`code`", "```", "\n", "\n- Built it", "\n1. Built", "<b>", "</b>", "http://a.b/delve ", "a, b, and c. ", "  ", "é", ". it", "in today's fast paced world, ", "that being said, ", "K", "ſ", " ", "robust"]


def test_paths_agree_on_random_texts(spark):
    rng = random.Random(6)
    texts = [rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.n_findings, r.words, round(r.total_weight, 6), r.band) for r in rows)
    want = [(k, len(r[0]), r[1], round(r[2], 6), r[4]) for k, r in enumerate(exact.lint_text(t or "", ENGINE) for t in [*texts, None])]
    assert key(lint.reports(df, ENGINE).collect()) == want
    for r in lint.json_reports(df, ENGINE).collect():
        findings, words, _, _, band = exact.lint_text([*texts, None][r.doc_id] or "", ENGINE)
        said = json.loads(r.report)
        assert said["findings"] == findings and (said["words"], said["band"]) == (words, band)
    fixed = {r.doc_id: r.fixed for r in fixing.fix(df, ENGINE).collect()}
    assert fixed == {k: None if t is None else exact.fix_text(t, ENGINE) for k, t in enumerate([*texts, None])}


def test_masks_tile_the_text():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(WORDS) for _ in range(20))
        mask = exact.mask_spans(text)
        pieces = sorted(mask + exact.prose_spans(len(text), mask))
        assert "".join(text[a:b] for a, b in pieces) == text
        kept = [text[a:b] for a, b in mask]
        assert all(piece in exact.fix_text(text, ENGINE) for piece in kept)


def test_required_literals_are_in_every_match():
    rng = random.Random(1)
    for _, pattern in ENGINE.regexes:
        literals, folded = P.required_literals(pattern)
        assert literals
        for _ in range(200):
            text = "".join(rng.choice(["it's worth noting that ", "not just x, but ", "real work", ";", "—", "Paid  Results", "“", "at its core, "]) for _ in range(3))
            if exact.compiled(pattern).search(text):
                assert any(x in (text.lower() if folded else text) for x in literals)


def test_rewriting_is_monotone():
    text = "We leverage a myriad of tools — a testament to synergy. It is important to note that we delve."
    for t in (text, text.upper(), "I fixed it."):
        fixed = exact.fix_text(t, ENGINE)
        after = exact.lint_text(fixed, ENGINE)
        assert after[2] <= exact.lint_text(t, ENGINE)[2] and not any(f["fixable"] for f in after[0])


def test_base_pack():
    rules = base_pack().rules
    assert len(rules) == 89 and len({r.id for r in rules}) == 89 and len(ENGINE.fixable_ids()) == 37
    assert [sum(r.kind == k for r in rules) for k in packs.KINDS] == [44, 28, 17]
    assert all(r.rationale and (r.pattern if r.kind == "regex" else r.patterns or r.swaps) for r in rules)


def test_later_packs_override_in_place():
    extra = Pack("own", "1", (Rule("T013", "again", "word", patterns=("delve",), weight=9.0), Rule("G001", "roles", "word", swaps={"roles": "jobs"}), Rule("G002", "semicolon", "regex", pattern="; ([a-z])", replace=". $1"), Rule("G003", "colon", "regex", pattern="(?<=[a-z]): ([a-z])", replace=". $1")), bands=(1.0, 2.0))
    engine = Engine.compile([base_pack(), extra])
    assert [r.id for r in engine.rules][:9] == [r.id for r in base_pack().rules][:9] and engine.rules[-1].id == "G003"
    assert engine.bands == (1.0, 2.0) and exact.lint_text("we delve", engine)[2] == 9.0
    for before, after in [("Target Roles and Python roles", "Target Jobs and Python jobs"), ("I ship fast; the code is tested.", "I ship fast. The code is tested."), ("I trust them: they cite sources.", "I trust them. They cite sources."), ("meet at 12:30 today", "meet at 12:30 today")]:
        assert exact.fix_text(before, engine) == after
    with pytest.raises(ValueError):
        Engine.compile([Pack("bad", "1", (Rule("R", "r", "regex"),))])
    with pytest.raises(KeyError):
        packs.parse_pack("[meta]\nname = 'x'\n")


def slow_mask(text):
    """The masks by plain patterns and a list of all that is taken, point by point."""
    taken = [False] * len(text)
    fence, at, found = None, 0, []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if line.lstrip(P.SPACES).startswith("```"):
            if fence is None:
                fence = at
            else:
                found.append((fence, at + len(line)))
                fence = None
        at += len(line)
    if fence is not None:
        found.append((fence, len(text)))
    for pattern in (None, P.HTML_BLOCK, P.HTML_TAG, P.INLINE_CODE, P.URL):
        more = found if pattern is None else [m.span() for m in re.finditer(pattern, text) if not taken[m.start()]]
        for a, b in more:
            taken[a:b] = [True] * (b - a)
    return taken


MARKUP = ["<script>", "</script>", "<Style a>", "</style >", "<svg", "</svg>", "<code>", "</code>", "<!--", "-->", "<b>", "<", ">", "`", "```", "\n", "\n```\n", "https://a.b/c", "x", " ", ")", "é"]


def test_masks_equal_plain_patterns():
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choice(MARKUP) for _ in range(rng.randint(0, 18)))
        got = [False] * len(text)
        for a, b in exact.mask_spans(text):
            got[a:b] = [True] * (b - a)
        assert got == slow_mask(text), text


def test_literals_equal_the_pattern():
    rng = random.Random(13)
    forms = list(ENGINE.literals)
    pattern = re.compile("(?a)" + packs.literal_regex(forms))
    for _ in range(2000):
        text = rng.choice(["", " ", "-"]).join(rng.choice([*rng.sample(forms, 3), "a", "in", "the", "É", "ſ", "K", "\n"]) for _ in range(8))
        text = "".join(c.upper() if rng.random() < 0.2 and c.isascii() else c for c in text)
        assert exact.literal_spans(text, ENGINE) == [m.span() for m in pattern.finditer(text)], text


LONG = ["<b>x</b>", "<script>", "<code", "`a` ", "```\n", "we delve into a testament to ", "it's worth noting that we ", "- built a thing\n", "red, green, and blue. ", "a — b – c ", "   ", "\n", "....", "é harness ", "1–2 ", ", , ", "https://a.b/c ", "In today's fast-paced world, ", "not just x, but y. "]


@pytest.mark.parametrize("piece", LONG)
def test_time_is_linear_in_the_text(piece):
    took = []
    for size in (200_000, 400_000):
        text = piece * (size // len(piece))
        best = 9e9
        for _ in range(4):
            began = time.perf_counter()
            exact.lint_text(text, ENGINE)
            exact.fix_text(text, ENGINE)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] <= 2.5 * took[0] + 0.2 and took[0] < 3, took


def test_a_pack_is_set_once():
    toml = "[meta]\nname = 'x'\nversion = '1'\n[[rules]]\nid = 'Z1'\nname = 'zed'\nkind = 'word'\npatterns = ['zed']\nrationale = 'test'\n"
    old = packs._extra[:], packs._engine[:]
    packs._extra.clear(), packs._engine.clear()
    try:
        packs.set_pack(toml)
        assert packs.default_engine().rules[-1].id == "Z1"
        with pytest.raises(RuntimeError):
            packs.set_pack(toml)
    finally:
        packs._extra[:], packs._engine[:] = old

"""Tokens of patterns, and hundreds of rules from a file."""

import json
import random
import re

import pytest
from test_text_ops import rows_of

from textassay.llm import url_filter
from textassay.llm.rule_tokens import literal_tokens


@pytest.mark.parametrize(
    "pattern, tokens",
    [
        (r"://(www[.])?casino[.]", ("casino",)),
        (r"casino[.]", ()),
        (r"[./]casino", ()),
        (r"[./]ab-cd9[/?]", ("ab", "cd9")),
        (r"\bads?[.]", ()),
        (r"\bad\b", ("ad",)),
        (r"/(?:x|y)/track(?:ing)?/", ()),
        (r"/track(?:/ing)?/", ("track",)),
        (r"/(out)/[a-z]+/go/", ("out", "go")),
        (r"^foo$", ("foo",)),
        (r"(?i)/foo/", ()),
        (r"/a.*-b\.", ("b",)),
        (r"/a[^a-z0-9]b/", ("a", "b")),
        (r"/a[^a-z]b/", ()),
        (r"(", ()),
    ],
)
def test_tokens_of_patterns(pattern, tokens):
    assert literal_tokens(pattern) == tokens


def test_tokens_stand_in_every_match():
    rng = random.Random(6)
    parts = ["a", "b1", "[.]", "[/-]", "-", "(x)?", "(?:-y)?", "z+", "[0-9]*", "\\b", "(q|-)", "."]
    checked = 0
    for _ in range(3000):
        pattern = rng.choice(["", "[./-]", "\\b"]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) + rng.choice(["", "[./-]", "\\b"])
        tokens = literal_tokens(pattern)
        if not tokens:
            continue
        for _ in range(150):
            text = "".join(rng.choice(["a", "b1", ".", "-", "/", "x", "-y", "z", "q", "7"]) for _ in range(rng.randint(3, 16)))
            if re.search(pattern, text):
                checked += 1
                assert set(tokens) <= set(re.split("[^a-z0-9]+", text)), (pattern, text)
    assert checked > 500


def test_hundreds_of_rules_from_a_file(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 3)))
    rules = [{"place": k, "action": rng.choice(["block", "allow"]), "name": f"r{k}", "pattern": rng.choice([rf"[./-]{word()}[./-]", rf"/{word()}/(?:[^?#]*/)?{word()}(?:[/?#.]|$)", rf"://([^/]*[.])?{word()}[.]{word()}[./]"])} for k in range(700)]
    hosts = [{"place": 1000 + k, "action": "block", "host": f"{word()}.com", "path": "/" + rng.choice("ab")} for k in range(20)]
    path = tmp_path / "rules.json"
    path.write_text("\n".join(map(json.dumps, rules + hosts)))
    host_rules, pattern_rules = url_filter.read_rules(spark, str(path))
    assert len(host_rules) == 20 and [r.name for r in pattern_rules] == [r["name"] for r in rules]
    urls = [f"http://{word()}.{word()}.com/{word()}/{word()}/{rng.choice(['', word()])}" for _ in range(400)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = []
    for k, url in enumerate(urls):
        host, path_ = (re.match(r"http://([^/]*)(.*)", url).groups()) if url and "://" in url else ("", "")
        fits = sorted((r for r in host_rules if (host == r.host or host.endswith("." + r.host)) and path_.startswith(r.path)), key=lambda r: (len(r.name), r.name))
        hit = next((r for r in pattern_rules if re.search(r.pattern, url or "")), None)
        want.append((k, host, path_, fits[-1].name if fits else None, fits[-1].action if fits else hit.action if hit else "allow", None if fits else hit and hit.name))
    for inline in (0, 1000):
        assert rows_of(url_filter.url_verdicts(pages, host_rules=host_rules, pattern_rules=pattern_rules, inline_rules=inline)) == sorted(map(repr, want))
    (tmp_path / "bad.json").write_text('{"place": 1, "action": "block", "name": "x", "pattern": "foo"}')
    with pytest.raises(ValueError, match="no token"):
        url_filter.read_rules(spark, str(tmp_path / "bad.json"))

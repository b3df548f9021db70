"""The feature bag of one text in plain Python; tests hold the native columns of ``features`` and the batches of ``bags`` against it."""

from __future__ import annotations

import regex

from . import patterns as P
from .exact import white_split
from .features import LONGEST_WORD

GAP = regex.compile(r"[^\p{Alphabetic}\p{N}']+")
MARK = regex.compile(r"[^\p{Alphabetic}\p{N}\p{White_Space}']")


def line_kind(line: str) -> str:
    body = line.lstrip(P.SPACES)
    for kind, opens in (("fence", ("```",)), ("heading", ("#",)), ("bullet", ("- ", "* ")), ("boldlead", ("**",))):
        if body.startswith(opens):
            return kind
    if body[:1].isascii() and body[:1].isdigit() and ". " in body:
        return "numlist"
    n = len(white_split(body))
    return "blank" if not body else next((kind for most, kind in ((10, "line_short"), (25, "line_mid"), (50, "line_long")) if n < most), "line_para")


def feature_bag(text: str) -> list[str]:
    words = [w.lower() for w in GAP.split(text) if 0 < len(w.encode("utf-8", "surrogatepass")) < LONGEST_WORD]
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    pairs = [f"b:{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [*(f"w:{w}" for w in words), *pairs, *(f"p:{c}" for c in MARK.findall(text)), *(f"s:{line_kind(x.removesuffix(chr(13)))}" for x in lines)]

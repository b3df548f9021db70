"""Per-text masking, linting and rewriting, in time linear in the text.

Offsets are UTF-8 bytes at the surface; inside, code points are used.  The
operators run these over Arrow batches: each text in its own row, without a
shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import ahocorasick

from textassay.sources.packs import Engine, Rule

from . import patterns as P

Span = tuple[int, int]


@lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


HTML_TAG, INLINE_CODE, URL = (re.compile(p) for p in (P.HTML_TAG, P.INLINE_CODE, P.URL))
BLANK = re.compile(P.PY_SPACE + "+")
#: White space to Python but not to Unicode's property.
SEPARATORS = re.compile("[\x1c-\x1f]")


def white_split(text: str) -> list[str]:
    return [w for w in BLANK.split(text) if w] if SEPARATORS.search(text) else text.split()


def lines_kept(text: str) -> list[str]:
    """Lines with their ends."""
    lines = [line + "\n" for line in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] else lines[:-1]


def merge(spans: list[Span]) -> list[Span]:
    """Sorted, with those that overlap or touch made one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def covers(mask: list[Span], point: int) -> bool:
    """Whether a point lies in one of disjoint sorted spans."""
    k = bisect.bisect_right(mask, (point, float("inf")))
    return k > 0 and point < mask[k - 1][1]


def fences(text: str) -> list[Span]:
    found, open_at, at = [], None, 0
    for line in lines_kept(text):
        if line.lstrip(P.SPACES).startswith("```"):
            if open_at is None:
                open_at = at
            else:
                found.append((open_at, at + len(line)))
                open_at = None
        at += len(line)
    return found if open_at is None else [*found, (open_at, len(text))]


BLOCK_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in P.BLOCK_NAMES} | {"!--": re.compile("-->")}


@lru_cache(maxsize=64)
def _block_start(names: tuple[str, ...]) -> re.Pattern:
    elements = [n for n in names if n != "!--"]
    parts = [rf"<({'|'.join(elements)})\b[^>]*>"] if elements else ["(?!)()"]
    return re.compile("(?i)" + "|".join([*parts, *(["<!--"] if "!--" in names else [])]))


def html_blocks(text: str) -> list[Span]:
    """Script, style, svg and code elements and comments that have an end; one without an end is looked for once."""
    found, at, names = [], 0, tuple(BLOCK_ENDS)
    last = text.rfind(">") + 1
    while names and (m := _block_start(names).search(text, at, last)):
        name = (m[1] or "!--").lower()
        end = BLOCK_ENDS[name].search(text, m.end())
        if end:
            found.append((m.start(), end.end()))
            at = end.end()
        else:
            names = tuple(n for n in names if n != name)
            at = m.start()
    return found


def html_tags(text: str) -> list[Span]:
    return [m.span() for m in HTML_TAG.finditer(text, 0, text.rfind(">") + 1)]


def mask_spans(text: str) -> list[Span]:
    """Regions that are no prose: fences, then blocks, tags, inline code and URLs whose start is free."""
    mask = merge(fences(text)) if "```" in text else []
    for cue, find in (("<", html_blocks), ("<", html_tags), ("`", lambda t: [m.span() for m in INLINE_CODE.finditer(t)]), ("://", lambda t: [m.span() for m in URL.finditer(t)])):
        if cue in text:
            # Matches of one sort never overlap: only what was masked before can bar a start.
            mask = merge([*mask, *(s for s in find(text) if not covers(mask, s[0]))])
    return mask


def prose_spans(length: int, mask: list[Span]) -> list[Span]:
    """What the mask leaves, in order."""
    edges = [0, *(x for span in mask for x in span), length]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def overlaps(mask: list[Span], start: int, end: int) -> bool:
    """Half-open; an empty span overlaps what it lies strictly inside."""
    k = bisect.bisect_left(mask, (end,))
    return k > 0 and mask[k - 1][1] > start


ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def bounded(text: str, start: int, end: int) -> bool:
    """No ASCII letter or digit goes on across either edge."""
    before = start == 0 or text[start] not in ALNUM or text[start - 1] not in ALNUM
    after = end >= len(text) or text[end - 1] not in ALNUM or text[end] not in ALNUM
    return before and after


def word_before(text: str, at: int) -> str:
    """The run of ASCII letters that ends the last ASCII word before ``at``, in lower case."""
    end = at
    while end > 0 and text[end - 1] not in ALNUM:
        end -= 1
    start = end
    while start > 0 and text[start - 1] in ALNUM and not text[start - 1].isdigit():
        start -= 1
    return text[start:end].lower()


def guarded(rule: Rule, text: str, at: int) -> bool:
    return bool(rule.unless_preceded_by) and word_before(text, at) in rule.unless_preceded_by


def excerpt(piece: str) -> str:
    return piece if len(piece) <= P.EXCERPT else piece[: P.EXCERPT - 3] + "..."


Found = tuple[int, int, int | str, str]  # start, end, rule's number or a structural id, excerpt


def structural(text: str, mask: list[Span]) -> list[Found]:
    """Findings of the document as a whole."""
    found, bullets, at = [], [], 0
    if compiled(P.BULLET_CUE).search(text):
        for line in lines_kept(text):
            body = line.lstrip(P.SPACES)
            if (body.startswith(("- ", "* ")) or (body[:1].isascii() and body[:1].isdigit() and ". " in body)) and not overlaps(mask, at, at + len(line)):
                words = white_split(body.lstrip("-* ").lstrip("0123456789."))
                if words:
                    bullets.append((at, words[0].lstrip("*_").lower()))
            at += len(line)
    if len(bullets) >= P.BULLETS:
        most = max(Counter(w for _, w in bullets).items(), key=lambda x: (x[1], x[0]))
        if most[1] / len(bullets) >= P.BULLET_SHARE:
            found.append((bullets[0][0], bullets[0][0], "S001", f'{most[1]}/{len(bullets)} bullets open with "{most[0]}"'))
    n, total, squares = sentence_sums(text)
    if n >= P.SENTENCES:
        cv = sentence_cv(n, total, squares)
        if cv < P.SENTENCE_CV:
            found.append((0, 0, "S002", f"{n} sentences, length CV {cv:.2f}"))
    if ", and " in text:
        triads = [m.span() for m in compiled(P.TRIAD).finditer(text) if not overlaps(mask, *m.span())]
        if len(triads) >= P.TRIADS:
            found += [(a, b, "S003", excerpt(text[a:b])) for a, b in triads]
    return found


def sentence_sums(text: str) -> tuple[int, int, int]:
    """How many sentences have three words or more, their words and the squares of these."""
    lengths = [k for k in (len(white_split(s)) for s in compiled(P.PY_SENTENCE).split(text)) if k >= P.SENTENCE_WORDS]
    return len(lengths), sum(lengths), sum(k * k for k in lengths)


def sentence_cv(n: int, total: int, squares: int) -> float:
    """Population standard deviation over mean, from exact sums."""
    return (n * squares - total * total) ** 0.5 / total


def byte_offsets(text: str) -> list[int] | None:
    """Where each code point starts in UTF-8; None if they are the same."""
    return None if text.isascii() else list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in text), initial=0))


def places(text: str, points: list[int]) -> list[int]:
    """Sorted points of a text as UTF-8 offsets."""
    if text.isascii():
        return points
    out, at, byte = [], 0, 0
    for p in points:
        byte += len(text[at:p].encode("utf-8", "surrogatepass"))
        at = p
        out.append(byte)
    return out


@lru_cache(maxsize=8)
def _automaton(forms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for form in forms:
        found.add_word(form, len(form))
    found.make_automaton()
    return found


def ascii_lower(text: str) -> str:
    """A-Z lowered and nothing else, so that places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def literal_spans(text: str, engine: Engine) -> list[Span]:
    """The leftmost longest words and phrases, one scan from left to right; only ASCII letters fold."""
    if not engine.literals:
        return []
    every = sorted((last + 1 - size, -last - 1) for last, size in _automaton(tuple(engine.literals)).iter(ascii_lower(text)))
    found: list[Span] = []
    for start, end in every:
        if not found or start >= found[-1][1]:
            found.append((start, -end))
    return found


@lru_cache(maxsize=64)
def _cues(pattern: str) -> tuple[tuple[str, ...], bool]:
    literals, folded = P.required_literals(pattern)
    return tuple(literals), folded


def possible(pattern: str, text: str, lowered: str) -> bool:
    """A cheap test that every text with a match passes."""
    literals, folded = _cues(pattern)
    return not literals or any(x in (lowered if folded else text) for x in literals)


def rule_findings(text: str, mask: list[Span], engine: Engine) -> list[Found]:
    """Words and phrases between word edges, then patterns, in the order of rules; outside the mask and unguarded."""
    found = []
    for a, b in literal_spans(text, engine):
        if bounded(text, a, b) and not overlaps(mask, a, b):
            k = engine.literals[ascii_lower(text[a:b])]
            if not guarded(engine.rules[k], text, a):
                found.append((a, b, k, excerpt(text[a:b])))
    lowered = text.lower()
    for k, pattern in engine.regexes:
        if possible(pattern, text, lowered):
            for m in compiled(pattern).finditer(text):
                if not overlaps(mask, *m.span()) and not guarded(engine.rules[k], text, m.start()):
                    found.append((*m.span(), k, excerpt(m[0])))
    return found


def prose_words(text: str, mask: list[Span]) -> int:
    """Words outside the mask; a word that the mask cuts counts in each piece."""
    return sum(len(white_split(text[a:b])) for a, b in prose_spans(len(text), mask))


def findings_of(text: str, engine: Engine) -> tuple[list[Found], int]:
    """All findings by start and end (ties: rules in their order, then the document's), in code points; and words of prose."""
    mask = mask_spans(text)
    found = sorted([*rule_findings(text, mask, engine), *structural(text, mask)], key=lambda f: (f[0], f[1]))
    return found, prose_words(text, mask)


def details(rule: int | str, engine: Engine) -> tuple[str, str, float, str, bool]:
    """Id, name, weight, reason and whether it can be fixed, of a rule or a rule of the document."""
    if isinstance(rule, str):
        return (rule, *P.STRUCTURAL[rule], False)
    r = engine.rules[rule]
    return r.id, r.name, r.weight, r.rationale, r.fixable


def score_of(found: list[Found], words: int, engine: Engine) -> tuple[float, float, str]:
    """Total weight, weight per 1000 words, band."""
    total = float(sum(details(f[2], engine)[2] for f in found))
    score = total / (words / 1000) if words else 0.0
    return total, score, "heavy" if score >= engine.bands[1] else "seasoned" if score >= engine.bands[0] else "clean"


def lint_text(text: str, engine: Engine) -> tuple[list[dict], int, float, float, str]:
    """Findings in order, words of prose, total weight, density and band."""
    found, words = findings_of(text, engine)
    place = byte_offsets(text)
    at = (lambda k: k) if place is None else place.__getitem__
    findings = []
    for a, b, rule, said in found:
        rule_id, name, weight, why, fixable = details(rule, engine)
        findings.append({"rule_id": rule_id, "rule_name": name, "start": at(a), "end": at(b), "excerpt": said, "weight": weight, "rationale": why, "fixable": fixable})
    return findings, words, *score_of(found, words, engine)


# --- rewriting


def shaped_like(source: str, new: str) -> str:
    """``new`` in the case shape of ``source``: all upper, capitalised, or as it is."""
    if len(source) > 1 and source.isascii() and source.isalpha() and source.isupper():
        return "".join(c.upper() if c.isascii() else c for c in new)
    return new[:1].upper() + new[1:] if "A" <= source[0] <= "Z" else new


def _python_replacement(text: str) -> str:
    return re.sub(r"\$(?:\{(\w+)\}|([0-9A-Za-z_]+))", lambda m: rf"\g<{m[1] or m[2]}>", text.replace("\\", "\\\\"))


def _swaps(text: str, engine: Engine) -> str:
    """Whole runs of ASCII letters by the swap map, unless the word before guards them; guards see the text as it came."""

    def swap(m: re.Match) -> str:
        new = engine.swaps.get(m[0].lower())
        return m[0] if new is None or guarded(engine.rules[new[1]], m.string, m.start()) else shaped_like(m[0], new[0])

    return compiled("[A-Za-z]+").sub(swap, text)


def _phrases(text: str, engine: Engine) -> str:
    """The packs' replacements in their order."""
    for pattern, new in engine.fixes:
        if possible(pattern, text, text.lower()):
            text = compiled(pattern).sub(_python_replacement(new), text)
    return text


def _cleanup(text: str, engine: Engine) -> str:
    """Runs of blanks, double commas, blanks before marks, marks before a dot."""
    text = compiled(P.SPACE_RUN).sub(" ", text)
    text = compiled("," + P.PY_SPACE + "*,").sub(",", text)
    text = compiled(r"(?<![ \t])[ \t]+([,.;:!?])").sub(r"\1", text)
    return compiled("([,;:])" + P.PY_SPACE + r"*\.").sub(".", text)


#: The steps of rewriting in their order; each takes prose without masked regions.
STEPS: dict[str, Callable[[str, Engine], str]] = {
    "ranges": lambda text, engine: compiled(P.NUMBER_RANGE).sub(r"\1 to \2", text),
    "em dashes": lambda text, engine: compiled(f"(?:(?<!{P.PY_SPACE}){P.PY_SPACE}+)?—{P.PY_SPACE}*").sub(", ", text) if "—" in text else text,
    "en dashes": lambda text, engine: text.replace(" – ", ", "),
    "phrases": _phrases,
    "swaps": _swaps,
    "cleanup": _cleanup,
    "capitals": lambda text, engine: compiled("([.!?]" + P.PY_SPACE + "+)([a-z])").sub(lambda m: m[1] + m[2].upper(), text),
}


LETTER = re.compile("[A-Za-z]")


def first_capital(before: str, after: str) -> str:
    """If the first ASCII letter was upper case, the first of the result becomes so."""
    first, now = LETTER.search(before), LETTER.search(after)
    if first and now and first[0].isupper():
        return after[: now.start()] + now[0].upper() + after[now.end() :]
    return after


def fix_text(text: str, engine: Engine, steps: tuple[str, ...] | None = None) -> str:
    """The text rewritten between its masked regions; with ``steps``, by these alone."""
    out, at = [], 0
    for a, b in prose_spans(len(text), mask_spans(text)):
        piece = text[a:b]
        for step in STEPS if steps is None else steps:
            piece = STEPS[step](piece, engine)
        out += [text[at:a], piece]
        at = b
    done = "".join(out) + text[at:]
    return first_capital(text, done) if steps is None else done

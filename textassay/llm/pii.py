"""Personal data by anchors.

An Aho-Corasick automaton finds the signs that personal data can't do without:
at-signs, digits, plus signs, schemes, and cues of identifiers.  At each anchor a
small deterministic parser expands to both sides and validates what it finds.
Four base kinds have fixed boundaries; four more are added by the method:
``login`` (user and password in a URL), ``ipv6`` (a bracketed host after a scheme),
``iban`` (behind its cue, with a right checksum) and ``secret`` (a value assigned to
a name like token or password, or a key with the prefix of a known issuer).
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone", "login", "ipv6", "iban", "secret")
BASE = KINDS[:4]

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")

Span = tuple[int, int]


#: Names whose assigned value is a secret, and the least length of that value.
SECRET_NAMES = {"token": 16, "secret": 12, "api_key": 12, "api-key": 12, "apikey": 12, "api key": 12, "access_key": 12, "private_key": 12, "password": 6, "passwd": 6, "passphrase": 6}
#: Public prefixes of issued keys, with the signs and the length of what follows.
KEY_PREFIXES = {"AKIA": (r"[0-9A-Z]", 16, 16), "ASIA": (r"[0-9A-Z]", 16, 16), "AIza": (r"[0-9A-Za-z_-]", 35, 35), "ghp_": (r"[0-9A-Za-z]", 36, 36), "github_pat_": (r"[0-9A-Za-z_]", 60, 90), "glpat-": (r"[0-9A-Za-z_-]", 20, 40), "sk_live_": (r"[0-9A-Za-z]", 16, 99), "xoxb-": (r"[0-9A-Za-z-]", 24, 99), "xoxp-": (r"[0-9A-Za-z-]", 24, 99)}


def spellings(cue: str) -> set[str]:
    return {cue, cue.upper(), cue.capitalize(), cue.title()}


def _automaton() -> ahocorasick.Automaton:
    """Signs with what to do at them: a sign itself, or (parser's name, cue)."""
    found = ahocorasick.Automaton()
    for sign in ("@", "+", "://", *DIGITS):
        found.add_word(sign, sign)
    for spelling in spellings("iban"):
        found.add_word(spelling, ("iban", "iban"))
    for name in SECRET_NAMES:
        for spelling in spellings(name):
            found.add_word(spelling, ("name", name))
    for prefix in KEY_PREFIXES:
        found.add_word(prefix, ("prefix", prefix))
    found.make_automaton()
    return found


_made: list[ahocorasick.Automaton] = []


def email_at(text: str, at: int, low: int) -> Span | None:
    """Around the at-sign ``at``; the local part starts at ``low`` at the earliest."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    end, n, labels = at + 1, len(text), 0
    if start == at:
        return None
    while True:
        begin = end
        while end < n and text[end] in LABEL:
            end += 1
        if end == begin:
            end = begin - 1  # the dot before isn't part of it
            break
        labels += 1
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def digit_run(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def ips_at(text: str, at: int) -> tuple[list[Span], int]:
    """Addresses in the chain of numbers and single dots from ``at``, and where it ends."""
    ends, end, n = [], digit_run(text, at), len(text)
    starts = [at]
    ends.append(end)
    while end + 1 < n and text[end] == "." and text[end + 1] in DIGITS:
        starts.append(end + 1)
        end = digit_run(text, end + 1)
        ends.append(end)
    found = []
    for k in range(0, len(starts) - 3, 4):
        if all(small(text[starts[j] : ends[j]]) for j in range(k, k + 4)):
            found.append((starts[k], ends[k + 3]))
    return found, end


def small(number: str) -> bool:
    """At most 255, however many zeros lead."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


def card_at(text: str, at: int) -> tuple[Span | None, int]:
    """The chain of digits with single spaces or dashes from ``at``, and where it ends."""
    end, n = digit_run(text, at), len(text)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = digit_run(text, end + 1)
    digits = [ord(c) - 48 for c in text[at:end] if c in DIGITS] if end - at <= 40 else []
    return ((at, end) if 14 <= len(digits) <= 19 and luhn(digits) else None), end


def luhn(digits: list[int]) -> bool:
    doubled = (d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    """From the plus sign ``at``; also where the next one may start."""
    n = len(text)
    if at + 1 >= n or text[at + 1] not in DIGITS:
        return None, at + 1
    end = at + 2
    while end < n and text[end] in PHONE:
        end += 1
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None, at + 1
    digits = sum(c in DIGITS for c in text[at:end]) if end - at <= 200 else sum(map(text[at:end].count, DIGITS))
    return ((at, end) if 10 <= digits <= 15 else None), end


AUTHORITY = re.compile(r"[^\s/?#<>\"']{1,512}")
IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


def login_at(text: str, at: int) -> Span | None:
    """``user:password`` of the authority that starts at ``at``."""
    m = AUTHORITY.match(text, at)
    user = m[0].rpartition("@")[0] if m else ""
    return (at, at + len(user)) if re.fullmatch(r"[^:@]+:.+", user) else None


def ipv6_at(text: str, at: int) -> Span | None:
    """The bracketed address in the authority that starts at ``at``."""
    m = AUTHORITY.match(text, at)
    host = m[0].rpartition("@")[2] if m else ""
    start = at + len(m[0]) - len(host) if m else at
    end = host.find("]")
    if not host.startswith("[") or end < 0:
        return None
    try:
        ipaddress.IPv6Address(host[1:end])
    except ValueError:
        return None
    return (start + 1, start + end)


def iban_at(text: str, at: int) -> Span | None:
    """The account number that follows a cue which ends at ``at``."""
    m = IBAN.match(text, at)
    if not m:
        return None
    plain = m[1].replace(" ", "")
    digits = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return m.span(1) if 15 <= len(plain) <= 34 and int(digits) % 97 == 1 else None


ASSIGNED = re.compile(r"""["']?[ \t]{0,3}(?:=|:|=>|:=|is)[ \t]{0,3}(?:"([^"\s]{6,512})"|'([^'\s]{6,512})'|([^\s"'<>,;)\]}]{6,512}))""")
KEYS = {prefix: re.compile(f"{signs}{{{low},{high}}}(?!{signs})") for prefix, (signs, low, high) in KEY_PREFIXES.items()}


def assigned_at(text: str, at: int, name: str) -> Span | None:
    """The value assigned to the name that ends at ``at``: long enough, and no plain word."""
    m = ASSIGNED.match(text, at)
    if not m:
        return None
    start, end = m.span(m.lastindex)
    if m.lastindex == 3:
        while end > start and text[end - 1] in ".:!?":  # marks of a sentence
            end -= 1
    value = text[start:end]
    mixed = any(c in DIGITS for c in value) and any(c not in DIGITS for c in value)
    return (start, end) if end - start >= SECRET_NAMES[name] and (mixed or m.lastindex < 3) else None


def key_at(text: str, at: int, prefix: str) -> Span | None:
    """The key whose prefix ends at ``at``."""
    start = at - len(prefix)
    if start and (text[start - 1] in ALNUM or text[start - 1] == "_"):
        return None
    m = KEYS[prefix].match(text, at)
    return (start, m.end()) if m else None


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all personal data, by start and then by kind as listed."""
    if not _made:
        _made.append(_automaton())
    found: list[tuple[int, str, int]] = []
    email_end = ip_end = card_end = phone_end = secret_end = 0
    for last, sign in _made[0].iter(text):
        if sign in DIGITS:
            if last >= ip_end:
                ips, ip_end = ips_at(text, last)
                found += [(a, "ip", b) for a, b in ips]
            if last >= card_end:
                card, card_end = card_at(text, last)
                if card:
                    found.append((card[0], "card", card[1]))
        elif sign == "@":
            email = email_at(text, last, email_end)
            if email:
                found.append((email[0], "email", email[1]))
                email_end = email[1]
        elif sign == "+":
            if last >= phone_end:
                phone, phone_end = phone_at(text, last)
                if phone:
                    found.append((phone[0], "phone", phone[1]))
        elif sign == "://":
            for kind, parse in (("login", login_at), ("ipv6", ipv6_at)):
                if span := parse(text, last + 1):
                    found.append((span[0], kind, span[1]))
        else:
            parser, cue = sign
            if parser == "iban":
                span, kind = iban_at(text, last + 1), "iban"
            else:
                span, kind = (assigned_at if parser == "name" else key_at)(text, last + 1, cue), "secret"
            if span and (kind != "secret" or span[0] >= secret_end):
                found.append((span[0], kind, span[1]))
                if kind == "secret":
                    secret_end = span[1]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


PRIVATE = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def scan_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            spans = find_spans(text)
            base = [s for s in spans if s[1] in BASE]
            rows.append((i, *(sum(s[1] == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PRIVATE, strict=True)], schema=PRIVATE)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive.  A null text has
    none.  Repeated rows and null ids are reported like any others; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(scan_partition, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None) -> str | None:
    """The text with every span as its kind in angle brackets; of spans that overlap the first is named."""
    out, at = [], 0
    for a, kind, b in find_spans(text or ""):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return text if text is None else "".join(out) + text[at:]


def mask_partition(text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[text_at] = pa.array(map(masked, columns[text_at].to_pylist()), batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def mask_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with every span replaced by its kind in angle brackets.

    Null texts stay null and empty ones empty; repeated rows are masked alike;
    columns come back as they were, whatever their names; an empty table stays
    empty.
    """
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(mask_partition(docs.columns.index(text_col)), docs.schema)

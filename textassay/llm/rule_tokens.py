"""Literal tokens that stand in every match of a pattern, taken from the pattern itself."""

from __future__ import annotations

import re._constants as C
import re._parser as parser

TOKEN_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _is_sign(code: int) -> bool:
    return chr(code) in TOKEN_SIGNS


def _class_parts(items) -> bool:
    """Whether a class of characters can match no sign of a token."""
    negated = items[0][0] is C.NEGATE
    if negated:
        listed = {v for op, v in items[1:] if op is C.LITERAL} | {k for op, v in items[1:] if op is C.RANGE for k in range(v[0], v[1] + 1)}
        return all(ord(c) in listed for c in TOKEN_SIGNS)
    for op, v in items:
        if op is C.LITERAL and not _is_sign(v):
            continue
        if op is C.RANGE and not any(v[0] <= ord(c) <= v[1] for c in TOKEN_SIGNS):
            continue
        if op is C.CATEGORY and v in (C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD):
            continue
        return False
    return True


def _edge(items: list, last: bool) -> bool | None:
    """Whether what stands at the edge of every match of ``items`` parts tokens; None if it does or there is nothing."""
    for op, value in reversed(items) if last else items:
        if op in (C.ASSERT, C.ASSERT_NOT):
            continue
        if op is C.AT:
            found = value in (C.AT_BOUNDARY, C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING)
        elif op is C.LITERAL:
            found = not _is_sign(value)
        elif op is C.IN:
            found = _class_parts(value)
        elif op is C.SUBPATTERN:
            found = _edge(list(value[3]), last)
        elif op is C.BRANCH:
            each = [_edge(list(branch), last) for branch in value[1]]
            found = False if False in each else None if None in each else True
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found = _edge(list(value[2]), last)
            if found and not value[0]:
                found = None
        else:
            found = False
        if found is not None:
            return found
    return None


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """Runs of a-z and 0-9 that stand as whole tokens in every text in lower case that ``pattern`` fits.

    Only runs on the pattern's outer level are looked at (a group that is always
    there counts as that).  A run is a token if what stands on both of its sides in
    every match parts tokens; an open end of the pattern does not.  Where case is
    ignored or the pattern cannot be read, there are none.
    """
    try:
        parsed = parser.parse(pattern)
    except Exception:
        return ()
    if parsed.state.flags & C.SRE_FLAG_IGNORECASE:
        return ()

    def opened(items) -> list:
        out = []
        for op, value in items:
            if op is C.SUBPATTERN and not value[1] and not value[2]:
                out += opened(value[3])
            else:
                out.append((op, value))
        return out

    items = opened(parsed)
    found, at = [], 0
    while at < len(items):
        end = at
        while end < len(items) and items[end][0] is C.LITERAL and _is_sign(items[end][1]):
            end += 1
        if end > at:
            if _edge(items[:at], True) and _edge(items[end:], False):
                found.append("".join(chr(v) for _, v in items[at:end]))
            at = end
        else:
            at += 1
    return tuple(dict.fromkeys(found))

"""Repeated passages of two and three lines."""

import hashlib
import random
from collections import defaultdict

import pytest
from test_text_ops import frame, rows_of

from textassay.llm import line_dedup


def slow_passages(rows, window=4, least=50):
    key_of = lambda i, t: (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "")
    seen, gone = set(), defaultdict(set)
    for key in sorted({key_of(i, t) for i, t in rows}):
        lines = key[3].split("\n")
        words = [len(x.split(" ")) if x else 0 for x in lines]
        for k in range(len(lines)):
            for size in range(1, window + 1):
                if k + size > len(lines) or (size < window and sum(words[k : k + size]) < least):
                    continue
                run = tuple(lines[k : k + size])
                if run in seen:
                    gone[key] |= set(range(k, k + size))
                seen.add(run)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone[key_of(i, t)])
        out.append((i, t if t is None else left, len(lines), len(gone[key_of(i, t)])))
    return out


def test_passages_against_brute_force(spark):
    rng = random.Random(5)
    line = lambda: rng.choice(["", "a", "b", *("w " * n + str(n) for n in (15, 16, 24, 25, 34, 48, 49, 60))])
    rows = [(k, "\n".join(line() for _ in range(rng.randint(0, 9)))) for k in range(80)]
    rows += [(100 + k, rows[k % 9][1]) for k in range(9)] + [(3, rows[3][1]), (None, None), (None, rows[5][1]), (200, ""), (201, "\n")]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert rows_of(got) == sorted(map(repr, slow_passages(rows)))
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_matches_are_chained_both_ways(spark):
    lines = [f"line {k}" for k in range(12)]
    rows = [(1, "\n".join(["x", *lines[:9], "y"])), (2, "\n".join(["p", "q", "r", *lines[1:8], "z"])), (3, "\n".join([*lines[2:7], *lines[6:11]]))]
    found = [(r.id, r.start, r.lines, r.first_id, r.first_start) for r in line_dedup.repeated_runs(frame(spark, rows)).collect()]
    assert sorted(found) == [(2, 3, 7, 1, 2), (3, 0, 5, 1, 3)]


def test_one_line_in_a_third_of_the_rows(spark):
    common = "license " * 60
    rows = [(k, f"own {k}\n{common}\nmore {k}" if k % 3 == 0 else f"own {k}\nother {k}") for k in range(3000)]
    got = {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {k: int(k % 3 == 0 and k > 0) for k, _ in rows}


@pytest.mark.parametrize("sizes, gone", [((30, 30), 2), ((20, 20, 20), 3), ((20, 20), 0), ((25, 0, 24), 0), ((25, 0, 25), 3)])
def test_passages_by_their_words(spark, sizes, gone):
    passage = "\n".join(" ".join(f"{k}{j}" for j in range(n)) for k, n in enumerate(sizes))
    rows = line_dedup.dedup_lines(frame(spark, [(1, passage), (2, "first\n" + passage + "\nlast")])).collect()
    assert {r.doc_id: r.n_deleted for r in rows} == {1: 0, 2: gone}

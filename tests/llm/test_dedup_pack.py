"""Exact and near duplicates, packing and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textassay.llm import decontaminate as dc
from textassay.llm import exact_dedup as ed
from textassay.llm import packing as pk
from textassay.llm import simhash_dedup as sd
from textassay.llm.common import materialise, salted_join

DOCS = "doc_id long, text string, lang string, sha string, root long, n_chars long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    """(id, text) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", 1, None if t is None else len(t)) for i, t in rows], DOCS)


def edge_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    rows = [(k, " ".join(word() for _ in range(rng.randint(0, 30)))) for k in range(60)]
    rows += [(100 + k, rows[k % 7][1]) for k in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, "lost row"), (None, "lost row"), (7, "same id, other text"), (8, rows[8][1]), (8, rows[8][1]), (300, "long " * 20_000), (301, "x" * 100_000)]
    rng.shuffle(rows)
    return rows


def test_exact_duplicates_against_brute_force(spark):
    rows = edge_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for keep, pick in (("max", max), ("min", min)):
        got = ed.exact_duplicates(frame(spark, rows), keep=keep).collect()
        assert len(got) == len(rows)
        want = []
        for t, ids in groups.items():
            named = [i for i in ids if i is not None]
            owner, first = (pick(named) if named else None), True
            for i in ids:
                want.append((i, owner, len(ids), i == owner and first, hashlib.sha256(t.encode()).hexdigest()))
                first = first and i != owner
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        kept = ed.drop_exact_duplicates(frame(spark, rows), keep=keep)
        assert kept.columns == ["doc_id", "text", "lang", "sha", "root", "n_chars"]
        assert sorted(repr((r.doc_id, r.text or "")) for r in kept.collect()) == sorted(repr((pick([i for i in ids if i is not None] or [None]), t)) for t, ids in groups.items())


def test_exact_duplicates_survive_spills(spark):
    rows = [(k, f"text {k % 50} " + "y" * 2000) for k in range(400)]
    got = ed.text_owners(frame(spark, rows), trie_bytes=5000).collect()
    assert sorted((r.owner, r.rows) for r in got) == sorted((350 + k, 8) for k in range(50))


def test_patricia_trie():
    rng = random.Random(2)
    trie, seen = ed.Patricia(), {}
    for _ in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        node = trie.terminal(key)
        node[1] = (node[1] or 0) + 1
        seen[key] = seen.get(key, 0) + 1
    assert dict(trie.pop_all()) == seen and trie.bytes == 0


def test_tries_hold_many_texts_and_spill_by_subtree():
    trie = ed.Patricia()
    keys = [b"shared prefix " + bytes([97 + k % 3]) + str(k).encode() + b"z" * (k % 40) for k in range(900)] + [b"", b"shared prefix ", b"other"]
    for key in keys:
        trie.terminal(key)[1] = [key]
    assert trie.bytes < sum(map(len, keys)) + 2 * len(keys) * ed.NODE_BYTES and set(trie.root[0]) == set(b"so")
    whole, gone = trie.bytes, dict(trie.spill(trie.bytes // 2))
    assert whole // 4 < trie.bytes <= whole // 2 and all(key == t[0] for key, t in gone.items())
    heads = {key[14:15] for key in gone}
    rest = dict(trie.pop_all())
    assert len(heads) == 2 and not any(key[14:15] in heads for key in rest)  # whole subtrees, the other stays
    assert sorted([*gone, *rest]) == sorted(keys) and trie.bytes == 0
    chain = ed.Patricia()
    for k in range(300):
        chain.terminal(b"a" * k)[1] = [k]
    spilled = list(chain.spill(chain.bytes // 3))
    assert spilled and {t[0] for _, t in [*spilled, *chain.pop_all()]} == set(range(300))


def test_same_length_and_hash_are_told_apart():
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("n", "h", "text", "owner", "rows", "owner_rows"), r, strict=True)) for r in rows])
    out = [r for b in ed.own_partition(True, 1)(iter([batch((2, 7, b"ab", 1, 1, 1), (2, 7, b"cd", 2, 1, 1)), batch((2, 7, b"ab", 5, 2, 1), (3, 1, b"abc", 4, 1, 1))])) for r in b.to_pylist()]
    sha = lambda t: hashlib.sha256(t).hexdigest()
    assert sorted((r["sha"], r["owner"], r["rows"]) for r in out) == sorted([(sha(b"ab"), 5, 3), (sha(b"cd"), 2, 1), (sha(b"abc"), 4, 1)])


def test_columns_with_the_operators_own_names(spark):
    names = ["__sha", "__owner", "__sha_of", "__id_of", "n", "__kept_id", "__kept_sha", "fp", "i", "t"]
    rows = [(1, "one text"), (2, "one text"), (3, "another"), (3, "another"), (None, None)]
    docs = spark.createDataFrame([(i, t, *("mine" for _ in names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for kept in (ed.drop_exact_duplicates(docs), sd.drop_near_duplicates(docs)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert len(found) == 3 and all(r[n] == "mine" for r in found for n in names)


def test_hot_keys_are_dealt_over_tasks(spark):
    rows = spark.range(4000).select((F.col("id") % 3000).alias("k0"), F.col("id")).select(F.when(F.col("k0") < 1500, 7).otherwise(F.col("k0")).alias("k"), "id")
    counted = materialise(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "counted")
    for least in (1, 100, 10_000):
        got = salted_join(rows, counted, ["k"], "n", ["id"], least=least)
        want = rows.join(counted.drop("n"), "k")
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_tables(spark):
    none = frame(spark, [])
    assert ed.exact_duplicates(none).collect() == [] and ed.drop_exact_duplicates(none).collect() == []
    assert sd.near_duplicates(none).collect() == [] and sd.drop_near_duplicates(none).collect() == []
    assert pk.pack_documents(none, WORD_BPE).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(none, bench).collect() == [] and dc.remove_contamination(none, bench).collect() == []
    one = frame(spark, [(1, "a b c")])
    assert [r.n_hit for r in dc.contamination(one, bench).collect()] == [0]


# --- near duplicates


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, bits=4):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= bits:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {p: top(p) for p in prints}


def test_near_duplicates_against_brute_force(spark):
    rows = edge_rows()
    base = [f"w{k}" for k in range(300)]
    for k in range(60):
        words = list(base)
        for _ in range(k % 5):
            words[random.Random(k).randrange(300)] = f"v{k}"
        rows.append((1000 + k, " ".join(words).upper() if k % 3 else " ".join(words)))
    prints = [slow_print(t) for _, t in rows]
    roots = slow_components(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = [(i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)]
    got = sd.near_duplicates(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len({w[2] for w in want if w[0] and w[0] >= 1000}) < 40
    kept = sd.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "sha", "root", "n_chars"]
    kept = kept.collect()
    by_root = defaultdict(list)
    for (i, t), p in zip(rows, prints, strict=True):
        by_root[roots[p]].append((i is None, i, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(repr((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())) for r in kept) == sorted(repr(min(v, key=repr and (lambda x: (x[0], x[1] or 0, x[2])))[1:]) for v in by_root.values())


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_of_planted_fingerprints(spark, bucket):
    rng = random.Random(9)
    prints = set()
    for _ in range(120):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randint(0, 4)):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
            p = rng.choice((p, q))
    dense = rng.getrandbits(64)
    prints |= {dense ^ 1 << a ^ 1 << b for a in range(9) for b in range(a)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p), k) for k, p in enumerate(prints)], "fp long, least long")
    links = sd.fingerprint_links(df, bucket=bucket).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    got = defaultdict(set)
    for r in sd.rooted_prints(df, 4).collect():
        got[r.root].add(r.fp)
    want = defaultdict(set)
    for p, r in slow_components(prints).items():
        want[r].add(signed(p))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_golay_keys_meet_at_every_distance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.int64)
    for bits in range(5):
        other = base.copy()
        for k in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[k] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
        keys = []
        for x in (base, other):
            owners, found = sd.golay_keys(x)
            keys.append([set(found[owners == k].tolist()) for k in range(len(x))])
        assert all(a & b for a, b in zip(*keys, strict=True))


def test_golay_keys_meet_under_all_errors_of_four_bits():
    errors = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(64), 4)], np.uint64).view(np.int64)
    one = np.array([0x0123456789ABCDEF], np.int64)
    _, own = sd.golay_keys(one)
    assert len(own) == len(set(own.tolist())) and own.min() >= 0
    for at in range(0, len(errors), 50_000):
        other = one ^ errors[at : at + 50_000]
        owners, found = sd.golay_keys(other)
        assert len(np.unique(owners[np.isin(found, own)])) == len(other)


def test_keys_gather_few_fingerprints_that_are_far_apart():
    prints = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    _, keys = sd.golay_keys(prints)
    # 2^33 keys of a kind or more: 18 kinds, 20,000 fingerprints, five codewords.
    assert len(keys) - len(np.unique(keys)) < 100


# --- packing


def test_packing_is_a_partition_of_the_corpus(spark):
    rows = edge_rows() + [(400, "Don't <|endoftext|> stop’s 12,5 ½ ŒUVRE İstanbul é \x1c z" * 3), (401, "alpha beta " * 5000)]
    tok = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = pk.pack_documents(frame(spark, rows), WORD_BPE, group_rows=40).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_sum_of_squares_fills_sequences():
    lengths = np.random.default_rng(1).integers(1, 3000, 5000)
    bins, offsets = pk.sum_of_squares(lengths, 4096)
    assert len(set(bins.tolist())) <= 1.01 * -(-int(lengths.sum()) // 4096) + 2


# --- decontamination


def slow_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and", "é1", "x9", "ko", "lu", "mi"])
    items = [(k, ", ".join(word() for _ in range(rng.randint(1, 14)))) for k in range(12)]
    items += [(20, None), (21, "..."), (None, "solo item"), (3, "the second text of item three"), (30, "zz " * 25)]
    rows = edge_rows() + [(500 + k, " ".join(word() for _ in range(80)) + rng.choice(["", items[k % 12][1].upper(), " solo, item "])) for k in range(50)] + [(600, "zz " * 40)]
    windows = defaultdict(set)
    for i, t in items:
        w = slow_words(t)
        for at in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[at : at + 10])].add("" if i is None else str(i))
    want = []
    for i, t in rows:
        w, hit, found = slow_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if own := windows.get(tuple(w[at : at + size])):
                    hit |= set(range(at, at + size))
                    found |= own
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    for block in (1 << 20, 40):
        got = dc.contamination(frame(spark, rows), bench, block_bytes=block).collect()
        assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    cleaned = dc.remove_contamination(frame(spark, rows), bench)
    assert cleaned.columns == ["doc_id", "text", "lang", "sha", "root", "n_chars"] and cleaned.count() == len(rows)
    assert not dc.contamination(cleaned, bench).filter("contaminated").count()
    before = {i: t for i, t in rows if i is not None and i >= 100 and i < 400}
    assert {r.doc_id: r.text for r in cleaned.collect() if r.doc_id in before} == before
    assert all(r.n_chars == len(r.text) for r in cleaned.collect() if r.text is not None)


def test_pieces_have_all_windows_of_an_item():
    rng = random.Random(6)
    for n in (0, 1, 9, 10, 11, 40, 41):
        words = [b"%d" % rng.randint(0, 3) for _ in range(n)]
        for most in (1, 5, 100):
            parts = list(dc.pieces_of(words, 10, most))
            of = lambda w: [tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))]
            assert [x for part in parts for x in of(part)] == of(words)


def test_phrases_hold_each_window_once_with_its_items():
    words = b"a b c a b c a b c a b c".split()
    phrases = dc.Phrases([(7, words), (None, words[3:]), (8, [b"a"]), (9, [])], 3)
    assert {size: len(p) for size, p in phrases.by_length.items()} == {1: 1, 3: 3}
    items = [sorted(phrases.owners[a:b].tolist()) for a, b in itertools.pairwise(phrases.owned)]
    assert items == [[2], [0, 1], [0, 1], [0, 1]]


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(0)
    seq = rng.integers(2, 6, 3000)
    index = dc.FMIndex(seq, 6)
    patterns = rng.integers(2, 6, (50, 4))
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [k for k in range(len(seq) - 3) if (seq[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want

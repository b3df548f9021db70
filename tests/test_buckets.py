"""Counts packed by buckets of features: every level against sums over the bags of single texts."""

import random
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from textassay.functions.bag import feature_bag
from textassay.functions.bags import Index, bags, family_counts
from textassay.operators import attribution, mining
from textassay.plans.entries import ENTRIES


def made(n=300, seed=4):
    pick = random.Random(seed)
    letters = "klmnoKÄäßß😀。.-\n é'"
    return [(pick.choice(["a", "b", "", None, "é", "void"]), "".join(pick.choice(letters + "   ") for _ in range(pick.randint(0, 60)))) for _ in range(n)]


def wanted(rows):
    y, df = Counter(), Counter()
    for family, text in rows:
        bag = feature_bag(text or "")
        y.update((family, x) for x in bag)
        df.update((family, x) for x in set(bag))
    return y, df


def batch(rows):
    return pa.RecordBatch.from_pydict({"family": pa.array([f for f, _ in rows], pa.string()), "text": pa.array([t for _, t in rows], pa.string())})


def test_a_name_has_one_bucket_in_all_batches():
    rows = made()
    seen = {}
    for k in range(0, 300, 50):
        texts = pa.array([t for _, t in rows[k : k + 50]])
        for bucket, _, names, _, _ in family_counts(texts, np.zeros(50, np.int64), 1 << 40):
            assert bucket.tolist() == sorted(bucket.tolist())
            for name, number in zip(names.to_pylist(), bucket.tolist(), strict=True):
                assert seen.setdefault(name, number) == number
    assert len(set(seen.values())) == len(seen) > 1000 and {n[0] for n in seen} == set("wbps")
    assert sum(len(x[0]) for x in family_counts(pa.array([], pa.string()), np.zeros(0, np.int64), 9)) == 0


@pytest.mark.parametrize("size", [1, 3000, 1 << 24])
@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_packed_counts_are_whole(monkeypatch, size, buckets):
    monkeypatch.setattr(mining, "MERGED_BYTES", size)
    monkeypatch.setattr(mining, "SHOWN_ROWS", 100)
    rows = [*made(), ("void", None), ("void", "")]
    sent = [row for k in range(0, len(rows), 40) for b in mining.count_partition(iter([batch(rows[k : k + 40])]), buckets, False) for row in (b.slice(j, 1) for j in range(len(b)))]
    sent.sort(key=lambda b: b.column("bucket")[0].as_py())
    sent = [b for k in range(0, len(sent), 3) for b in pa.Table.from_batches(sent[k : k + 3]).combine_chunks().to_batches()]
    y, df = wanted(rows)
    got = [tuple(r.values()) for b in mining.sum_buckets(iter(sent)) for r in b.to_pylist()]
    assert sorted(map(repr, got)) == sorted(repr((f, x, n, df[f, x])) for (f, x), n in y.items())
    pooled = [tuple(r.values()) for b in partial(mining.sum_buckets, pooled=True, apart=False)(iter(sent)) for r in b.to_pylist()]
    whole, docs = Counter(), Counter()
    for (f, x), n in y.items():
        whole[x] += n
        docs[x] += df[f, x]
    assert sorted(pooled, key=repr) == sorted(((None, x, n, docs[x]) for x, n in whole.items()), key=repr)


def test_all_levels(spark):
    rows = [*made(), ("void", None), ("none", ""), ("none", None)]
    y, _ = wanted(rows)
    want = Counter({(f, x, n): 1 for (f, x), n in y.items()})
    for level in (lambda f, x: (None, x), lambda f, x: (f, None), lambda f, x: (None, None)):
        sums = Counter()
        for (f, x), n in y.items():
            sums[level(f, x)] += n
        want.update((*key, n) for key, n in sums.items())
    df = spark.createDataFrame(rows, "family string, text string").repartition(5)
    assert Counter(tuple(r) for r in mining.grouped_counts(df).select("family", "feature", "y").collect()) == want


@pytest.mark.parametrize("name", ["mine_counts", "mine_docfreq", "mine_grouping_sets"])
def test_rows_of_buckets_are_shuffled_not_features(spark, name):
    plan = ENTRIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(bucket") == plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan and "Expand" not in plan


def test_an_index_finds_its_names_alone():
    texts = [t for _, t in made(200, 6)] + ["", None, "a", "Kk k kk. K\n", "x" * 40 + " k l", "k " + "x" * 40 + " l k"]
    found = bags(pa.array(texts))
    every = found.names.to_pylist()
    odd = ["b:a", "b:a b c", "b: a", "w:", "p:ab", "p:", "s:none", "x:k", "", "b:k l", "b:l k"]
    pick = random.Random(2)
    for names in ([], odd, sorted({*pick.sample(every, 40), *odd}), sorted(set(every)), [n for n in sorted(set(every)) if n[0] == "b"]):
        rows, places, counts = Index(pa.array(names, pa.string())).counts(pa.array(texts))
        want = sorted((row, names.index(every[c]), n) for row, c, n in zip(found.rows.tolist(), found.codes.tolist(), found.counts.tolist(), strict=True) if every[c] in names)
        assert list(zip(rows.tolist(), places.tolist(), counts.tolist(), strict=True)) == want
    assert len(want) > 100


def test_an_index_makes_no_names_of_pairs(monkeypatch):
    from textassay.functions import bags as module

    monkeypatch.setattr(module, "prefixed", None)
    catalog = mining.Matrix(pa.array(["b:k l", "w:k"]), np.ones(2), np.ones(2), ["a"], None, None, None)
    rows, places, values = catalog.entries(pa.array(["m k l", "k"]))
    assert (rows.tolist(), places.tolist()) == ([0, 0, 1], [0, 1, 1]) and abs(values[2] - 1) < 1e-12


def test_tasks_keep_their_own_first_features(spark):
    """A family's candidates aren't put in one task before most of them are left out."""
    scored = spark.createDataFrame([("a", f"w:{k}", 5, float(k % 7)) for k in range(50)], "family string, feature string, y long, z double")
    plan = mining.nominated(scored, 2000)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    assert [r.feature for r in mining.nominated(scored, 3).orderBy("rank").collect()] == ["w:13", "w:20", "w:27"]


def test_calls_need_no_evidence(spark):
    rows = spark.createDataFrame([(k, f, f"{f} walks on, {f} runs {k}.") for k in range(20) for f in ("a", "b")], "doc_id long, family string, text string")
    catalog = mining.mine(rows, 50)
    weights = catalog.weights.withColumn("w", catalog.weights.rate / 100)
    catalog = mining.Catalog(catalog.features, weights, catalog.families)
    shown, bare = ({(r.id, r.ranked[0].family, r.confidence, r.matched): r.evidence for r in attribution.attributed(rows, catalog, most=most).collect()} for most in (8, 0))
    assert shown.keys() == bare.keys() and not any(bare.values()) and all(shown.values())
    # Ties of what a feature leads by go by its name.
    assert all([e.feature for e in x] == [e.feature for e in sorted(x, key=lambda e: (-round(e.contribution, 9), e.feature))] for x in shown.values())

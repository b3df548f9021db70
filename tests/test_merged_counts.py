"""Counts merged in one pass over sorted rows against sums of all counts."""

import random
from collections import Counter, defaultdict

from textassay.functions.bag import feature_bag
from textassay.operators import mining


def test_merged_counts(spark, monkeypatch):
    pick = random.Random(3)
    rows = [(pick.choice(["a", "b", "", None, "empty"]), " ".join(pick.choice("klmnopqrstuvwxyzäöü") for _ in range(pick.randint(0, 40)))) for _ in range(300)]
    rows = [(f, None if f == "empty" else t) for f, t in rows]
    y, texts, total, samples = Counter(), Counter(), Counter(), Counter(f for f, _ in rows)
    for f, t in rows:
        bag = feature_bag(t or "")
        total[f] += len(bag)
        y.update((f, x) for x in bag)
        texts.update((f, x) for x in set(bag))
    most, whole, docs = defaultdict(int), Counter(), Counter()
    for (f, x), n in y.items():
        most[x] = max(most[x], n)
        whole[x] += n
        docs[x] += texts[f, x]
    want = {(f, x, n, texts[f, x], whole[x], docs[x]) for (f, x), n in y.items() if most[x] >= mining.LEAST_COUNT}
    df = spark.createDataFrame(rows, "family string, text string").repartition(5)
    counts, totals = mining.used_often(df)
    got = [tuple(r) for r in counts.select("family", "feature", "y", "df", "y_w", "df_w").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) < len(y)
    assert {(r.family, r.total, r.samples) for r in totals.collect()} == {(f, total[f], n) for f, n in samples.items()}


def test_a_feature_goes_on_in_the_next_rows(monkeypatch):
    import pyarrow as pa

    rows = [("f", "a", 2), ("f", "a", 2), ("f", "b", 1), ("f", "b", 1), ("f", None, 1), ("g", "a", 4), ("h", "a", 3), ("h", "b", 5)]
    batches = [pa.RecordBatch.from_pylist([{"family": g, "feature": x, "y": n, "df": 1}], pa.schema([("family", pa.string()), ("feature", pa.string()), ("y", pa.int64()), ("df", pa.int64())])) for x, g, n in [*rows[:3], ("f", "b", 9), *rows[3:]]]
    for size in (1, 2, 3, 100):
        monkeypatch.setattr(mining, "MERGED_ROWS", size)
        out = [tuple(r.values()) for b in mining.merge_partition(iter(batches)) for r in b.to_pylist()]
        assert out == [("a", "f", 4, 2, 16, 6), ("b", "f", 11, 3, 16, 6), (None, "f", 1, 1, 16, 6), ("a", "h", 3, 1, 8, 2), ("b", "h", 5, 1, 8, 2)]


def test_mining_shuffles_all_counts_once(spark):
    rows = spark.createDataFrame([("a", "x y")], "family string, text string")
    made = []
    real = mining.materialise
    mining.materialise = lambda df, label: (made.append((label, df._jdf.queryExecution().executedPlan().toString())), real(df, label))[1]
    try:
        mining.used_often(rows)
    finally:
        mining.materialise = real
    plan = made[0][1]
    assert made[0][0] == "counts" and plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan

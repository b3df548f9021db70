"""Counts of each text's own features."""

from collections import Counter

from textassay.functions.bag import feature_bag
from textassay.operators import mining
from textassay.plans.entries import ENTRIES

SF = "/root/testdata/sf0.001"


def test_counts_of_repeated_ids_are_summed(spark):
    rows = [(1, "a b a b"), (2, "a b"), (1, "b a b"), (None, "a"), (None, "a b"), (3, None)]
    got = mining.text_counts(spark.createDataFrame(rows, "doc_id long, text string"), "wb").collect()
    want = Counter((i, f) for i, t in rows for f in feature_bag(t or "") if f[0] in "wb")
    assert {(r.doc_id, r.feature): r.n for r in got} == want and len(got) == len(want)


def test_features_of_texts_are_not_shuffled(spark):
    for name in ("tok_words", "tok_bigrams", "tok_punct", "tok_layout"):
        plan = ENTRIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "hashpartitioning" not in plan, name

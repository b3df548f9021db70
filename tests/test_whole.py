"""Queries see every document, and all of it."""

import __spark_entry__

from textassay.functions import exact
from textassay.operators import lint
from textassay.plans.entries import ENTRIES
from textassay.plans.fixtures import whole
from textassay.plans.lint_queries import ENGINE

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_reports_see_every_document(spark):
    every = ids(spark.read.parquet(f"{SF}/documents.parquet"))
    assert ids(__spark_entry__.entry(spark)) == every
    for name in ("lint_report", "prose_words", "lint_json", "fix_full", "fix_word_swaps", "fix_guarantee", "who_call"):
        assert ids(ENTRIES[name][0](spark, SF)) == every, name


def test_no_text_is_emptied(spark):
    own = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in whole(spark, SF).collect()}
    assert texts.keys() == own.keys() and all(texts[i].startswith(own[i] + " ") for i in own)
    words = {i: exact.lint_text(t, ENGINE)[1] for i, t in texts.items()}
    assert {r.doc_id: r.words for r in ENTRIES["lint_report"][0](spark, SF).collect()} == words


def test_rewriting_never_adds_weight(spark):
    rows = ENTRIES["fix_guarantee"][0](spark, SF).collect()
    assert all(r.not_heavier for r in rows)


def test_uniform_sentences(spark):
    even = "One two three four. Five six seven eight. " * 4 + "One two three four."
    rows = spark.createDataFrame([(1, even), (2, even.replace("Five six", "Five " * 12 + "six", 2))], "doc_id long, text string")
    assert [(r.doc_id, r.rule_id) for r in lint.findings(rows, ENGINE).collect()] == [(1, "S002")]

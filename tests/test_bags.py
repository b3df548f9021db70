"""Bags of batches against the bag of one text."""

import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from textassay.functions.bag import feature_bag
from textassay.functions.bags import bags
from textassay.operators import mining

SF = "/root/testdata/sf0.001"
ODD = "aAbΣσİßéÉ'  \n\n\r\t.1²٣-*#`  \u00a0\u3000😀—ͅᾈⅣZ"


def counted(texts):
    found = bags(pa.array(texts, pa.string()))
    names, out = found.names.to_pylist(), [Counter() for _ in texts]
    for row, code, n in zip(found.rows.tolist(), found.codes.tolist(), found.counts.tolist(), strict=True):
        assert names[code] not in out[row]
        out[row][names[code]] = n
    return out


def test_batches_equal_single_texts():
    pick = random.Random(5)
    made = ["".join(pick.choice(ODD) for _ in range(pick.choice((0, 1, 2, 3, 5, 40, 200)))) for _ in range(2000)]
    made += ["", None, ".", " 1. x", "1.", " 1 x", "``", "`", "```", "- ", "-", " a", "**", "*", "#", "x" * 31, "y" * 32, "é" * 16, "z" * 31 + " " + "q" * 40 + " z"]
    texts = made + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    want = [Counter(feature_bag(t or "")) for t in texts]
    assert counted(texts) == want and counted(texts[::-1]) == want[::-1]
    assert counted([]) == [] and counted([None, ""]) == [Counter(), Counter()]
    part = pa.array(texts, pa.string()).slice(7, 50)
    assert bags(part).size == 50 and sum(bags(part).counts) == sum(sum(w.values()) for w in want[7:57])


def test_broken_characters_are_marks():
    raw = pa.array([b"ab \xff\xfe c", b"d\xc3"], pa.binary())
    found = bags(pa.StringArray.from_buffers(2, *raw.buffers()[1:]))
    assert dict(zip(found.names.to_pylist(), [0] * 99)).keys() >= {"w:ab", "w:c", "w:d", "p:\ufffd"}


def test_batches_are_faster_than_single_texts():
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() * 5
    bags(pa.array(texts))
    seconds = []
    for make in (lambda: bags(pa.array(texts)), lambda: [Counter(feature_bag(t)) for t in texts]):
        took = []
        for _ in range(3):
            began = time.process_time()
            make()
            took.append(time.process_time() - began)
        seconds.append(min(took))
    assert seconds[0] * 2 < seconds[1]


def test_mining_reads_texts_in_batches_and_sends_its_vocabulary(spark):
    rows = spark.createDataFrame([(k, f, f"{f} walks on, {f} runs {k}.") for k in range(40) for f in ("a", "b")], "doc_id long, family string, text string")
    plan = mining.feature_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan
    catalog = mining.mine(rows, 50)
    rates = {(r.feature, r.family): r.rate for r in catalog.weights.collect()}
    assert rates["w:a", "b"] == 0 < rates["w:a", "a"] and rates["w:walks", "a"] == rates["w:walks", "b"] > 0

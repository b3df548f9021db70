"""Catalogs, attribution, evaluation, corpora, harvests, readers, writers, streams and the command line."""

import io
import json

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textassay.__main__ import main
from textassay.functions.bag import feature_bag
from textassay.functions.hashing import fnv1a_mod
from textassay.functions.registered import load_catalog, register
from textassay.operators import attribution, corpora, evaluation, harvest, mining, training
from textassay.sources import readers, writers
from textassay.sources.chat import chat_transport
from textassay.streaming.samples import lint_stream, sample_stream

ALPHA = "Moreover, the {0} is robust. Furthermore, we note the {0} again; moreover it holds."
BETA = "the {0} works. i checked the {0} twice and it was fine. plain words here."
NONSENSE = "zz qq {0} vv kk {0} jj xx ww"
NOUNS = ["system", "parser", "table", "engine", "index", "cache", "queue", "graph", "model", "scanner"]


def writers_corpus(spark, rejection=False):
    rows = [(k, fam, f"p{k % 12}", text.format(NOUNS[k % 10])) for fam, text in (("alpha", ALPHA), ("beta", BETA)) for k in range(60)]
    if rejection:
        rows += [(k, "unmatched", "", NONSENSE.format(NOUNS[k % 10])) for k in range(60)]
    return spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, family string, prompt_id string, text string")


@pytest.fixture(scope="module")
def catalog(spark):
    return training.fit(writers_corpus(spark), 200, 8, trainer="replay").persist()


def ask(spark, catalog, text, margin=0.3, matched=4):
    return attribution.who(spark.createDataFrame([(0, text)], "doc_id long, text string"), catalog, min_confidence=margin, min_matched=matched).first()


def test_two_writers_are_told_apart(spark, catalog):
    a = ask(spark, catalog, ALPHA.format("compiler"))
    assert a.call == "alpha" and "w:moreover" in [r.feature for r in a.receipts] and len(a.receipts) <= 8
    assert ask(spark, catalog, BETA.format("compiler")).call == "beta"
    none = ask(spark, catalog, "zzz qqq", 0.5)
    assert none.call is None and none.receipts == [] and none.catalog == ["alpha", "beta"]
    for row in (a, none):
        assert abs(sum(c.probability for c in row.ranked) - 1) < 1e-9 and 0 <= row.confidence <= 1


def test_fit_twice_is_the_same(spark, catalog):
    again = training.fit(writers_corpus(spark).repartition(7), 200, 8, trainer="replay")
    rows = lambda c: sorted(map(tuple, c.weights.select("feature", "family", "w").collect()))
    assert rows(again) == rows(catalog)


def test_rejection_class(spark):
    catalog = training.fit(writers_corpus(spark, True), 200, 8, trainer="replay").persist()
    odd = ask(spark, catalog, NONSENSE.format("lamp"), 0.0)
    assert odd.ranked[0].family == "unmatched" and odd.call is None
    assert ask(spark, catalog, ALPHA.format("lamp")).call == "alpha"


def test_lbfgs_agrees(spark):
    catalog = training.fit(writers_corpus(spark), 100).persist()
    assert ask(spark, catalog, ALPHA.format("x")).call == "alpha" and ask(spark, catalog, BETA.format("x")).call == "beta"


def test_replay_takes_steps_in_single_precision():
    w, b = training.replay([0, 1], [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))], 2, 2, 3)
    assert w.dtype == np.float32 and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 and np.allclose(b.sum(), 0, atol=1e-5)


def test_evaluation_of_two_writers(spark):
    rows = writers_corpus(spark, True).withColumn("prompt_id", F.concat("prompt_id", F.col("doc_id").cast("string")))
    out = evaluation.evaluate(rows, 100, floor=0.9, trainer="lbfgs", negatives=rows.limit(5))
    assert out["accuracy"].first().accuracy == 1.0 and out["threshold"].first().step == 0
    assert {r.truth for r in out["confusion"].collect()} == {"alpha", "beta"} and out["control"].first().n > 5


def slow_fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % 100


def test_fnv(spark):
    texts = ["", "a", "prompt-17", "éü😀", "x" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv1a_mod(F.col("t"), 100).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: slow_fnv(t) for t in texts}


def test_mining_of_empty_and_odd_texts(spark):
    rows = spark.createDataFrame([(0, "a", None), (1, "a", ""), (2, "b", "it's é\r\n\n# x\n- y")], "doc_id long, family string, text string")
    counts = {(r.family, r.feature): r.y for r in mining.feature_counts(rows).collect()}
    assert counts == {("b", f): n for f, n in {"w:it's": 1, "w:é": 1, "w:x": 1, "w:y": 1, "b:it's é": 1, "b:é x": 1, "b:x y": 1, "p:#": 1, "p:-": 1, "s:line_short": 1, "s:blank": 1, "s:heading": 1, "s:bullet": 1}.items()}
    assert mining.mine(rows, 5).features.collect() == []


def pend(spark, battery, done, target, family="m"):
    b = spark.createDataFrame(list(enumerate(battery)), "place long, prompt_id string")
    d = spark.createDataFrame(done, "family string, prompt_id string")
    m = spark.createDataFrame([(0, family, target)], "model_idx int, family string, target int")
    return [r.prompt_id for r in harvest.pending(b, m, d).orderBy("turn").collect()]


def test_pending(spark):
    five = [f"p{k}" for k in range(5)]
    assert pend(spark, five, [("m", "p0"), ("m", "p2")], 5) == ["p1", "p3", "p4"]
    assert pend(spark, five[:3], [("other", "p0")], 5) == five[:3]
    assert len(pend(spark, five, [("m", "p0"), ("m", "p1")], 4)) == 2 and pend(spark, five, [("m", "p0")], 1) == []
    assert pend(spark, five, [("m", p) for p in five], 9) == [] and pend(spark, five, [("m", "x"), ("m", "y")], 3) == ["p0"]


def test_harvest_loop():
    config = harvest.Config("http://x", delay_secs=0, per_run=5, strikes=2, backoff_secs=3, models=(harvest.Model("a", "p", "a"), harvest.Model("b", "p", "b"), harvest.Model("c", "p", "c")))
    now, asked, out = [0.0], [], []

    def answer(model, prompt):
        asked.append((model.family, prompt))
        if model.family == "b" and len(asked) < 4:
            raise RuntimeError("HTTP 429")
        return ("" if model.family == "c" else f"{prompt}!", "up")

    def sleep(s):
        now[0] += s + 0.5

    got = harvest.harvest(config, [[("1", "x"), ("2", "y")], [("1", "x")], [("1", "x"), ("2", "y"), ("3", "z")]], answer, out.append, "now", lambda: now[0], sleep)
    assert got == {"a": 2, "b": 1} and [json.loads(x)["prompt_id"] for x in out] == ["1", "2", "1"]
    assert [p for f, p in asked if f == "c"] == ["x", "y"] and [p for f, p in asked if f == "b"] == ["x", "x"]


def test_samples_name_their_source():
    config = harvest.Config("http://h/v1", delay_secs=0, models=(harvest.Model("a", "p", "m"),))
    out = []
    assert harvest.harvest(config, [[("1", "x")]], lambda model, prompt: ("said", "up"), out.append, "now") == {"a": 1}
    assert json.loads(out[0]) == {"family": "a", "provider": "p", "model": "m", "prompt_id": "1", "source": "harvest/http://h/v1", "upstream": "up", "harvested_at": "now", "text": "said"}


def test_a_cooling_model_is_waited_for_and_others_are_asked():
    config = harvest.Config("http://h", delay_secs=0, backoff_secs=9, models=(harvest.Model("a", "p", "a"), harvest.Model("b", "p", "b")))
    now, slept, asked = [100.0], [], []

    def ask(model, prompt):
        asked.append((now[0], model.family, prompt))
        now[0] += 1
        if len(asked) == 1:
            raise RuntimeError("Rate Limit reached")
        return "yes", "up"

    def sleep(s):
        slept.append(s)
        now[0] += s

    got = harvest.harvest(config, [[("1", "x")], [("1", "x"), ("2", "y")]], ask, lambda line: None, "t", lambda: now[0], sleep)
    assert got == {"b": 2, "a": 1} and [f for _, f, _ in asked] == ["a", "b", "b", "a"] and asked[-1][0] == 110 and slept == [7]


def test_chat_transport():
    config = harvest.Config("http://h/v1/", api_key="k", models=(harvest.Model("a", "p", "m"),))
    seen = []

    def answering(body):
        def open_url(request, timeout):
            seen.append((request.full_url, dict(request.header_items()), json.loads(request.data), timeout))
            return io.BytesIO(json.dumps(body).encode())

        return chat_transport(config, open_url)

    model = config.models[0]
    assert answering({"choices": [{"message": {"content": "hi"}}], "model": "m-2"})(model, "q") == ("hi", "m-2")
    url, headers, body, timeout = seen[0]
    assert url == "http://h/v1/chat/completions" and headers["Authorization"] == "Bearer k" and timeout == 420
    assert body == {"model": "m", "messages": [{"role": "user", "content": "q"}], "max_tokens": 1024, "stream": False}
    assert answering({"choices": [{"message": {"content": None}}]})(model, "q") == ("", "m") == answering({})(model, "q")
    with pytest.raises(RuntimeError, match="429"):
        answering({"error": {"code": 429}})(model, "q")


def test_bags_of_both_paths(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["", "\n", "a\r\n\n# x\n- y\n**z\n1. q\n```", "it's “é” ² x_y"]
    rows = mining.with_features(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in rows:
        assert sorted(feature_bag(texts[r.i])) == sorted(r.features), texts[r.i][:80]


def test_attribution_in_sql(spark, catalog):
    load_catalog(spark, catalog, min_matched=4)
    row = spark.sql(f"SELECT assay_who('{ALPHA.format('lamp')}', 0.3D) AS w, assay_who(NULL, 0.3D) AS n").first()
    said, want = json.loads(row.w), ask(spark, catalog, ALPHA.format("lamp"))
    assert row.n is None and said["call"] == want.call == "alpha" and said["matched"] == want.matched and abs(said["confidence"] - want.confidence) < 1e-9
    assert [r["feature"] for r in said["receipts"]] == [r.feature for r in want.receipts] and said["catalog"] == ["alpha", "beta"]
    with pytest.raises(RuntimeError):
        load_catalog(spark, catalog)


def test_rows_with_one_id_stay_apart(spark, catalog):
    rows = spark.createDataFrame([(1, ALPHA.format("a")), (1, BETA.format("b")), (None, ALPHA.format("c")), (2, None)], "doc_id long, text string")
    found = attribution.who(rows, catalog, min_matched=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.call or "") for r in found) == [(False, 1, "alpha"), (False, 1, "beta"), (False, 2, ""), (True, 0, "alpha")]
    assert "Exchange" not in attribution.attributed(rows, catalog)._jdf.queryExecution().executedPlan().toString()
    assert mining.vectors(rows, catalog).filter("id = 1").count() == sum(r.matched for r in found if r.doc_id == 1)


def test_readers_and_writers(spark, catalog, tmp_path):
    lines = tmp_path / "c.jsonl"
    lines.write_text('{"family": "a", "text": "x", "more": 1}\n\n{"family": "b", "prompt_id": "7", "text": "y"}\n')
    assert sorted(map(tuple, readers.read_corpus(spark, str(lines)).collect())) == [("a", "", "x"), ("b", "7", "y")]
    (tmp_path / "bad.jsonl").write_text('{"family": "a", "text": \n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "short.jsonl").write_text('{"family": "a"}\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_corpus(spark, str(tmp_path / "short.jsonl")).collect()
    assert readers.read_texts(spark, str(lines)).first().text == lines.read_text()
    writers.write_catalog(catalog, str(tmp_path / "cat"))
    toml = writers.catalog_toml(catalog, "test")
    for back in (readers.read_catalog(spark, str(tmp_path / "cat")), readers.parse_catalog(spark, toml)):
        key = lambda c: sorted((r.feature, r.family, round(r.w, 5)) for r in c.weights.collect())
        assert key(back) == key(catalog)
    assert json.loads(corpora.atlas_json(catalog, "w:moreover").first().atlas)["rows"][0][0] == "alpha"
    row = attribution.who(spark.createDataFrame([(0, ALPHA.format("x"))], "doc_id long, text string"), catalog, min_matched=4).first().asDict(recursive=True)
    assert writers.attribution_lines(row)[0].startswith("alpha") and writers.exit_code("heavy", "seasoned") == 1 and writers.exit_code("clean", "seasoned") == 0


def test_stream_lints_each_sample_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda p, t: json.dumps({"family": "a", "prompt_id": p, "harvested_at": "2026-01-01T00:00:00Z", "text": t})
    run = lambda: lint_stream(sample_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "1.json").write_text("\n".join([line("1", "We delve."), line("1", "again"), line("2", "plain")]))
    run()
    (tmp_path / "in" / "2.json").write_text(line("2", "seen") + "\n" + line("3", "robust"))
    run()
    got = {r.sample: r.n_findings for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"a/1", "a/2", "a/3"} and got["a/3"] == 1


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT assay_fix('We leverage it') AS f, assay_lint('We leverage it') AS r, assay_fix(NULL) AS n").first()
    assert row.f == "We use it" and json.loads(row.r)["findings"][0]["rule_id"] == "T011" and row.n is None


def test_command_line(tmp_path, capsys):
    page = tmp_path / "a.md"
    page.write_text("We leverage tools.")
    assert main(["lint", str(page), "--fail-on", "heavy"]) == 1 and main(["lint", str(page), "--json"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out[out.index("\n{") :])["band"] == "heavy"
    assert main(["fix", str(page), "--write"]) == 0 and page.read_text() == "We use tools."
    assert main(["lint", str(tmp_path / "missing")]) == 2

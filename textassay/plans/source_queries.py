"""Queries of features, mining, attribution, evaluation, corpora and harvests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textassay.functions import features as X
from textassay.operators import attribution, corpora, evaluation, harvest, mining, training
from textassay.operators.mining import Catalog

from .fixtures import CORPUS_SQL, SCORED_SQL, corpus, documents, scored

TOP_K = 2000

# --- tokens

WORDS_SQL = r"list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}'']+'), lambda w: w <> '' AND strlen(w) < 32), lambda w: lower(w))"
WORD_BAG = f"list_transform({WORDS_SQL}, lambda w: 'w:' || w)"
PAIR_BAG = "CASE WHEN len(ws) > 1 THEN list_transform(ws[1:len(ws)-1], lambda w, i: 'b:' || w || ' ' || ws[i + 1]) ELSE [] END"
MARK_BAG = r"list_transform(regexp_extract_all(text, '[^\p{L}\p{N}\s'']'), lambda c: 'p:' || c)"
KIND_SQL = r"""CASE WHEN starts_with(t, '```') THEN 'fence' WHEN starts_with(t, '#') THEN 'heading'
 WHEN starts_with(t, '- ') OR starts_with(t, '* ') THEN 'bullet' WHEN starts_with(t, '**') THEN 'boldlead'
 WHEN regexp_matches(t, '^[0-9]') AND contains(t, '. ') THEN 'numlist' WHEN t = '' THEN 'blank'
 WHEN n < 10 THEN 'line_short' WHEN n < 25 THEN 'line_mid' WHEN n < 50 THEN 'line_long' ELSE 'line_para' END"""
LINES_SQL = lambda source: rf"""
    SELECT doc_id, family, 's:' || {KIND_SQL} AS feature FROM (
        SELECT doc_id, family, t, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n FROM (
            SELECT doc_id, family, regexp_replace(regexp_replace(unnest(CASE WHEN ends_with(text, chr(10)) OR text = '' THEN lines[1:len(lines)-1] ELSE lines END), '\r$', ''), '^\s+', '') AS t
            FROM (SELECT doc_id, family, text, string_split(text, chr(10)) AS lines FROM ({source}))))"""
BAG_SQL = f"""
    SELECT doc_id, family, unnest({WORD_BAG}) AS feature FROM ({CORPUS_SQL})
    UNION ALL SELECT doc_id, family, unnest({PAIR_BAG}) FROM (SELECT doc_id, family, {WORDS_SQL} AS ws FROM ({CORPUS_SQL}))
    UNION ALL SELECT doc_id, family, unnest({MARK_BAG}) FROM ({CORPUS_SQL})
    UNION ALL {LINES_SQL(CORPUS_SQL)}"""


def counted(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """How often each feature of one kind stands in each text."""
    return mining.text_counts(documents(spark, sf_dir), kind)


def tok_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, "w")


def tok_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, "b")


def tok_pairs_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by a window over exploded words."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(X.words(F.col("text"))).alias("pos", "w"))
    paired = rows.withColumn("next", F.lead("w").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("next IS NOT NULL")
    return paired.select("doc_id", F.concat(F.lit("b:"), "w", F.lit(" "), "next").alias("feature")).groupBy("doc_id", "feature").agg(F.count(F.lit(1)).alias("n"))


def tok_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, "p")


def tok_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, "s")


KIND_COUNT = lambda prefix: f"SELECT doc_id, feature, count(*) AS n FROM ({BAG_SQL}) WHERE starts_with(feature, '{prefix}') GROUP BY doc_id, feature"

# --- mining

COUNTS_SQL = f"SELECT family, feature, count(*) AS y, count(DISTINCT doc_id) AS df FROM ({BAG_SQL}) GROUP BY family, feature"
MINED = f"""
    counts AS MATERIALIZED ({COUNTS_SQL}),
    pooled AS (SELECT feature, sum(y) AS y_w, sum(df) AS df FROM counts GROUP BY feature),
    totals AS (SELECT family, sum(y) AS total FROM counts GROUP BY family),
    samples AS (SELECT family, count(*) AS samples FROM ({CORPUS_SQL}) GROUP BY family),
    whole AS (SELECT sum(total)::DOUBLE AS n, (SELECT sum(samples) FROM samples)::DOUBLE AS docs FROM totals),
    prior AS (SELECT c.family, c.feature, c.y, c.y + 1000.0e0 * (p.y_w::DOUBLE / w.n) AS own, p.y_w + 1000.0e0 * (p.y_w::DOUBLE / w.n) AS pool, t.total::DOUBLE AS total, w.n
              FROM counts c JOIN pooled p USING (feature) JOIN totals t USING (family), whole w WHERE c.y >= 5),
    scored AS (SELECT family, feature, y, (ln(own / (total + 1000.0e0 - own)) - ln(pool / (n + 1000.0e0 - pool))) / sqrt(1 / own + 1 / pool) AS z FROM prior),
    top AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY round(abs(z), 6) DESC, feature) AS rank FROM scored QUALIFY rank <= {TOP_K}),
    vocabulary AS MATERIALIZED (SELECT DISTINCT feature FROM top),
    features AS MATERIALIZED (SELECT feature, ln((1 + docs) / (1 + df)) + 1 AS idf, y_w / n * 1000 AS base FROM vocabulary JOIN pooled USING (feature), whole),
    weights AS MATERIALIZED (
        SELECT v.feature, t.family, coalesce(c.y::DOUBLE / t.total * 1000, 0) AS rate FROM vocabulary v CROSS JOIN totals t LEFT JOIN counts c ON c.family = t.family AND c.feature = v.feature)"""


def mine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.feature_counts(corpus(spark, sf_dir)).select("family", "feature", "y", "df")


def mine_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of the counts in one pass: family and feature, each alone, and the whole."""
    return mining.grouped_counts(corpus(spark, sf_dir))


def mine_docfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.pooled_counts(corpus(spark, sf_dir))


def mine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    return mining.family_totals(mining.feature_counts(rows), rows)


def mine_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir)
    scored_rows = mining.scored_features(*mining.used_often(rows))
    return mining.nominated(scored_rows, TOP_K).select("family", "rank", "feature", "y", F.round("z", 6).alias("z"))


def mined(spark: SparkSession, sf_dir: str) -> Catalog:
    return mining.mine(corpus(spark, sf_dir), TOP_K)


def weighed(catalog: Catalog) -> Catalog:
    """A catalog with weights from the rates alone, so that SQL can check what follows."""
    weights = catalog.weights.join(catalog.features.select("feature", "base"), "feature").select("feature", "family", "rate", F.round(F.log((F.col("rate") + 0.1) / (F.col("base") + 0.1)), 6).alias("w"))
    return Catalog(catalog.features, weights, catalog.families).stored()


def mine_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.with_index(mined(spark, sf_dir)).select("feature", F.col("idx").cast("long").alias("idx"))


def mine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir).features.select("feature", F.round("idf", 6).alias("idf"), F.round("base", 6).alias("base"))


def mine_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir).weights.select("feature", "family", F.round("rate", 6).alias("rate"))


def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mining.vectors(corpus(spark, sf_dir), mined(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "feature", F.round("v", 6).alias("v"))


# --- attribution

VECTORS = f"""
    {MINED},
    weighted AS MATERIALIZED (SELECT w.feature, w.family, w.rate, f.base, round(ln((w.rate + 0.1e0) / (f.base + 0.1e0)), 6) AS w FROM weights w JOIN features f USING (feature)),
    raw AS (SELECT doc_id, feature, (1 + ln(count(*)::DOUBLE)) * any_value(idf) AS x FROM ({BAG_SQL}) JOIN features USING (feature) GROUP BY doc_id, feature),
    vectors AS MATERIALIZED (SELECT doc_id, feature, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS v FROM raw)"""
POSTERIORS = f"""
    {VECTORS},
    pulled AS (SELECT doc_id, family, sum(w * v) AS score, count(*) AS matched FROM vectors JOIN weighted USING (feature) GROUP BY doc_id, family),
    scores AS MATERIALIZED (SELECT d.doc_id, s.family, coalesce(p.score, 0) AS score, coalesce(p.matched, 0) AS matched FROM ({CORPUS_SQL}) d CROSS JOIN samples s LEFT JOIN pulled p ON p.doc_id = d.doc_id AND p.family = s.family),
    raised AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS e FROM scores),
    shared AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS probability FROM raised),
    posterior AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(probability, 9) DESC, family) AS rank FROM shared),
    decided AS (SELECT doc_id, max(family) FILTER (WHERE rank = 1) AS top, max(family) FILTER (WHERE rank = 2) AS runner,
                       max(probability) FILTER (WHERE rank = 1) - max(probability) FILTER (WHERE rank = 2) AS confidence, max(matched) AS matched
                FROM posterior GROUP BY doc_id),
    called AS (SELECT *, CASE WHEN matched >= 40 AND confidence >= 0.3 AND top <> 'unmatched' THEN top END AS call FROM decided)"""


def attributed(spark: SparkSession, sf_dir: str, most: int = 0) -> DataFrame:
    """Without evidence, unless ``most`` is given."""
    return attribution.attributed(corpus(spark, sf_dir), weighed(mined(spark, sf_dir)), most=most)


def who_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.scores(attributed(spark, sf_dir)).select(F.col("id").alias("doc_id"), "family", F.round("score", 6).alias("score"), "matched")


def who_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.posteriors(attributed(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "family", F.round("probability", 6).alias("probability"), F.col("rank").cast("long").alias("rank"))


def who_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.decisions(attributed(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "top", "runner", F.round("confidence", 5).alias("confidence"), "matched", "call")


def who_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribution.receipts(attributed(spark, sf_dir, attribution.RECEIPTS))
    return found.select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "feature", F.round("contribution", 6).alias("contribution"), F.round("rate", 6).alias("rate"), F.round("baseline", 6).alias("baseline"))


def who_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attribution.who(corpus(spark, sf_dir), weighed(mined(spark, sf_dir)))
    return attribution.closest(rows).select("doc_id", F.size("ranked").alias("families"), F.get("closest", 0)["family"].alias("closest"), "call", F.array_join("catalog", ",").alias("catalog"))


# --- evaluation

FNV_SQL = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(strlen(prompt_id)), lambda i: ascii(substr(prompt_id, (i + 1)::INT, 1))::HUGEINT)), lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.split_holdout(corpus(spark, sf_dir))
    return rows.select("doc_id", F.col("bucket").cast("long").alias("bucket"), "is_train")


def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.truncate_words(corpus(spark, sf_dir), 50).select("doc_id", "text")


def eval_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.forced_choice(scored(spark, sf_dir)).select("n", "hits", F.round("accuracy", 6).alias("accuracy"))


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.sweep(scored(spark, sf_dir))
    return rows.select("step", "called", "hits", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


def eval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.threshold(evaluation.sweep(scored(spark, sf_dir)))
    return rows.select("step", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


def eval_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.control(scored(spark, sf_dir), 0.5).select("n", "called", F.round("false_positive_rate", 6).alias("false_positive_rate"))


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(scored(spark, sf_dir), ["de", "en", "fr", "unmatched"], 0.5)


SWEEP_SQL = f"""
    SELECT step::INT AS step, called, hits, round(hits / called::DOUBLE, 6) AS precision, round(called / n::DOUBLE, 6) AS coverage
    FROM (SELECT g.step, count(*) FILTER (WHERE confidence >= g.step * 0.01e0 AND pred <> 'unmatched') AS called,
                 count(*) FILTER (WHERE confidence >= g.step * 0.01e0 AND pred <> 'unmatched' AND pred = truth) AS hits, count(*) AS n
          FROM ({SCORED_SQL}) s, range(100) g(step) WHERE truth <> 'unmatched' GROUP BY g.step) WHERE called > 0"""

# --- corpora and harvests


def era_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.hash_sample(corpus(spark, sf_dir), 20, "family", F.col("doc_id")).select("family", "doc_id")


def era_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all corpora of an era, by family."""
    rows = corpus(spark, sf_dir)
    made = corpora.era_corpora(rows.filter("family != 'unmatched'"), rows.filter("family = 'unmatched'"), {"a": "de", "b": "en", "c": "fr"}, ["a", "b"], 30)
    out = None
    for name, df in made.items():
        part = df.groupBy("family").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("corpus"), "family", "n")
        out = part if out is None else out.unionByName(part)
    return out


ERA_SQL = f"""
    WITH n AS (SELECT family, least(count(*), 30) AS n FROM ({CORPUS_SQL}) GROUP BY family),
    parts(corpus, family) AS (VALUES ('catalog', 'de'), ('catalog', 'en'), ('catalog', 'fr'), ('catalog', 'unmatched'), ('vendors', 'de'), ('vendors', 'en'), ('vendors', 'unmatched'), ('pair-a-b', 'de'), ('pair-a-b', 'en'))
    SELECT corpus, family, n FROM parts JOIN n USING (family)"""


def vendor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.vendor_pairs(documents(spark, sf_dir).select(F.col("source").alias("family")).distinct())


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prompt_id").alias("prompts"))


def replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.split("text", " ")).alias("n_words")
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    first = lambda role: said.filter(F.col("role") == role).groupBy(F.col("conv_id").alias("prompt_id")).agg(F.min_by("text", "turn").alias("text")).select("prompt_id", words)
    rows = corpora.replication(first("user"), first("assistant"))
    return rows.select("matched", F.round("ours", 4).alias("ours"), F.round("theirs", 4).alias("theirs"), F.round("ratio", 6).alias("ratio"))


REPLICATION_SQL = """
    WITH first AS (SELECT conv_id, role, len(string_split(arg_min(text, turn), ' ')) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role)
    SELECT count(*) AS matched, round(median(a.n), 4) AS ours, round(median(b.n), 4) AS theirs, round(median(b.n) / median(a.n), 6) AS ratio
    FROM first a JOIN first b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'"""


def atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.atlas_row(mined(spark, sf_dir), "w:the").select("feature", "family", F.round("rate", 6).alias("rate"))


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages whose references to an asset that many of them name carry the page's own stamp."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", corpora.stamp(F.col("html")).alias("stamp"), F.md5(corpora.stamped(F.col("html"), "href", "de", F.col("html"))).alias("page_md5"))


def _harvest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    battery = said.select(F.col("conv_id").alias("place")).distinct().withColumn("prompt_id", F.col("place").cast("string"))
    done = harvest.done_pairs(said.filter("turn = 0 AND role IS NOT NULL").select(F.col("role").alias("family"), F.col("conv_id").cast("string").alias("prompt_id")))
    models = spark.createDataFrame([(0, "user", 60), (1, "assistant", 40), (2, "system", 1), (3, "other", 25)], "model_idx int, family string, target int")
    return battery, models, done


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.pending(*_harvest(spark, sf_dir)).select("model_idx", "family", F.col("turn").cast("long").alias("turn"), "prompt_id")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harvest.round_robin(harvest.pending(*_harvest(spark, sf_dir)), 50)
    return rows.select("model_idx", F.col("turn").cast("long").alias("turn"), "prompt_id")


PENDING_SQL = """
    WITH battery AS (SELECT DISTINCT conv_id AS place, CAST(conv_id AS VARCHAR) AS prompt_id FROM conversations),
    done AS (SELECT DISTINCT role AS family, CAST(conv_id AS VARCHAR) AS prompt_id FROM conversations WHERE turn = 0 AND role IS NOT NULL),
    models(model_idx, family, target) AS (VALUES (0, 'user', 60), (1, 'assistant', 40), (2, 'system', 1), (3, 'other', 25)),
    owed AS (SELECT model_idx, m.family, greatest(target - (SELECT count(*) FROM done d WHERE d.family = m.family), 0) AS owed FROM models m)
    SELECT model_idx, family, turn, prompt_id FROM (
        SELECT o.model_idx, o.family, o.owed, b.prompt_id, row_number() OVER (PARTITION BY o.model_idx ORDER BY b.place) AS turn
        FROM battery b CROSS JOIN owed o WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.family = o.family AND d.prompt_id = b.prompt_id))
    WHERE turn <= owed"""

# --- training, rows only


def fit_lbfgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.fit(corpus(spark, sf_dir)).weights


def fit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.fit(corpus(spark, sf_dir), trainer="replay").weights


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evaluate(corpus(spark, sf_dir))["sweep"]


WITH = lambda ctes, select: f"WITH {ctes} {select}"

QUERIES = {
    "tok_words": (tok_words, KIND_COUNT("w:")),
    "tok_bigrams": (tok_pairs, KIND_COUNT("b:")),
    "tok_bigrams_window": (tok_pairs_window, KIND_COUNT("b:")),
    "tok_punct": (tok_marks, KIND_COUNT("p:")),
    "tok_layout": (tok_layout, KIND_COUNT("s:")),
    "mine_counts": (mine_counts, COUNTS_SQL),
    "mine_grouping_sets": (mine_grouping, f"SELECT family, feature, count(*) AS y FROM ({BAG_SQL}) GROUP BY GROUPING SETS ((family, feature), (feature), (family), ())"),
    "mine_docfreq": (mine_docfreq, f"SELECT feature, sum(y)::BIGINT AS y_w, sum(df)::BIGINT AS df FROM ({COUNTS_SQL}) GROUP BY feature"),
    "mine_totals": (mine_totals, WITH(MINED, "SELECT family, total::BIGINT AS total, samples FROM totals JOIN samples USING (family)")),
    "mine_logodds_topk": (mine_logodds, WITH(MINED, "SELECT family, rank, feature, y, round(z, 6) AS z FROM top")),
    "mine_vocab": (mine_vocabulary, WITH(MINED, "SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM vocabulary")),
    "mine_features": (mine_features, WITH(MINED, "SELECT feature, round(idf, 6) AS idf, round(base, 6) AS base FROM features")),
    "mine_catalog_rates": (mine_rates, WITH(MINED, "SELECT feature, family, round(rate, 6) AS rate FROM weights")),
    "tfidf_vectors": (tfidf, WITH(VECTORS, "SELECT doc_id, feature, round(v, 6) AS v FROM vectors")),
    "who_scores": (who_scores, WITH(POSTERIORS, "SELECT doc_id, family, round(score, 6) AS score, matched FROM scores")),
    "who_posterior": (who_posterior, WITH(POSTERIORS, "SELECT doc_id, family, round(probability, 6) AS probability, rank FROM posterior")),
    "who_call": (who_call, WITH(POSTERIORS, "SELECT doc_id, top, runner, round(confidence, 5) AS confidence, matched, call FROM called")),
    "who_receipts": (
        who_receipts,
        WITH(
            POSTERIORS,
            """SELECT doc_id, rank, feature, round(contribution, 6) AS contribution, round(rate, 6) AS rate, round(base, 6) AS baseline FROM (
                SELECT v.doc_id, v.feature, (a.w - b.w) * v.v AS contribution, a.rate, a.base, row_number() OVER (PARTITION BY v.doc_id ORDER BY round((a.w - b.w) * v.v, 9) DESC, v.feature) AS rank
                FROM vectors v JOIN called c ON c.doc_id = v.doc_id AND c.call IS NOT NULL JOIN weighted a ON a.feature = v.feature AND a.family = c.top JOIN weighted b ON b.feature = v.feature AND b.family = c.runner) WHERE rank <= 8""",
        ),
    ),
    "who_full": (who_full, WITH(POSTERIORS, "SELECT doc_id, (SELECT count(*) FROM samples)::INT AS families, top AS closest, call, (SELECT string_agg(family, ',' ORDER BY family) FROM samples) AS catalog FROM called")),
    "split_holdout": (split_holdout, f"SELECT doc_id, b AS bucket, b >= 20 AS is_train FROM (SELECT doc_id, ({FNV_SQL} % 100)::BIGINT AS b FROM ({CORPUS_SQL}))"),
    "truncate_words": (truncate, rf"SELECT doc_id, array_to_string(ws[1:50], ' ') AS text FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents) WHERE len(ws) >= 50"),
    "eval_forced_choice": (eval_forced, f"SELECT count(*) AS n, count(*) FILTER (WHERE pred = truth) AS hits, round(avg(CASE WHEN pred = truth THEN 1.0e0 ELSE 0 END), 6) AS accuracy FROM ({SCORED_SQL}) WHERE truth <> 'unmatched'"),
    "eval_sweep": (swept, SWEEP_SQL),
    "eval_threshold": (eval_threshold, f"SELECT step, precision, coverage FROM ({SWEEP_SQL}) WHERE precision >= 0.95 ORDER BY step LIMIT 1"),
    "eval_control_fp": (eval_control, f"SELECT count(*) AS n, count(*) FILTER (WHERE confidence >= 0.5 AND pred <> 'unmatched') AS called, round(count(*) FILTER (WHERE confidence >= 0.5 AND pred <> 'unmatched') / count(*)::DOUBLE, 6) AS false_positive_rate FROM ({SCORED_SQL}) WHERE truth = 'unmatched'"),
    "eval_confusion": (eval_confusion, "SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE confidence >= 0.5 AND pred = '{f}') AS {f}" for f in ("de", "en", "fr", "unmatched")) + f", count(*) FILTER (WHERE confidence < 0.5) AS abstain FROM ({SCORED_SQL}) WHERE truth <> 'unmatched' GROUP BY truth"),
    "era_sample": (era_sample, f"SELECT family, doc_id FROM ({CORPUS_SQL}) QUALIFY row_number() OVER (PARTITION BY family ORDER BY md5('7:' || doc_id), doc_id) <= 20"),
    "era_corpora": (era_corpora, ERA_SQL),
    "vendor_pairs": (vendor_pairs, "SELECT a.source AS a, b.source AS b FROM (SELECT DISTINCT source FROM documents) a, (SELECT DISTINCT source FROM documents) b WHERE a.source < b.source"),
    "group_counts": (group_counts, f"SELECT family, count(*) AS n, count(DISTINCT prompt_id) AS prompts FROM ({CORPUS_SQL}) GROUP BY family"),
    "replication_medians": (replication, REPLICATION_SQL),
    "atlas_row": (atlas, WITH(MINED, "SELECT feature, family, round(rate, 6) AS rate FROM weights WHERE feature = 'w:the'")),
    "asset_stamp": (stamps, r"""SELECT page_id, substr(sha256(html), 1, 8) AS stamp, md5(regexp_replace(html, 'href="/de(?:\?v=[0-9a-f]+)?"', 'href="/de?v=' || substr(sha256(html), 1, 8) || '"', 'g')) AS page_md5 FROM pages"""),
    "harvest_pending": (pending, PENDING_SQL),
    "harvest_round_robin": (round_robin, f"SELECT model_idx, turn, prompt_id FROM ({PENDING_SQL}) ORDER BY turn, model_idx LIMIT 50"),
    "fit_lbfgs": (fit_lbfgs, None),
    "fit_replay": (fit_replay, None),
    "evaluate_full": (evaluate, None),
}

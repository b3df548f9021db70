"""Queries of linting, masks, packs and rewriting, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textassay.functions import patterns as P
from textassay.functions import spans as S
from textassay.operators import fix as fixing
from textassay.operators import lint
from textassay.sources.packs import PACK_FILE, Engine, Pack, Rule, base_pack, literal_regex, rules_frame

from .fixtures import WHOLE_SQL, documents, whole

ENGINE = Engine.compile([base_pack()])
LITERALS = list(ENGINE.literals)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- spans


def spans_sql(source: str, pattern: str) -> str:
    """Byte and character places of all matches: ``doc_id, text, start_b, end_b, at_c, hit``."""
    p = q(pattern)
    size = lambda f, what, to: f"coalesce(list_sum(list_transform({what}[1:{to}], lambda x: {f}(x))), 0)::BIGINT"
    return f"""
        SELECT doc_id, text, hits[i] AS hit,
               {size("strlen", "gaps", "i")} + {size("strlen", "hits", "i-1")} AS start_b,
               {size("strlen", "gaps", "i")} + {size("strlen", "hits", "i")} AS end_b,
               {size("length", "gaps", "i")} + {size("length", "hits", "i-1")} + 1 AS at_c
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps
                    FROM ({source}) WHERE regexp_matches(text, {p})))
    """


IS_ALNUM = lambda x: f"regexp_matches({x}, '[0-9A-Za-z]')"
BOUNDED_SQL = f"""NOT (at_c > 1 AND {IS_ALNUM("substr(text, at_c - 1, 1)")} AND {IS_ALNUM("substr(hit, 1, 1)")})
 AND NOT ({IS_ALNUM("substr(hit, length(hit), 1)")} AND {IS_ALNUM("substr(text, at_c + length(hit), 1)")})"""
RULES_SQL = "(VALUES " + ", ".join(f"({q(form)}, {q(ENGINE.rules[k].id)}, {ENGINE.rules[k].weight:.6f})" for form, k in ENGINE.literals.items()) + ") rule(form, rule_id, weight)"
GUARD_WORDS = next(r.unless_preceded_by for r in ENGINE.rules if r.unless_preceded_by)
GUARD_SQL = f"NOT (rule_id = 'T016' AND lower(regexp_extract(substr(text, 1, at_c - 1), '([A-Za-z]*)[^A-Za-z0-9]*$', 1)) IN ({', '.join(map(q, GUARD_WORDS))}))"
EXCERPT_SQL = "CASE WHEN length(hit) <= 60 THEN hit ELSE substr(hit, 1, 57) || '...' END"


# The masks: candidates of every sort, each kept if its start is free of the sorts before; then merged.
CANDIDATES = lambda k, pattern: f"SELECT doc_id, {k} AS sort, start_b, end_b, at_c - 1 AS start_c, at_c - 1 + length(hit) AS end_c FROM ({spans_sql('SELECT doc_id, text FROM whole', pattern)})"
FREE = lambda k, earlier: f"SELECT c.* FROM candidates c WHERE sort = {k} AND NOT EXISTS (SELECT 1 FROM ({earlier}) e WHERE e.doc_id = c.doc_id AND c.start_b >= e.start_b AND c.start_b < e.end_b)"
MASK_CTES = f"""
    whole AS MATERIALIZED ({WHOLE_SQL}),
    line AS (SELECT doc_id, text, i, len(lines) AS n, lines[i] AS line,
                    coalesce(list_sum(list_transform(lines[1:i-1], lambda x: strlen(x) + 1)), 0)::BIGINT AS start_b,
                    coalesce(list_sum(list_transform(lines[1:i-1], lambda x: length(x) + 1)), 0)::BIGINT AS start_c
             FROM (SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM whole WHERE contains(text, '```')))),
    mark AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM line WHERE starts_with(regexp_replace(line, '^\\s+', ''), '```')),
    fence AS (SELECT o.doc_id, 0 AS sort, o.start_b, CASE WHEN c.i IS NULL OR c.i = c.n THEN strlen(o.text) ELSE c.start_b + strlen(c.line) + 1 END AS end_b,
                     o.start_c, CASE WHEN c.i IS NULL OR c.i = c.n THEN length(o.text) ELSE c.start_c + length(c.line) + 1 END AS end_c
              FROM mark o LEFT JOIN mark c ON c.doc_id = o.doc_id AND c.k = o.k + 1 WHERE o.k % 2 = 1),
    candidates AS MATERIALIZED ({" UNION ALL ".join(CANDIDATES(k + 1, p) for k, p in enumerate((P.HTML_BLOCK, P.HTML_TAG, P.INLINE_CODE, P.URL)))}),
    m1 AS MATERIALIZED (SELECT * FROM fence UNION ALL {FREE(1, "SELECT * FROM fence")}),
    m2 AS MATERIALIZED (SELECT * FROM m1 UNION ALL {FREE(2, "SELECT * FROM m1")}),
    m3 AS MATERIALIZED (SELECT * FROM m2 UNION ALL {FREE(3, "SELECT * FROM m2")}),
    m4 AS MATERIALIZED (SELECT * FROM m3 UNION ALL {FREE(4, "SELECT * FROM m3")}),
    mask AS MATERIALIZED (
        SELECT doc_id, min(start_b) AS s, max(end_b) AS e, min(start_c) AS sc, max(end_c) AS ec
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_b, end_b ROWS UNBOUNDED PRECEDING) AS island
              FROM (SELECT *, CASE WHEN start_b <= max(end_b) OVER (PARTITION BY doc_id ORDER BY start_b, end_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m4))
        GROUP BY doc_id, island),
    segment AS MATERIALIZED (
        SELECT doc_id, sc AS place, false AS prose, substr(text, (sc + 1)::INT, (ec - sc)::INT) AS text FROM mask JOIN whole USING (doc_id)
        UNION ALL
        SELECT doc_id, a, true, substr(text, (a + 1)::INT, (b - a)::INT) FROM (
            SELECT doc_id, coalesce(lag(ec) OVER (PARTITION BY doc_id ORDER BY sc), 0) AS a, sc AS b FROM mask
            UNION ALL SELECT w.doc_id, coalesce(max(ec), 0), any_value(length(w.text)) FROM whole w LEFT JOIN mask m ON m.doc_id = w.doc_id GROUP BY w.doc_id)
        JOIN whole USING (doc_id) WHERE a < b)"""
WORDS_SQL = "len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))"
OUTSIDE = lambda rows, end="end_b": f"SELECT x.* FROM ({rows}) x WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.doc_id = x.doc_id AND m.s < x.{end} AND m.e > x.start_b)"
WHOLE = "SELECT doc_id, text FROM whole"
LITERAL_FINDINGS_SQL = OUTSIDE(f"""
    SELECT doc_id, rule_id, start_b, end_b, {EXCERPT_SQL} AS excerpt, weight
    FROM ({spans_sql(WHOLE, literal_regex(LITERALS))}) s JOIN {RULES_SQL} ON lower(hit) = form
    WHERE {BOUNDED_SQL} AND {GUARD_SQL}""")
REGEX_FINDINGS_SQL = OUTSIDE(" UNION ALL ".join(
    f"SELECT doc_id, {q(ENGINE.rules[k].id)} AS rule_id, start_b, end_b, {EXCERPT_SQL} AS excerpt, {ENGINE.rules[k].weight:.6f} AS weight FROM ({spans_sql(WHOLE, pattern)})" for k, pattern in ENGINE.regexes
))
MASKED = lambda select: f"WITH {MASK_CTES}, found AS MATERIALIZED ({FINDINGS_SQL}), report AS ({REPORT_SQL}) {select}"

# --- rules of whole documents

BULLETS_SQL = OUTSIDE("""
    SELECT doc_id, i, body, rest, start_b, start_b + strlen(body) + 1 AS end_b,
           lower(regexp_replace(regexp_extract(rest, '[^\\s]+'), '^[*_]+', '')) AS opener
    FROM (SELECT *, regexp_replace(regexp_replace(body, '^[-* ]+', ''), '^[0-9.]+', '') AS rest
          FROM (SELECT doc_id, i, regexp_replace(lines[i], '^\\s+', '') AS body,
                       coalesce(list_sum(list_transform(lines[1:i-1], lambda x: strlen(x) + 1)), 0)::BIGINT AS start_b
                FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM whole))))
    WHERE (starts_with(body, '- ') OR starts_with(body, '* ') OR (regexp_matches(body, '^[0-9]') AND contains(body || chr(10), '. ')))
      AND regexp_matches(rest, '[^\\s]')""")
S001_SQL = f"""
    SELECT doc_id, 'S001' AS rule_id, start_b, start_b AS end_b, n || '/' || total || ' bullets open with "' || opener || '"' AS excerpt, 2.0 AS weight
    FROM (SELECT doc_id, opener, count(*) AS n, sum(count(*)) OVER w AS total, min(min(start_b)) OVER w AS start_b,
                 row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, opener DESC) AS r
          FROM ({BULLETS_SQL}) GROUP BY doc_id, opener WINDOW w AS (PARTITION BY doc_id))
    WHERE r = 1 AND total >= 4 AND n / total >= 0.8"""
SENTENCES_SQL = """
    SELECT doc_id, n, sqrt(n * squares - total * total) / total AS cv
    FROM (SELECT doc_id, count(*)::DOUBLE AS n, sum(w)::DOUBLE AS total, sum(w * w)::DOUBLE AS squares
          FROM (SELECT doc_id, len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '')) AS w
                FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?]+(?:\\s+|$)')) AS s FROM whole))
          WHERE w >= 3 GROUP BY doc_id)"""
S002_SQL = f"""
    SELECT doc_id, 'S002' AS rule_id, 0 AS start_b, 0 AS end_b, printf('%d sentences, length CV %.2f', n::BIGINT, cv) AS excerpt, 2.0 AS weight
    FROM ({SENTENCES_SQL}) WHERE n >= 8 AND cv < 0.3"""
TRIADS_SQL = OUTSIDE(f"SELECT doc_id, start_b, end_b, {EXCERPT_SQL} AS excerpt FROM ({spans_sql(WHOLE, P.TRIAD)})")
S003_SQL = f"SELECT doc_id, 'S003' AS rule_id, start_b, end_b, excerpt, 0.25 AS weight FROM ({TRIADS_SQL}) QUALIFY count(*) OVER (PARTITION BY doc_id) >= 3"
FINDINGS_SQL = " UNION ALL ".join((LITERAL_FINDINGS_SQL, REGEX_FINDINGS_SQL, S001_SQL, S002_SQL, S003_SQL))
REPORT_SQL = f"""
    SELECT doc_id, n_findings, words, round(total_weight, 4) AS total_weight,
           round(CASE WHEN words = 0 THEN 0 ELSE total_weight / (words / 1000.0e0) END, 4) AS score,
           CASE WHEN words = 0 THEN 'clean' WHEN total_weight / (words / 1000.0e0) >= 6 THEN 'heavy' WHEN total_weight / (words / 1000.0e0) >= 2 THEN 'seasoned' ELSE 'clean' END AS band
    FROM (SELECT w.doc_id, count(f.rule_id) AS n_findings, any_value(coalesce(p.words, 0))::BIGINT AS words, coalesce(sum(f.weight), 0)::DOUBLE AS total_weight
          FROM whole w LEFT JOIN found f ON w.doc_id = f.doc_id
          LEFT JOIN (SELECT doc_id, sum({WORDS_SQL}) AS words FROM segment WHERE prose GROUP BY doc_id) p ON p.doc_id = w.doc_id GROUP BY w.doc_id)"""
LITERAL_IDS = sorted({ENGINE.rules[k].id for k in ENGINE.literals.values()})
REGEX_IDS = sorted({ENGINE.rules[k].id for k, _ in ENGINE.regexes})


def literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.literal_spans(whole(spark, sf_dir), ENGINE).select("doc_id", F.explode("spans").alias("s"))
    return found.select("doc_id", F.col("s.start").alias("start_b"), F.col("s.end").alias("end_b"), F.col("s.at").alias("at_c"), F.col("s.hit").alias("hit"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lint.findings(whole(spark, sf_dir), ENGINE)
    return rows.select("doc_id", "rule_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"), "excerpt", F.round("weight", 4).alias("weight"))


def lint_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of words and phrases."""
    return found(spark, sf_dir).filter(F.col("rule_id").isin(LITERAL_IDS)).select("doc_id", "rule_id", "start_b", "end_b")


def lint_regexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of patterns."""
    return found(spark, sf_dir).filter(F.col("rule_id").isin(REGEX_IDS)).select("doc_id", "rule_id", "start_b", "end_b")


def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lint.reports(whole(spark, sf_dir), ENGINE)
    return rows.select("doc_id", "n_findings", "words", F.round("total_weight", 4).alias("total_weight"), F.round("score", 4).alias("score"), "band")


def lint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.json_reports(whole(spark, sf_dir), ENGINE)


def lint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.rule_rollup(lint.findings(whole(spark, sf_dir), ENGINE)).select("rule_id", "n", F.round("weight", 4).alias("weight"))


def lint_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.gate(lint.reports(whole(spark, sf_dir), ENGINE), "seasoned")


def structural(rule_id: str):
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir).filter(F.col("rule_id") == rule_id).select("doc_id", "start_b", "end_b", "excerpt")

    return of


def s002(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = lint.sentence_stats(whole(spark, sf_dir)).filter("n > 0")
    return stats.select("doc_id", F.col("n").cast("double").alias("n"), F.round("cv", 6).alias("cv"))


# --- masks and intervals

INTERVALS_SQL = "SELECT doc_id, k, (doc_id * 13 + k * 29) % 97 AS s, (doc_id * 13 + k * 29) % 97 + 3 + (doc_id + k) % 11 AS e FROM documents, range(6) r(k)"
MERGED_SQL = f"""
    SELECT doc_id, min(s) AS s, max(e) AS e
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
                FROM ({INTERVALS_SQL})))
    GROUP BY doc_id, island"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: F.struct(((F.col("doc_id") * 13 + k * 29) % 97).cast("int").alias("start"), ((F.col("doc_id") * 13 + k * 29) % 97 + 3 + (F.col("doc_id") + k) % 11).cast("int").alias("end"))
    made = F.transform(F.sequence(F.lit(0), F.lit(5)), one)
    return documents(spark, sf_dir).select("doc_id", made.alias("intervals")).select("doc_id", S.merged(F.col("intervals")).alias("mask"))


def mask_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).select("doc_id", F.explode("mask").alias("m")).select("doc_id", F.col("m.start").alias("s"), F.col("m.end").alias("e"))


def prose_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select("doc_id", F.explode(S.complement(F.col("mask"), F.lit(110))).alias("p"))
    return rows.select("doc_id", F.col("p.start").alias("s"), F.col("p.end").alias("e"))


SEGMENTS_SQL = f"""
    SELECT doc_id, s, e FROM (
        SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM ({MERGED_SQL})
        UNION ALL SELECT doc_id, max(e), 110 FROM ({MERGED_SQL}) GROUP BY doc_id)
    WHERE s < e"""


def mask_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and spans of the merged intervals: which of 0, 10, .. 100 are covered, and which tens overlap."""
    rows = intervals(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(10))))
    return rows.select("doc_id", "p", S.covers(F.col("mask"), F.col("p")).alias("covered"), S.overlaps(F.col("mask"), F.col("p"), F.col("p") + 10).alias("overlapping"))


MASK_HITS_SQL = f"""
    SELECT d.doc_id, p.p::INT AS p, coalesce(bool_or(p.p >= s AND p.p < e), false) AS covered, coalesce(bool_or(p.p < e AND p.p + 10 > s), false) AS overlapping
    FROM documents d, range(0, 101, 10) p(p) JOIN ({MERGED_SQL}) m ON m.doc_id = d.doc_id GROUP BY d.doc_id, p.p"""


def mask_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged masks of all texts: fences, blocks, tags, inline code and URLs."""
    rows = lint.with_mask(whole(spark, sf_dir)).select("doc_id", F.explode("mask").alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("start_b"), F.col("m.end").alias("end_b"))


def page_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of raw pages, where script, style and comments are long."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    rows = lint.with_mask(pages, "html").select("page_id", F.explode("mask").alias("m"))
    return rows.select("page_id", F.col("m.start").alias("start_b"), F.col("m.end").alias("end_b"))


def prose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.reports(whole(spark, sf_dir), ENGINE).select("doc_id", "words")


# --- packs

EXTRA = Pack("extra", "1", (Rule("T013", "delve-again", "word", patterns=("delve",), weight=3.0, rationale="override"), Rule("X001", "the-word", "word", patterns=("the",), weight=0.01, rationale="data"), Rule("X002", "of-the", "phrase", patterns=("of the", "de la"), weight=0.02, rationale="data", replace="of"), Rule("X003", "digits", "regex", pattern="[0-9]+", weight=0.03, rationale="data")))
DATA_ENGINE = Engine.compile([base_pack(), EXTRA])
PACKS = [base_pack(), EXTRA]


def pack_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged rules in their order, in SQL form: first place of an id, last definition."""
    from pyspark.sql import Window

    rows = rules_frame(spark, PACKS)
    own = Window.partitionBy("id")
    last = rows.withColumn("first_pack", F.first("pack_idx").over(own.orderBy("pack_idx", "rule_idx"))).withColumn("first_rule", F.first("rule_idx").over(own.orderBy("pack_idx", "rule_idx"))).withColumn("r", F.row_number().over(own.orderBy(F.desc("pack_idx"), F.desc("rule_idx")))).filter("r = 1")
    place = F.row_number().over(Window.orderBy("first_pack", "first_rule"))
    return last.select(place.alias("place"), "id", "name", F.round("weight", 4).alias("weight"))


def pack_fixable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules_frame(spark, [base_pack()])
    return rows.filter((F.size("swaps") > 0) | F.col("replace").isNotNull()).select("id", "kind")


def pack_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the packs: ids that repeat, rules that can't fire, rules without a reason."""
    rows = rules_frame(spark, PACKS)
    twice = rows.groupBy("id").count().filter("count > 1").select("id", F.lit("repeated").alias("fault"))
    dead = rows.filter((F.col("kind") == "regex") & F.col("pattern").isNull() | (F.col("kind") != "regex") & (F.size("patterns") + F.size("swaps") == 0)).select("id", F.lit("dead").alias("fault"))
    mute = rows.filter(F.coalesce(F.trim("rationale"), F.lit("")) == "").select("id", F.lit("no reason").alias("fault"))
    return twice.unionByName(dead).unionByName(mute)


#: The base pack's file as SQL reads it: blocks of lines, without a TOML parser.
PACK_CTES = f"""
    block AS (SELECT generate_subscripts(blocks, 1) - 1 AS place, unnest(blocks) AS b FROM (SELECT string_split({q(PACK_FILE.read_text(encoding="utf-8"))}, '[[rules]]') AS blocks)),
    base AS (
        SELECT place, regexp_extract(b, '\\nid = "([^"]*)"', 1) AS id, regexp_extract(b, '\\nname = "([^"]*)"', 1) AS name, regexp_extract(b, '\\nkind = "([^"]*)"', 1) AS kind,
               regexp_extract(b, '\\nweight = ([0-9.]+)', 1)::DOUBLE AS weight, regexp_matches(b, '\\n(swaps|replace) = ') AS fixable,
               regexp_matches(b, '\\nrationale = ".*[^ ].*"') AS reasoned, regexp_matches(b, '\\n(pattern = |patterns = \\[ *"|swaps = \\{{ *[^ }}])') AS fires
        FROM block WHERE place > 0),
    extra(place, id, name, weight) AS (VALUES (1001, 'T013', 'delve-again', 3.0), (1002, 'X001', 'the-word', 0.01), (1003, 'X002', 'of-the', 0.02), (1004, 'X003', 'digits', 0.03)),
    listed AS (SELECT place, id, name, weight FROM base UNION ALL SELECT place, id, name, weight::DOUBLE FROM extra)"""
PACK_MERGE_SQL = f"WITH {PACK_CTES} SELECT row_number() OVER (ORDER BY min(place)) AS place, id, arg_max(name, place) AS name, round(arg_max(weight, place), 4) AS weight FROM listed GROUP BY id"
PACK_CHECK_SQL = f"""
    WITH {PACK_CTES}
    SELECT id, 'repeated' AS fault FROM listed GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, 'dead' FROM base WHERE NOT fires
    UNION ALL SELECT id, 'no reason' FROM base WHERE NOT reasoned"""


def lint_data_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack over words that the documents have, on top of the base pack: all findings of both on the texts as they are, by rule."""
    found = lint.findings(documents(spark, sf_dir), DATA_ENGINE)
    return found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def engine_sql(engine: Engine, source: str) -> str:
    """Findings of an engine's rules on texts that show no markup, as ``doc_id, rule_id, weight``."""
    rules = "(VALUES " + ", ".join(f"({q(form)}, {q(engine.rules[k].id)}, {engine.rules[k].weight:.6f})" for form, k in engine.literals.items()) + ") rule(form, rule_id, weight)"
    literal = f"SELECT doc_id, rule_id, start_b, end_b, weight FROM ({spans_sql(source, literal_regex(list(engine.literals)))}) s JOIN {rules} ON lower(hit) = form WHERE {BOUNDED_SQL} AND {GUARD_SQL}"
    return " UNION ALL ".join([literal, *(f"SELECT doc_id, {q(engine.rules[k].id)}, start_b, end_b, {engine.rules[k].weight:.6f} FROM ({spans_sql(source, pattern)})" for k, pattern in engine.regexes)])


DATA_PACK_SQL = f"""
    WITH {MASK_CTES.replace(WHOLE_SQL, "SELECT doc_id, text FROM documents")},
    found AS ({OUTSIDE(engine_sql(DATA_ENGINE, WHOLE))} UNION ALL SELECT doc_id, rule_id, start_b, end_b, weight FROM ({S001_SQL} UNION ALL {S002_SQL} UNION ALL {S003_SQL}))
    SELECT doc_id, rule_id, count(*) AS n, round(sum(weight)::DOUBLE, 4) AS weight FROM found GROUP BY doc_id, rule_id"""

# --- rewriting


def fixed(*steps: str):
    """Texts rewritten by these steps alone (none named: by all)."""

    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = fixing.fix(whole(spark, sf_dir), ENGINE, steps=steps or None)
        return rows.select("doc_id", F.md5("fixed").alias("fixed_md5"))

    return of


def replace_sql(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(new)}, 'g')"


def dashes_sql(source: str) -> str:
    text = replace_sql("text", r"(\d)\s*[–—]\s*(\d|Present|Current|Now|[A-Z][a-z]+\.? \d)", r"\1 to \2")
    return f"SELECT doc_id, place, prose, replace({replace_sql(text, r'\s*—\s*', ', ')}, ' – ', ', ') AS text FROM ({source})"


def phrases_sql(source: str) -> str:
    text = "text"
    for pattern, new in ENGINE.fixes:
        text = replace_sql(text, pattern, new)
    return f"SELECT doc_id, place, prose, {text} AS text FROM ({source})"


def swaps_sql(source: str) -> str:
    """Words swapped, token by token."""
    forms = "MAP {" + ", ".join(f"{q(f)}: {q(new)}" for f, (new, _) in sorted(ENGINE.swaps.items())) + "}"
    guarded = ", ".join(q(f) for f, (_, k) in sorted(ENGINE.swaps.items()) if ENGINE.rules[k].unless_preceded_by)
    before = "CASE WHEN i > 1 AND NOT regexp_matches(gaps[i], '[0-9]') THEN lower(words[i - 1]) ELSE '' END"
    new = f"{forms}[lower(w)]"
    shaped = f"CASE WHEN regexp_matches(w, '^[A-Z]{{2,}}$') THEN upper({new}) WHEN regexp_matches(w, '^[A-Z]') THEN upper(substr({new}, 1, 1)) || substr({new}, 2) ELSE {new} END"
    word = f"CASE WHEN {new} IS NULL OR (lower(w) IN ({guarded}) AND {before} IN ({', '.join(map(q, GUARD_WORDS))})) THEN w ELSE {shaped} END"
    return f"""
        SELECT doc_id, place, prose, array_to_string(list_transform(words, lambda w, i: gaps[i] || {word}), '') || gaps[len(gaps)] AS text
        FROM (SELECT doc_id, place, prose, regexp_extract_all(text, '[A-Za-z]+') AS words, string_split_regex(text, '[A-Za-z]+') AS gaps FROM ({source}))"""


def cleanup_sql(source: str) -> str:
    text = "text"
    for _ in range(2):  # no lookaround: neighbours that a match takes are met the second time
        text = replace_sql(text, "([^\\n \\t])[ \\t]{2,}([^\\n \\t])", r"\1 \2")
    for pattern, new in ((r",\s*,", ","), (r"[ \t]+([,.;:!?])", r"\1"), (r"[,;:]\s*\.", ".")):
        text = replace_sql(text, pattern, new)
    return f"SELECT doc_id, place, prose, {text} AS text FROM ({source})"


def capitals_sql(source: str) -> str:
    p = q(r"[.!?]\s+[a-z]")
    return f"""
        SELECT doc_id, place, prose, array_to_string(list_transform(gaps, lambda g, i: g || upper(coalesce(hits[i], ''))), '') AS text
        FROM (SELECT doc_id, place, prose, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM ({source}))"""


def joined_sql(*steps) -> str:
    """``doc_id, text``: prose segments by the steps, masked ones as they are, put together."""
    source = "SELECT * FROM segment WHERE prose"
    for step in steps:
        source = step(source)
    return f"SELECT w.doc_id, coalesce(string_agg(x.text, '' ORDER BY x.place), '') AS text FROM whole w LEFT JOIN (SELECT * FROM segment WHERE NOT prose UNION ALL {source}) x ON x.doc_id = w.doc_id GROUP BY w.doc_id"


def fixed_sql(*steps) -> str:
    return f"WITH {MASK_CTES} SELECT doc_id, md5(text) AS fixed_md5 FROM ({joined_sql(*steps)})"


def full_sql() -> str:
    done = "regexp_extract(c.text, '^([^A-Za-z]*)', 1)"
    first = f"CASE WHEN regexp_matches(d.text, '^[^A-Za-z]*[A-Z]') AND regexp_matches(c.text, '[A-Za-z]') THEN {done} || upper(substr(c.text, length({done}) + 1, 1)) || substr(c.text, length({done}) + 2) ELSE c.text END"
    return f"WITH {MASK_CTES} SELECT d.doc_id, md5({first}) AS fixed_md5 FROM whole d JOIN ({joined_sql(dashes_sql, phrases_sql, swaps_sql, cleanup_sql, capitals_sql)}) c ON d.doc_id = c.doc_id"


def fix_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixing.guarantee(whole(spark, sf_dir), ENGINE)
    return rows.select("doc_id", (F.col("after") <= F.col("before") + 1e-9).alias("not_heavier"), F.col("fixable_left"))


STRUCTURAL_SQL = lambda rule_id: MASKED(f"SELECT doc_id, start_b, end_b, excerpt FROM found WHERE rule_id = '{rule_id}'")
ONE_OF = lambda ids: ", ".join(map(q, ids))

QUERIES = {
    "lint_literal_spans": (literal_spans, f"WITH whole AS MATERIALIZED ({WHOLE_SQL}) SELECT doc_id, start_b, end_b, at_c, hit FROM ({spans_sql(WHOLE, literal_regex(LITERALS))})"),
    "lint_guarded": (lint_literals, MASKED(f"SELECT doc_id, rule_id, start_b, end_b FROM found WHERE rule_id IN ({ONE_OF(LITERAL_IDS)})")),
    "lint_regex_spans": (lint_regexes, MASKED(f"SELECT doc_id, rule_id, start_b, end_b FROM found WHERE rule_id IN ({ONE_OF(REGEX_IDS)})")),
    "lint_findings": (found, MASKED("SELECT doc_id, rule_id, start_b, end_b, excerpt, round(weight, 4)::DOUBLE AS weight FROM found")),
    "lint_report": (lint_report, MASKED("SELECT * FROM report")),
    "lint_json": (lint_json, None),
    "lint_rule_rollup": (lint_rollup, MASKED("SELECT rule_id, count(*) AS n, round(sum(weight)::DOUBLE, 4) AS weight FROM found GROUP BY rule_id")),
    "lint_band_gate": (lint_gate, MASKED("SELECT CASE r WHEN 2 THEN 'heavy' WHEN 1 THEN 'seasoned' ELSE 'clean' END AS worst, r >= 1 AS fails FROM (SELECT max(CASE band WHEN 'heavy' THEN 2 WHEN 'seasoned' THEN 1 ELSE 0 END) AS r FROM report)")),
    "lint_data_pack": (lint_data_pack, DATA_PACK_SQL),
    "s001_bullets": (structural("S001"), STRUCTURAL_SQL("S001")),
    "s002_sentence_cv": (s002, MASKED(f"SELECT doc_id, n, round(cv, 6) AS cv FROM ({SENTENCES_SQL})")),
    "s003_triads": (structural("S003"), STRUCTURAL_SQL("S003")),
    "mask_spans": (mask_spans, f"WITH {MASK_CTES} SELECT doc_id, s AS start_b, e AS end_b FROM mask"),
    "mask_pages": (page_masks, f"WITH {MASK_CTES.replace(WHOLE_SQL, 'SELECT page_id AS doc_id, html AS text FROM pages')} SELECT doc_id AS page_id, s AS start_b, e AS end_b FROM mask"),
    "mask_merge": (mask_merge, MERGED_SQL),
    "mask_hits": (mask_hits, MASK_HITS_SQL),
    "prose_segments": (prose_segments, SEGMENTS_SQL),
    "prose_words": (prose_words, MASKED("SELECT doc_id, words FROM report")),
    "pack_merge": (pack_merge, PACK_MERGE_SQL),
    "pack_fixable": (pack_fixable, f"WITH {PACK_CTES} SELECT id, kind FROM base WHERE fixable"),
    "pack_check": (pack_check, PACK_CHECK_SQL),
    "fix_ranges_dashes": (fixed("ranges", "em dashes", "en dashes"), fixed_sql(dashes_sql)),
    "fix_phrases": (fixed("phrases"), fixed_sql(phrases_sql)),
    "fix_word_swaps": (fixed("swaps"), fixed_sql(swaps_sql)),
    "fix_cleanup": (fixed("cleanup"), fixed_sql(cleanup_sql)),
    "fix_capitals": (fixed("capitals"), fixed_sql(capitals_sql)),
    "fix_full": (fixed(), full_sql()),
    "fix_guarantee": (fix_guarantee, None),
}

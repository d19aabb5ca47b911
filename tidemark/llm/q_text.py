"""Queries over quality, license, page and line operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html_text, license_scan, line_dedup, quality_classifier, quality_rules
from tidemark.runtime import read_table, table


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning; one without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt outside the held-out third."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    out = quality_classifier.score(d, quality_classifier.fit(d, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of base rules and outlier rule."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    vec = table(quality_rules.vectors(quality_rules.base_stats(d)).drop("text"), "statistics")
    out = quality_rules.judge(vec, quality_rules.estimates(vec))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document that holds one."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    out = line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


QUERIES = {
    "op1_quality": op1_quality,
    "op3_quality_rules": op3_quality_rules,
    "op4_license": op4_license,
    "op6_html": op6_html,
    "op10_line_dedup": op10_line_dedup,
}


def _templates_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.TEMPLATES.items())


_SPLIT = "list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> '')"
_PAIRS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_BLANK = "[\\x20\\x09-\\x0D]"


def _fits(p: str) -> str:
    """Whether few enough places of a template are fields."""
    count = lambda *kinds: f"len(list_filter({p}, lambda x: x IN ({', '.join(kinds)})))"
    return f"""10 * {count("'<*>'")} <= 3 * n AND 10 * {count("'<*>'", "'<#>'")} <= 5 * n"""


def _wider(k: int) -> str:
    """Templates p{k} with more fields, as p{k + 1}."""
    return f"""e{k} AS (SELECT n, lead, p, i, p[i] AS tok, list_concat(p[1:i - 1], ['<*>'], p[i + 1:len(p)]) AS m FROM (SELECT DISTINCT n, lead, p, unnest(range(1, n + 1)) AS i FROM p{k})),
 g{k} AS (SELECT n, lead, i, m FROM e{k} GROUP BY ALL HAVING count(*) >= 5 OR count(*) > 1 AND bool_or(tok = '<*>')),
 o{k} AS (SELECT n, lead, p, list(CASE WHEN g.n IS NULL THEN tok ELSE '<*>' END ORDER BY e.i) AS w FROM e{k} AS e LEFT JOIN g{k} AS g USING (n, lead, i, m) GROUP BY ALL),
 p{k + 1} AS (SELECT n, lead, first, CASE WHEN {_fits("w")} THEN w ELSE p END AS p FROM p{k} JOIN o{k} USING (n, lead, p))"""


ORACLE_SQL = {
    "op4_license": f"""WITH u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n\\s*\\n'), [t])) AS u FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
 w AS (SELECT doc_id, u, {_SPLIT.format("lower(u)")} AS w FROM u), b AS (SELECT doc_id, u, {_PAIRS.format("w")} AS b FROM w WHERE len(w) > 1),
 t AS (SELECT name, {_SPLIT.format("lower(v)")} AS w FROM (VALUES {_templates_sql()}) AS x(name, v)), tb AS (SELECT name, {_PAIRS.format("w")} AS tb FROM t),
 d AS (SELECT doc_id, u, name, 2 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b JOIN tb ON 2 * least(len(b), len(tb)) >= 0.79 * (len(b) + len(tb))),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, name DESC) AS r FROM d)
 SELECT doc_id, name AS license, round(max(dice), 6) AS dice, count(*) AS n_units FROM r WHERE r = 1 AND dice >= 0.8 - 1e-12 GROUP BY doc_id, name""",
    "op10_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, pos, line, list_transform(list_filter(regexp_split_to_array(line, '{_BLANK}+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<#>' ELSE w END) AS w FROM l),
 n AS (SELECT *, len(w) AS n, w[1:least(2, len(w) // 3)] AS lead FROM k WHERE len(w) > 0),
 f AS (SELECT *, row_number() OVER () AS no FROM n SEMI JOIN (SELECT n, lead FROM n GROUP BY ALL HAVING count(*) >= 5) AS g USING (n, lead)),
 a AS (SELECT no, n, lead, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM f),
 c AS (SELECT n, lead, i, tok FROM a WHERE tok <> '<#>' GROUP BY ALL HAVING count(*) >= 5),
 v AS (SELECT no, list(CASE WHEN a.tok = '<#>' OR c.tok IS NOT NULL THEN a.tok ELSE '<*>' END ORDER BY a.i) AS p FROM a LEFT JOIN c USING (n, lead, i, tok) GROUP BY no),
 q AS (SELECT doc_id, pos, n, lead, p AS first FROM f JOIN v USING (no) WHERE {_fits("p")}),
 p0 AS (SELECT DISTINCT n, lead, first, first AS p FROM q),
 {_wider(0)},
 {_wider(1)},
 t AS (SELECT doc_id, pos, n, lead, p AS template FROM q JOIN p2 USING (n, lead, first)),
 r AS (SELECT n, lead, template, min(doc_id) AS first FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
 g AS (SELECT DISTINCT doc_id, pos FROM t JOIN r USING (n, lead, template) WHERE doc_id <> first),
 x AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
 SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, x.text FROM documents LEFT JOIN x ON documents.doc_id = x.doc_id""",
}

"""The p-queries on text and matching, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veyra.llm.addresses import same_place
from veyra.llm.canonical import fee_values, known_aliases, map_to_list
from veyra.llm.entities import institution_records, judged, same_institution
from veyra.llm.language import found_languages, languages
from veyra.llm.mainbody import main_body
from veyra.llm.mixing import mix, mix_report
from veyra.llm.packing import pack, packing_report
from veyra.llm.repeats import repeated_lines, templated_lines, without_lines
from veyra.llm.sizes import sized


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return main_body(spark.read.parquet(f"{d}/pages.parquet"))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return same_institution(institution_records(read("dz_responses"), read("identity_labels"), read("municipal_points")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("a_key", "b_key")


def p4_judged(spark: SparkSession, d: str) -> DataFrame:
    """The matcher held against labels known to be good and bad."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    records = institution_records(read("dz_responses"), read("identity_labels"), read("municipal_points"), known_bad=True)
    return judged(same_institution(records), read("identity_labels"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    dz = spark.read.parquet(f"{d}/dz_responses.parquet").selectExpr("dz_id as id", "address", "city")
    points = spark.read.parquet(f"{d}/municipal_points.parquet").selectExpr("point_id as id", "address", "city")
    return same_place(dz.unionByName(points)).select("a_key", "b_key")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return map_to_list(fee_values(read("missed_fees"), read("fee_lines")), read("fee_vocab"), aliases=known_aliases())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(spark.read.parquet(f"{d}/pages.parquet"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return without_lines(pages, repeated_lines(pages))


def p7_templates(spark: SparkSession, d: str) -> DataFrame:
    return templated_lines(spark.read.parquet(f"{d}/pages.parquet"))


def p7_untemplated(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return without_lines(pages, templated_lines(pages))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(sized(spark.read.parquet(f"{d}/documents.parquet")), spark.read.parquet(f"{d}/pack_sizes.parquet"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_containers(spark, d), spark.read.parquet(f"{d}/pack_sizes.parquet"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(sized(spark.read.parquet(f"{d}/documents.parquet"), keep=("source",)), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(p9_mix(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return found_languages(spark.read.parquet(f"{d}/documents.parquet"))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES: dict = {"p3_found": p3_found, "p4_found": p4_found, "p4_matches": p4_matches, "p4_judged": p4_judged, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_clean": p7_clean, "p7_templates": p7_templates, "p7_untemplated": p7_untemplated, "p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_languages": p10_languages}

_P7_LINES = r"""
WITH p AS (SELECT DISTINCT page_id, url, raw_markdown FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL AND raw_markdown IS NOT NULL),
u AS (SELECT *, regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/:?#\s]+)(?::\d*)?([^?#\s]*)', ['h', 't']) AS m FROM p),
l AS (SELECT page_id, regexp_replace(m.h, '^www\.|\.$', '') AS site, regexp_replace(m.t, '/+$', '') AS page,
      unnest(string_split(raw_markdown, chr(10))) AS line, generate_subscripts(string_split(raw_markdown, chr(10)), 1) AS line_no FROM u),
k AS (SELECT page_id, site, page, CAST(line_no AS INTEGER) AS line_no, lower(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) AS key FROM l),
rep AS (SELECT site, key FROM k WHERE key <> '' AND site <> '' GROUP BY site, key HAVING count(DISTINCT page) >= 8),
hit AS (SELECT DISTINCT page_id, line_no FROM k JOIN rep USING (site, key))
"""
P7_SQL = _P7_LINES + "SELECT page_id, line_no FROM hit"
P7_CLEAN_SQL = (
    _P7_LINES
    + """, numbered AS (SELECT p.page_id, p.raw_markdown, l.line, l.line_no FROM p JOIN l USING (page_id)),
kept AS (SELECT n.page_id, string_agg(n.line, chr(10) ORDER BY n.line_no) AS kept_text FROM numbered n LEFT JOIN hit h ON n.page_id = h.page_id AND n.line_no = h.line_no
         WHERE h.page_id IS NULL GROUP BY n.page_id)
SELECT a.page_id, CASE WHEN a.raw_markdown IS NULL THEN NULL ELSE coalesce(k.kept_text, '') END AS kept_text
FROM (SELECT DISTINCT page_id, raw_markdown FROM pages) a LEFT JOIN kept k USING (page_id)"""
)

_LEVEL = ", w{0} AS (SELECT site, leaf FROM n{0} GROUP BY 1, 2 HAVING count(DISTINCT coalesce(t[{1}], '')) > 32), n{1} AS (SELECT n.site, n.key, n.t, n.leaf || ' ' || CASE WHEN w.leaf IS NULL THEN coalesce(n.t[{1}], '') ELSE '*' END AS leaf FROM n{0} n LEFT JOIN w{0} w ON n.site = w.site AND n.leaf = w.leaf)"
P7_TEMPLATES_SQL = (
    _P7_LINES
    + r""", d AS (SELECT DISTINCT site, key FROM k WHERE key <> '' AND site <> ''), x AS (SELECT site, key, list_transform(regexp_extract_all(key, '\p{N}+|\p{L}{1,6}'), lambda z: CASE WHEN regexp_matches(z, '^\p{N}') THEN '*' ELSE z END) AS t FROM d),
n0 AS (SELECT site, key, t, CAST(len(t) AS VARCHAR) AS leaf FROM x)"""
    + "".join(_LEVEL.format(i, i + 1) for i in range(3))
    + """, placed AS (SELECT DISTINCT k.page_id, k.line_no, k.site, k.page, n.leaf FROM k JOIN n3 n ON k.site = n.site AND k.key = n.key), wide AS (SELECT site, leaf FROM placed GROUP BY 1, 2 HAVING count(DISTINCT page) >= 8),
pos AS (SELECT site, leaf, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM n3 SEMI JOIN wide USING (site, leaf)), each AS (SELECT site, leaf, i, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '*' END AS tok FROM pos GROUP BY 1, 2, 3), texts AS (SELECT site, leaf, string_agg(tok, ' ' ORDER BY i) AS template FROM each GROUP BY 1, 2)
SELECT DISTINCT page_id, line_no, template FROM placed JOIN texts USING (site, leaf)"""
)

_HIT_PAGES = """, gone AS (SELECT DISTINCT page_id, line_no FROM placed JOIN wide USING (site, leaf)), numbered AS (SELECT p.page_id, l.line, l.line_no FROM p JOIN l USING (page_id)),
kept AS (SELECT n.page_id, string_agg(n.line, chr(10) ORDER BY n.line_no) AS kept_text FROM numbered n LEFT JOIN gone h ON n.page_id = h.page_id AND n.line_no = h.line_no WHERE h.page_id IS NULL GROUP BY n.page_id)
SELECT a.page_id, CASE WHEN a.raw_markdown IS NULL THEN NULL ELSE coalesce(k.kept_text, '') END AS kept_text FROM (SELECT DISTINCT page_id, raw_markdown FROM pages) a LEFT JOIN kept k USING (page_id)"""
P7_UNTEMPLATED_SQL = P7_TEMPLATES_SQL[: P7_TEMPLATES_SQL.index(",\npos AS")] + _HIT_PAGES

ORACLE: dict = {"p7_found": P7_SQL, "p7_clean": P7_CLEAN_SQL, "p7_templates": P7_TEMPLATES_SQL, "p7_untemplated": P7_UNTEMPLATED_SQL}

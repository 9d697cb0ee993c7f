"""Further queries: one-to-one matches, version diffs, mixed scripts, capped counters, nearest neighbours, containing regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import canonical_url
from veyra.operators.proximity import great_circle_m, near_pairs, positioned, regions_of_points
from veyra.plans.geo import GOOD, HAV
from veyra.plans.registry import query
from veyra.plans.windows import CANON
from veyra.sources.tables import Tables


@query("""WITH a AS (SELECT price_id, school_id, category, amount, row_number() OVER (PARTITION BY school_id, category, amount ORDER BY price_id) AS k FROM (SELECT DISTINCT price_id, school_id, category, amount FROM pricing WHERE academic_year = '2024/2025' AND amount IS NOT NULL AND category IS NOT NULL)),
b AS (SELECT price_id AS next_id, school_id, category, amount, row_number() OVER (PARTITION BY school_id, category, amount ORDER BY price_id) AS k FROM (SELECT DISTINCT price_id, school_id, category, amount FROM pricing WHERE academic_year = '2025/2026' AND amount IS NOT NULL AND category IS NOT NULL)) SELECT price_id, next_id FROM a JOIN b USING (school_id, category, amount, k)""")
def one_to_one(t: Tables) -> DataFrame:
    """Each row of a year with at most one equal row of the next: the k-th of a kind meets the k-th, so no row is taken twice."""
    p = t.pricing.filter("amount is not null and category is not null").select("price_id", "school_id", "category", "amount", "academic_year").distinct()
    w = Window.partitionBy("academic_year", "school_id", "category", "amount").orderBy("price_id")
    r = p.filter(F.col("academic_year").isin("2024/2025", "2025/2026")).withColumn("k", F.row_number().over(w))
    a = r.filter("academic_year = '2024/2025'").drop("academic_year")
    b = r.filter("academic_year = '2025/2026'").drop("academic_year").withColumnRenamed("price_id", "next_id")
    return a.join(b, ["school_id", "category", "amount", "k"]).select("price_id", "next_id")


@query(rf"""WITH p AS (SELECT DISTINCT page_id, {CANON} AS canon, raw_markdown AS body, last_scraped_at FROM pages WHERE url IS NOT NULL AND raw_markdown IS NOT NULL), e AS (SELECT canon, arg_min(body, (last_scraped_at, page_id)) AS a, arg_max(body, (last_scraped_at, page_id)) AS b, count(*) AS versions FROM p WHERE last_scraped_at IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT canon, unnest(string_split(a, chr(10))) AS line, -1 AS d FROM e UNION ALL SELECT canon, unnest(string_split(b, chr(10))), 1 FROM e), s AS (SELECT canon, line, sum(d) AS d FROM x WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT canon, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM s GROUP BY 1""")
def version_line_diff(t: Tables) -> DataFrame:
    """Lines added and removed between a page's first and last crawl; hashes of lines are counted, never texts."""
    p = t.pages.filter("url is not null and raw_markdown is not null and last_scraped_at is not null").select("page_id", canonical_url(F.col("url")).alias("canon"), F.transform(F.filter(F.split("raw_markdown", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)).alias("body"), "last_scraped_at").distinct()
    key = F.struct("last_scraped_at", "page_id")
    e = p.groupBy("canon").agg(F.min_by("body", key).alias("a"), F.max_by("body", key).alias("b"), F.count("*").alias("n")).filter("n > 1")
    x = e.select("canon", F.explode("a").alias("line"), F.lit(-1).alias("d")).unionByName(e.select("canon", F.explode("b").alias("line"), F.lit(1).alias("d")))
    s = x.groupBy("canon", "line").agg(F.sum("d").alias("d"))
    return s.groupBy("canon").agg(F.sum(F.greatest("d", F.lit(0))).cast("long").alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).cast("long").alias("removed"))


@query(r"""WITH n AS (SELECT DISTINCT point_id, name FROM municipal_points WHERE name IS NOT NULL), w AS (SELECT point_id, name, regexp_extract_all(lower(name), '[\p{L}\p{N}]+') AS ws FROM n)
SELECT point_id, len(list_filter(ws, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[Ѐ-ӿ]'))) AS mixed, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[Ѐ-ӿ]') THEN translate(x, 'aeopcyxkmht', 'аеорсухкмнт') ELSE x END), ' ') AS repaired FROM w""")
def mixed_scripts(t: Tables) -> DataFrame:
    """Words that mix scripts, their Latin lookalikes made Cyrillic."""
    ws = F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    mixed = lambda x: x.rlike("[a-z]") & x.rlike("[Ѐ-ӿ]")
    repaired = F.transform("ws", lambda x: F.when(mixed(x), F.translate(x, "aeopcyxkmht", "аеорсухкмнт")).otherwise(x))
    return t.municipal_points.filter("name is not null").select("point_id", "name").distinct().select("point_id", ws.alias("ws")).select("point_id", F.size(F.filter("ws", mixed)).cast("long").alias("mixed"), F.array_join(repaired, " ").alias("repaired"))


@query("""WITH f AS (SELECT user_id, min(ts) AS seen FROM events GROUP BY 1), r AS (SELECT user_id, CAST(seen AS DATE) AS day, row_number() OVER (PARTITION BY CAST(seen AS DATE) ORDER BY seen, user_id) AS k FROM f) SELECT day, count(*) AS newcomers, count(*) FILTER (WHERE k <= 20) AS admitted FROM r GROUP BY 1""")
def capped_newcomers(t: Tables) -> DataFrame:
    """Keys first seen on each day, and how many a daily cap lets in."""
    f = t.events.groupBy("user_id").agg(F.min("ts").alias("at"))
    return f.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("newcomers")).withColumn("admitted", F.least("newcomers", F.lit(20)))


@query("""WITH l AS (SELECT user_id, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'purchase') AS evidence FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN last_at >= now - INTERVAL 12 HOUR THEN 'running' WHEN evidence > 0 THEN 'partial' ELSE 'failed' END AS status, last_at FROM l, m""")
def stale_runs(t: Tables) -> DataFrame:
    """Runs whose last sign of life is too old end as partial or failed, by whether they left anything."""
    g = t.events.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "purchase").alias("evidence"))
    late = F.col("last_at") < t.events.agg(F.max("ts").alias("now")).scalar() - F.expr("interval 12 hours")
    return g.select("user_id", F.when(~late, "running").when(F.col("evidence") > 0, "partial").otherwise("failed").alias("status"), "last_at")


@query(f"""WITH q AS (SELECT DISTINCT location_id AS id, lat, lng FROM place_pins WHERE {GOOD}), p AS (SELECT DISTINCT point_id AS id, lat, lng FROM municipal_points WHERE {GOOD}),
d AS (SELECT q.id AS location_id, p.id AS point_id, {HAV.format(a='q', b='p')} AS m FROM q JOIN p ON abs(q.lat - p.lat) < 0.0091), r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY m, point_id) AS k FROM d WHERE m <= 1000) SELECT location_id, point_id, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""")
def nearest_three(t: Tables) -> DataFrame:
    """The three nearest points within a kilometre of each pin."""
    near = near_pairs(positioned(t.place_pins, "location_id"), positioned(t.municipal_points, "point_id"), 1000.0)
    d = near.select(F.col("a_id").alias("location_id"), F.col("b_id").alias("point_id"), great_circle_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")).alias("m"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("location_id").orderBy("m", "point_id"))).filter("rank <= 3").select("location_id", "point_id", "rank")


@query(f"""WITH p AS (SELECT DISTINCT point_id AS id, lat, lng FROM municipal_points WHERE {GOOD}), ring AS (SELECT district_id, unnest(range(1, len(rings) + 1)) AS k, rings FROM districts), v AS (SELECT district_id, k, rings[k] AS g, unnest(range(1, len(rings[k]))) AS i FROM ring),
e AS (SELECT district_id, k, g[i].lng AS x1, g[i].lat AS y1, g[i + 1].lng AS x2, g[i + 1].lat AS y2 FROM v), c AS (SELECT e.district_id, p.id, e.k, count(*) % 2 AS odd FROM p JOIN e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY ALL),
i AS (SELECT district_id, id FROM c GROUP BY ALL HAVING max(CASE WHEN k = 1 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN k > 1 THEN odd ELSE 0 END) = 0), n AS (SELECT district_id, count(*) AS points FROM i GROUP BY 1)
SELECT d.district_id, d.name, coalesce(n.points, 0) AS points, (SELECT count(DISTINCT id) FROM i) AS inside_any FROM (SELECT DISTINCT district_id, name FROM districts) d LEFT JOIN n USING (district_id)""")
def points_by_region(t: Tables) -> DataFrame:
    """Points counted by the region that holds them, regions without any included."""
    i = regions_of_points(positioned(t.municipal_points, "point_id"), t.districts, "district_id")
    n = i.groupBy("region").agg(F.count("*").alias("points"))
    every = i.agg(F.count_distinct("id").alias("n")).scalar()
    d = t.districts.select("district_id", "name").distinct()
    return d.join(n, F.col("district_id") == F.col("region"), "left").select("district_id", "name", F.coalesce("points", F.lit(0)).alias("points"), every.alias("inside_any"))


@query(r"""SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(raw_markdown, '(^|[^0-9])(0[0-9]{1,2} [0-9]{3} [0-9]{4})', 2), lambda x: '+359' || substr(replace(x, ' ', ''), 2)))) AS phones FROM pages WHERE raw_markdown IS NOT NULL""")
def phone_numbers(t: Tables) -> DataFrame:
    """Phone numbers of each page in international form."""
    found = F.regexp_extract_all("raw_markdown", F.lit(r"(^|[^0-9])(0[0-9]{1,2} [0-9]{3} [0-9]{4})"), F.lit(2))
    return t.pages.filter("raw_markdown is not null").select("page_id", F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("+359"), F.substring(F.replace(x, F.lit(" "), F.lit("")), 2, 20))))).alias("phones"))


@query(r"""SELECT DISTINCT school_id, list_sort(regexp_extract_all(coalesce(name_i18n['bg'], ''), '[0-9]+')) = list_sort(regexp_extract_all(coalesce(name_i18n['en'], ''), '[0-9]+')) AS same FROM schools WHERE name_i18n['bg'] IS NOT NULL AND name_i18n['en'] IS NOT NULL""")
def numbers_preserved(t: Tables) -> DataFrame:
    """Whether a translation keeps its original's numbers."""
    nums = lambda k: F.array_sort(F.regexp_extract_all(F.col("name_i18n")[k], F.lit("[0-9]+"), F.lit(0)))
    return t.schools.filter("name_i18n['bg'] is not null and name_i18n['en'] is not null").select("school_id", (nums("bg") == nums("en")).alias("same")).distinct()


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', ' '), '.', ','), '-', '−') AS printed FROM orders")
def printed_amounts(t: Tables) -> DataFrame:
    """Numbers as a Bulgarian reader expects them."""
    return t.orders.select("o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.-", " ,−").alias("printed"))


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def seeded_sample(t: Tables) -> DataFrame:
    """A simple random sample of a hundred rows that any engine draws alike; the limit is the feature."""
    return t.documents.select("doc_id").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(100)

"""Reading queries: filters, semi- and anti-joins, counts, facets, quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import closed, finite, in_box, percent, ratio
from veyra.operators.relational import best_of, sliced_running_sum
from veyra.plans.registry import query
from veyra.sources.tables import Tables

BOX = (41.0, 22.0, 43.0, 24.0)


@query("""
WITH s AS (SELECT DISTINCT school_id, city, school_type FROM schools),
p AS (SELECT school_id, count(DISTINCT location_id) AS pins FROM place_pins WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1),
f AS (SELECT school_id, count(DISTINCT price_id) AS prices, list_sort(list(DISTINCT category)) AS categories FROM pricing WHERE category IS NOT NULL GROUP BY 1)
SELECT s.school_id, s.city, s.school_type, coalesce(p.pins, 0) AS pins, coalesce(f.prices, 0) AS prices, coalesce(f.categories, []) AS categories
FROM s LEFT JOIN p USING (school_id) LEFT JOIN f USING (school_id)""")
def entity_listing(t: Tables) -> DataFrame:
    """A root entity with its related rows pre-aggregated before the joins."""
    s = t.schools.select("school_id", "city", "school_type").distinct()
    p = t.place_pins.filter("lat is not null and lng is not null").groupBy("school_id").agg(F.count_distinct("location_id").alias("pins"))
    f = t.pricing.filter("category is not null").groupBy("school_id").agg(F.count_distinct("price_id").alias("prices"), F.sort_array(F.collect_set("category")).alias("categories"))
    out = s.join(p, "school_id", "left").join(f, "school_id", "left")
    return out.select("school_id", "city", "school_type", F.coalesce("pins", F.lit(0)).alias("pins"), F.coalesce("prices", F.lit(0)).alias("prices"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(t: Tables) -> DataFrame:
    """By primary key; row-group statistics prune the scan."""
    return t.orders.filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 1000000000)")
def multi_key_lookup(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_custkey").isin(3, 5, 8, 1_000_000_000)).select("c_custkey", "c_name")


@query("SELECT p.age_group, count(DISTINCT p.school_id) AS schools FROM pricing p JOIN place_pins l ON l.school_id = p.school_id JOIN schools s ON s.school_id = p.school_id WHERE p.age_group IS NOT NULL GROUP BY 1")
def distinct_count_by_group(t: Tables) -> DataFrame:
    """Exact distinct roots over a three-way join; the bridges are reduced to distinct keys before they meet."""
    p = t.pricing.filter("age_group is not null").select("school_id", "age_group").distinct()
    out = p.join(t.place_pins.select("school_id").distinct(), "school_id", "left_semi").join(t.schools.select("school_id").distinct(), "school_id", "left_semi")
    return out.groupBy("age_group").agg(F.count("*").alias("schools"))


TWO_LEVEL = """
WITH g AS (SELECT o_orderpriority AS kind, year(o_orderdate) AS year, l_returnflag AS subject, round(CAST(avg(l_quantity) AS DOUBLE), 2) AS average, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity IS NULL OR l_quantity >= 5 GROUP BY 1, 2, 3)
SELECT kind, CAST(count(*) AS BIGINT) AS groups, round(CAST(sum(CAST(average AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 1) AS overall, CAST(sum(n) AS BIGINT) AS rows FROM g GROUP BY 1"""


@query(TWO_LEVEL)
def two_level_average(t: Tables) -> DataFrame:
    """Averages by three keys, rounded, and the average of these by the first."""
    j = t.lineitem.filter("l_quantity is null or l_quantity >= 5").select("l_orderkey", "l_returnflag", "l_quantity").join(t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("year"), F.col("l_returnflag").alias("subject")).agg(F.round(F.avg("l_quantity"), 2).alias("average"), F.count("*").alias("n"))
    return g.groupBy("kind").agg(F.count("*").alias("groups"), F.round(F.sum(F.col("average").cast("decimal(18,2)")).cast("double") / F.count("*"), 1).alias("overall"), F.sum("n").alias("rows"))


@query("SELECT DISTINCT s.school_id, s.city FROM schools s WHERE EXISTS (SELECT 1 FROM place_pins p WHERE p.school_id = s.school_id AND p.lat BETWEEN 41.0 AND 43.0 AND p.lng BETWEEN 22.0 AND 24.0) AND EXISTS (SELECT 1 FROM pricing f WHERE f.school_id = s.school_id)")
def semi_join_in_box(t: Tables) -> DataFrame:
    """Correlated EXISTS with a residual box predicate as semi-joins; the box reaches the scan."""
    inside = t.place_pins.filter(in_box(F.col("lat"), F.col("lng"), *BOX)).select("school_id")
    return t.schools.select("school_id", "city").distinct().join(inside, "school_id", "left_semi").join(t.pricing.select("school_id"), "school_id", "left_semi")


@query("SELECT DISTINCT school_id, city FROM schools s WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.school_id = s.school_id AND p.is_valid)")
def anti_without_children(t: Tables) -> DataFrame:
    return t.schools.join(t.pages.filter("is_valid").select("school_id"), "school_id", "left_anti").select("school_id", "city").distinct()


@query("SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS orders, max(o.o_totalprice) AS largest FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2")
def left_outer_keep(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("largest"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "largest")


@query("""SELECT n_name, r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(18, 2)))) AS DOUBLE) AS revenue, count(DISTINCT c_custkey) AS customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_revenue(t: Tables) -> DataFrame:
    """The facts are summed by order before any dimension is joined."""
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    by_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(money).alias("r"))
    j = by_order.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    j = j.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("r").cast("double").alias("revenue"), F.count("c_custkey").alias("customers"))


@query("""WITH a AS (SELECT DISTINCT p_partkey, p_name FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_partkey, p_name FROM part WHERE p_retailprice > 1000 AND p_partkey NOT IN (SELECT p_partkey FROM a))
SELECT p_partkey, p_name, 'small' AS origin FROM a UNION ALL SELECT p_partkey, p_name, 'dear' FROM b""")
def union_of_lists(t: Tables) -> DataFrame:
    """Two filtered lists as one; membership in the first decides for rows of both. One scan, one pass."""
    small, dear = F.col("p_size") < 10, F.col("p_retailprice") > 1000
    return t.part.filter(small | dear).select("p_partkey", "p_name", F.when(closed(small), "small").otherwise("dear").alias("origin")).distinct()


@query("""
SELECT 'brand' AS facet, p_brand AS option, count(*) AS n FROM part WHERE p_type LIKE '%STEEL%' AND p_size <= 25 GROUP BY 2
UNION ALL SELECT 'type', p_type, count(*) FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size <= 25 GROUP BY 2
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_type LIKE '%STEEL%' GROUP BY 2""")
def faceted_counts(t: Tables) -> DataFrame:
    """For each option its count under all other facets' filters: one scan; a row counts for the facets whose other filters it passes."""
    brand, kind, size = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), F.col("p_type").contains("STEEL"), F.col("p_size") <= 25
    offer = lambda ok, facet, c: F.when(ok, F.struct(F.lit(facet).alias("facet"), c.cast("string").alias("option")))
    votes = F.array_compact(F.array(offer(kind & size, "brand", F.col("p_brand")), offer(brand & size, "type", F.col("p_type")), offer(brand & kind, "size", F.col("p_size"))))
    return t.part.select(F.inline(votes)).groupBy("facet", "option").agg(F.count("*").alias("n"))


@query("SELECT 'city' AS facet, list_sort(list(DISTINCT city)) AS options FROM schools WHERE city IS NOT NULL UNION ALL SELECT 'level', list_sort(list(DISTINCT education_level)) FROM schools WHERE education_level IS NOT NULL UNION ALL SELECT 'type', list_sort(list(DISTINCT school_type)) FROM schools WHERE school_type IS NOT NULL")
def facet_values(t: Tables) -> DataFrame:
    s = t.schools.select(F.expr("stack(3, 'city', city, 'level', education_level, 'type', school_type) as (facet, option)")).filter("option is not null").distinct()
    return s.groupBy("facet").agg(F.sort_array(F.collect_list("option")).alias("options"))


@query("""SELECT source, count(*) AS documents, count(*) FILTER (WHERE lang IS NOT NULL AND trim(lang) <> '') AS labelled, count(*) FILTER (WHERE n_chars >= 1000) AS long_ones,
round(100.0 * count(*) FILTER (WHERE lang IS NOT NULL AND trim(lang) <> '') / nullif(count(*), 0), 1) AS labelled_pct FROM documents GROUP BY 1""")
def conditional_counts(t: Tables) -> DataFrame:
    labelled = closed(F.trim("lang") != "")
    g = t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(labelled).alias("labelled"), F.count_if(F.col("n_chars") >= 1000).alias("long_ones"))
    return g.withColumn("labelled_pct", percent(F.col("labelled"), F.col("documents")))


@query("""SELECT event_type, coalesce(json_extract_string(props, '$.k'), '<missing>') AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def json_path_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.coalesce(F.get_json_object("props", "$.k"), F.lit("<missing>")).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY 1")
def json_key_counts(t: Tables) -> DataFrame:
    return t.events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT round(lat, 4) AS lat4, round(lng, 4) AS lng4, school_id FROM place_pins WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)), g AS (SELECT lat4, lng4, count(*) AS owners FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT lat4, lng4, owners, school_id FROM p JOIN g USING (lat4, lng4)""")
def duplicate_groups(t: Tables) -> DataFrame:
    """Owners that share a rounded position, a row for each."""
    p = t.place_pins.filter("lat is not null and lng is not null and not (lat = 0 and lng = 0)").select(F.round("lat", 4).alias("lat4"), F.round("lng", 4).alias("lng4"), "school_id").distinct()
    g = p.groupBy("lat4", "lng4").agg(F.count("*").alias("owners")).filter("owners >= 2")
    return p.join(g, ["lat4", "lng4"]).select("lat4", "lng4", "owners", "school_id")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def grouping_sets_stats(t: Tables) -> DataFrame:
    g = t.orders.groupingSets([[], [F.col("o_orderstatus")], [F.col("o_orderpriority")]], F.col("o_orderstatus"), F.col("o_orderpriority"))
    return g.agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("""SELECT event_type, user_id, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY total DESC, event_type, user_id LIMIT 200""")
def having_top(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", "user_id").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.count("*").alias("n")).filter("n >= 2")
    return g.orderBy(F.desc("total"), "event_type", "user_id").limit(200)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def membership_under_or(t: Tables) -> DataFrame:
    """Two memberships under OR: existence columns from two joins, then one filter."""
    a = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("_a"))
    b = t.lineitem.filter("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("_b", F.lit(True))
    return t.supplier.join(a, "s_nationkey", "left").join(b, "s_suppkey", "left").filter(closed(F.col("_a")) | closed(F.col("_b"))).select("s_suppkey", "s_name")


@query("""WITH s AS (SELECT DISTINCT school_id, city FROM schools), b AS (SELECT city, school_id, EXISTS (SELECT 1 FROM place_pins p WHERE p.school_id = s.school_id AND p.lat IS NOT NULL) AS pinned,
 EXISTS (SELECT 1 FROM pricing f WHERE f.school_id = s.school_id AND f.category = 'tuition') AS priced FROM s)
SELECT city, count(*) AS schools, count(*) FILTER (WHERE pinned) AS pinned, count(*) FILTER (WHERE priced) AS priced, round(CAST(count(*) FILTER (WHERE pinned AND priced) AS DOUBLE) / nullif(count(*) FILTER (WHERE pinned), 0), 4) AS priced_of_pinned FROM b GROUP BY 1""")
def coverage_chain(t: Tables) -> DataFrame:
    s = t.schools.select("school_id", "city").distinct()
    p = t.place_pins.filter("lat is not null").select("school_id").distinct().withColumn("_p", F.lit(True))
    f = t.pricing.filter("category = 'tuition'").select("school_id").distinct().withColumn("_f", F.lit(True))
    b = s.join(p, "school_id", "left").join(f, "school_id", "left").select("city", closed(F.col("_p")).alias("p"), closed(F.col("_f")).alias("f"))
    g = b.groupBy("city").agg(F.count("*").alias("schools"), F.count_if("p").alias("pinned"), F.count_if("f").alias("priced"), F.count_if(F.col("p") & F.col("f")).alias("_both"))
    return g.select("city", "schools", "pinned", "priced", ratio(F.col("_both"), F.col("pinned")).alias("priced_of_pinned"))


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS k FROM c)
SELECT l_suppkey, l_returnflag AS mode, n FROM r WHERE k = 1""")
def mode_with_preference(t: Tables) -> DataFrame:
    """The most frequent value, ties by a fixed preference: an aggregate, no window."""
    c = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    rank = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return c.groupBy("l_suppkey").agg(F.max(F.struct("n", (-rank).alias("p"), "l_returnflag")).alias("m")).select("l_suppkey", F.col("m.l_returnflag").alias("mode"), F.col("m.n").alias("n"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT c_nationkey, max(n) AS n FROM c GROUP BY 1), w AS (SELECT c.c_nationkey, count(*) AS ways, min(c_mktsegment) AS segment FROM c JOIN m ON c.c_nationkey = m.c_nationkey AND c.n = m.n GROUP BY 1)
SELECT c_nationkey, CASE WHEN ways = 1 THEN segment END AS segment, ways > 1 AS ambiguous FROM w""")
def mode_or_ambiguous(t: Tables) -> DataFrame:
    """The most frequent value, none where two tie."""
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    m = c.withColumn("_top", F.max("n").over(Window.partitionBy("c_nationkey"))).filter("n = _top").groupBy("c_nationkey").agg(F.count("*").alias("ways"), F.min("c_mktsegment").alias("segment"))
    return m.select("c_nationkey", F.when(F.col("ways") == 1, F.col("segment")).alias("segment"), (F.col("ways") > 1).alias("ambiguous"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18, 2)) AS cost, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM orders)
SELECT o_custkey, CAST(count(*) FILTER (WHERE run <= 500000) AS BIGINT) AS within, CAST(count(*) FILTER (WHERE run > 500000) AS BIGINT) AS beyond, CAST(coalesce(max(CASE WHEN run <= 500000 THEN run END), 0) AS DOUBLE) AS spent FROM l GROUP BY 1""")
def ledger_with_cap(t: Tables) -> DataFrame:
    """Running exact sums against a cap that equality still meets."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    run = sliced_running_sum(o, ["o_custkey"], F.date_trunc("quarter", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice").cast("decimal(18,2)"), "run")
    return run.groupBy("o_custkey").agg(F.count_if(F.col("run") <= 500000).alias("within"), F.count_if(F.col("run") > 500000).alias("beyond"), F.coalesce(F.max(F.when(F.col("run") <= 500000, F.col("run"))), F.lit(0)).cast("double").alias("spent"))


@query("""SELECT verdict, count(*) AS rows, count(*) FILTER (WHERE regexp_matches(lower(english_name), 'kindergarten|school|nursery|creche|^(dg|dya|ou|nu|su) ')) AS named,
round(CAST(count(*) FILTER (WHERE regexp_matches(lower(english_name), 'kindergarten|school|nursery|creche|^(dg|dya|ou|nu|su) ')) AS DOUBLE) / count(*), 4) AS share FROM identity_labels GROUP BY 1""")
def confusion_counts(t: Tables) -> DataFrame:
    named = closed(F.lower("english_name").rlike("kindergarten|school|nursery|creche|^(dg|dya|ou|nu|su) "))
    g = t.identity_labels.groupBy("verdict").agg(F.count("*").alias("rows"), F.count_if(named).alias("named"))
    return g.withColumn("share", ratio(F.col("named"), F.col("rows")))


@query("SELECT school_id, count(*) AS rows, CAST(sum(CASE WHEN amount_min IS NULL OR isnan(amount_min) OR amount_min < 0 THEN 0 ELSE CAST(amount_min AS DECIMAL(18, 2)) END) AS DOUBLE) AS lows FROM pricing GROUP BY 1")
def coerced_sums(t: Tables) -> DataFrame:
    """Sums in which missing, negative and not-a-number count as zero."""
    v = finite(F.col("amount_min"))
    return t.pricing.groupBy("school_id").agg(F.count("*").alias("rows"), F.sum(F.when(v >= 0, v.cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("lows"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY price_id ORDER BY loaded_at DESC, scraped_at DESC) AS k FROM pricing), g AS (SELECT *, amount IS NOT NULL AND regexp_matches(amount, '^[0-9]+(\\.[0-9]+)?$') AS number,
 currency IS NOT NULL AND trim(currency) <> '' AS cur, period IS NOT NULL AS per, coalesce(amount_min < amount_max, FALSE) AS rng FROM r WHERE k = 1)
SELECT category, count(*) AS rows, count(*) FILTER (WHERE number AND cur AND per AND NOT rng) AS passing, list_sort(list(DISTINCT CASE WHEN NOT number THEN 'amount' WHEN NOT cur THEN 'currency' WHEN NOT per THEN 'period' END) FILTER (WHERE NOT (number AND cur AND per))) AS reasons FROM g GROUP BY 1""".replace("\\\\", "\\"))
def row_gate(t: Tables) -> DataFrame:
    """Fail-closed conjunction over the newest version of each row, with the first reason of those that fail."""
    r = best_of(t.pricing.select("price_id", "category", "amount", "currency", "period", "amount_min", "amount_max", "loaded_at", "scraped_at"), ["price_id"], [F.desc("loaded_at"), F.desc("scraped_at")])
    number, cur, per = closed(F.col("amount").rlike(r"^[0-9]+(\.[0-9]+)?$")), closed(F.trim("currency") != ""), F.col("period").isNotNull()
    rng = closed(F.col("amount_min") < F.col("amount_max"))
    why = F.when(~number, "amount").when(~cur, "currency").when(~per, "period")
    return r.groupBy("category").agg(F.count("*").alias("rows"), F.count_if(number & cur & per & ~rng).alias("passing"), F.nullif(F.sort_array(F.collect_set(why)), F.array().cast("array<string>")).alias("reasons"))


@query("""WITH m AS (SELECT o_orderpriority, median(CAST(o_totalprice AS DECIMAL(18, 2))) AS mid FROM orders WHERE o_totalprice BETWEEN 1 AND 500000 GROUP BY 1)
SELECT o_orderkey, o_orderpriority, o_totalprice, o_totalprice > CAST(mid AS DOUBLE) AS high FROM orders JOIN m USING (o_orderpriority) WHERE o_totalprice < CAST(mid AS DOUBLE) * 0.25 OR o_totalprice > CAST(mid AS DOUBLE) * 1.75""")
def peer_median_outliers(t: Tables) -> DataFrame:
    """Rows far from the exact median of their group; the medians join back, so no group is held in one window frame."""
    a = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    m = a.filter("o_totalprice between 1 and 500000").groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("mid"))
    far = a.join(m, "o_orderpriority").filter("o_totalprice < mid * 0.25 or o_totalprice > mid * 1.75")
    return far.select("o_orderkey", "o_orderpriority", "o_totalprice", (F.col("o_totalprice") > F.col("mid")).alias("high"))


@query("SELECT school_id, min(loaded_at) AS first_seen, count(DISTINCT price_id) AS prices FROM pricing GROUP BY 1")
def first_seen(t: Tables) -> DataFrame:
    return t.pricing.groupBy("school_id").agg(F.min("loaded_at").alias("first_seen"), F.count_distinct("price_id").alias("prices"))


@query("SELECT DISTINCT s.school_id, s.name_i18n['bg'] AS name FROM schools s WHERE lower(s.name_i18n['bg']) LIKE '%градина%'")
def substring_search(t: Tables) -> DataFrame:
    name = F.col("name_i18n")["bg"]
    return t.schools.filter(F.lower(name).contains("градина")).select("school_id", name.alias("name")).distinct()


@query("SELECT DISTINCT school_id, coalesce(name_i18n['en'], name_i18n['bg']) AS name FROM schools")
def language_fallback(t: Tables) -> DataFrame:
    return t.schools.select("school_id", F.coalesce(F.col("name_i18n")["en"], F.col("name_i18n")["bg"]).alias("name")).distinct()


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%' AND is_valid")
def prefix_filter(t: Tables) -> DataFrame:
    """The prefix reaches the Parquet scan."""
    return t.pages.filter(F.col("url").startswith("https://") & F.col("is_valid")).select("page_id", "url")

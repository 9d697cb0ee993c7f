"""Queries on keys, sets and queues: scored and historical matches, cut-offs, own values, centroids, work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import name_key
from veyra.operators.graph import components
from veyra.operators.proximity import near_pairs, positioned
from veyra.operators.relational import best_of
from veyra.plans.geo import GOOD, HAV
from veyra.plans.registry import query
from veyra.sources.tables import Tables

KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


BRAND = rf"regexp_extract({KEY.format('name')}, '[^ ]+$')"


@query(f"""WITH RECURSIVE q AS (SELECT DISTINCT location_id AS id, lat, lng, {BRAND} AS brand FROM place_pins WHERE {GOOD} AND name IS NOT NULL), e AS (SELECT a.id AS a, b.id AS b FROM q a JOIN q b ON a.brand = b.brand AND a.id <> b.id AND {HAV.format(a='a', b='b')} <= 1000),
c AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node) SELECT node, min(label) AS component FROM c GROUP BY 1""")
def brand_clusters(t: Tables) -> DataFrame:
    """Connected parts of pins whose names end in one word within a kilometre: near pairs meet in cells, then the words are compared."""
    p = positioned(t.place_pins, "location_id")
    names = t.place_pins.filter("name is not null").select(F.col("location_id").cast("long").alias("id"), F.regexp_extract(name_key(F.col("name")), "[^ ]+$", 0).alias("brand")).distinct()
    b = p.join(names, "id")
    near = near_pairs(b, b, 1000.0).filter("a_id < b_id and a_brand = b_brand").select("a_id", "b_id")
    return components(near, "a_id", "b_id")


@query(f"""WITH d AS (SELECT DISTINCT dz_id, {KEY.format('name_full')} AS k, city, dz_kind FROM dz_responses WHERE name_full IS NOT NULL), p AS (SELECT DISTINCT location_id, {KEY.format('name')} AS k, city, CASE education_level WHEN 'nursery' THEN 'ДЯ' WHEN 'kindergarten' THEN 'ДГ' ELSE 'У' END AS kind FROM place_pins WHERE name IS NOT NULL),
s AS (SELECT d.dz_id, p.location_id, max(3 + CASE WHEN d.city = p.city THEN 2 ELSE 0 END + CASE WHEN d.dz_kind = p.kind THEN 1 ELSE 0 END) AS score FROM d JOIN p ON d.k = p.k GROUP BY 1, 2), r AS (SELECT *, max(score) OVER (PARTITION BY dz_id) AS top FROM s)
SELECT dz_id, max(top) AS score, CASE WHEN count(*) = 1 THEN min(location_id) END AS location_id FROM r WHERE score = top GROUP BY 1""")
def scored_match(t: Tables) -> DataFrame:
    """The best-scored candidate of equal name; none where two share the best score."""
    d = t.dz_responses.filter("name_full is not null").select("dz_id", name_key(F.col("name_full")).alias("k"), F.col("city").alias("dcity"), "dz_kind").distinct()
    kind = F.when(F.col("education_level") == "nursery", "ДЯ").when(F.col("education_level") == "kindergarten", "ДГ").otherwise("У")
    p = t.place_pins.filter("name is not null").select("location_id", name_key(F.col("name")).alias("k"), "city", kind.alias("kind")).distinct()
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    s = d.join(p, "k").groupBy("dz_id", "location_id").agg(F.max(3 + 2 * one(F.col("dcity") == F.col("city")) + one(F.col("dz_kind") == F.col("kind"))).alias("score"))
    top = s.groupBy("dz_id").agg(F.max("score").alias("top"))
    g = s.join(top, "dz_id").filter("score = top").groupBy("dz_id").agg(F.max("top").alias("score"), F.count("*").alias("n"), F.min("location_id").alias("m"))
    return g.select("dz_id", "score", F.when(F.col("n") == 1, F.col("m")).alias("location_id"))


@query(f"""WITH r AS (SELECT dz_id, {KEY.format('name_full')} AS k, row_number() OVER (PARTITION BY dz_id ORDER BY fetched_at DESC, response_id DESC) AS v FROM dz_responses WHERE name_full IS NOT NULL), p AS (SELECT {KEY.format('name')} AS k, min(location_id) AS location_id FROM place_pins WHERE name IS NOT NULL GROUP BY 1)
SELECT r.dz_id, coalesce(max(CASE WHEN v = 1 THEN location_id END), min(CASE WHEN v > 1 THEN location_id END)) AS location_id, CASE WHEN max(CASE WHEN v = 1 THEN location_id END) IS NOT NULL THEN 'current' WHEN min(location_id) IS NOT NULL THEN 'former' END AS by_name FROM r LEFT JOIN p USING (k) GROUP BY 1""")
def current_or_former_name(t: Tables) -> DataFrame:
    """A match by the newest name, else by an earlier one."""
    w = Window.partitionBy("dz_id").orderBy(F.desc("fetched_at"), F.desc("response_id"))
    r = t.dz_responses.filter("name_full is not null").select("dz_id", name_key(F.col("name_full")).alias("k"), F.row_number().over(w).alias("v"))
    p = t.place_pins.filter("name is not null").groupBy(name_key(F.col("name")).alias("k")).agg(F.min("location_id").alias("location_id"))
    now, then = F.max(F.when(F.col("v") == 1, F.col("location_id"))), F.min(F.when(F.col("v") > 1, F.col("location_id")))
    return r.join(p, "k", "left").groupBy("dz_id").agg(F.coalesce(now, then).alias("location_id"), F.when(now.isNotNull(), "current").when(then.isNotNull(), "former").alias("by_name"))


@query("""WITH m AS (SELECT DISTINCT source, doc_kind FROM documents WHERE source IS NOT NULL AND doc_kind IS NOT NULL), o AS (SELECT a.source, b.doc_kind FROM (SELECT DISTINCT source FROM m) a, (SELECT DISTINCT doc_kind FROM m) b)
SELECT source, doc_kind AS missing FROM o EXCEPT SELECT source, doc_kind FROM m""")
def others_minus_own(t: Tables) -> DataFrame:
    """Values that occur elsewhere but not in a group: the list of all values is small and fixed, each group's own is taken from it."""
    m = t.documents.filter("source is not null and doc_kind is not null").select("source", "doc_kind").distinct()
    every = m.agg(F.sort_array(F.collect_set("doc_kind")).alias("e")).scalar()
    own = m.groupBy("source").agg(F.collect_set("doc_kind").alias("own"))
    return own.select("source", F.explode(F.array_except(every, F.col("own"))).alias("missing"))


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), c AS (SELECT o_orderpriority, min(o_totalprice) AS cutoff FROM r WHERE k <= 100 GROUP BY 1)
SELECT c.o_orderpriority, c.cutoff, count(*) FILTER (WHERE o.o_totalprice >= c.cutoff) AS at_or_above, count(*) FILTER (WHERE o.o_totalprice = c.cutoff) AS ties FROM c JOIN orders o ON o.o_orderpriority = c.o_orderpriority GROUP BY 1, 2""")
def cutoffs(t: Tables) -> DataFrame:
    """The hundredth-best value of each group and how many tie with it; each task keeps its best hundred before the shuffle."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = t.orders.select("o_orderpriority", "o_totalprice", F.row_number().over(w).alias("k"), "o_orderkey").filter("k <= 100")
    c = top.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("cutoff"))
    o = t.orders.select("o_orderpriority", "o_totalprice").join(c, "o_orderpriority")
    return o.groupBy("o_orderpriority", "cutoff").agg(F.count_if(F.col("o_totalprice") >= F.col("cutoff")).alias("at_or_above"), F.count_if(F.col("o_totalprice") == F.col("cutoff")).alias("ties"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(lower(url), '^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)', 1) AS host, unnest(regexp_extract_all(raw_markdown, '(^|[^0-9])(0[0-9]{1,2} [0-9]{3} [0-9]{4})', 2)) AS phone FROM pages WHERE url IS NOT NULL AND raw_markdown IS NOT NULL), n AS (SELECT phone FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT host, count(*) AS phones, min(phone) AS first_phone FROM p JOIN n USING (phone) GROUP BY 1""")
def own_phones(t: Tables) -> DataFrame:
    """Phone numbers that stand on one site only."""
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z]+://)?(?:www\.)?([^/:?#]+)", 1)
    found = F.regexp_extract_all("raw_markdown", F.lit(r"(^|[^0-9])(0[0-9]{1,2} [0-9]{3} [0-9]{4})"), F.lit(2))
    p = t.pages.filter("url is not null and raw_markdown is not null").select(host.alias("host"), F.explode(found).alias("phone")).distinct()
    n = p.groupBy("phone").agg(F.count("*").alias("n"), F.min("host").alias("host")).filter("n = 1")
    return n.groupBy("host").agg(F.count("*").alias("phones"), F.min("phone").alias("first_phone"))


@query("""WITH v AS (SELECT DISTINCT price_id, school_id, category, plan_name, age_group, academic_year, loaded_at FROM pricing), m AS (SELECT school_id, category, plan_name, age_group, academic_year, max((loaded_at, price_id)) AS newest FROM v GROUP BY ALL)
SELECT v.price_id, CASE WHEN (v.loaded_at, v.price_id) = m.newest THEN 'kept' ELSE 'superseded' END AS standing FROM v JOIN m ON v.school_id = m.school_id AND v.category IS NOT DISTINCT FROM m.category AND v.plan_name IS NOT DISTINCT FROM m.plan_name AND v.age_group IS NOT DISTINCT FROM m.age_group AND v.academic_year IS NOT DISTINCT FROM m.academic_year""")
def superseded_rows(t: Tables) -> DataFrame:
    """Old rows kept or superseded against the newest of the same content key."""
    v = t.pricing.select("price_id", "school_id", "category", "plan_name", "age_group", "academic_year", "loaded_at").distinct()
    v = v.withColumn("k", F.sha2(F.to_json(F.struct("school_id", "category", "plan_name", "age_group", "academic_year"), {"ignoreNullFields": "false"}), 256)).select("k", "price_id", F.struct("loaded_at", "price_id").alias("r"))
    m = v.groupBy("k").agg(F.max("r").alias("newest"))
    return v.join(m, "k").select("price_id", F.when(F.col("r") == F.col("newest"), "kept").otherwise("superseded").alias("standing"))


@query(r"""WITH o AS (SELECT label_id, CAST(regexp_extract(english_name, '^([0-9]+)(st|nd|rd|th) ', 1) AS VARCHAR) AS n, regexp_extract(english_name, '^([0-9]+)(st|nd|rd|th) ', 2) AS s FROM identity_labels WHERE regexp_matches(english_name, '^[0-9]+(st|nd|rd|th) ')), i AS (SELECT label_id, CAST(n AS BIGINT) AS n, s FROM o)
SELECT DISTINCT label_id, n, s = CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS right_ending FROM i""")
def ordinal_endings(t: Tables) -> DataFrame:
    """Whether an ordinal has the ending its number asks for."""
    p = r"^([0-9]+)(st|nd|rd|th) "
    o = t.identity_labels.filter(F.col("english_name").rlike(p)).select("label_id", F.regexp_extract("english_name", p, 1).cast("long").alias("n"), F.regexp_extract("english_name", p, 2).alias("s"))
    want = F.when((F.col("n") % 100).between(11, 13), "th").when(F.col("n") % 10 == 1, "st").when(F.col("n") % 10 == 2, "nd").when(F.col("n") % 10 == 3, "rd").otherwise("th")
    return o.select("label_id", "n", (F.col("s") == want).alias("right_ending")).distinct()


@query(r"""WITH n AS (SELECT DISTINCT dz_id, ' ' || trim(regexp_replace(lower(name_full), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS k FROM dz_responses WHERE name_full IS NOT NULL)
SELECT DISTINCT dz_id, trim(regexp_replace(regexp_replace(k, ' (детска градина|детска ясла|(основно|начално|средно) училище|дг|дя|оу|ну|су) ', ' '), ' (гр|град) [^ ]+ $', ' ')) AS core FROM n""")
def core_names(t: Tables) -> DataFrame:
    """Names without their first type words and a town at the end."""
    k = F.concat(F.lit(" "), name_key(F.col("name_full")), F.lit(" "))
    typed = r"^(.*?) (детска градина|детска ясла|(основно|начално|средно) училище|дг|дя|оу|ну|су) "
    core = F.regexp_replace(F.regexp_replace(k, typed, "$1 "), r" (гр|град) [^ ]+ $", " ")
    return t.dz_responses.filter("name_full is not null").select("dz_id", F.trim(core).alias("core")).distinct()


@query("""WITH p AS (SELECT doc_id, string_split(text, '€') AS parts FROM documents WHERE contains(text, '€')), n AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS nth FROM p)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, md5(right(parts[nth], 40) || '€' || left(parts[nth + 1], 40)) AS window_md5 FROM n""")
def keyword_windows(t: Tables) -> DataFrame:
    """What stands within forty characters on both sides of each occurrence of a keyword, up to the next one."""
    parts = F.split("text", "€", -1)
    around = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.right(F.get(parts, i - 1), F.lit(40)), F.lit("€"), F.left(F.get(parts, i), F.lit(40))))
    return t.documents.filter(F.col("text").contains("€")).select("doc_id", F.posexplode(around).alias("pos", "w")).select("doc_id", (F.col("pos") + 1).alias("nth"), F.md5("w").alias("window_md5"))


@query(r"""WITH d AS (SELECT DISTINCT page_id, raw_markdown, last_scraped_at FROM pages WHERE raw_markdown IS NOT NULL), x AS (SELECT page_id, last_scraped_at, unnest(regexp_extract_all(raw_markdown, '(^|[^0-9.:,])([0-3]?[0-9]\.[01]?[0-9]\.20[0-9][0-9])', 2)) AS s FROM d), p AS (SELECT page_id, last_scraped_at, try_strptime(s, '%d.%m.%Y') AS day FROM x)
SELECT page_id, last_scraped_at, count(*) AS dates, count(*) FILTER (WHERE day > last_scraped_at) AS future FROM p WHERE day IS NOT NULL GROUP BY 1, 2""")
def future_dates(t: Tables) -> DataFrame:
    """Dates in a page that lie after its crawl."""
    found = F.regexp_extract_all("raw_markdown", F.lit(r"(^|[^0-9.:,])([0-3]?[0-9]\.[01]?[0-9]\.20[0-9][0-9])"), F.lit(2))
    d = t.pages.filter("raw_markdown is not null").select("page_id", "last_scraped_at", "raw_markdown").distinct().select("page_id", "last_scraped_at", F.explode(found).alias("s"))
    p = d.withColumn("day", F.try_to_timestamp("s", F.lit("d.M.yyyy")).cast("timestamp_ntz")).filter("day is not null")
    return p.groupBy("page_id", "last_scraped_at").agg(F.count("*").alias("dates"), F.count_if(F.col("day") > F.col("last_scraped_at")).alias("future"))


@query("""WITH p AS (SELECT DISTINCT school_id, location_id, lat, lng FROM place_pins WHERE lat BETWEEN -90 AND 90 AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)), b AS (SELECT school_id, count(*) AS pins, CAST(sum(CAST(round(lat * 1000000) AS BIGINT)) // count(*) AS BIGINT) AS clat, CAST(sum(CAST(round(lng * 1000000) AS BIGINT)) // count(*) AS BIGINT) AS clng, max(lat) - min(lat) AS dlat, max(lng) - min(lng) AS dlng FROM p GROUP BY 1)
SELECT school_id, pins, CASE WHEN dlat <= 0.005 AND dlng <= 0.007 THEN clat END AS lat_e6, CASE WHEN dlat <= 0.005 AND dlng <= 0.007 THEN clng END AS lng_e6 FROM b""")
def centroids(t: Tables) -> DataFrame:
    """The middle of an owner's points, in millionths of a degree, if they lie close together."""
    p = t.place_pins.filter("lat between -90 and 90 and lng is not null and not (lat = 0 and lng = 0)").select("school_id", "location_id", "lat", "lng").distinct()
    close = (F.max("lat") - F.min("lat") <= 0.005) & (F.max("lng") - F.min("lng") <= 0.007)
    mid = lambda c: F.expr(f"sum(cast(round({c} * 1000000) as bigint)) div count(*)")
    return p.groupBy("school_id").agg(F.count("*").alias("pins"), F.when(close, mid("lat")).alias("lat_e6"), F.when(close, mid("lng")).alias("lng_e6"))


@query("""WITH p AS (SELECT DISTINCT page_id, school_id, is_valid, scrape_count, last_scraped_at, raw_markdown IS NULL OR trim(raw_markdown) = '' AS empty FROM pages), m AS (SELECT max(last_scraped_at) AS now FROM p)
SELECT page_id, CASE WHEN NOT coalesce(is_valid, FALSE) THEN 'invalid' WHEN empty THEN 'empty' ELSE 'stale' END AS reason FROM p, m WHERE NOT coalesce(is_valid, FALSE) OR empty OR last_scraped_at IS NULL OR last_scraped_at < now - INTERVAL 180 DAY""")
def work_queue(t: Tables) -> DataFrame:
    """Pages that need another visit, and why."""
    p = t.pages.select("page_id", "is_valid", "last_scraped_at", F.coalesce(F.trim("raw_markdown") == "", F.lit(True)).alias("empty")).distinct()
    now = t.pages.agg(F.max("last_scraped_at")).scalar()
    bad = ~F.coalesce("is_valid", F.lit(False))
    stale = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < now - F.expr("interval 180 days"))
    return p.filter(bad | F.col("empty") | stale).select("page_id", F.when(bad, "invalid").when(F.col("empty"), "empty").otherwise("stale").alias("reason")).distinct()


@query(r"""WITH e AS (SELECT DISTINCT fee_id, trim(regexp_replace(lower(evidence), '\s+', ' ', 'g')) AS q FROM missed_fees WHERE evidence IS NOT NULL)
SELECT fee_id, q FROM e WHERE length(q) BETWEEN 3 AND 60 AND NOT regexp_matches(q, '[a-z0-9._%+-]+@[a-z0-9.-]+|https?://|www\.|([0-9][ -]?){7,}')""")
def clean_queries(t: Tables) -> DataFrame:
    """Short texts with white space collapsed, those too short, too long or with personal data left out."""
    q = F.trim(F.regexp_replace(F.lower("evidence"), r"\s+", " "))
    e = t.missed_fees.filter("evidence is not null").select("fee_id", q.alias("q")).distinct()
    return e.filter(F.length("q").between(3, 60) & ~F.col("q").rlike(r"[a-z0-9._%+-]+@[a-z0-9.-]+|https?://|www\.|([0-9][ -]?){7,}"))


@query(r"""WITH l AS (SELECT DISTINCT page_id, raw_markdown FROM pages WHERE raw_markdown IS NOT NULL), x AS (SELECT page_id, unnest(string_split(raw_markdown, chr(10))) AS line, CAST(generate_subscripts(string_split(raw_markdown, chr(10)), 1) AS INTEGER) AS line_no FROM l),
a AS (SELECT page_id, line_no, unnest(regexp_extract_all(line, '([0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)', 1)) AS v, unnest(regexp_extract_all(line, '([0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)', 2)) AS currency FROM x)
SELECT page_id, line_no, currency, CAST(replace(v, ',', '.') AS DOUBLE) AS amount, count(*) AS times FROM a GROUP BY ALL""")
def page_findings(t: Tables) -> DataFrame:
    """One page in, no or many findings out: lines and the amounts in each are exploded by built-in functions."""
    p = t.pages.filter("raw_markdown is not null").select("page_id", "raw_markdown").distinct()
    lines = p.select("page_id", F.posexplode(F.split("raw_markdown", "\n", -1)).alias("pos", "line"))
    pat = F.lit(r"([0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)")
    found = lines.select("page_id", (F.col("pos") + 1).alias("line_no"), F.explode(F.arrays_zip(F.regexp_extract_all("line", pat, F.lit(1)).alias("v"), F.regexp_extract_all("line", pat, F.lit(2)).alias("c"))).alias("f"))
    found = found.select("page_id", "line_no", F.col("f.c").alias("currency"), F.replace(F.col("f.v"), F.lit(","), F.lit(".")).cast("double").alias("amount"))
    return found.groupBy("page_id", "line_no", "currency", "amount").agg(F.count("*").alias("times"))

"""Queries that link rows and keep state: superset joins, reverse and unanimous links, claims, diffs with a breaker, merges, gates, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import canonical_url, closed, finite, hash_share, name_key, ratio
from veyra.plans.listing import loose_spelling_search
from veyra.plans.registry import ORACLE, query
from veyra.plans.texts import CANON, KEY
from veyra.sources.tables import Tables

HOST = r"regexp_extract(lower({0}), '^[a-z]+://(?:www\.)?([^/:?#]+)', 1)"
_HOST = r"^[a-z]+://(?:www\.)?([^/:?#]+)"


def host(c: str):
    return F.regexp_extract(F.lower(c), _HOST, 1)


@query(f"SELECT DISTINCT s.school_id, m.fee_id FROM schools s JOIN missed_fees m ON {HOST.format('s.website_url')} = {HOST.format('m.page_url')} WHERE {HOST.format('s.website_url')} <> ''")
def same_site_rows(t: Tables) -> DataFrame:
    """Rows of one site: a cheap key that holds all true pairs joins, the exact host decides."""
    cheap = lambda c: F.regexp_extract(F.lower(c), r"([^/.:-]+\.[a-z]+)(?:[:/?#]|$)", 1)
    s = t.schools.filter("website_url is not null").select("school_id", cheap("website_url").alias("k"), host("website_url").alias("h")).distinct().filter("h != ''")
    m = t.missed_fees.filter("page_url is not null").select("fee_id", cheap("page_url").alias("k"), host("page_url").alias("g")).distinct()
    return s.join(m, "k").filter("h = g").select("school_id", "fee_id").distinct()


_TAIL = f"regexp_extract({KEY.format('name')}, '[^ 0-9]+ [^ 0-9]+$')"


@query(f"""WITH p AS (SELECT DISTINCT school_id, city, education_level AS lvl, {_TAIL} AS k FROM place_pins WHERE name IS NOT NULL), a AS (SELECT * FROM p WHERE lvl = 'kindergarten' AND k <> ''), b AS (SELECT * FROM p WHERE lvl = 'school' AND k <> ''),
x AS (SELECT DISTINCT a.school_id AS earlier, b.school_id AS later FROM a JOIN b USING (city, k)) SELECT later AS school_id, min(earlier) AS continued_from FROM x WHERE earlier IN (SELECT earlier FROM x GROUP BY 1 HAVING count(*) = 1) GROUP BY later HAVING count(*) = 1""")
def reverse_links(t: Tables) -> DataFrame:
    """Who an institution continues: the reverse edge of a name link, kept where it is the only one on both sides."""
    tail = F.regexp_extract(name_key(F.col("name")), "[^ 0-9]+ [^ 0-9]+$", 0)
    p = t.place_pins.filter("name is not null").select("school_id", "city", "education_level", tail.alias("k")).distinct().filter("k != ''")
    x = p.filter("education_level = 'kindergarten'").select(F.col("school_id").alias("earlier"), "city", "k").join(p.filter("education_level = 'school'").select(F.col("school_id").alias("later"), "city", "k"), ["city", "k"]).select("earlier", "later").distinct()
    once = x.groupBy("earlier").agg(F.count("*").alias("n"), F.min("later").alias("later")).filter("n = 1")
    # a later one with two candidates is ambiguous even if one of them is linked elsewhere too
    return once.groupBy("later").agg(F.count("*").alias("n"), F.min("earlier").alias("continued_from")).filter("n = 1").select(F.col("later").alias("school_id"), "continued_from")


@query(f"""WITH a AS (SELECT DISTINCT point_id, city, {_TAIL} AS k FROM municipal_points WHERE name IS NOT NULL AND {_TAIL} <> ''), b AS (SELECT DISTINCT location_id, city, {_TAIL} AS k FROM place_pins WHERE name IS NOT NULL AND {_TAIL} <> ''), m AS (SELECT point_id, location_id FROM a JOIN b USING (city, k))
SELECT point_id, location_id, count(*) OVER (PARTITION BY point_id) AS by_point, count(*) OVER (PARTITION BY location_id) AS by_pin, count(*) OVER (PARTITION BY point_id) > 1 OR count(*) OVER (PARTITION BY location_id) > 1 AS doubled FROM m""")
def double_claims(t: Tables) -> DataFrame:
    """A match of many to many that tells which rows are claimed more than once; counts are aggregates joined back."""
    side = lambda d, i: d.filter("name is not null").select(i, "city", F.regexp_extract(name_key(F.col("name")), "[^ 0-9]+ [^ 0-9]+$", 0).alias("k")).distinct().filter("k != ''")
    m = side(t.municipal_points, "point_id").join(side(t.place_pins, "location_id"), ["city", "k"]).select("point_id", "location_id")
    a, b = m.groupBy("point_id").agg(F.count("*").alias("by_point")), m.groupBy("location_id").agg(F.count("*").alias("by_pin"))
    return m.join(a, "point_id").join(b, "location_id").select("point_id", "location_id", "by_point", "by_pin", ((F.col("by_point") > 1) | (F.col("by_pin") > 1)).alias("doubled"))


@query("""WITH f AS (SELECT DISTINCT line_id, per, fee_kind, currency, amount FROM fee_lines WHERE amount > 0 AND NOT isnan(amount)) SELECT b.line_id, EXISTS (SELECT 1 FROM f e WHERE e.currency = 'EUR' AND e.per = b.per AND e.fee_kind IS NOT DISTINCT FROM b.fee_kind AND abs(e.amount - b.amount / 1.95583) <= 0.01 * e.amount) AS repeated FROM f b WHERE b.currency = 'BGN'""")
def currency_variants(t: Tables) -> DataFrame:
    """Sums in the old currency that repeat a euro sum of their group within one percent; both meet in cells of a log scale."""
    f = t.fee_lines.select("line_id", "per", F.coalesce("fee_kind", F.lit("")).alias("kind"), "currency", finite(F.col("amount")).alias("v")).distinct().filter("v > 0")
    cell = lambda c: F.floor(F.log(c) / 0.02).cast("long")
    e = f.filter("currency = 'EUR'").select("per", "kind", F.col("v").alias("e"), F.explode(F.array(*[cell(F.col("v")) + i for i in (-1, 0, 1)])).alias("cell"))
    b = f.filter("currency = 'BGN'").select("line_id", "per", "kind", (F.col("v") / 1.95583).alias("b"))
    hit = b.withColumn("cell", cell(F.col("b"))).join(e, ["per", "kind", "cell"]).filter("abs(e - b) <= 0.01 * e").select("line_id").distinct()
    return b.select("line_id").distinct().join(hit.withColumn("hit", F.lit(True)), "line_id", "left").select("line_id", closed(F.col("hit")).alias("repeated"))


@query(f"""WITH p AS (SELECT DISTINCT {HOST.format('url')} AS h FROM pages WHERE page_category = 'pricing' AND is_valid), m AS (SELECT DISTINCT fee_id, {HOST.format('page_url')} AS h FROM missed_fees) SELECT fee_id FROM m WHERE h IN (SELECT h FROM p)""")
def fees_with_a_page(t: Tables) -> DataFrame:
    """Rows whose site has a valid page of prices: a semi-join."""
    p = t.pages.filter("page_category = 'pricing' and is_valid").select(host("url").alias("h"))
    return t.missed_fees.filter("page_url is not null").select("fee_id", host("page_url").alias("h")).join(p, "h", "left_semi").select("fee_id").distinct()


@query(f"""WITH p AS (SELECT DISTINCT school_id, city, regexp_extract({KEY.format('name')}, '[^ ]+$') AS k FROM place_pins WHERE name IS NOT NULL) SELECT city, k AS name, count(DISTINCT school_id) AS owners, min(school_id) AS first_owner FROM p GROUP BY 1, 2 HAVING count(DISTINCT school_id) > 1""")
def shared_last_names(t: Tables) -> DataFrame:
    """One published name among several owners of a group: an aggregate in place of a self-join."""
    p = t.place_pins.filter("name is not null").select("school_id", "city", F.regexp_extract(name_key(F.col("name")), "[^ ]+$", 0).alias("name")).distinct()
    return p.groupBy("city", "name").agg(F.count_distinct("school_id").alias("owners"), F.min("school_id").alias("first_owner")).filter("owners > 1")


@query("""WITH have AS (SELECT DISTINCT city, kind FROM municipal_points WHERE city IS NOT NULL AND kind IS NOT NULL) SELECT DISTINCT city, education_level AS kind FROM place_pins WHERE city IS NOT NULL AND education_level IS NOT NULL AND (city, education_level) NOT IN (SELECT city, kind FROM have)
UNION ALL SELECT 'any', k FROM (SELECT DISTINCT kind AS k FROM have WHERE kind NOT IN (SELECT education_level FROM place_pins WHERE education_level IS NOT NULL))""")
def inserted_keys(t: Tables) -> DataFrame:
    """What an insert of keys not yet there adds, on both sides."""
    have = t.municipal_points.select("city", "kind").filter("city is not null and kind is not null").distinct()
    new = t.place_pins.select("city", F.col("education_level").alias("kind")).filter("city is not null and kind is not null").distinct()
    back = have.select("kind").distinct().join(new.select("kind").distinct(), "kind", "left_anti").select(F.lit("any").alias("city"), "kind")
    return new.join(have, ["city", "kind"], "left_anti").unionByName(back)


@query("""WITH s AS (SELECT DISTINCT school_id, city, school_type, education_level AS lvl FROM schools), g AS (SELECT DISTINCT school_id, age_group FROM pricing WHERE age_group IS NOT NULL)
SELECT s.city, s.school_type, s.lvl, list_sort(list(DISTINCT g.age_group)) AS bands, count(DISTINCT s.school_id) AS members FROM s JOIN g USING (school_id) GROUP BY 1, 2, 3""")
def sibling_bands(t: Tables) -> DataFrame:
    """The bands that the siblings of a group cover, over the bridge of their prices; bands are a short fixed list."""
    s = t.schools.select("school_id", "city", "school_type", F.col("education_level").alias("lvl")).distinct()
    g = t.pricing.filter("age_group is not null").select("school_id", "age_group").distinct()
    return s.join(g, "school_id").groupBy("city", "school_type", "lvl").agg(F.sort_array(F.collect_set("age_group")).alias("bands"), F.count_distinct("school_id").alias("members"))


_ADDR = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT DISTINCT city, {_ADDR.format('address')} AS a, CAST(floor(lat * 10000) AS BIGINT) AS lat, CAST(floor(lng * 10000) AS BIGINT) AS lng FROM municipal_points WHERE address IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng IS NOT NULL), d AS (SELECT DISTINCT point_id, city, {_ADDR.format('address')} AS a FROM municipal_points WHERE address IS NOT NULL)
SELECT d.point_id, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(lat) END AS lat, CASE WHEN count(*) = 1 THEN min(lng) END AS lng FROM d JOIN p USING (city, a) GROUP BY 1""")
def unanimous_points(t: Tables) -> DataFrame:
    """The position of an address if all its candidates share one, else none."""
    text = F.trim(F.regexp_replace(F.lower("address"), r"[^\p{L}\p{N}]+", " "))
    m = t.municipal_points.filter("address is not null")
    p = m.filter("lat between -90 and 90 and lng is not null").select("city", text.alias("a"), F.floor(F.col("lat") * 10000).alias("lat"), F.floor(F.col("lng") * 10000).alias("lng")).distinct()
    one = p.groupBy("city", "a").agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    d = m.select("point_id", "city", text.alias("a")).distinct().join(one, ["city", "a"])
    return d.groupBy("point_id").agg(F.sum("n").alias("candidates"), F.min("lat").alias("lat0"), F.min("lng").alias("lng0"), F.count("*").alias("k")).select("point_id", "candidates", F.when(F.col("candidates") == 1, F.col("lat0")).alias("lat"), F.when(F.col("candidates") == 1, F.col("lng0")).alias("lng"))


@query("""WITH p AS (SELECT DISTINCT school_id, location_id, floor(lat * 10000) AS y, floor(lng * 10000) AS x FROM place_pins WHERE lat BETWEEN -90 AND 90 AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)) SELECT a.location_id, count(DISTINCT b.school_id) AS others, min(b.school_id) AS first_other FROM p a JOIN p b USING (y, x) WHERE a.school_id <> b.school_id GROUP BY 1""")
def other_owners_here(t: Tables) -> DataFrame:
    """How many other owners have a pin on the same spot: owners of a spot are counted once, a pin takes its own away."""
    p = t.place_pins.filter("lat between -90 and 90 and lng is not null and not (lat = 0 and lng = 0)").select("school_id", "location_id", F.floor(F.col("lat") * 10000).alias("y"), F.floor(F.col("lng") * 10000).alias("x")).distinct()
    own = p.select("y", "x", "school_id").distinct()
    # the two smallest owners of a spot are enough to name the first other one
    spot = own.groupBy("y", "x").agg(F.count("*").alias("n"), F.min("school_id").alias("s1"))
    second = own.join(spot, ["y", "x"]).filter("school_id > s1").groupBy("y", "x").agg(F.min("school_id").alias("s2"))
    hit = p.join(spot.filter("n > 1").join(second, ["y", "x"]), ["y", "x"]).select("location_id", (F.col("n") - 1).alias("others"), F.when(F.col("school_id") == F.col("s1"), F.col("s2")).otherwise(F.col("s1")).alias("first_other"))
    return hit.groupBy("location_id").agg(F.max("others").alias("others"), F.min("first_other").alias("first_other"))


@query("""WITH c AS (SELECT c_mktsegment, quantile_disc(c_acctbal, 0.75) AS cutoff FROM customer GROUP BY 1) SELECT c_custkey, CASE WHEN c_acctbal >= cutoff + 250 THEN 'likely' WHEN c_acctbal >= cutoff - 250 THEN 'close' ELSE 'below' END AS chance FROM customer JOIN c USING (c_mktsegment)""")
def chances(t: Tables) -> DataFrame:
    """A value against its group's cut-off, in three bands."""
    c = t.customer.groupBy("c_mktsegment").agg(F.expr("percentile_disc(0.75) within group (order by c_acctbal)").alias("cutoff"))
    d = F.col("c_acctbal") - F.col("cutoff")
    return t.customer.join(c, "c_mktsegment").select("c_custkey", F.when(F.col("c_acctbal") >= F.col("cutoff") + 250, "likely").when(F.col("c_acctbal") >= F.col("cutoff") - 250, "close").otherwise("below").alias("chance"))


@query("SELECT source, count(DISTINCT lang) AS labels, count(DISTINCT lang) > 8 AS several FROM documents GROUP BY 1")
def distinct_flags(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count_distinct("lang").alias("labels")).withColumn("several", F.col("labels") > 8)


@query("""WITH s AS (SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS score, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2), m AS (SELECT user_id, max((score, days)) AS top FROM s GROUP BY 1)
SELECT s.user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS best, max(score) AS score, max(days) AS days, count(*) AS tied FROM s JOIN m ON s.user_id = m.user_id AND (s.score, s.days) = m.top GROUP BY 1""")
def best_candidates(t: Tables) -> DataFrame:
    """Scores of each candidate summed over many rows, the days that speak for it, and the best one; a tie names none."""
    s = t.events.groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score"), F.count_distinct(F.to_date("ts")).alias("days"))
    m = s.groupBy("user_id").agg(F.max(F.struct("score", "days")).alias("top"))
    b = s.join(m, "user_id").filter(F.struct("score", "days") == F.col("top")).groupBy("user_id").agg(F.count("*").alias("tied"), F.min("event_type").alias("e"), F.max("score").alias("score"), F.max("days").alias("days"))
    return b.select("user_id", F.when(F.col("tied") == 1, F.col("e")).alias("best"), "score", "days", "tied")


_FEATURES = {"address": "address IS NOT NULL", "number": "regexp_matches(coalesce(name_full, ''), '[0-9]')", "quoted": "regexp_matches(coalesce(name_full, ''), '[«„“\"]')", "town": "contains(lower(coalesce(name_full, '')), lower(city))"}


@query("WITH r AS (SELECT DISTINCT * FROM dz_responses), v AS (SELECT *, row_number() OVER (PARTITION BY dz_id ORDER BY fetched_at, response_id) AS a, row_number() OVER (PARTITION BY dz_id ORDER BY fetched_at DESC, response_id DESC) AS z FROM r), f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, o.dz_id, coalesce(o.h, FALSE) AS was, coalesce(n.h, FALSE) AS now FROM (SELECT dz_id, {c} AS h FROM v WHERE a = 1) o JOIN (SELECT dz_id, {c} AS h FROM v WHERE z = 1) n USING (dz_id)" for k, c in _FEATURES.items()) + """)
SELECT feature, count(*) FILTER (WHERE was) AS before, count(*) FILTER (WHERE now) AS after, count(*) FILTER (WHERE was AND NOT now) AS lost, min(dz_id) FILTER (WHERE was AND NOT now) AS first_lost, greatest(10, CAST(ceil(0.05 * count(*) FILTER (WHERE was)) AS BIGINT)) AS allowed, count(*) FILTER (WHERE was AND NOT now) > greatest(10, CAST(ceil(0.05 * count(*) FILTER (WHERE was)) AS BIGINT)) AS stop FROM f GROUP BY 1""")
def publish_diff(t: Tables) -> DataFrame:
    """Coverage of each feature before and after, what lost it, and the breaker: stop where more than ten and five percent are lost.

    First and last version of a key come from one aggregate; features are exploded from one row."""
    r = t.dz_responses.select("dz_id", "name_full", "address", "city", "fetched_at", "response_id")
    name = F.coalesce("name_full", F.lit(""))
    has = F.struct(F.col("address").isNotNull().alias("address"), name.rlike("[0-9]").alias("number"), name.rlike('[«„“"]').alias("quoted"), closed(F.lower(name).contains(F.lower("city"))).alias("town"))
    at = F.struct("fetched_at", "response_id")
    v = r.withColumn("has", has).groupBy("dz_id").agg(F.min_by("has", at).alias("old"), F.max_by("has", at).alias("new"))
    f = v.select("dz_id", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"old.{k}").alias("was"), F.col(f"new.{k}").alias("now")) for k in _FEATURES])).alias("f")).select("dz_id", "f.*")
    gone = F.col("was") & ~F.col("now")
    a = f.groupBy("feature").agg(F.count_if("was").alias("before"), F.count_if("now").alias("after"), F.count_if(gone).alias("lost"), F.min(F.when(gone, F.col("dz_id"))).alias("first_lost"))
    a = a.withColumn("allowed", F.greatest(F.lit(10), F.ceil(0.05 * F.col("before"))))
    return a.withColumn("stop", F.col("lost") > F.col("allowed"))


@query("""WITH d AS (SELECT source, year(published_at) AS year, doc_id, published_at FROM documents WHERE published_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source, year ORDER BY published_at DESC, doc_id) AS k FROM d) SELECT source, year, doc_id AS newest FROM r WHERE k = 1""")
def newest_by_year(t: Tables) -> DataFrame:
    """The newest row of each year, of equal ones the first."""
    d = t.documents.filter("published_at is not null").select("source", F.year("published_at").cast("long").alias("year"), "doc_id", "published_at")
    return d.groupBy("source", "year").agg(F.max_by("doc_id", F.struct("published_at", (-F.col("doc_id")).alias("k"))).alias("newest"))


@query("""WITH p AS (SELECT DISTINCT school_id, academic_year, loaded_at, price_id FROM pricing WHERE regexp_matches(academic_year, '^20[0-9]{2}')), y AS (SELECT school_id, CAST(left(academic_year, 4) AS INTEGER) AS year, max(loaded_at) AS latest, count(DISTINCT price_id) AS n FROM p GROUP BY 1, 2) SELECT school_id, max(year) AS latest_year, list(n ORDER BY year) AS history, list(year ORDER BY year) AS years FROM y GROUP BY 1""")
def history_by_year(t: Tables) -> DataFrame:
    """The latest year of each owner and its history in order; a row for each year first, so an owner holds few."""
    p = t.pricing.filter(F.col("academic_year").rlike("^20[0-9]{2}")).select("school_id", F.left("academic_year", F.lit(4)).cast("int").alias("year"), "price_id").distinct()
    y = p.groupBy("school_id", "year").agg(F.count("*").alias("n"))
    h = y.groupBy("school_id").agg(F.max("year").alias("latest_year"), F.sort_array(F.collect_list(F.struct("year", "n"))).alias("h"))
    return h.select("school_id", "latest_year", F.transform("h", lambda x: x["n"]).alias("history"), F.transform("h", lambda x: x["year"]).alias("years"))


@query("""WITH s AS (SELECT source, doc_id, n_chars, (CASE WHEN doc_kind IN ('fees', 'rules') THEN 3 ELSE 0 END) + (CASE WHEN lang = 'bg' THEN 1 ELSE 0 END) AS score FROM documents WHERE n_chars > 0), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, n_chars, doc_id) AS place FROM s), b AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM k WHERE place <= 12) SELECT source, doc_id, place, CAST(used AS BIGINT) AS used FROM b WHERE used <= 6000""")
def selected_texts(t: Tables) -> DataFrame:
    """The best twelve of each source by score, in order while they fit a budget of characters; tasks keep their best twelve first."""
    score = F.when(F.col("doc_kind").isin("fees", "rules"), 3).otherwise(0) + F.when(F.col("lang") == "bg", 1).otherwise(0)
    w = Window.partitionBy("source").orderBy(F.desc("score"), "n_chars", "doc_id")
    k = t.documents.filter("n_chars > 0").select("source", "doc_id", "n_chars", score.alias("score")).withColumn("place", F.row_number().over(w)).filter("place <= 12")
    used = F.sum("n_chars").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return k.select("source", "doc_id", F.col("place").cast("long").alias("place"), used.alias("used")).filter("used <= 6000")


@query(rf"""WITH u AS (SELECT DISTINCT school_id, url, {CANON} AS c, CASE WHEN page_category = 'pricing' THEN 5 WHEN page_category = 'admission' THEN 3 ELSE 1 END + CASE WHEN regexp_matches(lower(url), 'taksi|fees|pric') THEN 2 ELSE 0 END AS score FROM pages WHERE url IS NOT NULL), b AS (SELECT school_id, c, max(score) AS score, arg_min(url, (-score, length(url), url)) AS url FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY school_id ORDER BY score DESC, length(url), url) AS place FROM b) SELECT school_id, place, url, score FROM r WHERE place <= 3""")
def best_links(t: Tables) -> DataFrame:
    """The three best candidate pages of each owner, one for each canonical address; highest score, then the shortest address."""
    score = F.when(F.col("page_category") == "pricing", 5).when(F.col("page_category") == "admission", 3).otherwise(1) + F.when(F.lower("url").rlike("taksi|fees|pric"), 2).otherwise(0)
    u = t.pages.filter("url is not null").select("school_id", "url", canonical_url(F.col("url")).alias("c"), score.alias("score")).distinct()
    b = u.groupBy("school_id", "c").agg(F.max("score").alias("score"), F.min_by("url", F.struct(-F.col("score"), F.length("url"), "url")).alias("url"))
    w = Window.partitionBy("school_id").orderBy(F.desc("score"), F.length("url"), "url")
    return b.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("school_id", "place", "url", "score")


@query(f"""WITH a AS (SELECT DISTINCT city, regexp_extract({KEY.format('name_full')}, '[^ ]+$') AS k FROM dz_responses WHERE name_full IS NOT NULL), b AS (SELECT DISTINCT city, regexp_extract({KEY.format('name')}, '[^ ]+$') AS k FROM municipal_points WHERE name IS NOT NULL) SELECT city, k AS name FROM a INTERSECT SELECT city, k FROM b""")
def shared_names(t: Tables) -> DataFrame:
    """Normalised names that two tables share: a set intersection."""
    last = lambda c: F.regexp_extract(name_key(F.col(c)), "[^ ]+$", 0).alias("name")
    return t.dz_responses.filter("name_full is not null").select("city", last("name_full")).intersect(t.municipal_points.filter("name is not null").select("city", last("name")))


@query(f"""WITH k AS (SELECT DISTINCT school_id, {KEY.format('name')} AS k FROM place_pins WHERE name IS NOT NULL), m AS (SELECT school_id, arg_min(k, (length(k), k)) AS shortest, count(*) AS names FROM k GROUP BY 1) SELECT m.school_id, names, CASE WHEN bool_and(contains(k.k, shortest)) THEN shortest END AS shared FROM m JOIN k ON k.school_id = m.school_id GROUP BY 1, 2, shortest""")
def shared_key(t: Tables) -> DataFrame:
    """The key contained in every key of a set: only the shortest can be, so two aggregates decide."""
    k = t.place_pins.filter("name is not null").select("school_id", name_key(F.col("name")).alias("k")).distinct()
    m = k.groupBy("school_id").agg(F.min_by("k", F.struct(F.length("k"), "k")).alias("shortest"), F.count("*").alias("names"))
    return k.join(m, "school_id").groupBy("school_id", "names", "shortest").agg(F.bool_and(F.col("k").contains(F.col("shortest"))).alias("every")).select("school_id", "names", F.when(F.col("every"), F.col("shortest")).alias("shared"))


@query("""WITH p AS (SELECT DISTINCT school_id, floor(lat * 10000) AS y, floor(lng * 10000) AS x FROM place_pins WHERE lat BETWEEN -90 AND 90 AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)), s AS (SELECT school_id, count(*) AS places, min((y, x)) AS spot FROM p GROUP BY 1) SELECT school_id, places, CASE WHEN places = 1 THEN min(school_id) FILTER (WHERE places = 1) OVER (PARTITION BY spot) ELSE school_id END AS hosted_by FROM s""")
def folded_places(t: Tables) -> DataFrame:
    """Owners on one spot are folded under the first; owners of several places are never folded."""
    p = t.place_pins.filter("lat between -90 and 90 and lng is not null and not (lat = 0 and lng = 0)").select("school_id", F.floor(F.col("lat") * 10000).alias("y"), F.floor(F.col("lng") * 10000).alias("x")).distinct()
    s = p.groupBy("school_id").agg(F.count("*").alias("places"), F.min(F.struct("y", "x")).alias("spot"))
    first = s.filter("places = 1").groupBy("spot").agg(F.min("school_id").alias("first"))
    return s.join(first, "spot", "left").select("school_id", "places", F.when(F.col("places") == 1, F.col("first")).otherwise(F.col("school_id")).alias("hosted_by"))


@query("""WITH p AS (SELECT point_id, lat IS NULL OR lng IS NULL AS nowhere, kind, trim(coalesce(address, '')) AS a, trim(coalesce(integration_id, '')) AS i FROM (SELECT DISTINCT point_id, lat, lng, kind, address, integration_id FROM municipal_points)) SELECT point_id, nowhere AND kind IN ('school', 'kindergarten', 'nursery') AND a <> '' AND i <> '' AS terminal, CASE WHEN NOT nowhere THEN 'placed' WHEN a = '' THEN 'no address' WHEN i = '' THEN 'no source' ELSE 'failed' END AS state FROM p""")
def terminal_failures(t: Tables) -> DataFrame:
    """Rows without a position for which every attempt failed: a conjunction over fields that may be missing or blank."""
    some = lambda c: closed(F.trim(c) != "")
    nowhere = F.col("lat").isNull() | F.col("lng").isNull()
    p = t.municipal_points.select("point_id", "lat", "lng", "kind", "address", "integration_id").distinct()
    return p.select("point_id", (nowhere & F.col("kind").isin("school", "kindergarten", "nursery") & some("address") & some("integration_id")).alias("terminal"), F.when(~nowhere, "placed").when(~some("address"), "no address").when(~some("integration_id"), "no source").otherwise("failed").alias("state"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, raw_markdown FROM pages WHERE raw_markdown IS NOT NULL), l AS (SELECT page_id, trim(regexp_replace(unnest(string_split(raw_markdown, chr(10))), '[*#>_|-]+', ' ', 'g')) AS s FROM p)
SELECT page_id, count(*) AS lines, count(*) FILTER (WHERE length(s) < 3) AS empty, count(*) FILTER (WHERE length(s) BETWEEN 3 AND 24 AND NOT regexp_matches(s, '[0-9.!?]')) AS labels, count(*) FILTER (WHERE regexp_matches(s, '(…|\.\.\.)$')) AS broken, count(*) FILTER (WHERE regexp_matches(s, '20(1[0-9]|2[0-3])')) AS stale FROM l GROUP BY 1""")
def noise_lines(t: Tables) -> DataFrame:
    """How many lines of a page are empty, mere labels, broken off or about years long past; counted inside the row."""
    p = t.pages.filter("raw_markdown is not null").select("page_id", "raw_markdown").distinct()
    lines = F.transform(F.split("raw_markdown", "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[*#>_|-]+", " ")))
    p = p.select("page_id", lines.alias("l"))
    count = lambda f: F.size(F.filter("l", f)).cast("long")
    a = p.select("page_id", F.size("l").cast("long").alias("lines"), count(lambda s: F.length(s) < 3).alias("empty"), count(lambda s: F.length(s).between(3, 24) & ~s.rlike("[0-9.!?]")).alias("labels"), count(lambda s: s.rlike(r"(…|\.\.\.)$")).alias("broken"), count(lambda s: s.rlike("20(1[0-9]|2[0-3])")).alias("stale"))
    return a.groupBy("page_id").agg(*[F.sum(c).alias(c) for c in ("lines", "empty", "labels", "broken", "stale")])


@query("""WITH m AS (SELECT max(fetched_at) AS now FROM dz_responses), s AS (SELECT city, max(fetched_at) AS seen FROM dz_responses GROUP BY 1), f AS (SELECT city FROM s, m WHERE seen >= now - INTERVAL 720 HOUR) SELECT DISTINCT p.school_id, f.city IS NOT NULL AS fresh FROM place_pins p LEFT JOIN f USING (city)""")
def fresh_snapshots(t: Tables) -> DataFrame:
    """Rows with whether their side snapshot is fresh enough to filter by."""
    now = t.dz_responses.agg(F.max("fetched_at")).scalar()
    f = t.dz_responses.groupBy("city").agg(F.max("fetched_at").alias("at")).filter(F.col("at") >= now - F.expr("interval 720 hours")).select("city", F.lit(True).alias("f"))
    return t.place_pins.select("school_id", "city").distinct().join(f, "city", "left").select("school_id", closed(F.col("f")).alias("fresh")).distinct()


@query(f"""WITH c AS (SELECT DISTINCT d.dz_id, d.name_full, p.location_id FROM dz_responses d JOIN place_pins p ON d.city = p.city AND {KEY.format('d.name_full')} = {KEY.format('p.name')}), u AS (SELECT dz_id, min(location_id) AS location_id, count(DISTINCT location_id) AS n, min(name_full) AS value FROM c GROUP BY 1)
SELECT dz_id, CASE WHEN n = 1 THEN 'promoted' ELSE 'conflict' END AS outcome, CASE WHEN n = 1 THEN location_id END AS location_id, CASE WHEN n = 1 THEN value END AS value, 'dz_responses:' || dz_id AS provenance FROM u""")
def promotions(t: Tables) -> DataFrame:
    """A dry run of promoting reviewed values: what would be written where, its provenance, and the conflicts left alone."""
    d = t.dz_responses.filter("name_full is not null").select("dz_id", "name_full", "city", name_key(F.col("name_full")).alias("k")).distinct()
    p = t.place_pins.filter("name is not null").select("location_id", "city", name_key(F.col("name")).alias("k")).distinct()
    u = d.join(p, ["city", "k"]).groupBy("dz_id").agg(F.min("location_id").alias("l"), F.count_distinct("location_id").alias("n"), F.min("name_full").alias("v"))
    one = F.col("n") == 1
    return u.select("dz_id", F.when(one, "promoted").otherwise("conflict").alias("outcome"), F.when(one, F.col("l")).alias("location_id"), F.when(one, F.col("v")).alias("value"), F.concat(F.lit("dz_responses:"), F.col("dz_id")).alias("provenance"))


@query(f"""WITH bad AS (SELECT DISTINCT {HOST.format('url')} AS h FROM pages WHERE NOT is_valid) SELECT DISTINCT page_id, CASE WHEN {HOST.format('url')} IN (SELECT h FROM bad) THEN FALSE ELSE is_valid END AS is_valid, is_valid AND {HOST.format('url')} IN (SELECT h FROM bad) AS changed FROM pages WHERE url IS NOT NULL""")
def bulk_update(t: Tables) -> DataFrame:
    """One predicate updates many rows: a site with an invalid page has none that is valid."""
    bad = t.pages.filter("not is_valid and url is not null").select(host("url").alias("h"), F.lit(True).alias("bad")).distinct()
    p = t.pages.filter("url is not null").select("page_id", "is_valid", host("url").alias("h")).join(bad, "h", "left")
    hit = closed(F.col("bad"))
    return p.select("page_id", F.when(hit, F.lit(False)).otherwise(F.col("is_valid")).alias("is_valid"), (F.col("is_valid") & hit).alias("changed")).distinct()


@query(f"""WITH k AS (SELECT DISTINCT school_id, city, {_TAIL} AS k FROM place_pins WHERE name IS NOT NULL), g AS (SELECT city, k, count(DISTINCT school_id) AS n, min(school_id) AS parent FROM k WHERE k <> '' GROUP BY 1, 2), m AS (SELECT k.school_id, g.parent, g.n FROM k JOIN g USING (city, k)), a AS (SELECT school_id, count(DISTINCT parent) AS parents, min(parent) AS parent FROM m WHERE n = 2 GROUP BY 1)
SELECT p.location_id, p.school_id AS old_owner, coalesce(CASE WHEN a.parents = 1 THEN a.parent END, p.school_id) AS new_owner, coalesce(a.parents > 1, FALSE) AS ambiguous FROM (SELECT DISTINCT location_id, school_id FROM place_pins) p LEFT JOIN a USING (school_id)""")
def reparented(t: Tables) -> DataFrame:
    """Rows of two owners of one name go under the first; an owner with two possible parents is left alone and reported."""
    k = t.place_pins.filter("name is not null").select("school_id", "city", F.regexp_extract(name_key(F.col("name")), "[^ 0-9]+ [^ 0-9]+$", 0).alias("k")).distinct().filter("k != ''")
    g = k.groupBy("city", "k").agg(F.count_distinct("school_id").alias("n"), F.min("school_id").alias("parent")).filter("n = 2")
    a = k.join(g, ["city", "k"]).groupBy("school_id").agg(F.count_distinct("parent").alias("parents"), F.min("parent").alias("parent"))
    p = t.place_pins.select("location_id", "school_id").distinct().join(a, "school_id", "left")
    return p.select("location_id", F.col("school_id").alias("old_owner"), F.coalesce(F.when(F.col("parents") == 1, F.col("parent")), F.col("school_id")).alias("new_owner"), closed(F.col("parents") > 1).alias("ambiguous"))


@query("""WITH v AS (SELECT DISTINCT school_type, education_level, country_code FROM schools UNION SELECT DISTINCT school_type, education_level, 'BG' FROM place_pins) SELECT school_type, education_level, coalesce(school_type IN ('state', 'private', 'international') AND education_level IN ('nursery', 'kindergarten', 'school') AND country_code = 'BG', FALSE) AS valid FROM v""")
def valid_values(t: Tables) -> DataFrame:
    """Values held against the lists a configuration allows."""
    v = t.schools.select("school_type", "education_level", "country_code").distinct().union(t.place_pins.select("school_type", "education_level", F.lit("BG")).distinct()).distinct()
    return v.select("school_type", "education_level", closed(F.col("school_type").isin("state", "private", "international") & F.col("education_level").isin("nursery", "kindergarten", "school") & (F.col("country_code") == "BG")).alias("valid"))


@query("""WITH s AS (SELECT DISTINCT school_id, city FROM schools), a AS (SELECT school_id, min((location_id, lat, lng)) AS v FROM place_pins WHERE lat BETWEEN 41 AND 44.3 AND lng BETWEEN 22 AND 28.7 GROUP BY 1), m AS (SELECT city, round(median(lat), 6) AS lat, round(median(lng), 6) AS lng FROM (SELECT DISTINCT point_id, city, lat, lng FROM municipal_points WHERE lat BETWEEN 41 AND 44.3 AND lng BETWEEN 22 AND 28.7) GROUP BY 1)
SELECT s.school_id, coalesce(struct_extract(a.v, 2), m.lat) AS lat, coalesce(struct_extract(a.v, 3), m.lng) AS lng, CASE WHEN a.v IS NOT NULL THEN 'own pin' WHEN m.lat IS NOT NULL THEN 'town' ELSE 'none' END AS by_what FROM s LEFT JOIN a USING (school_id) LEFT JOIN m USING (city)""")
def positions_with_fallback(t: Tables) -> DataFrame:
    """A chain of look-ups in which the first answer wins: the owner's first pin in bounds, else the middle of its town's points."""
    box = "lat between 41 and 44.3 and lng between 22 and 28.7"
    a = t.place_pins.filter(box).groupBy("school_id").agg(F.min(F.struct("location_id", "lat", "lng")).alias("v"))
    m = t.municipal_points.filter(box).select("point_id", "city", "lat", "lng").distinct().groupBy("city").agg(F.round(F.median("lat"), 6).alias("mlat"), F.round(F.median("lng"), 6).alias("mlng"))
    s = t.schools.select("school_id", "city").distinct().join(a, "school_id", "left").join(m, "city", "left")
    return s.select("school_id", F.coalesce("v.lat", "mlat").alias("lat"), F.coalesce("v.lng", "mlng").alias("lng"), F.when(F.col("v").isNotNull(), "own pin").when(F.col("mlat").isNotNull(), "town").otherwise("none").alias("by_what"))


@query(f"""WITH h AS (SELECT DISTINCT label_id FROM ({ORACLE['loose_spelling_search']})), l AS (SELECT DISTINCT label_id, verdict FROM identity_labels), j AS (SELECT l.verdict, h.label_id IS NOT NULL AS matched FROM l LEFT JOIN h USING (label_id))
SELECT count(*) FILTER (WHERE verdict = 'known_good' AND matched) AS true_positive, count(*) FILTER (WHERE verdict = 'known_good' AND NOT matched) AS false_negative, count(*) FILTER (WHERE verdict = 'known_bad' AND matched) AS false_positive, count(*) FILTER (WHERE verdict = 'known_bad' AND NOT matched) AS true_negative,
round(CAST(count(*) FILTER (WHERE verdict = 'known_good' AND matched) AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict IN ('known_good', 'known_bad') AND matched), 0), 4) AS precision, round(CAST(count(*) FILTER (WHERE verdict = 'known_good' AND matched) AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict = 'known_good'), 0), 4) AS recall FROM j""")
def judged_matcher(t: Tables) -> DataFrame:
    """The spelling matcher held against labelled good and bad cases."""
    h = loose_spelling_search(t).select("label_id").distinct().withColumn("m", F.lit(True))
    j = t.identity_labels.select("label_id", "verdict").distinct().join(h, "label_id", "left").select("verdict", closed(F.col("m")).alias("m"))
    good, bad, m = closed(F.col("verdict") == "known_good"), closed(F.col("verdict") == "known_bad"), F.col("m")
    a = j.agg(F.count_if(good & m).alias("true_positive"), F.count_if(good & ~m).alias("false_negative"), F.count_if(bad & m).alias("false_positive"), F.count_if(bad & ~m).alias("true_negative"))
    tp = F.col("true_positive")
    return a.select("*", ratio(tp, tp + F.col("false_positive")).alias("precision"), ratio(tp, tp + F.col("false_negative")).alias("recall"))


@query("""SELECT DISTINCT price_id, category, CASE WHEN category IS NOT NULL THEN period END AS period, CASE WHEN category = 'tuition' THEN age_group END AS age_group, (category IS NULL AND period IS NOT NULL) OR (category IS DISTINCT FROM 'tuition' AND age_group IS NOT NULL) AS was_reset FROM pricing""")
def filter_states(t: Tables) -> DataFrame:
    """States of filters in which those that depend on another one are reset where it doesn't allow them."""
    c = F.col("category")
    tuition = closed(c == "tuition")
    reset = (c.isNull() & F.col("period").isNotNull()) | (~tuition & F.col("age_group").isNotNull())
    return t.pricing.select("price_id", "category", F.when(c.isNotNull(), F.col("period")).alias("period"), F.when(tuition, F.col("age_group")).alias("age_group"), reset.alias("was_reset")).distinct()


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders WHERE o_totalprice <= 150000), h AS (SELECT o_custkey, count(*) AS hidden FROM orders WHERE o_totalprice > 150000 GROUP BY 1)
SELECT o.o_custkey, o.place, o.o_orderkey, coalesce(h.hidden, 0) AS hidden FROM o LEFT JOIN h USING (o_custkey)""")
def budgeted_options(t: Tables) -> DataFrame:
    """Options of each owner grouped by priority and sorted in the group, those over the budget counted as hidden."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_totalprice", "o_orderkey")
    o = t.orders.filter("o_totalprice <= 150000").select("o_custkey", F.row_number().over(w).cast("long").alias("place"), "o_orderkey")
    h = t.orders.filter("o_totalprice > 150000").groupBy("o_custkey").agg(F.count("*").alias("hidden"))
    return o.join(h, "o_custkey", "left").select("o_custkey", "place", "o_orderkey", F.coalesce("hidden", F.lit(0)).alias("hidden"))


@query(f"""WITH p AS (SELECT DISTINCT page_id, {HOST.format('url')} AS h FROM pages WHERE url IS NOT NULL), w AS (SELECT page_id, h, CAST(floor(CAST(concat('0x', substr(sha256(h), 1, 8)) AS BIGINT) / 4294967296.0 * 8) AS BIGINT) AS worker FROM p) SELECT page_id, worker, row_number() OVER (PARTITION BY h ORDER BY page_id) AS turn FROM w""")
def worker_turns(t: Tables) -> DataFrame:
    """Work spread over eight workers so that the pages of one site go to one, in their order."""
    p = t.pages.filter("url is not null").select("page_id", host("url").alias("h")).distinct()
    return p.select("page_id", F.floor(hash_share(F.col("h")) * 8).alias("worker"), F.row_number().over(Window.partitionBy("h").orderBy("page_id")).cast("long").alias("turn"))

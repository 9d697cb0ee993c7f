"""Joins beyond equality, matches that must be unique, and comparisons of row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import hash_share, name_key
from veyra.operators.relational import as_of, band_join, interval_join, multiset_diff, snapshot_diff, tiered_match, unique_matches, upsert
from veyra.plans.registry import query
from veyra.sources.tables import Tables


@query("""WITH a AS (SELECT p_partkey, p_brand, p_retailprice AS x FROM part WHERE p_retailprice > 0) SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM a JOIN a b ON a.p_brand = b.p_brand AND abs(a.x - b.x) <= a.x * 0.0005 AND a.p_partkey < b.p_partkey""")
def band_pairs(t: Tables) -> DataFrame:
    """Rows of one brand whose prices differ by at most half a thousandth."""
    a = t.part.select(F.col("p_partkey").alias("a_key"), "p_brand", F.col("p_retailprice").alias("x"))
    b = t.part.select(F.col("p_partkey").alias("b_key"), "p_brand", F.col("p_retailprice").alias("y"))
    return band_join(a, b, ["p_brand"], "x", "y", 0.0005).filter("a_key < b_key").select("a_key", "b_key")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type FROM events WHERE user_id IS NOT NULL), o AS (SELECT event_id AS before_id, user_id, ts, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT e.event_id, o.before_id FROM (SELECT * FROM e WHERE event_type <> (SELECT min(event_type) FROM events)) e ASOF LEFT JOIN (SELECT user_id, ts, max(before_id) AS before_id FROM o GROUP BY 1, 2) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def rule_as_of(t: Tables) -> DataFrame:
    """For each event the newest event of the first kind by the same user not after it."""
    e = t.events.filter("user_id is not null").select("event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type").alias("kind"))
    kinds = e.join(F.broadcast(first), F.col("event_type") == F.col("kind"), "left")
    left = kinds.filter("kind is null").select("event_id", "user_id", "ts")
    right = kinds.filter("kind is not null").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id")).withColumnRenamed("ts", "at")
    return as_of(left, right, ["user_id"], "ts", "at", ["before_id"]).select("event_id", "before_id")


@query("""WITH s AS (SELECT DISTINCT response_id, CAST(epoch(fetched_at) AS BIGINT) AS a, CASE WHEN address IS NOT NULL THEN CAST(epoch(received_at) AS BIGINT) END AS b FROM dz_responses), e AS (SELECT DISTINCT page_id, CAST(epoch(last_scraped_at) AS BIGINT) AS x FROM pages WHERE last_scraped_at IS NOT NULL)
SELECT response_id, b IS NULL AS open, count(*) AS crawls FROM e JOIN s ON x >= a AND (b IS NULL OR x <= b) GROUP BY 1, 2""")
def interval_events(t: Tables) -> DataFrame:
    """Crawls inside each fetch's span; a fetch without an address has no end. Closed spans meet events in day cells, open ones are counted from sorted days."""
    s = t.dz_responses.select("response_id", F.unix_timestamp("fetched_at").alias("a"), F.when(F.col("address").isNotNull(), F.unix_timestamp("received_at") + 1).alias("b")).distinct()
    e = t.pages.filter("last_scraped_at is not null").select("page_id", F.unix_timestamp("last_scraped_at").alias("x")).distinct()
    closed = interval_join(e, s.filter("b is not null"), "x", "a", "b", 86400).groupBy("response_id").agg(F.count("*").alias("crawls")).select("response_id", F.lit(False).alias("open"), "crawls")
    # the days after an open span's first one count whole, from sums by day; only the first day is compared event by event
    day = lambda c: F.floor(F.col(c) / 86400)
    days = e.groupBy(day("x").alias("day")).agg(F.count("*").alias("n"))
    later = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("from_day"))
    o = s.filter("b is null").select("response_id", "a", day("a").alias("day"))
    first = o.join(e.select("x", day("x").alias("day")), "day").filter("x >= a").groupBy("response_id").agg(F.count("*").alias("n"))
    # the next day that has events, as of the span's own
    stops = later.select(F.col("day").alias("at"), "from_day").unionByName(o.select((F.col("day") + 1).alias("at"), F.lit(None).cast("long").alias("from_day"))).distinct()
    ahead = stops.groupBy("at").agg(F.max("from_day").alias("f")).select("at", F.coalesce(F.first("f", True).over(Window.orderBy("at").rowsBetween(0, Window.unboundedFollowing)), F.lit(0)).alias("rest"))
    both = o.join(first, "response_id", "left").join(ahead, F.col("at") == F.col("day") + 1).select("response_id", F.lit(True).alias("open"), (F.coalesce("n", F.lit(0)) + F.col("rest")).alias("crawls"))
    return closed.unionByName(both.filter("crawls > 0"))


@query("""WITH b(lo, hi, band) AS (VALUES (1, 5, 'small'), (6, 15, 'middle'), (10, 20, 'late'), (21, 50, 'large')) SELECT p_partkey, (SELECT arg_min(band, lo) FROM b WHERE p_size BETWEEN lo AND hi) AS band FROM part""")
def range_lookup(t: Tables) -> DataFrame:
    """The first of some ordered ranges that holds a value: few fixed ranges are an expression, not a join."""
    bands = [(1, 5, "small"), (6, 15, "middle"), (10, 20, "late"), (21, 50, "large")]
    return t.part.select("p_partkey", F.coalesce(*[F.when(F.col("p_size").between(lo, hi), F.lit(b)) for lo, hi, b in bands]).alias("band"))


@query("""WITH one AS (SELECT s_nationkey, floor(s_acctbal / 1000) AS band, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2 HAVING count(DISTINCT s_suppkey) = 1) SELECT c_custkey, s_suppkey FROM customer JOIN one ON c_nationkey = s_nationkey AND floor(c_acctbal / 1000) = band""")
def unique_match(t: Tables) -> DataFrame:
    """Customers whose nation and band of balance have exactly one supplier."""
    band = lambda c: F.floor(F.col(c) / 1000).alias("band")
    s = t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), band("s_acctbal"), "s_suppkey")
    return unique_matches(t.customer.select("c_custkey", "c_nationkey", band("c_acctbal")), s, ["c_nationkey", "band"], "s_suppkey").select("c_custkey", "s_suppkey")


TIERS = r"""WITH d AS (SELECT DISTINCT dz_id, trim(regexp_replace(lower(name_full), '[^\p{L}\p{N}]+', ' ', 'g')) AS nk, city FROM dz_responses WHERE name_full IS NOT NULL),
q AS (SELECT DISTINCT location_id, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS nk, city FROM place_pins WHERE name IS NOT NULL),
t1 AS (SELECT nk, city, min(location_id) AS a FROM q GROUP BY 1, 2 HAVING count(DISTINCT location_id) = 1), t2 AS (SELECT nk, min(location_id) AS b FROM q GROUP BY 1 HAVING count(DISTINCT location_id) = 1)
SELECT d.dz_id, d.nk, d.city, coalesce(a, b) AS location_id, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 END AS tier FROM d LEFT JOIN t1 ON d.nk = t1.nk AND d.city = t1.city LEFT JOIN t2 ON d.nk = t2.nk"""


@query(TIERS)
def tiered_names(t: Tables) -> DataFrame:
    """By name and town, else by name alone, each only if it means one record."""
    d = t.dz_responses.filter("name_full is not null").select("dz_id", name_key(F.col("name_full")).alias("nk"), "city").distinct()
    q = t.place_pins.filter("name is not null").select("location_id", name_key(F.col("name")).alias("nk"), "city").distinct()
    return tiered_match(d, [(q, ["nk", "city"]), (q, ["nk"])], "location_id").select("dz_id", "nk", "city", "location_id", "tier")


@query("""SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 500""")
def sibling_pairs(t: Tables) -> DataFrame:
    """Pairs within a group whose values lie close: cells of the value's axis keep a large group from meeting itself whole."""
    a = t.supplier.select(F.col("s_suppkey").alias("a_key"), "s_nationkey", F.col("s_acctbal").alias("x"), F.explode(F.sequence(F.floor(F.col("s_acctbal") / 500) - 1, F.floor(F.col("s_acctbal") / 500) + 1)).alias("cell"))
    b = t.supplier.select(F.col("s_suppkey").alias("b_key"), "s_nationkey", F.col("s_acctbal").alias("y"), F.floor(F.col("s_acctbal") / 500).alias("cell"))
    return a.join(b, ["s_nationkey", "cell"]).filter("a_key < b_key and abs(x - y) <= 500").select("a_key", "b_key", "s_nationkey")


@query("""WITH g AS (SELECT o_orderpriority, year(o_orderdate) AS year, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 2) AS mean FROM orders GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN o_totalprice > mean * 1.1 THEN 'above' WHEN o_totalprice < mean * 0.9 THEN 'below' ELSE 'near' END AS class FROM orders o JOIN g ON g.o_orderpriority = o.o_orderpriority AND g.year = year(o.o_orderdate)""")
def against_benchmark(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"))
    g = o.groupBy("o_orderpriority", "year").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 2).alias("mean"))
    return o.join(g, ["o_orderpriority", "year"]).select("o_orderkey", F.when(F.col("o_totalprice") > F.col("mean") * 1.1, "above").when(F.col("o_totalprice") < F.col("mean") * 0.9, "below").otherwise("near").alias("class"))


@query("""SELECT min(price_id) AS price_id, count(*) AS copies FROM pricing GROUP BY school_id, age_group, category, academic_year, amount, amount_min, amount_max, currency, period, plan_name, price_source HAVING count(*) > 1""")
def duplicate_signatures(t: Tables) -> DataFrame:
    """Rows equal in all their content columns; the signature is hashed, so that wide keys aren't shuffled."""
    sig = ["school_id", "age_group", "category", "academic_year", "amount", "amount_min", "amount_max", "currency", "period", "plan_name", "price_source"]
    k = F.sha2(F.to_json(F.struct(*sig), {"ignoreNullFields": "false"}), 256)
    return t.pricing.groupBy(k.alias("k")).agg(F.min("price_id").alias("price_id"), F.count("*").alias("copies")).filter("copies > 1").select("price_id", "copies")


@query("""WITH g AS (SELECT n_regionkey, n_name FROM nation) SELECT a.n_name, list_sort(list(b.n_name)) AS others FROM g a JOIN g b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY 1""")
def others_in_group(t: Tables) -> DataFrame:
    """Each member with the other members of its group: the group's list once, less the member."""
    g = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("all"))
    return t.nation.join(g, "n_regionkey").select("n_name", F.array_remove("all", F.col("n_name")).alias("others")).filter("size(others) > 0")


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The registry as it was known at the middle of its fetches, and what has been fetched since: the newest row of each id."""
    r = t.dz_responses.select("dz_id", "name_full", "address", "fetched_at", "response_id")
    ends = [F.unix_micros(f("fetched_at").cast("timestamp")) for f in (F.min, F.max)]
    middle = r.agg(F.timestamp_micros(((ends[0] + ends[1]) / 2).cast("long")).cast("timestamp_ntz").alias("m")).scalar()
    late = F.col("fetched_at") >= middle
    g = r.groupBy("dz_id", late.alias("late")).agg(F.max_by(F.struct("name_full", "address"), F.struct("fetched_at", "response_id")).alias("v"))
    return g.filter("not late").select("dz_id", "v.*"), g.filter("late").select("dz_id", "v.*")


OLD_NEW = """WITH m AS (SELECT (epoch_us(min(fetched_at)) + epoch_us(max(fetched_at))) // 2 AS mid FROM dz_responses),
r AS (SELECT dz_id, name_full, address, epoch_us(fetched_at) >= mid AS late, row_number() OVER (PARTITION BY dz_id, epoch_us(fetched_at) >= mid ORDER BY fetched_at DESC, response_id DESC) AS k FROM dz_responses, m),
a AS (SELECT dz_id, name_full, address FROM r WHERE k = 1 AND NOT late), b AS (SELECT dz_id, name_full, address FROM r WHERE k = 1 AND late)"""


@query(OLD_NEW + """, j AS (SELECT coalesce(a.dz_id, b.dz_id) AS dz_id, a.dz_id IS NULL AS isnew, b.dz_id IS NULL AS gone, a.name_full AS n0, a.address AS a0, CASE WHEN b.dz_id IS NULL THEN a.name_full ELSE b.name_full END AS n, coalesce(b.address, a.address) AS ad FROM a FULL JOIN b ON a.dz_id = b.dz_id)
SELECT dz_id, n AS name_full, ad AS address, CASE WHEN isnew THEN 'created' WHEN gone THEN 'kept' WHEN n IS NOT DISTINCT FROM n0 AND ad IS NOT DISTINCT FROM a0 THEN 'unchanged' ELSE 'updated' END AS action FROM j""")
def upsert_merge(t: Tables) -> DataFrame:
    """Later fetches merged into earlier ones by key: a stored address is never lost to a null."""
    old, new = _versions(t)
    return upsert(old, new, ["dz_id"], keep_old_if_null=["address"])


@query(OLD_NEW + """SELECT coalesce(a.dz_id, b.dz_id) AS dz_id, CASE WHEN a.dz_id IS NULL THEN 'added' WHEN b.dz_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.dz_id = b.dz_id
WHERE a.dz_id IS NULL OR b.dz_id IS NULL OR a.name_full IS DISTINCT FROM b.name_full OR a.address IS DISTINCT FROM b.address""")
def version_diff(t: Tables) -> DataFrame:
    old, new = _versions(t)
    return snapshot_diff(old, new, ["dz_id"])


@query("""WITH a AS (SELECT category, period, count(*) AS n FROM pricing WHERE academic_year = '2024/2025' GROUP BY 1, 2), b AS (SELECT category, period, count(*) AS n FROM pricing WHERE academic_year = '2025/2026' GROUP BY 1, 2),
j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.period, b.period) AS period, coalesce(b.n, 0) - coalesce(a.n, 0) AS d FROM a FULL JOIN b ON a.category = b.category AND a.period = b.period)
SELECT category, period, greatest(-d, 0) AS lost, greatest(d, 0) AS gained FROM j WHERE d <> 0 AND period IS NOT NULL""")
def multiset_changes(t: Tables) -> DataFrame:
    p = t.pricing.filter("period is not null")
    return multiset_diff(p.filter("academic_year = '2024/2025'"), p.filter("academic_year = '2025/2026'"), ["category", "period"])


@query("""WITH seen AS (SELECT DISTINCT dz_id FROM dz_responses WHERE fetched_at >= (SELECT max(fetched_at) FROM dz_responses) - INTERVAL 180 DAY), a AS (SELECT dz_id, max(fetched_at) AS last_at FROM dz_responses GROUP BY 1)
SELECT a.dz_id, CASE WHEN s.dz_id IS NULL THEN a.last_at END AS inactive_since FROM a LEFT JOIN seen s USING (dz_id)""")
def soft_delete(t: Tables) -> DataFrame:
    """Records absent from the latest scan are marked with the time they were last seen; nothing is deleted."""
    last = t.dz_responses.groupBy("dz_id").agg(F.max("fetched_at").alias("last_at"))
    cut = t.dz_responses.agg((F.max("fetched_at") - F.expr("interval 180 days")).alias("cut")).scalar()
    return last.select("dz_id", F.when(F.col("last_at") < cut, F.col("last_at")).alias("inactive_since"))


@query("""WITH v AS (SELECT DISTINCT school_id, category, plan_name, amount, currency, period, price_id, loaded_at FROM pricing WHERE amount IS NOT NULL), f AS (SELECT school_id, category, plan_name, amount, currency, arg_max(period, (loaded_at, price_id)) AS period FROM v WHERE period IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT v.price_id, coalesce(v.period, f.period) AS period, v.period IS NULL AND f.period IS NOT NULL AS filled FROM v LEFT JOIN f ON v.school_id = f.school_id AND v.category = f.category AND v.plan_name IS NOT DISTINCT FROM f.plan_name AND v.amount = f.amount AND v.currency IS NOT DISTINCT FROM f.currency""")
def fill_from_superseded(t: Tables) -> DataFrame:
    """A missing value from the newest other row of the same content: one window, no self-join."""
    v = t.pricing.filter("amount is not null").select("school_id", "category", "plan_name", "amount", "currency", "period", "price_id", "loaded_at").distinct()
    w = Window.partitionBy("school_id", "category", "plan_name", "amount", "currency")
    best = F.max(F.when(F.col("period").isNotNull(), F.struct("loaded_at", "price_id", "period"))).over(w)
    return v.select("price_id", "period", best.alias("b")).select("price_id", F.coalesce("period", "b.period").alias("period"), (F.col("period").isNull() & F.col("b").isNotNull()).alias("filled"))


@query(r"""WITH u AS (SELECT DISTINCT school_id, regexp_extract(lower(website_url), '^[a-z]+://(?:www\.)?(?:[^/:?#]*-)?([^/:?#.-]+\.[^/:?#.]+)', 1) AS site FROM schools WHERE website_url IS NOT NULL), n AS (SELECT site, count(*) AS members FROM u WHERE site <> '' GROUP BY 1 HAVING count(*) >= 2) SELECT site, members, school_id FROM u JOIN n USING (site)""")
def shared_sites(t: Tables) -> DataFrame:
    """Members of each family of sites that several entities share, a row for each: a family of any size is no single value.

    A tenant's own part of the host, up to its last hyphen, doesn't count."""
    u = t.schools.select("school_id", F.regexp_extract(F.lower("website_url"), r"^[a-z]+://(?:www\.)?(?:[^/:?#]*-)?([^/:?#.-]+\.[^/:?#.]+)", 1).alias("site")).filter("site != ''").distinct()
    n = u.groupBy("site").agg(F.count("*").alias("members")).filter("members >= 2")
    return u.join(n, "site").select("site", "members", "school_id")


@query("SELECT doc_id, source FROM documents WHERE CAST(concat('0x', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.25")
def hash_sample(t: Tables) -> DataFrame:
    """A sample that depends on keys alone, so that reruns and joins agree."""
    return t.documents.filter(hash_share(F.col("doc_id")) < 0.25).select("doc_id", "source")


@query("""WITH h AS (SELECT source, md5(text) AS k, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) SELECT source, count(*) AS different, CAST(sum(copies) AS BIGINT) AS documents, count(*) FILTER (WHERE copies > 1) AS repeated FROM h GROUP BY 1""")
def content_copies(t: Tables) -> DataFrame:
    """Exact copies by content hash; texts never cross the network."""
    h = t.documents.filter("text is not null").select("source", F.md5("text").alias("k")).groupBy("source", "k").agg(F.count("*").alias("copies"))
    return h.groupBy("source").agg(F.count("*").alias("different"), F.sum("copies").alias("documents"), F.count_if(F.col("copies") > 1).alias("repeated"))

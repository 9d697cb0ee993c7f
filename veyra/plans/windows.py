"""Ordered logic: best rows, series, carried state, neighbours, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import canonical_url, school_year_start
from veyra.operators.relational import carried, round_robin, sliced_running_sum
from veyra.plans.registry import query
from veyra.sources.tables import Tables

CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '[?#].*$', ''), '^([^/:]+):[0-9]+', '\1'), '/+$', '')"


@query(f"""WITH p AS (SELECT DISTINCT page_id, {CANON} AS canon, length(coalesce(raw_markdown, '')) AS n, last_scraped_at FROM pages WHERE url IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY n > 0 DESC, last_scraped_at DESC NULLS LAST, n DESC, page_id) AS k, count(*) OVER (PARTITION BY canon) AS versions FROM p)
SELECT canon, page_id, n AS length, versions FROM r WHERE k = 1""")
def best_version_per_url(t: Tables) -> DataFrame:
    """With text before without, then newest, then longest; only lengths are carried through the shuffle."""
    p = t.pages.filter("url is not null").select("page_id", canonical_url(F.col("url")).alias("canon"), F.length(F.coalesce("raw_markdown", F.lit(""))).cast("long").alias("n"), "last_scraped_at").distinct()
    pick = F.max(F.struct((F.col("n") > 0).alias("a"), F.col("last_scraped_at"), F.col("n"), (-F.col("page_id")).alias("d"))).alias("m")
    return p.groupBy("canon").agg(pick, F.count("*").alias("versions")).select("canon", (-F.col("m.d")).alias("page_id"), F.col("m.n").alias("length"), "versions")


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order, count(*) AS orders FROM orders GROUP BY 1""")
def first_and_latest(t: Tables) -> DataFrame:
    """First and last of each group as aggregates, so that partial results combine before the shuffle."""
    key = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", key).alias("first_order"), F.max_by("o_orderkey", key).alias("latest_order"), F.count("*").alias("orders"))


SERIES = "SELECT l_returnflag AS subject, l_linestatus AS status, year(l_shipdate) AS year, round(avg(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2, 3"


def _series(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_quantity"), 2).alias("value"))


@query(f"""WITH s AS ({SERIES}), p AS (SELECT subject, year, max(value) FILTER (WHERE status = 'O') AS open, max(value) FILTER (WHERE status = 'F') AS done FROM s GROUP BY 1, 2)
SELECT subject, year, open, done, lag(open) OVER w AS open_before, CAST(year - lag(year) OVER w AS INTEGER) AS gap FROM p WINDOW w AS (PARTITION BY subject ORDER BY year)""")
def pivot_with_lag(t: Tables) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("year")
    p = _series(t).groupBy("subject", "year").pivot("status", ["O", "F"]).agg(F.max("value"))
    return p.select("subject", "year", F.col("O").alias("open"), F.col("F").alias("done"), F.lag("O").over(w).alias("open_before"), (F.col("year") - F.lag("year").over(w)).alias("gap"))


@query(f"""WITH s AS ({SERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY subject, status ORDER BY year DESC) AS k FROM s), m AS (SELECT subject, status, max(value) FILTER (WHERE k = 1) AS latest, max(year) AS year, CAST(sum(CAST(value AS DECIMAL(18, 2))) FILTER (WHERE k BETWEEN 2 AND 5) AS DOUBLE) / count(*) FILTER (WHERE k BETWEEN 2 AND 5) AS before, count(*) FILTER (WHERE k <= 5) AS years FROM r GROUP BY 1, 2)
SELECT subject, status, year, latest, years, CASE WHEN years < 3 THEN NULL WHEN latest > before + 0.05 THEN 'up' WHEN latest < before - 0.05 THEN 'down' ELSE 'level' END AS trend FROM m""")
def latest_against_mean(t: Tables) -> DataFrame:
    """The latest year against the mean of the four before it; none with fewer than three years."""
    r = _series(t).withColumn("k", F.row_number().over(Window.partitionBy("subject", "status").orderBy(F.desc("year"))))
    prior = F.when(F.col("k").between(2, 5), F.col("value").cast("decimal(18,2)"))
    m = r.groupBy("subject", "status").agg(F.max("year").alias("year"), F.max(F.when(F.col("k") == 1, F.col("value"))).alias("latest"), F.count_if(F.col("k") <= 5).alias("years"), (F.sum(prior).cast("double") / F.count(prior)).alias("before"))
    trend = F.when(F.col("years") < 3, None).when(F.col("latest") > F.col("before") + 0.05, "up").when(F.col("latest") < F.col("before") - 0.05, "down").otherwise("level")
    return m.select("subject", "status", "year", "latest", "years", trend.alias("trend"))


YEARS = "try_cast(nullif(regexp_extract(academic_year, '(20[0-9][0-9])\\s*[-/]\\s*([0-9]{4}|[0-9][0-9])', 1), '') AS INTEGER)".replace("\\\\", "\\")


@query(f"""WITH f AS (SELECT DISTINCT price_id, school_id, category, plan_name, amount, currency, period, CASE WHEN CASE WHEN length(regexp_extract(academic_year, '(20[0-9][0-9])\\s*[-/]\\s*([0-9]{{4}}|[0-9][0-9])', 2)) = 2 THEN floor({YEARS} / 100) * 100 ELSE 0 END + try_cast(nullif(regexp_extract(academic_year, '(20[0-9][0-9])\\s*[-/]\\s*([0-9]{{4}}|[0-9][0-9])', 2), '') AS INTEGER) - {YEARS} = 1 THEN {YEARS} END AS y FROM pricing),
m AS (SELECT *, max(y) OVER (PARTITION BY school_id, category) AS latest, max(y) OVER (PARTITION BY school_id, category, plan_name, amount, currency, period) AS same FROM f)
SELECT price_id, school_id, y AS year FROM m WHERE y IS NULL OR y = latest OR y = same AND NOT y < same""".replace("\\\\", "\\"))
def latest_year_rows(t: Tables) -> DataFrame:
    """Rows of the latest year of their group, rows without a year, and older ones that no later year repeats."""
    f = t.pricing.select("price_id", "school_id", "category", "plan_name", "amount", "currency", "period", school_year_start(F.col("academic_year")).alias("y")).distinct()
    f = f.withColumn("group", F.xxhash64(F.to_json(F.struct("school_id", "category"), {"ignoreNullFields": "false"}))).withColumn("content", F.sha2(F.to_json(F.struct("school_id", "category", "plan_name", "amount", "currency", "period"), {"ignoreNullFields": "false"}), 256))
    latest = f.groupBy("group").agg(F.max("y").alias("latest"))
    same = f.groupBy("content").agg(F.max("y").alias("same"))
    m = f.join(latest, "group").join(same, "content")
    return m.filter("y is null or y = latest or y = same").select("price_id", "school_id", F.col("y").alias("year"))


@query("""WITH e AS (SELECT event_type, event_id, value, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value, event_id) AS k FROM e)
SELECT event_type, value AS starts, n FROM r WHERE k = 1""")
def densest_window(t: Tables) -> DataFrame:
    """The start with the most values within five of it: range frames over cells of five, each with its neighbour's values."""
    own = F.floor(F.col("value") / 5)
    cells = t.events.filter("value is not null").select("event_type", "value", own.alias("own"), F.explode(F.array(own, own - 1)).alias("cell"))
    w = Window.partitionBy("event_type", "cell").orderBy("value").rangeBetween(Window.currentRow, 5)
    e = cells.withColumn("n", F.count("*").over(w)).filter("cell = own")
    return e.groupBy("event_type").agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m")).select("event_type", (-F.col("m.v")).alias("starts"), F.col("m.n").alias("n"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS no FROM documents WHERE text IS NOT NULL"


def _lines(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", "line", (F.col("p") + 1).alias("no"))


@query(f"""WITH l AS ({LINES}), k AS (SELECT *, max(CASE WHEN contains(line, '€') OR contains(line, 'лв') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l)
SELECT doc_id, no, md5(line) AS line_md5 FROM k WHERE near = 1""")
def keyword_context(t: Tables) -> DataFrame:
    """Lines with a keyword and their neighbours, inside each document by array functions: no shuffle at all."""
    arr = F.split("text", "\n", -1)
    hit = lambda c: closed_contains(c)
    d = t.documents.filter("text is not null").select("doc_id", arr.alias("a"))
    d = d.withColumn("h", F.transform("a", hit))
    near = F.transform("a", lambda line, i: F.struct((i + 1).alias("no"), F.md5(line).alias("line_md5"), (F.get("h", i) | F.coalesce(F.get("h", i - 1), F.lit(False)) | F.coalesce(F.get("h", i + 1), F.lit(False))).alias("near")))
    return d.select("doc_id", F.inline(near)).filter("near").select("doc_id", F.col("no").cast("int").alias("no"), "line_md5")


def closed_contains(c):
    return c.contains("€") | c.contains("лв")


@query(f"""WITH l AS ({LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY no) AS k FROM l WHERE trim(line) <> '')
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE k = 1) AS different FROM r GROUP BY 1""")
def line_dedupe(t: Tables) -> DataFrame:
    """First occurrences of lines, whatever their case."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return t.documents.filter("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.array_distinct(lines)).cast("long").alias("different")).filter("lines > 0")


@query(f"""WITH l AS ({LINES}), s AS (SELECT *, max(CASE WHEN line LIKE '%:' OR length(line) < 40 AND trim(line) <> '' THEN no END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT doc_id, head, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""")
def section_state(t: Tables) -> DataFrame:
    """Each line under the nearest heading before it; numbers and lengths are carried through the shuffle, never texts."""
    lines = _lines(t).select("doc_id", "no", F.length("line").alias("n"), F.when(F.col("line").endswith(":") | ((F.length("line") < 40) & (F.trim("line") != "")), F.col("no")).alias("h"))
    s = carried(lines, ["doc_id"], [F.col("no")], F.col("h"), "head")
    return s.groupBy("doc_id", "head").agg(F.count("*").alias("lines"), F.sum("n").cast("long").alias("chars"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents WHERE source IS NOT NULL),
s AS (SELECT *, sum(n_chars) OVER (ORDER BY turn, source ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM s WHERE run <= 200000""")
def round_robin_pick(t: Tables) -> DataFrame:
    d = t.documents.filter("source is not null").select("doc_id", "source", "n_chars")
    return round_robin(d, "source", [F.desc("n_chars"), F.asc("doc_id")], "n_chars", 200000).select("doc_id", "source", "turn")


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS starts, max(ts) AS ends FROM s GROUP BY 1, 2""")
def sessions(t: Tables) -> DataFrame:
    """Runs of a user's events no more than half an hour apart."""
    e = t.events.select("user_id", "event_id", "ts", F.to_date("ts").alias("day"))
    # each day of a user is a slice; its first event looks back to the last one of the slice before
    last = e.groupBy("user_id", "day").agg(F.max("ts").alias("_last"))
    last = last.select("user_id", "day", F.lag("_last").over(Window.partitionBy("user_id").orderBy("day")).alias("_back"))
    before = F.coalesce(F.lag("ts").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")), F.col("_back"))
    e = e.join(last, ["user_id", "day"]).withColumn("opens", F.when(F.timestamp_diff("MICROSECOND", before, F.col("ts")) <= 1_800_000_000, 0).otherwise(1))
    s = sliced_running_sum(e, ["user_id"], F.col("day"), [F.col("ts"), F.col("event_id")], F.col("opens"), "session")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("starts"), F.max("ts").alias("ends"))


@query("""WITH r AS (SELECT DISTINCT response_id, dz_id, name_full, fetched_at FROM dz_responses), h AS (SELECT *, lag(name_full) OVER w AS before FROM r WINDOW w AS (PARTITION BY dz_id ORDER BY fetched_at, response_id))
SELECT dz_id, count(*) AS fetches, count(*) FILTER (WHERE before IS NOT NULL AND before IS DISTINCT FROM name_full) AS changes FROM h GROUP BY 1""")
def change_history(t: Tables) -> DataFrame:
    """How often a polled record came back with another wording."""
    w = Window.partitionBy("dz_id").orderBy("fetched_at", "response_id")
    h = t.dz_responses.select("response_id", "dz_id", "name_full", "fetched_at").distinct().withColumn("before", F.lag("name_full").over(w))
    return h.groupBy("dz_id").agg(F.count("*").alias("fetches"), F.count_if(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("name_full"))).alias("changes"))


@query("""WITH r AS (SELECT school_id, location_id, lat, lng, row_number() OVER (PARTITION BY school_id ORDER BY location_id) AS k FROM (SELECT DISTINCT school_id, location_id, lat, lng FROM place_pins WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0) AND lat BETWEEN -90 AND 90)),
d AS (SELECT r.school_id, sqrt(pow((r.lat - f.lat) * 111320, 2) + pow((r.lng - f.lng) * 111320 * cos(radians(f.lat)), 2)) AS m FROM r JOIN r f ON r.school_id = f.school_id AND f.k = 1)
SELECT school_id, count(*) AS pins, round(max(m), 1) AS spread, max(m) > 500 AS wide FROM d GROUP BY 1""")
def spread_of_points(t: Tables) -> DataFrame:
    """Each owner's points against its first; owners spread wider than 500 m are flagged."""
    p = t.place_pins.filter("lat between -90 and 90 and lng is not null and not (lat = 0 and lng = 0)").select("school_id", "location_id", "lat", "lng").distinct()
    first = p.groupBy("school_id").agg(F.min_by(F.struct("lat", "lng"), "location_id").alias("f"))
    m = F.sqrt(F.pow((F.col("lat") - F.col("f.lat")) * 111320, 2) + F.pow((F.col("lng") - F.col("f.lng")) * 111320 * F.cos(F.radians("f.lat")), 2))
    d = p.join(first, "school_id").select("school_id", m.alias("m"))
    return d.groupBy("school_id").agg(F.count("*").alias("pins"), F.round(F.max("m"), 1).alias("spread"), (F.max("m") > 500).alias("wide"))

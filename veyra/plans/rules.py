"""Queries on rules, places and states: write gates, adjacency, rings put together, nearest edges, ownership, reports, state machines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import closed, finite
from veyra.functions.html import signals
from veyra.operators.places import joined_rings, nearest_edges
from veyra.plans.registry import query
from veyra.plans.streams import _events, _stream
from veyra.sources.tables import Tables
from veyra.streaming.drain import drain
from veyra.streaming.state import attributed, capped_counts, transitions

GOOD = "lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)"


@query(f"""WITH p AS (SELECT DISTINCT point_id, lower(trim(address)) AS a, CAST(floor(lat * 10000) AS BIGINT) AS y, CAST(floor(lng * 10000) AS BIGINT) AS x, coalesce({GOOD}, FALSE) AS inside FROM municipal_points), s AS (SELECT y, x, count(DISTINCT a) AS n FROM p WHERE inside GROUP BY 1, 2)
SELECT point_id, CASE WHEN NOT inside THEN 'out of bounds' WHEN n > 1 THEN 'spot of another address' ELSE 'accepted' END AS gate FROM p LEFT JOIN s USING (y, x)""")
def write_gates(t: Tables) -> DataFrame:
    """What may be written: no position out of bounds, none on a spot that another address holds."""
    good = closed(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lng") == 0)))
    cell = lambda c: F.floor(F.col(c) * 10000)
    p = t.municipal_points.select("point_id", F.lower(F.trim("address")).alias("a"), cell("lat").alias("y"), cell("lng").alias("x"), good.alias("inside")).distinct()
    s = p.filter("inside").groupBy("y", "x").agg(F.count_distinct("a").alias("n"))
    return p.join(s, ["y", "x"], "left").select("point_id", F.when(~F.col("inside"), "out of bounds").when(F.col("n") > 1, "spot of another address").otherwise("accepted").alias("gate"))


@query(f"""WITH k AS (SELECT city, kind, district, count(DISTINCT point_id) AS n, min(point_id) AS only_id, min(lat) AS lat, min(lng) AS lng FROM municipal_points WHERE {GOOD} AND district IS NOT NULL GROUP BY 1, 2, 3) SELECT city, kind, district, n, CASE WHEN n = 1 THEN only_id END AS point_id, CASE WHEN n = 1 THEN lat END AS lat, CASE WHEN n = 1 THEN lng END AS lng FROM k""")
def keyed_positions(t: Tables) -> DataFrame:
    """A look-up by key that fails closed: several candidates give none."""
    k = t.municipal_points.filter(f"{GOOD} and district is not null").groupBy("city", "kind", "district").agg(F.count_distinct("point_id").alias("n"), F.min("point_id").alias("i"), F.min("lat").alias("y"), F.min("lng").alias("x"))
    one = lambda c, a: F.when(F.col("n") == 1, F.col(c)).alias(a)
    return k.select("city", "kind", "district", "n", one("i", "point_id"), one("y", "lat"), one("x", "lng"))


@query("""WITH r AS (SELECT district_id, rings[1] AS r FROM districts), v AS (SELECT DISTINCT district_id, unnest(r).lng AS x, unnest(r).lat AS y FROM r) SELECT a.district_id AS a_key, b.district_id AS b_key, count(*) AS shared FROM v a JOIN v b USING (x, y) WHERE a.district_id < b.district_id GROUP BY 1, 2
UNION ALL SELECT district_id, NULL, count(*) FROM v GROUP BY 1""")
def adjacent_districts(t: Tables) -> DataFrame:
    """Districts whose outlines share corners, and the corners of each."""
    v = t.districts.select("district_id", F.explode(F.get("rings", F.lit(0))).alias("p")).select("district_id", "p.lng", "p.lat").distinct()
    pair = v.select(F.col("district_id").alias("a_key"), "lng", "lat").join(v.select(F.col("district_id").alias("b_key"), "lng", "lat"), ["lng", "lat"]).filter("a_key < b_key").groupBy("a_key", "b_key").agg(F.count("*").alias("shared"))
    own = v.groupBy("district_id").agg(F.count("*").alias("shared")).select(F.col("district_id").alias("a_key"), F.lit(None).cast("long").alias("b_key"), "shared")
    return pair.unionByName(own)


@query("SELECT DISTINCT district_id, CAST(len(rings[1]) AS BIGINT) AS vertices, TRUE AS closed FROM districts")
def assembled_rings(t: Tables) -> DataFrame:
    """Outlines cut into pieces, some turned round, and put together again at their ends."""
    r = t.districts.select("district_id", F.get("rings", F.lit(0)).alias("r")).distinct()
    n = F.size("r")
    cut = F.array(F.struct(F.lit(0).alias("a"), F.floor(n / 3).alias("z")), F.struct(F.floor(n / 3).cast("int").alias("a"), F.floor(n / 2).alias("z")), F.struct(F.floor(n / 2).cast("int").alias("a"), (n - 1).cast("long").alias("z")))
    p = r.select("district_id", "r", F.posexplode(cut).alias("k", "c")).select("district_id", "k", F.slice("r", F.col("c.a") + 1, (F.col("c.z") - F.col("c.a") + 1).cast("int")).alias("piece"))
    p = p.select("district_id", F.when(F.col("k") == 1, F.reverse("piece")).otherwise(F.col("piece")).alias("piece"))
    rings = joined_rings(p, "district_id", "piece")
    return rings.select("district_id", F.size("ring").cast("long").alias("vertices"), F.col("closed"))


_M = "111320.0"


@query(f"""WITH p AS (SELECT DISTINCT location_id, lat, lng FROM place_pins WHERE {GOOD}), r AS (SELECT DISTINCT district_id, rings[1] AS r FROM districts), s AS (SELECT district_id, unnest(range(1, len(r))) AS i, r FROM r), e AS (SELECT district_id, r[i].lng AS x1, r[i].lat AS y1, r[i + 1].lng AS x2, r[i + 1].lat AS y2 FROM s),
m AS (SELECT location_id, district_id, (x1 - lng) * {_M} * cos(radians(lat)) AS a_x, (y1 - lat) * {_M} AS a_y, (x2 - lng) * {_M} * cos(radians(lat)) AS b_x, (y2 - lat) * {_M} AS b_y FROM p JOIN e ON greatest(y1, y2) > lat - 0.02 AND least(y1, y2) < lat + 0.02 AND greatest(x1, x2) > lng - 0.03 AND least(x1, x2) < lng + 0.03),
f AS (SELECT *, greatest(0.0, least(1.0, -(a_x * (b_x - a_x) + a_y * (b_y - a_y)) / nullif((b_x - a_x) * (b_x - a_x) + (b_y - a_y) * (b_y - a_y), 0))) AS f FROM m), d AS (SELECT location_id, min(round(sqrt(pow(a_x + f * (b_x - a_x), 2) + pow(a_y + f * (b_y - a_y), 2)), 3)) AS metres FROM f GROUP BY 1) SELECT location_id, metres FROM d WHERE metres <= 1200""")
def snapped_pins(t: Tables) -> DataFrame:
    """The distance of each pin to the nearest edge of an outline within 1,200 m, through a grid of cells."""
    p = t.place_pins.filter(GOOD).select("location_id", "lat", "lng").distinct()
    r = F.get("rings", F.lit(0))
    e = t.districts.select("district_id", r.alias("r")).distinct().select("district_id", F.explode(F.sequence(F.lit(0), F.size("r") - 2)).alias("i"), "r")
    at = lambda k, c: F.get("r", F.col("i") + k)[c]
    e = e.select(at(0, "lng").alias("x1"), at(0, "lat").alias("y1"), at(1, "lng").alias("x2"), at(1, "lat").alias("y2"))
    return nearest_edges(p, e, 1200.0).groupBy("location_id").agg(F.min(F.round("metres", 3)).alias("metres")).filter("metres <= 1200")


@query(r"""WITH s AS (SELECT DISTINCT school_id, city, coalesce(regexp_extract(name_i18n['bg'], '[0-9]+'), '') AS number FROM schools), p AS (SELECT DISTINCT page_id, school_id, lower(coalesce(url, '')) AS u, lower(coalesce(raw_markdown, '')) AS txt FROM pages)
SELECT page_id, p.school_id, 3 * CAST(contains(txt, lower(city)) AS INTEGER) + 2 * CAST(number <> '' AND contains(u, number) AS INTEGER) + CAST(regexp_matches(txt, 'училище|градина|ясла|school|kindergarten|nursery') AS INTEGER) - 2 * CAST(regexp_matches(u, 'portal|katalog|directory') AS INTEGER) AS score FROM p JOIN s USING (school_id)""")
def ownership_scores(t: Tables) -> DataFrame:
    """How much speaks for a page being its owner's own: town, number in the address, type words; directories count against it."""
    s = t.schools.select("school_id", "city", F.coalesce(F.regexp_extract(F.col("name_i18n")["bg"], "[0-9]+", 0), F.lit("")).alias("number")).distinct()
    p = t.pages.select("page_id", "school_id", F.lower(F.coalesce("url", F.lit(""))).alias("u"), F.lower(F.coalesce("raw_markdown", F.lit(""))).alias("txt")).distinct().join(s, "school_id")
    one = lambda c: c.cast("int")
    score = 3 * one(F.col("txt").contains(F.lower("city"))) + 2 * one((F.col("number") != "") & F.col("u").contains(F.col("number"))) + one(F.col("txt").rlike("училище|градина|ясла|school|kindergarten|nursery")) - 2 * one(F.col("u").rlike("portal|katalog|directory"))
    return p.select("page_id", "school_id", score.alias("score"))


@query(r"""WITH s AS (SELECT DISTINCT school_id, regexp_extract(coalesce(name_i18n['bg'], ''), '[0-9]+') AS own FROM schools), p AS (SELECT DISTINCT page_id, school_id, raw_markdown FROM pages WHERE raw_markdown IS NOT NULL), n AS (SELECT page_id, school_id, unnest(regexp_extract_all(raw_markdown, '№ ?([0-9]{1,3})', 1)) AS n FROM p)
SELECT page_id, own, count(*) FILTER (WHERE n <> own) AS others, count(*) FILTER (WHERE n = own) AS agreeing FROM n JOIN s USING (school_id) GROUP BY 1, 2""")
def named_numbers(t: Tables) -> DataFrame:
    """Numbers a page names that contradict its owner's, and those that agree."""
    s = t.schools.select("school_id", F.regexp_extract(F.coalesce(F.col("name_i18n")["bg"], F.lit("")), "[0-9]+", 0).alias("own")).distinct()
    n = t.pages.filter("raw_markdown is not null").select("page_id", "school_id", "raw_markdown").distinct().select("page_id", "school_id", F.explode(F.regexp_extract_all("raw_markdown", F.lit("№ ?([0-9]{1,3})"), F.lit(1))).alias("n"))
    return n.join(s, "school_id").groupBy("page_id", "own").agg(F.count_if(F.col("n") != F.col("own")).alias("others"), F.count_if(F.col("n") == F.col("own")).alias("agreeing"))


@query(f"""WITH p AS (SELECT DISTINCT school_id, location_id, coalesce({GOOD}, FALSE) AS placed, updated_at FROM place_pins) SELECT school_id, arg_max(location_id, (placed, updated_at, -location_id)) AS location_id, count(DISTINCT location_id) AS places FROM p GROUP BY 1""")
def primary_places(t: Tables) -> DataFrame:
    """Each owner's first place: one with a position before others, then the newest, then the smaller id."""
    placed = closed(F.expr(GOOD))
    return t.place_pins.select("school_id", "location_id", placed.alias("placed"), "updated_at").groupBy("school_id").agg(F.max_by("location_id", F.struct("placed", "updated_at", (-F.col("location_id")).alias("k"))).alias("location_id"), F.count_distinct("location_id").alias("places"))


@query("""WITH s AS (SELECT DISTINCT school_id, city, education_level, school_type, num_pupils FROM schools) SELECT school_id, concat_ws(' ', CASE education_level WHEN 'nursery' THEN 'A nursery' WHEN 'kindergarten' THEN 'A kindergarten' ELSE 'A school' END || ' in ' || city || '.', CASE WHEN school_type IS NOT NULL THEN 'It is ' || school_type || '.' END, CASE WHEN num_pupils IS NOT NULL THEN 'Pupils: ' || num_pupils || '.' END) AS summary FROM s""")
def template_summaries(t: Tables) -> DataFrame:
    """A text put together from what facts there are."""
    kind = F.when(F.col("education_level") == "nursery", "A nursery").when(F.col("education_level") == "kindergarten", "A kindergarten").otherwise("A school")
    parts = [F.concat(kind, F.lit(" in "), F.col("city"), F.lit(".")), F.concat(F.lit("It is "), F.col("school_type"), F.lit(".")), F.concat(F.lit("Pupils: "), F.col("num_pupils"), F.lit("."))]
    return t.schools.select("school_id", "city", "education_level", "school_type", "num_pupils").distinct().select("school_id", F.concat_ws(" ", *parts).alias("summary"))


@query("""WITH p AS (SELECT DISTINCT price_id, amount_min AS lo, amount_max AS hi, currency, category, academic_year FROM pricing), i AS (SELECT price_id, list_filter([CASE WHEN lo > hi AND NOT isnan(lo) AND NOT isnan(hi) THEN 'swapped' END, CASE WHEN NOT isnan(lo) AND lo < 0 THEN 'negative' END, CASE WHEN currency IS NULL THEN 'no currency' END, CASE WHEN category IS NULL THEN 'no category' END, CASE WHEN academic_year IS NULL THEN 'no year' END], lambda x: x IS NOT NULL) AS issues FROM p)
SELECT price_id, issues, CASE WHEN list_contains(issues, 'swapped') OR list_contains(issues, 'negative') THEN 'failed' WHEN len(issues) > 1 THEN 'review' ELSE 'ok' END AS status FROM i""")
def validation_reports(t: Tables) -> DataFrame:
    """A report for each row: the rules it breaks, and the status that follows from them."""
    lo, hi = finite(F.col("amount_min")), finite(F.col("amount_max"))
    rules = [(lo > hi, "swapped"), (lo < 0, "negative"), (F.col("currency").isNull(), "no currency"), (F.col("category").isNull(), "no category"), (F.col("academic_year").isNull(), "no year")]
    p = t.pricing.select("price_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules])).alias("issues")).distinct()
    return p.select("price_id", "issues", F.when(F.arrays_overlap("issues", F.array(F.lit("swapped"), F.lit("negative"))), "failed").when(F.size("issues") > 1, "review").otherwise("ok").alias("status"))


@query("""SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS so_far FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)""")
def checkpoint_counters(t: Tables) -> DataFrame:
    """Counters of each stage by day and so far; days are counted before they are summed up in order."""
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.select("event_type", "day", "n", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("so_far"))


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seen) AS k, max(day) OVER () AS newest FROM f) SELECT day, user_id, n FROM r WHERE k <= 20 AND day > newest - INTERVAL 10 DAY""")
def stream_capped_counts(t: Tables) -> DataFrame:
    """Counts by day of at most twenty keys a day, the first to come, and of the last ten days only."""
    d = drain(capped_counts(_events(t), "ts", "user_id", "event_id", 20), "update", ["day", "user_id"])
    newest = d.agg(F.max("day")).scalar()
    return d.filter(F.col("day") > newest - F.expr("interval 10 days")).select("day", "user_id", "n")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'purchase', 'error')), l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e)
SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND prev = 'click') AS uncertain, count(*) FILTER (WHERE event_type = 'purchase' AND prev = 'click') AS settled FROM l GROUP BY 1""")
def stream_transitions(t: Tables) -> DataFrame:
    """A state for each key: a click leaves it pending, a purchase settles it, an error makes a pending one uncertain."""
    e = _events(t).filter("event_type in ('click', 'purchase', 'error')")
    return drain(transitions(e, "user_id", "event_type", ["ts", "event_id"]), "update", ["user_id"])


@query("""WITH r AS (SELECT dz_id, name_full, row_number() OVER (PARTITION BY dz_id ORDER BY fetched_at, response_id) AS k, response_id FROM (SELECT DISTINCT dz_id, response_id, name_full, fetched_at FROM dz_responses)), o AS (SELECT dz_id, name_full AS first_name FROM r WHERE k = 1)
SELECT r.dz_id, count(*) AS deliveries, count(*) FILTER (WHERE r.name_full IS DISTINCT FROM o.first_name) AS conflicts FROM r JOIN o USING (dz_id) GROUP BY 1""")
def stream_attribution(t: Tables) -> DataFrame:
    """Evidence attributed once: the same again changes nothing, other evidence for a key is counted as a conflict."""
    r = _stream(t, "dz_responses").select("response_id", "dz_id", "name_full", "fetched_at")
    return drain(attributed(r, "dz_id", ["fetched_at", "response_id"], "name_full"), "update", ["dz_id"])


@query(r"""WITH p AS (SELECT DISTINCT page_id, url, raw_markdown FROM pages WHERE url IS NOT NULL AND raw_markdown IS NOT NULL) SELECT page_id, url AS title, len(regexp_extract_all(raw_markdown, '\]\((/files/[^)\s]+)\)', 1)) AS files, 'https://' || regexp_extract(url, '^(?:[A-Za-z]+://)?([^/?#]+)', 1) || nullif(regexp_extract(raw_markdown, '\]\((/files/[^)\s]+)\)', 1), '') AS first_file FROM p WHERE starts_with(url, 'https://')""")
def html_signals(t: Tables) -> DataFrame:
    """Title, links with their absolute addresses and visible text of HTML, read by the standard library's parser."""
    line = lambda x: F.regexp_replace(F.regexp_replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), r"!\[([^\]]*)\]\(([^)\s]*)\)", ""), r"\[([^\]]*)\]\(([^)\s]*)\)", '<a href="$2">$1</a>')
    body = F.concat_ws("\n", F.transform(F.split("raw_markdown", "\n", -1), lambda x: F.concat(F.lit("<p>"), line(x), F.lit("</p>"))))
    head = F.concat(F.lit("<html><head><title>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</title><script>var a = '<a href=\"/files/no\">';</script></head><body>"))
    p = t.pages.filter("raw_markdown is not null and url like 'https://%'").select("page_id", "url", "raw_markdown").distinct().select("page_id", "url", F.concat(head, body, F.lit("</body></html>")).alias("html"))

    def read(batches):
        for pdf in batches:
            got = [signals(h, u) for h, u in zip(pdf["html"], pdf["url"])]
            links = [[x for x in g["links"] if "/files/" in x] for g in got]
            yield pd.DataFrame({"page_id": pdf["page_id"], "title": [g["title"] for g in got], "files": [len(x) for x in links], "first_file": [x[0] if x else None for x in links]})

    return p.mapInPandas(read, "page_id long, title string, files long, first_file string")

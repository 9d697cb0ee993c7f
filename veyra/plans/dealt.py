"""The p-queries of the core: points near points or regions, and quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.operators.proximity import near_and_inside, ring_faults
from veyra.operators.units import BGN_PAT, CENT_WORDS, EUR_PAT, NUMBER_WORDS, PERIOD_PATS, PLAIN_PERIODS, THOUSAND, common_units, told_units


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    return near_and_inside(read("place_pins"), read("municipal_points"), read("districts"))


def p1_rings(spark: SparkSession, d: str) -> DataFrame:
    """Every ring of every district with what is wrong with it, if anything."""
    return ring_faults(spark.read.parquet(f"{d}/districts.parquet"), "district_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return told_units(spark.read.parquet(f"{d}/pricing.parquet")).filter("not plain").select("price_id", "eur_cents", "unit").distinct()


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """Every amount in euro cents for one unit: told, or inferred with its posterior and whether that is uncertain."""
    units = common_units(spark.read.parquet(f"{d}/pricing.parquet"))
    return units.select("price_id", "eur_cents", "unit", "basis", F.round("confidence", 6).alias("confidence"), "uncertain").distinct()


QUERIES = {"p1_found": p1_found, "p1_rings": p1_rings, "p2_found": p2_found, "p2_units": p2_units}

P1_SQL = """
WITH pin AS (SELECT DISTINCT location_id AS id, lat, lng FROM place_pins
             WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)),
pt AS (SELECT DISTINCT point_id AS id, lat, lng FROM municipal_points
       WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)),
every AS (SELECT 'near_pin' AS relation, * FROM pin UNION ALL SELECT 'near_point', * FROM pt),
near AS (
  SELECT DISTINCT b.relation, least(a.id, b.id) AS a_key, greatest(a.id, b.id) AS b_key FROM pin a JOIN every b
  ON abs(a.lat - b.lat) < 0.0014 AND (b.relation = 'near_point' OR a.id < b.id) AND a.id <> b.id
  AND 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 150),
ring AS (SELECT district_id, unnest(range(1, len(rings) + 1)) AS k, rings FROM districts),
vertex AS (SELECT district_id, k, rings[k] AS v, unnest(range(1, len(rings[k]))) AS i FROM ring),
edge AS (SELECT district_id, k, v[i].lng AS x1, v[i].lat AS y1, v[i + 1].lng AS x2, v[i + 1].lat AS y2 FROM vertex),
crossed AS (
  SELECT e.district_id, p.id, e.k, count(*) % 2 AS odd FROM every p JOIN edge e
  ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lng < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY ALL),
inside AS (SELECT district_id, id FROM crossed GROUP BY ALL HAVING max(CASE WHEN k = 1 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN k > 1 THEN odd ELSE 0 END) = 0)
SELECT relation, a_key, b_key FROM near UNION ALL SELECT 'in_district', district_id, id FROM inside
"""

def _re2(pattern: str) -> str:
    """A pattern without looks aside, for tests only: what must not stand beside a word becomes what must."""
    for a, b in ((r"(?<![a-zа-я])", "(?:^|[^a-zа-я])"), (r"(?![a-zа-я])", "(?:$|[^a-zа-я])"), (r"(?<=[,/;(] ?)", "[,/;(] ?"), (r"(?<!half[- ])", "")):
        pattern = pattern.replace(a, b)
    return pattern.replace("'", "''")


def _p2_sql() -> str:
    text = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[\\s\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{2007}}\\x{{2019}}`]+', ' ', 'g'))"
    has = lambda x, p: f"regexp_matches({x}, '{_re2(p)}')"
    money = lambda x: f"CASE WHEN {has(x, EUR_PAT)} AND NOT {has(x, BGN_PAT)} THEN 'EUR' WHEN {has(x, BGN_PAT)} AND NOT {has(x, EUR_PAT)} THEN 'BGN' END"
    year = lambda x: f"regexp_replace({x}, 'half[- ]year(ly)?', 'semester', 'g')"
    hits = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {has(year(x) if k == 'year' else x, p)} THEN '{k}' END" for k, p in PERIOD_PATS.items()) + "], lambda z: z IS NOT NULL)"
    period = lambda x: f"CASE WHEN len({hits(x)}) = 1 THEN {hits(x)}[1] END"
    names = "MAP {" + ", ".join(f"'{w}': {n}" for w, n in NUMBER_WORDS.items()) + "}"
    cents = "CASE " + " ".join(f"WHEN c IN ({', '.join(repr(w) for w in CENT_WORDS[k])}) THEN '{v}'" for k, v in (("eur_cent", "EUR"), ("bgn_cent", "BGN"))) + " END"
    return rf"""WITH b AS (SELECT DISTINCT price_id, amount, currency, period, plan_name FROM pricing WHERE amount IS NOT NULL AND NOT coalesce(regexp_matches(amount, '^\d+(\.\d+)?$') AND currency = 'EUR' AND period IN ({', '.join(map(repr, PLAIN_PERIODS))}), FALSE)),
t AS (SELECT price_id, {text('amount')} AS a, {text('currency')} AS c, {text('period')} AS p, {text('plan_name')} AS n FROM b),
s AS (SELECT *, CASE WHEN NOT regexp_matches(a, '\d') THEN [] WHEN regexp_matches(a, '[/(]') THEN list_filter(regexp_split_to_array(a, '\s*[/()]\s*'), lambda x: regexp_matches(x, '\d')) ELSE [a] END AS s FROM t),
o AS (SELECT *, list_filter(s, lambda x: {has('x', EUR_PAT)}) AS euro, list_filter(s, lambda x: {has('x', BGN_PAT)}) AS lev FROM s),
r AS (SELECT *, regexp_replace(CASE WHEN len(s) = 1 THEN s[1] WHEN len(s) = 2 AND len(euro) = 1 AND len(lev) = 1 THEN euro[1] END, '(за|на|per|every) (1|3|6) (месеца?|months?|час)', '', 'g') AS s1 FROM o),
k AS (SELECT *, regexp_extract_all(s1, '\d+(?:[ ''.,]\d+)*') AS chains, {money('coalesce(s1, a)')} AS cut, {cents} AS cent FROM r),
m AS (SELECT *, CASE WHEN len(chains) = 1 AND (regexp_matches(chains[1], '^\d{{1,3}}([ ''.,]\d{{3}})+([.,]\d{{1,2}})?$') OR regexp_matches(chains[1], '^\d+([.,]\d+)?$')) THEN regexp_replace(chains[1], '[ '']', '', 'g') END AS num FROM k),
v AS (SELECT *, CASE WHEN NOT (contains(num, ',') AND contains(num, '.')) AND regexp_matches(num, '^\d{{1,3}}([.,]\d{{3}})+$') THEN regexp_replace(num, '[.,]', '', 'g') WHEN regexp_matches(num, '[.,]') THEN regexp_replace(regexp_extract(num, '^(.*)[.,]([^.,]*)$', 1), '[.,]', '', 'g') || '.' || regexp_extract(num, '^(.*)[.,]([^.,]*)$', 2) ELSE num END AS plain_num,
list_reduce(list_transform(regexp_split_to_array(a, '[^а-я]+'), lambda w: {{'s': CAST(0 AS BIGINT), 'o': CAST(coalesce({names}[w], 0) AS BIGINT)}}), lambda acc, x: CASE WHEN x.o = 1000 THEN {{'s': acc.s + greatest(acc.o, 1) * 1000, 'o': CAST(0 AS BIGINT)}} ELSE {{'s': acc.s, 'o': acc.o + x.o}} END, {{'s': CAST(0 AS BIGINT), 'o': CAST(0 AS BIGINT)}}) AS spelt FROM m),
f AS (SELECT price_id, CAST(CASE WHEN len(s) > 0 THEN CAST(round(CAST(plain_num AS DECIMAL(28, 8)) * 10000, 0) AS BIGINT) * CASE WHEN regexp_matches(s1, '\d\s?(?:{THOUSAND})(?:$|[^a-zа-я])') THEN 1000 ELSE 1 END ELSE nullif(spelt.s + spelt.o, 0) * 10000 END AS HUGEINT) AS v4,
coalesce(cut, cent, CASE WHEN c = '' THEN {money('n')} ELSE {money('c')} END) AS cur, cut IS NULL AND cent IS NOT NULL AS in_cents, CASE WHEN p <> '' THEN {period('p')} ELSE coalesce({period('a')}, {period('n')}) END AS per FROM v),
g AS (SELECT price_id, v4, per, CASE WHEN cur = 'BGN' THEN CASE WHEN in_cents THEN 10 ELSE 1000 END ELSE 1 END AS num, CASE WHEN cur = 'BGN' THEN 195583 WHEN in_cents THEN 10000 ELSE 100 END * CASE per WHEN 'quarter' THEN 3 WHEN 'half' THEN 6 WHEN 'year' THEN 12 ELSE 1 END AS den FROM f WHERE v4 IS NOT NULL AND cur IS NOT NULL AND per IS NOT NULL)
SELECT DISTINCT price_id, CAST((2 * v4 * num + den) // (2 * den) AS BIGINT) AS eur_cents, CASE WHEN per IN ('month', 'quarter', 'half', 'year') THEN 'month' ELSE per END AS unit FROM g"""


P1_RINGS_SQL = "SELECT DISTINCT district_id AS region, CAST(k AS INTEGER) AS ring_no, CAST(len(rings[k]) - 1 AS INTEGER) AS vertices, CAST(NULL AS VARCHAR) AS fault FROM (SELECT district_id, rings, unnest(range(1, len(rings) + 1)) AS k FROM districts)"
ORACLE = {"p1_found": P1_SQL, "p1_rings": P1_RINGS_SQL, "p2_found": _p2_sql()}

"""Text queries: keys, urls, markup, evidence, numbers, personal data, vocabularies, ranked name search, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.functions.columns import canonical_url, digits_only, name_key, school_year_start, sound_key, transliterate
from veyra.plans.registry import query
from veyra.sources.tables import Tables

KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TRANS = "translate(lower({0}), 'абвгдезийклмнопрстуфхъь', 'abvgdeziyklmnoprstufhay')"
for _a, _b in (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sht"), ("ю", "yu"), ("я", "ya")):
    TRANS = f"replace({TRANS}, '{_a}', '{_b}')"



@query(f"SELECT DISTINCT location_id, {KEY.format('name')} AS key, array_length(string_split({KEY.format('name')}, ' ')) AS words FROM place_pins WHERE name IS NOT NULL")
def normalise_keys(t: Tables) -> DataFrame:
    key = name_key(F.col("name"))
    return t.place_pins.filter("name is not null").select("location_id", key.alias("key"), F.size(F.split(key, " ")).cast("long").alias("words")).distinct()


@query(f"SELECT DISTINCT dz_id, {TRANS.format('name_full')} AS latin FROM dz_responses WHERE name_full IS NOT NULL")
def transliterated_names(t: Tables) -> DataFrame:
    return t.dz_responses.filter("name_full is not null").select("dz_id", transliterate(F.col("name_full")).alias("latin")).distinct()


@query()
def sound_keys(t: Tables) -> DataFrame:
    """What sounds alike. RE2 has no back-references, so tests hold it against a plain version."""
    return t.municipal_points.filter("name is not null").select("point_id", sound_key(F.col("name")).alias("sound")).distinct()


CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\.', ''), '[?#].*$', ''), '^([^/:]+):[0-9]+', '\1'), '/+$', '')"


@query(rf"""SELECT page_id, {CANON} AS canonical, regexp_extract({CANON}, '^[^/]+') AS host, regexp_extract({CANON}, '([^./]+\.[^./]+)(/|$)', 1) AS site, array_length(string_split({CANON}, '/')) - 1 AS depth, regexp_extract(url, '[?&]([^=&#]+)=', 1) AS first_parameter FROM pages WHERE url IS NOT NULL""")
def url_parts(t: Tables) -> DataFrame:
    c = canonical_url(F.col("url"))
    return t.pages.filter("url is not null").select("page_id", c.alias("canonical"), F.regexp_extract(c, r"^[^/]+", 0).alias("host"), F.regexp_extract(c, r"([^./]+\.[^./]+)(/|$)", 1).alias("site"), (F.size(F.split(c, "/")) - 1).cast("long").alias("depth"), F.regexp_extract("url", r"[?&]([^=&#]+)=", 1).alias("first_parameter"))


@query(r"""SELECT page_id, len(regexp_extract_all(raw_markdown, '!\[[^\]]*\]\([^)]*\)')) AS images, len(regexp_extract_all(raw_markdown, '\[[^\]]*\]\([^)\s]+\)')) AS links, list_sort(list_distinct(regexp_extract_all(raw_markdown, '\(([^)\s]+\.pdf)\)', 1))) AS files,
length(regexp_replace(regexp_replace(raw_markdown, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[#*>|_]+', '', 'g')) AS visible FROM pages WHERE raw_markdown IS NOT NULL""")
def links_and_text(t: Tables) -> DataFrame:
    """Links, images and files of marked-up text, and how much of it is visible."""
    md = F.col("raw_markdown")
    found = lambda p, g=0: F.regexp_extract_all(md, F.lit(p), F.lit(g))
    visible = F.regexp_replace(F.regexp_replace(md, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[#*>|_]+", "")
    return t.pages.filter("raw_markdown is not null").select("page_id", F.size(found(r"!\[[^\]]*\]\([^)]*\)")).cast("long").alias("images"), F.size(found(r"\[[^\]]*\]\([^)\s]+\)")).cast("long").alias("links"), F.sort_array(F.array_distinct(found(r"\(([^)\s]+\.pdf)\)", 1))).alias("files"), F.length(visible).cast("long").alias("visible"))


@query("SELECT page_id, sha256(raw_markdown) AS sha, length(raw_markdown) AS n FROM pages WHERE raw_markdown IS NOT NULL")
def content_hash(t: Tables) -> DataFrame:
    return t.pages.filter("raw_markdown is not null").select("page_id", F.sha2("raw_markdown", 256).alias("sha"), F.length("raw_markdown").cast("long").alias("n"))


@query(f"""WITH m AS (SELECT DISTINCT fee_id, {KEY.format('evidence')} AS q, page_url FROM missed_fees WHERE evidence IS NOT NULL AND trim(evidence) <> ''),
p AS (SELECT DISTINCT {CANON} AS c, {KEY.format('raw_markdown')} AS body FROM pages WHERE raw_markdown IS NOT NULL AND url IS NOT NULL), mc AS (SELECT fee_id, q, {CANON.replace('(url)', '(page_url)')} AS c FROM m)
SELECT mc.fee_id, count(p.c) > 0 AS page_known, coalesce(bool_or(contains(p.body, mc.q)), FALSE) AS quoted FROM mc LEFT JOIN p ON p.c = mc.c GROUP BY 1""")
def evidence_containment(t: Tables) -> DataFrame:
    """Whether a quote stands on its page, letters and digits compared: pages without quotes are left out before their texts travel,
    and a page's quotes are tested where its text is, in one row."""
    m = t.missed_fees.filter("trim(evidence) != ''").select("fee_id", name_key(F.col("evidence")).alias("q"), canonical_url(F.col("page_url")).alias("c")).distinct()
    p = t.pages.filter("raw_markdown is not null and url is not null").select(canonical_url(F.col("url")).alias("c"), "raw_markdown")
    known = p.select("c").distinct().withColumn("known", F.lit(True))
    asked = p.join(m.select("c").distinct(), "c", "left_semi").select("c", name_key(F.col("raw_markdown")).alias("body"))
    hit = m.join(asked, "c").filter(F.col("body").contains(F.col("q"))).select("fee_id").distinct().withColumn("hit", F.lit(True))
    own = m.join(known, "c", "left").groupBy("fee_id").agg((F.count("known") > 0).alias("page_known"))
    return own.join(hit, "fee_id", "left").select("fee_id", "page_known", F.coalesce("hit", F.lit(False)).alias("quoted"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS mails, len(regexp_extract_all(text, '(^|[^0-9])0[0-9]{1,2} [0-9]{3} [0-9]{4}')) AS phones, len(regexp_extract_all(text, 'https?://[^ \n)]+')) AS urls FROM documents WHERE text IS NOT NULL""")
def personal_data(t: Tables) -> DataFrame:
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return t.documents.filter("text is not null").select("doc_id", found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("mails"), found(r"(^|[^0-9])0[0-9]{1,2} [0-9]{3} [0-9]{4}").alias("phones"), found(r"https?://[^ \n)]+").alias("urls"))


@query(r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{1,3}(?:[ .][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)', 1)) AS raw, unnest(regexp_extract_all(text, '([0-9]{1,3}(?:[ .][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)', 2)) AS cur FROM documents WHERE text IS NOT NULL)
SELECT doc_id, cur AS currency, count(*) AS amounts, CAST(sum(CAST(replace(regexp_replace(raw, '[ .]', '', 'g'), ',', '.') AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM a GROUP BY 1, 2""")
def amounts_in_text(t: Tables) -> DataFrame:
    """Currency amounts in running text, in any written form, summed exactly."""
    p = r"([0-9]{1,3}(?:[ .][0-9]{3})+(?:,[0-9]{1,2})?|[0-9]+(?:,[0-9]{1,2})?) ?(€|EUR|лв)"
    a = t.documents.filter("text is not null").select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("raw"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("cur"))).alias("z"))
    v = F.replace(F.regexp_replace("z.raw", "[ .]", ""), F.lit(","), F.lit(".")).cast("decimal(18,2)")
    return a.groupBy("doc_id", F.col("z.cur").alias("currency")).agg(F.count("*").alias("amounts"), F.sum(v).cast("double").alias("total"))


TOPICS = {"food": "храна|обяд|меню|meals|lunch|menu", "money": "такса|цена|fee|price|€|лв", "health": "медицинск|nurse|болн", "sport": "плуване|футбол|шахмат|swimming|football|chess"}


@query("SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in sorted(TOPICS.items())) + "], lambda x: x IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL")
def vocabulary_tags(t: Tables) -> DataFrame:
    """Controlled-vocabulary tags, sorted."""
    return t.documents.filter("text is not null").select("doc_id", F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(k)) for k, p in sorted(TOPICS.items())])).alias("tags"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(string_split(text, chr(10))) AS lines FROM documents WHERE text IS NOT NULL""")
def script_profile(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", F.length(F.regexp_replace("text", "[^Ѐ-ӿ]", "")).cast("long").alias("cyrillic"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("long").alias("latin"), F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("numbers"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query(r"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS n FROM w WHERE length(word) > 1 GROUP BY 1""")
def word_counts(t: Tables) -> DataFrame:
    w = t.documents.filter("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower(F.translate("w", "İ", "i")).alias("word"))
    return w.filter(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n"))


RANK = """WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS k FROM part), r AS (SELECT *, CASE WHEN k = '{0}' THEN 1 WHEN starts_with(k, '{0} ') THEN 2 WHEN contains(' ' || k || ' ', ' {0} ') THEN 3 WHEN contains(k, '{0}') THEN 4 WHEN levenshtein(split_part(k, ' ', 1), '{0}') <= 1 THEN 5 END AS tier FROM n)
SELECT p_partkey, p_name, tier FROM r WHERE tier IS NOT NULL ORDER BY tier, length(p_name), p_partkey LIMIT 12"""


@query(RANK.format("red"))
def name_search(t: Tables) -> DataFrame:
    """Ranked search: whole, beginning, word, part, one letter off; then the shorter name, then the key. The limit is the feature."""
    q, k = "red", F.lower("p_name")
    tier = F.when(k == q, 1).when(k.startswith(f"{q} "), 2).when(F.concat(F.lit(" "), k, F.lit(" ")).contains(f" {q} "), 3).when(k.contains(q), 4).when(F.levenshtein(F.substring_index(k, " ", 1), F.lit(q)) <= 1, 5)
    return t.part.select("p_partkey", "p_name", tier.alias("tier")).filter("tier is not null").orderBy("tier", F.length("p_name"), "p_partkey").limit(12)


@query("SELECT price_id, CASE WHEN regexp_matches(academic_year, '^20[0-9][0-9]/20[0-9][0-9]$') AND CAST(substr(academic_year, 6, 4) AS INTEGER) - CAST(substr(academic_year, 1, 4) AS INTEGER) = 1 THEN CAST(substr(academic_year, 1, 4) AS INTEGER) END AS starts, CASE WHEN academic_year IS NULL THEN 'not stated' WHEN CASE WHEN regexp_matches(academic_year, '^20[0-9][0-9]/20[0-9][0-9]$') THEN CAST(substr(academic_year, 1, 4) AS INTEGER) END = year(scraped_at) - CASE WHEN month(scraped_at) < 9 THEN 1 ELSE 0 END THEN 'current' ELSE 'other' END AS standing FROM pricing")
def school_years(t: Tables) -> DataFrame:
    """The year a row is for, against the one under way when it was read; years turn on 1 September."""
    y = school_year_start(F.col("academic_year"))
    now = F.year("scraped_at") - F.when(F.month("scraped_at") < 9, 1).otherwise(0)
    return t.pricing.select("price_id", y.alias("starts"), F.when(F.col("academic_year").isNull(), "not stated").when(y == now, "current").otherwise("other").alias("standing"))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 12 MONTH AS DATE) AS anniversary, date_diff('year', o_orderdate, TIMESTAMP '2000-02-29') - CASE WHEN (month(o_orderdate), day(o_orderdate)) > (2, 29) THEN 1 ELSE 0 END AS whole_years, dayofweek(o_orderdate) AS weekday FROM orders")
def date_steps(t: Tables) -> DataFrame:
    """Anniversaries clamp to a month's end; whole years between dates; weekdays from Sunday as 0."""
    later = F.struct(F.month("o_orderdate"), F.dayofmonth("o_orderdate")) > F.struct(F.lit(2), F.lit(29))
    return t.orders.select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 12).alias("anniversary"), (2000 - F.year("o_orderdate") - F.when(later, 1).otherwise(0)).cast("long").alias("whole_years"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("weekday"))


@query("SELECT event_id, strftime(timezone('Europe/Sofia', timezone('UTC', ts)), '%Y-%m-%d') AS local_day, CAST(hour(timezone('Europe/Sofia', timezone('UTC', ts))) AS INTEGER) AS local_hour FROM events")
def local_days(t: Tables) -> DataFrame:
    """UTC instants as local days, summer time included."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Sofia")
    return t.events.select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), F.hour(local).alias("local_hour"))


@query("SELECT page_id, regexp_replace(raw_markdown, '[^0-9]', '', 'g') AS digits FROM pages WHERE raw_markdown IS NOT NULL AND regexp_replace(raw_markdown, '[^0-9]', '', 'g') <> ''")
def digit_runs(t: Tables) -> DataFrame:
    return t.pages.filter("raw_markdown is not null").select("page_id", digits_only(F.col("raw_markdown")).alias("digits")).filter("digits is not null")


@query("""WITH c AS (SELECT DISTINCT page_id, coalesce(raw_markdown, '') AS x FROM pages) SELECT CASE WHEN trim(x) = '' THEN 'empty' WHEN regexp_matches(lower(x), 'captcha|verify you are human|access denied') THEN 'challenge' WHEN regexp_matches(lower(x), 'domain is for sale|parked') THEN 'parked' WHEN contains(lower(x), 'lorem ipsum') THEN 'filler' WHEN length(x) < 200 THEN 'short' ELSE 'text' END AS kind, count(*) AS pages FROM c GROUP BY 1""")
def page_kinds(t: Tables) -> DataFrame:
    """Pages worth reading, and why others aren't."""
    x = F.coalesce("raw_markdown", F.lit(""))
    kind = F.when(F.trim(x) == "", "empty").when(F.lower(x).rlike("captcha|verify you are human|access denied"), "challenge").when(F.lower(x).rlike("domain is for sale|parked"), "parked").when(F.lower(x).contains("lorem ipsum"), "filler").when(F.length(x) < 200, "short").otherwise("text")
    return t.pages.select("page_id", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("pages"))

"""Queries that shape values: names and quotes, grades, fields and lines of texts, addresses, nested values, dates, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import closed, finite, percent, ratio
from veyra.plans.registry import query
from veyra.sources.tables import Tables

# The public transliteration of Bulgarian letters that take several Latin ones.
DIGRAPHS = (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sht"), ("ю", "yu"), ("я", "ya"))
_SINGLE = ("абвгдезийклмнопрстуфхъьАБВГДЕЗИЙКЛМНОПРСТУФХЪЬ", "abvgdeziyklmnoprstufhayABVGDEZIYKLMNOPRSTUFHAY")


def _cased(word: str) -> str:
    """SQL of a word in Latin letters with its case: a word of capitals keeps them throughout."""
    title, every = f"translate({word}, '{_SINGLE[0]}', '{_SINGLE[1]}')", f"translate({word}, '{_SINGLE[0]}', '{_SINGLE[1]}')"
    for a, b in DIGRAPHS:
        title = f"replace(replace({title}, '{a}', '{b}'), '{a.upper()}', '{b.capitalize()}')"
        every = f"replace(replace({every}, '{a}', '{b}'), '{a.upper()}', '{b.upper()}')"
    return f"CASE WHEN {word} = upper({word}) AND length({word}) > 1 THEN {every} ELSE {title} END"


@query(f"SELECT DISTINCT dz_id, list_aggregate(list_transform(string_split(name_full, ' '), lambda w: {_cased('w')}), 'string_agg', ' ') AS latin FROM dz_responses WHERE name_full IS NOT NULL")
def cased_transliteration(t: Tables) -> DataFrame:
    """Names in Latin letters with their case: Ж is Zh at a word's start and ZH in a word of capitals."""
    def one(w: Column) -> Column:
        c = F.translate(w, *_SINGLE)
        title = reduce(lambda x, d: F.replace(F.replace(x, F.lit(d[0]), F.lit(d[1])), F.lit(d[0].upper()), F.lit(d[1].capitalize())), DIGRAPHS, c)
        every = reduce(lambda x, d: F.replace(F.replace(x, F.lit(d[0]), F.lit(d[1])), F.lit(d[0].upper()), F.lit(d[1].upper())), DIGRAPHS, c)
        return F.when((w == F.upper(w)) & (F.length(w) > 1), every).otherwise(title)

    return t.dz_responses.filter("name_full is not null").select("dz_id", F.array_join(F.transform(F.split("name_full", " "), one), " ").alias("latin")).distinct()


@query(r"""WITH n AS (SELECT DISTINCT dz_id, trim(regexp_replace(regexp_replace(regexp_replace(name_full, '[«“"]([^«»“”„"]*)[»”"“]', '„\1“', 'g'), '„([^„“”]*)”', '„\1“', 'g'), '\s+', ' ', 'g')) AS n FROM dz_responses WHERE name_full IS NOT NULL)
SELECT dz_id, n = upper(n) AS capitals, CASE WHEN n = upper(n) THEN list_aggregate(list_transform(string_split(n, ' '), lambda w: CASE WHEN length(w) <= 2 OR NOT regexp_matches(w, '^[„(]?[А-Я]') THEN w WHEN starts_with(w, '„') OR starts_with(w, '(') THEN left(w, 2) || lower(substr(w, 3)) ELSE left(w, 1) || lower(substr(w, 2)) END), 'string_agg', ' ') ELSE n END AS tidy FROM n""")
def tidied_names(t: Tables) -> DataFrame:
    """Names with paired quotes, single blanks and, where all is in capitals, words in title case; short words stay as they are."""
    n = F.regexp_replace(F.regexp_replace(F.col("name_full"), '[«“"]([^«»“”„"]*)[»”"“]', "„$1“"), "„([^„“”]*)”", "„$1“")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    word = lambda w: F.when((F.length(w) <= 2) | ~w.rlike("^[„(]?[А-Я]"), w).when(w.startswith("„") | w.startswith("("), F.concat(F.left(w, F.lit(2)), F.lower(F.substring(w, F.lit(3), F.length(w))))).otherwise(F.concat(F.left(w, F.lit(1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    d = t.dz_responses.filter("name_full is not null").select("dz_id", n.alias("n")).distinct()
    caps = F.col("n") == F.upper("n")
    return d.select("dz_id", caps.alias("capitals"), F.when(caps, F.array_join(F.transform(F.split("n", " "), word), " ")).otherwise(F.col("n")).alias("tidy"))


ROMAN = "map {'I': 1, 'II': 2, 'III': 3, 'IV': 4, 'V': 5, 'VI': 6, 'VII': 7, 'VIII': 8, 'IX': 9, 'X': 10, 'XI': 11, 'XII': 12}"


@query(f"""WITH g AS (SELECT DISTINCT age_group AS label, string_split(age_group, '-') AS e FROM pricing WHERE age_group IS NOT NULL), r AS (SELECT label, coalesce(TRY_CAST(e[1] AS INTEGER), {ROMAN}[upper(trim(e[1]))]) AS lo, coalesce(TRY_CAST(e[-1] AS INTEGER), {ROMAN}[upper(trim(e[-1]))]) AS hi, regexp_matches(label, '[IVX]') AS grades FROM g)
SELECT label, lo, hi, grades, hi - lo + 1 AS width, lo <= hi AS valid FROM r""")
def grade_ranges(t: Tables) -> DataFrame:
    """Ranges of grades or ages out of labels, Roman numbers included."""
    numerals = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
    value = lambda c: F.coalesce(c.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, numerals)), F.upper(F.trim(c))).cast("int"), F.lit(0)))
    e = F.split("age_group", "-")
    g = t.pricing.filter("age_group is not null").select(F.col("age_group").alias("label"), value(F.element_at(e, 1)).alias("lo"), value(F.element_at(e, -1)).alias("hi"), F.col("age_group").rlike("[IVX]").alias("grades")).distinct()
    return g.select("label", "lo", "hi", "grades", (F.col("hi") - F.col("lo") + 1).alias("width"), (F.col("lo") <= F.col("hi")).alias("valid"))


@query(r"""WITH d AS (SELECT doc_id, TRY_CAST(regexp_extract(text, '(?:има|has|hat|са|are) ([0-9]{1,4}) (?:ученици|pupils|деца|children)', 1) AS INTEGER) AS n, TRY_CAST(regexp_extract(text, '([0-9]{1,2}):[0-9]{2}', 1) AS INTEGER) AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n BETWEEN 3 AND 60 THEN n END AS class_size, CASE WHEN h BETWEEN 6 AND 21 THEN h END AS first_hour FROM d WHERE n BETWEEN 3 AND 60 OR h BETWEEN 6 AND 21""")
def plausible_fields(t: Tables) -> DataFrame:
    """Fields read from texts, kept only within plausible bounds."""
    n = F.regexp_extract("text", r"(?:има|has|hat|са|are) ([0-9]{1,4}) (?:ученици|pupils|деца|children)", 1).try_cast("int")
    h = F.regexp_extract("text", r"([0-9]{1,2}):[0-9]{2}", 1).try_cast("int")
    d = t.documents.filter("text is not null").select("doc_id", n.alias("n"), h.alias("h"))
    size, hour = F.when(F.col("n").between(3, 60), F.col("n")), F.when(F.col("h").between(6, 21), F.col("h"))
    return d.select("doc_id", size.alias("class_size"), hour.alias("first_hour")).filter("class_size is not null or first_hour is not null")


@query(r"""WITH p AS (SELECT DISTINCT page_id, raw_markdown FROM pages WHERE raw_markdown IS NOT NULL), l AS (SELECT page_id, unnest(string_split(raw_markdown, chr(10))) AS line, CAST(generate_subscripts(string_split(raw_markdown, chr(10)), 1) AS INTEGER) AS line_no FROM p),
h AS (SELECT page_id, line_no, trim(line) AS line, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(lower(line), 'телефон|phone|работно време|office hours|адрес|address') AND regexp_matches(line, '[0-9]')) SELECT page_id, line_no, md5(line) AS line_md5 FROM h WHERE k <= 3""")
def matching_lines(t: Tables) -> DataFrame:
    """The first three lines of a page that one pattern names and another asks for; lines are picked inside the row, without a shuffle of texts."""
    p = t.pages.filter("raw_markdown is not null").select("page_id", "raw_markdown").distinct()
    lines = F.transform(F.split("raw_markdown", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    hit = F.slice(F.filter(lines, lambda s: F.lower(s["line"]).rlike("телефон|phone|работно време|office hours|адрес|address") & s["line"].rlike("[0-9]")), 1, 3)
    return p.select("page_id", F.explode(hit).alias("h")).select("page_id", "h.line_no", F.md5(F.trim("h.line")).alias("line_md5"))


@query(r"""SELECT DISTINCT price_id, CASE WHEN trim(plan_name) = '' OR regexp_matches(plan_name, '^\s*(https?://|www\.)\S+\s*$') OR regexp_matches(plan_name, '[*_#|`]|\]\(') OR length(plan_name) > 80 THEN NULL ELSE trim(plan_name) END AS shown FROM pricing""")
def displayable_texts(t: Tables) -> DataFrame:
    """Texts fit to be shown: no markup, no bare address of a page, not blank, not too long."""
    c = F.col("plan_name")
    bad = (F.trim(c) == "") | c.rlike(r"^\s*(https?://|www\.)\S+\s*$") | c.rlike(r"[*_#|`]|\]\(") | (F.length(c) > 80)
    return t.pricing.select("price_id", F.when(~bad, F.trim(c)).alias("shown")).distinct()


@query(r"""WITH a AS (SELECT DISTINCT response_id, lower(address) AS a FROM dz_responses WHERE address IS NOT NULL), m AS (SELECT response_id, regexp_extract(a, '(?:№|no\.?|n|ном\.?|номер|бл\.?|блок) *([0-9]+)(?:[ -]?([а-гa-d])(?:[^а-яa-z]|$))?', ['n', 'l']) AS m, trim(regexp_extract(a, '[«„“"]([^«»„“”"]+)[»“”"]', 1)) AS street FROM a)
SELECT response_id, nullif(street, '') AS street, TRY_CAST(m.n AS INTEGER) AS house, nullif(m.l, '') AS letter FROM m""")
def address_parts(t: Tables) -> DataFrame:
    """A typed address split into its quoted street, house number and letter."""
    a = F.lower("address")
    pat = r"(?:№|no\.?|n|ном\.?|номер|бл\.?|блок) *([0-9]+)(?:[ -]?([а-гa-d])(?:[^а-яa-z]|$))?"
    part = lambda p, g: F.nullif(F.trim(F.regexp_extract(a, p, g)), F.lit(""))
    return t.dz_responses.filter("address is not null").select("response_id", part('[«„“"]([^«»„“”"]+)[»“”"]', 1).alias("street"), F.regexp_extract(a, pat, 1).try_cast("int").alias("house"), part(pat, 2).alias("letter")).distinct()


@query(r"""WITH d AS (SELECT doc_id, lang, length(text) AS n, len(regexp_extract_all(text, '[А-Яа-я]')) AS cyr, len(regexp_extract_all(text, '[A-Za-z]')) AS lat, regexp_matches(lower(text), 'lorem ipsum|undefined|null null|\{\{') AS banned FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < 40 THEN 'short' WHEN n > 20000 THEN 'long' WHEN banned THEN 'banned' WHEN lang IN ('bg', 'ru', 'mk') AND cyr < lat THEN 'script' WHEN lang IN ('en', 'de', 'fr', 'tr', 'es') AND lat < cyr THEN 'script' ELSE 'good' END AS issue FROM d""")
def text_issues(t: Tables) -> DataFrame:
    """The first fault of a text: too short or long, banned words, another script than its label's."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    n, cyr, lat = F.length("text"), count("[А-Яа-я]"), count("[A-Za-z]")
    issue = F.when(n < 40, "short").when(n > 20000, "long").when(F.lower("text").rlike(r"lorem ipsum|undefined|null null|\{\{"), "banned").when(F.col("lang").isin("bg", "ru", "mk") & (cyr < lat), "script").when(F.col("lang").isin("en", "de", "fr", "tr", "es") & (lat < cyr), "script").otherwise("good")
    return t.documents.filter("text is not null").select("doc_id", issue.alias("issue"))


@query("""SELECT o_orderkey, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS enrolment_year, CASE WHEN o_orderkey % 86400 // 3600 < 10 THEN '0' ELSE '' END || (o_orderkey % 86400 // 3600) || ':' || CASE WHEN o_orderkey % 3600 // 60 < 10 THEN '0' ELSE '' END || (o_orderkey % 3600 // 60) AS clock, CAST(round(o_totalprice * 1.73 / 60) AS BIGINT) AS minutes FROM orders""")
def clocks_and_years(t: Tables) -> DataFrame:
    """Years that roll over in October, seconds as hours and minutes, and seconds stretched to rounded minutes."""
    s = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    year = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 10, 1).otherwise(0)
    return t.orders.select("o_orderkey", year.cast("long").alias("enrolment_year"), F.concat(two(F.floor(s % 86400 / 3600)), F.lit(":"), two(F.floor(s % 3600 / 60))).alias("clock"), F.round(F.col("o_totalprice") * 1.73 / 60).cast("long").alias("minutes"))


@query("""WITH c AS (SELECT DISTINCT school_id, created_at FROM schools), n AS (SELECT c.school_id, c.created_at, min(p.scraped_at) AS next_at FROM c LEFT JOIN pricing p ON p.school_id = c.school_id AND p.scraped_at >= c.created_at GROUP BY 1, 2)
SELECT school_id, created_at, next_at, date_diff('day', created_at, next_at) AS days FROM n""")
def next_milestone(t: Tables) -> DataFrame:
    """The next event on or after a date, and the days until then."""
    c = t.schools.select("school_id", "created_at").distinct()
    p = t.pricing.select(F.col("school_id").alias("owner"), "scraped_at").distinct()
    n = c.join(p, (F.col("owner") == F.col("school_id")) & (F.col("scraped_at") >= F.col("created_at")), "left").groupBy("school_id", "created_at").agg(F.min("scraped_at").alias("next_at"))
    return n.select("school_id", "created_at", "next_at", F.datediff("next_at", "created_at").cast("long").alias("days"))


@query("""WITH p AS (SELECT DISTINCT price_id, school_id, amount_min AS lo, amount_max AS hi FROM pricing), q AS (SELECT school_id, CASE WHEN lo IS NULL OR isnan(lo) THEN NULL ELSE CAST(lo AS DECIMAL(18, 2)) END AS lo, CASE WHEN hi IS NULL OR isnan(hi) THEN NULL ELSE CAST(hi AS DECIMAL(18, 2)) END AS hi FROM p)
SELECT school_id, CAST(coalesce(sum(lo), 0) AS DOUBLE) AS lo, CASE WHEN count(*) = count(hi) THEN CAST(sum(hi) AS DOUBLE) END AS hi, count(*) - count(hi) AS unknown FROM q GROUP BY 1""")
def interval_sums(t: Tables) -> DataFrame:
    """Sums of intervals with unknown ends: an unknown upper end leaves the sum without one."""
    lo, hi = (finite(F.col(c)).cast("decimal(18,2)") for c in ("amount_min", "amount_max"))
    p = t.pricing.select("price_id", "school_id", lo.alias("lo"), hi.alias("hi")).distinct()
    return p.groupBy("school_id").agg(F.coalesce(F.sum("lo"), F.lit(0)).cast("double").alias("lo"), F.when(F.count("*") == F.count("hi"), F.sum("hi").cast("double")).alias("hi"), (F.count("*") - F.count("hi")).alias("unknown"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN 0 AND 9000 THEN s_acctbal END AS clamped, CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_acctbal > 9000 THEN 'too large' ELSE 'fine' END AS finding, least(s_acctbal, 1000.0 * s_nationkey) AS lo, greatest(s_acctbal, 1000.0 * s_nationkey) AS hi, s_acctbal > 1000.0 * s_nationkey AS swapped FROM supplier""")
def clamped_and_swapped(t: Tables) -> DataFrame:
    """Values outside their range become unknown, and ends given the wrong way round are swapped, each with a finding."""
    v, o = F.col("s_acctbal"), F.lit(1000.0) * F.col("s_nationkey")
    return t.supplier.select("s_suppkey", F.when(v.between(0, 9000), v).alias("clamped"), F.when(v < 0, "negative").when(v > 9000, "too large").otherwise("fine").alias("finding"), F.least(v, o).alias("lo"), F.greatest(v, o).alias("hi"), (v > o).alias("swapped"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'N' THEN 0.8 ELSE 0.25 END / 1000 + l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 0.00015 ELSE 0.0006 END, 8) AS cost FROM lineitem""")
def tiered_costs(t: Tables) -> DataFrame:
    """Units times the price of their tier, from fixed tables of prices."""
    unit = F.when(F.col("l_returnflag") == "A", 3.0).when(F.col("l_returnflag") == "N", 0.8).otherwise(0.25)
    other = F.when(F.col("l_linestatus") == "O", 0.00015).otherwise(0.0006)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * unit / 1000 + F.col("l_extendedprice") * other, 8).alias("cost"))


@query(r"""WITH k AS (SELECT event_id, 'props[' || (event_id % 7) || '].' || json_keys(props)[1] AS path FROM events)
SELECT event_id, path, regexp_replace(regexp_replace(path, '\[[0-9]+\]', '', 'g'), '^\$?\.', '') AS plain_path, CAST(regexp_extract(path, '\[([0-9]+)\]', 1) AS INTEGER) AS row_id, starts_with(path, 'props[3].') OR path = 'props[5].k' AS blocked FROM k""")
def normalised_paths(t: Tables) -> DataFrame:
    """Paths into nested values without their indexes, the row ids parsed out of them, and whether a dotted prefix blocks them."""
    path = F.concat(F.lit("props["), F.col("event_id") % 7, F.lit("]."), F.element_at(F.json_object_keys("props"), 1))
    k = t.events.select("event_id", path.alias("path"))
    return k.select("event_id", "path", F.regexp_replace(F.regexp_replace("path", r"\[[0-9]+\]", ""), r"^\$?\.", "").alias("plain_path"), F.regexp_extract("path", r"\[([0-9]+)\]", 1).cast("int").alias("row_id"), (F.col("path").startswith("props[3].") | (F.col("path") == "props[5].k")).alias("blocked"))


@query("""SELECT source, CAST(to_json(list({'kind': doc_kind, 'n': n} ORDER BY doc_kind)) AS VARCHAR) AS report, len(list(doc_kind)) AS kinds FROM (SELECT source, doc_kind, count(*) AS n FROM documents WHERE doc_kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def nested_report(t: Tables) -> DataFrame:
    """A report as an array of structs in JSON, one entry for each of a source's few kinds."""
    n = t.documents.filter("doc_kind is not null").groupBy("source", "doc_kind").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_kind").alias("kind"), "n"))).alias("r")).select("source", F.to_json("r").alias("report"), F.size("r").cast("long").alias("kinds"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NOT json_valid(props) OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS failed FROM events""")
def typed_rows(t: Tables) -> DataFrame:
    """Answers read as typed rows; one that can't be read so is reported as failed."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.select("event_id", k.alias("k"), k.isNull().alias("failed"))


@query("""SELECT school_id, list_sort(list(DISTINCT lang || ':' || doc_kind)) AS pairs FROM documents WHERE school_id IS NOT NULL AND lang IS NOT NULL AND doc_kind IS NOT NULL GROUP BY 1""")
def pair_sets(t: Tables) -> DataFrame:
    """The set of language:kind pairs of each owner; both come from short fixed lists."""
    return t.documents.filter("school_id is not null").select("school_id", F.concat("lang", F.lit(":"), "doc_kind").alias("p")).filter("p is not null").groupBy("school_id").agg(F.sort_array(F.collect_set("p")).alias("pairs"))


@query("""WITH e AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS k FROM e) SELECT user_id, list(event_type ORDER BY k) AS kept FROM r WHERE k <= 3 AND event_type IN ('click', 'view', 'error', 'purchase') GROUP BY 1""")
def capped_lists(t: Tables) -> DataFrame:
    """The first three different values of each user, in order, invalid ones left out."""
    e = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    r = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("first_id"))).filter("k <= 3").filter(F.col("event_type").isin("click", "view", "error", "purchase"))
    return r.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "event_type"))).alias("r")).select("user_id", F.transform("r", lambda x: x["event_type"]).alias("kept"))


@query("""SELECT school_id, CAST(json_object('name', name, 'city', city) AS VARCHAR) AS public FROM (SELECT DISTINCT school_id, name_i18n['bg'] AS name, city FROM schools WHERE name_i18n['bg'] IS NOT NULL AND city IS NOT NULL)""")
def public_projection(t: Tables) -> DataFrame:
    """A nested record's public part as JSON, withheld subtrees stripped."""
    s = t.schools.select("school_id", F.struct(F.col("name_i18n")["bg"].alias("name"), "city", "website_url", "num_pupils").alias("record"))
    return s.filter("record.name is not null and record.city is not null").select("school_id", F.to_json(F.col("record").dropFields("website_url", "num_pupils")).alias("public")).distinct()


@query("""WITH p AS (SELECT DISTINCT page_id, is_valid, raw_markdown, last_scraped_at, page_category FROM pages)
SELECT count(*) AS pages, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_valid AND trim(raw_markdown) <> '') AS with_text, count(*) FILTER (WHERE is_valid AND trim(raw_markdown) <> '' AND page_category IN ('pricing', 'admission')) AS useful,
round(100.0 * count(*) FILTER (WHERE is_valid) / count(*), 1) AS valid_share, round(100.0 * count(*) FILTER (WHERE is_valid AND trim(raw_markdown) <> '') / nullif(count(*) FILTER (WHERE is_valid), 0), 1) AS text_share, round(100.0 * count(*) FILTER (WHERE is_valid AND trim(raw_markdown) <> '' AND page_category IN ('pricing', 'admission')) / nullif(count(*) FILTER (WHERE is_valid AND trim(raw_markdown) <> ''), 0), 1) AS useful_share FROM p""")
def funnel(t: Tables) -> DataFrame:
    """Counts from step to step and each step's share of the one before."""
    p = t.pages.select("page_id", "is_valid", "raw_markdown", "last_scraped_at", "page_category").distinct()
    valid = closed(F.col("is_valid"))
    text = valid & closed(F.trim("raw_markdown") != "")
    useful = text & closed(F.col("page_category").isin("pricing", "admission"))
    a = p.agg(F.count("*").alias("pages"), F.count_if(valid).alias("valid"), F.count_if(text).alias("with_text"), F.count_if(useful).alias("useful"))
    return a.select("*", percent(F.col("valid"), F.col("pages")).alias("valid_share"), percent(F.col("with_text"), F.col("valid")).alias("text_share"), percent(F.col("useful"), F.col("with_text")).alias("useful_share"))


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(6, 2))) * (1 + CAST(l_tax AS DECIMAL(6, 2)))) AS own FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(own AS DECIMAL(28, 8)) AS own, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) - own AS DECIMAL(28, 8)) AS discrepancy FROM orders JOIN l ON l_orderkey = o_orderkey""")
def reconciled_totals(t: Tables) -> DataFrame:
    """Exact decimal sums against totals told elsewhere, the discrepancy at eight places."""
    d = lambda c, k: F.col(c).cast(f"decimal({k},2)")
    line = (d("l_extendedprice", 18) * (1 - d("l_discount", 6)) * (1 + d("l_tax", 6))).cast("decimal(28,8)")
    l = t.lineitem.groupBy("l_orderkey").agg(F.sum(line).cast("decimal(28,8)").alias("own"))  # noqa: E741
    return t.orders.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "own", (d("o_totalprice", 18) - F.col("own")).cast("decimal(28,8)").alias("discrepancy"))


@query("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 25 THEN p_retailprice / 1.95583 ELSE p_retailprice END AS v FROM part), r AS (SELECT p_brand, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1)
SELECT r.p_brand, round(lo, 6) AS lo, round(hi, 6) AS hi, min(p_partkey) FILTER (WHERE v = lo) AS at_lo, min(p_partkey) FILTER (WHERE v = hi) AS at_hi FROM r JOIN p ON p.p_brand = r.p_brand GROUP BY ALL""")
def range_ends(t: Tables) -> DataFrame:
    """The range of converted values and the first row at each end, from one aggregate."""
    p = t.part.select("p_brand", "p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice") / 1.95583).otherwise(F.col("p_retailprice")).alias("v"))
    a = p.groupBy("p_brand").agg(F.min(F.struct("v", "p_partkey")).alias("lo"), F.max(F.struct("v", (-F.col("p_partkey")).alias("k"))).alias("hi"))
    return a.select("p_brand", F.round("lo.v", 6).alias("lo"), F.round("hi.v", 6).alias("hi"), F.col("lo.p_partkey").alias("at_lo"), (-F.col("hi.k")).alias("at_hi"))


@query("""WITH f AS (SELECT DISTINCT line_id, amount, quote FROM fee_lines), j AS (SELECT *, amount IS NULL OR isnan(amount) AS none, contains(coalesce(quote, ''), CAST(CAST(CASE WHEN isnan(amount) THEN NULL ELSE amount END AS BIGINT) AS VARCHAR)) AS hit FROM f)
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT none AND NOT hit) AS wrong, count(*) FILTER (WHERE NOT none AND hit) AS found, round(CAST(count(*) FILTER (WHERE NOT none AND NOT hit) AS DOUBLE) / nullif(count(*), 0), 4) AS wrong_rate, round(CAST(count(*) FILTER (WHERE NOT none AND hit) AS DOUBLE) / nullif(count(*), 0), 4) AS found_rate, CAST(count(*) FILTER (WHERE NOT none AND NOT hit) AS DOUBLE) / nullif(count(*), 0) > 0.05 + 0.02 AS worse FROM j""")
def answer_rates(t: Tables) -> DataFrame:
    """Rates of wrong and found answers at four places, and whether the wrong ones exceed a baseline by more than a margin."""
    f = t.fee_lines.select("line_id", finite(F.col("amount")).alias("amount"), "quote").distinct()
    hit = closed(F.coalesce("quote", F.lit("")).contains(F.col("amount").cast("long").cast("string")))
    none = F.col("amount").isNull()
    a = f.agg(F.count("*").alias("rows"), F.count_if(~none & ~hit).alias("wrong"), F.count_if(~none & hit).alias("found"))
    return a.select("*", ratio(F.col("wrong"), F.col("rows")).alias("wrong_rate"), ratio(F.col("found"), F.col("rows")).alias("found_rate"), (F.col("wrong") / F.col("rows") > 0.05 + 0.02).alias("worse"))

"""Arrays, maps and JSON: canonical forms, emptiness, flattening, tag sets; and further text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import name_key, ratio
from veyra.plans.registry import query
from veyra.sources.tables import Tables


def canonical_json(c: Column) -> Column:
    """Flat JSON with its keys in order, so that equal objects have equal text."""
    m = F.from_json(c, "map<string,string>")
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), F.coalesce(e["value"], F.lit("null")), F.lit('"'))), ","), F.lit("}"))


@query("""SELECT event_id, '{' || array_to_string(list_transform(list_sort(json_keys(props)), lambda k: '"' || k || '":"' || coalesce(json_extract_string(props, '$.' || k), 'null') || '"'), ',') || '}' AS canonical FROM events WHERE props IS NOT NULL""")
def canonical_props(t: Tables) -> DataFrame:
    return t.events.filter("props is not null").select("event_id", canonical_json(F.col("props")).alias("canonical"))


@query("""SELECT DISTINCT school_id, list_sort(map_keys(name_i18n)) AS languages, len(list_filter(map_values(name_i18n), lambda v: v IS NOT NULL AND trim(v) <> '')) AS filled FROM schools WHERE name_i18n IS NOT NULL""")
def map_emptiness(t: Tables) -> DataFrame:
    """Which keys a map has and how many of its values hold something."""
    vals = F.filter(F.map_values("name_i18n"), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
    return t.schools.filter("name_i18n is not null").select("school_id", F.sort_array(F.map_keys("name_i18n")).alias("languages"), F.size(vals).cast("long").alias("filled")).distinct()


@query("""SELECT DISTINCT school_id, lang, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM (SELECT school_id, unnest(map_keys(name_i18n)) AS lang, unnest(map_values(name_i18n)) AS name FROM schools) WHERE name IS NOT NULL""".replace("\\\\", "\\"))
def exploded_names(t: Tables) -> DataFrame:
    return t.schools.select("school_id", F.explode("name_i18n").alias("lang", "name")).filter("name is not null").select("school_id", "lang", name_key(F.col("name")).alias("key")).distinct()


@query("""SELECT entry_code, list_sort(list_distinct(list_transform(list_concat([name_en, name_bg], coalesce(other_names, [])), lambda x: lower(trim(x))))) AS names FROM fee_vocab""")
def merged_name_lists(t: Tables) -> DataFrame:
    """Names and synonyms as one distinct sorted list; list sizes are bounded by the reference list's own."""
    every = F.concat(F.array("name_en", "name_bg"), F.coalesce("other_names", F.array().cast("array<string>")))
    return t.fee_vocab.select("entry_code", F.array_sort(F.array_distinct(F.transform(every, lambda x: F.lower(F.trim(x))))).alias("names"))


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings) SELECT label, count(*) AS n, round(avg(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum')), 4) AS energy, CAST(min(len(embedding)) AS BIGINT) AS dims FROM v GROUP BY 1""")
def vector_norms(t: Tables) -> DataFrame:
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(sq), 4).alias("energy"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '(^|[^0-9.:,])([0-3]?[0-9]\.[01]?[0-9]\.20[0-9][0-9])', 2))) AS dates, len(regexp_extract_all(text, '(^|[^0-9])([0-2]?[0-9]:[0-5][0-9])', 2)) AS times FROM documents WHERE text IS NOT NULL""")
def dates_in_text(t: Tables) -> DataFrame:
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(2))
    return t.documents.filter("text is not null").select("doc_id", F.array_sort(F.array_distinct(found(r"(^|[^0-9.:,])([0-3]?[0-9]\.[01]?[0-9]\.20[0-9][0-9])"))).alias("dates"), F.size(found(r"(^|[^0-9])([0-2]?[0-9]:[0-5][0-9])")).cast("long").alias("times"))


@query(r"""WITH m AS (SELECT DISTINCT fee_id, amount, evidence FROM missed_fees WHERE amount IS NOT NULL AND evidence IS NOT NULL), n AS (SELECT fee_id, amount, list_transform(regexp_extract_all(evidence, '[0-9]+(?:[.,][0-9]{1,2})?'), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE)) AS nums FROM m)
SELECT fee_id, len(nums) AS numbers, list_contains(list_transform(nums, lambda x: round(x, 2)), round(amount, 2)) AS printed FROM n""")
def printed_numbers(t: Tables) -> DataFrame:
    """Whether a structured amount is printed in its evidence."""
    nums = F.transform(F.regexp_extract_all("evidence", F.lit(r"[0-9]+(?:[.,][0-9]{1,2})?"), F.lit(0)), lambda x: F.round(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), 2))
    return t.missed_fees.filter("amount is not null and evidence is not null").select("fee_id", "amount", "evidence").distinct().select("fee_id", F.size(nums).cast("long").alias("numbers"), F.array_contains(nums, F.round("amount", 2)).alias("printed"))


@query(r"""WITH p AS (SELECT DISTINCT page_id, page_category, lower(coalesce(url, '') || ' ' || coalesce(raw_markdown, '')) AS x FROM pages)
SELECT page_id, page_category, CASE WHEN regexp_matches(x, 'такси|fees|price|цен') THEN 'fees' WHEN regexp_matches(x, 'прием|admission|кандидатств') THEN 'admission' WHEN regexp_matches(x, 'новини|news') THEN 'news' WHEN regexp_matches(x, 'контакт|contact') THEN 'contact' ELSE 'other' END AS kind FROM p""")
def keyword_classes(t: Tables) -> DataFrame:
    """The first class in order whose words a page has."""
    x = F.lower(F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("raw_markdown", F.lit(""))))
    kind = F.when(x.rlike("такси|fees|price|цен"), "fees").when(x.rlike("прием|admission|кандидатств"), "admission").when(x.rlike("новини|news"), "news").when(x.rlike("контакт|contact"), "contact").otherwise("other")
    return t.pages.select("page_id", "page_category", "url", "raw_markdown").distinct().select("page_id", "page_category", kind.alias("kind"))


@query("""WITH d AS (SELECT school_id, count(DISTINCT category) AS cats FROM pricing WHERE category IS NOT NULL GROUP BY 1), c AS (SELECT count(DISTINCT category) AS every FROM pricing WHERE category IS NOT NULL)
SELECT school_id, round(CAST(cats AS DOUBLE) / every, 4) AS coverage, CASE WHEN cats * 1.0 / every >= 0.8 THEN 'full' WHEN cats * 1.0 / every >= 0.4 THEN 'part' ELSE 'thin' END AS band FROM d, c""")
def coverage_bands(t: Tables) -> DataFrame:
    p = t.pricing.filter("category is not null").select("school_id", "category").distinct()
    every = p.agg(F.count_distinct("category").alias("every")).scalar()
    d = p.groupBy("school_id").agg(F.count("*").alias("cats"))
    share = F.col("cats") / every
    return d.select("school_id", ratio(F.col("cats"), every).alias("coverage"), F.when(share >= 0.8, "full").when(share >= 0.4, "part").otherwise("thin").alias("band"))


@query("""WITH s AS (SELECT DISTINCT school_id, website_url, city FROM schools WHERE website_url IS NOT NULL), h AS (SELECT school_id, city, split_part(regexp_replace(lower(website_url), '^[a-z]+://(www\\.)?', ''), '/', 1) AS host FROM s)
SELECT city, count(*) AS sites, count(DISTINCT host) AS hosts, min(host) AS first_host, max(length(host)) AS longest FROM h GROUP BY 1""".replace("\\\\", "\\"))
def hosts_by_city(t: Tables) -> DataFrame:
    host = F.substring_index(F.regexp_replace(F.lower("website_url"), r"^[a-z]+://(www\.)?", ""), "/", 1)
    h = t.schools.filter("website_url is not null").select("school_id", "website_url", "city").distinct().select("city", host.alias("host"))
    return h.groupBy("city").agg(F.count("*").alias("sites"), F.count_distinct("host").alias("hosts"), F.min("host").alias("first_host"), F.max(F.length("host")).cast("long").alias("longest"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY 1), r AS (SELECT n, total, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS ra, rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0 AS rb FROM g)
SELECT count(*) AS customers, round(corr(ra, rb), 6) AS rank_correlation FROM r""")
def rank_correlation(t: Tables) -> DataFrame:
    """Spearman's correlation: ranks come from counts of equal values, so no single task orders all rows."""
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))

    def ranks(df: DataFrame, c: str, name: str) -> DataFrame:
        # equal values are counted first; the counts are ranged over buckets whose sums are few
        v = df.groupBy(c).agg(F.count("*").alias("_m"))
        ends = df.agg(F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias("e")).scalar()
        v = v.withColumn("_b", F.floor(F.when(ends["hi"] > ends["lo"], (F.col(c).cast("double") - ends["lo"]) / (ends["hi"] - ends["lo"]) * 1023).otherwise(0)))
        b = v.groupBy("_b").agg(F.sum("_m").alias("_s"))
        b = b.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
        w = Window.partitionBy("_b").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return v.join(F.broadcast(b), "_b").select(c, (F.col("_before") + F.sum("_m").over(w) - F.col("_m") + (F.col("_m") + 1) / 2.0).alias(name))

    r = g.join(ranks(g, "n", "ra"), "n").join(ranks(g, "total", "rb"), "total")
    return r.agg(F.count("*").alias("customers"), F.round(F.corr("ra", "rb"), 6).alias("rank_correlation"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT median(n) AS mid FROM c)
SELECT min(day) AS day FROM c, m WHERE dayofweek(day) BETWEEN 2 AND 4 AND n >= 0.9 * mid""")
def normal_day(t: Tables) -> DataFrame:
    """The first Tuesday to Thursday with about as many rows as the median day."""
    c = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    mid = c.agg(F.median("n").alias("mid")).scalar()
    return c.filter(F.dayofweek("day").between(3, 5) & (F.col("n") >= 0.9 * mid)).agg(F.min("day").alias("day"))


@query("""WITH k AS (SELECT source, lower(unnest(regexp_extract_all(text, '\\p{L}{4,}'))) AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), c AS (SELECT source, w, count(*) AS n FROM k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c)
SELECT source, w AS word, n, rank FROM r WHERE rank <= 5""".replace("\\\\", "\\"))
def top_words(t: Tables) -> DataFrame:
    """The five commonest words of each source."""
    k = t.documents.filter("text is not null and source is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0))).alias("w"))
    c = k.groupBy("source", F.lower(F.translate("w", "İ", "i")).alias("word")).agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word")).cast("long")).filter("rank <= 5")

"""List and search queries: filters built from what a caller asks, sort orders, ranked search, paging, public projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veyra.functions.columns import closed, name_key, sound_key, transliterate
from veyra.plans.registry import query
from veyra.plans.texts import KEY, TRANS
from veyra.sources.tables import Tables


def wanted(column: Column, value: str | None) -> Column:
    """Equality without case and outer blanks; a blank value or ``all`` asks for nothing."""
    v = (value or "").strip().lower()
    return F.lit(True) if v in ("", "all") else closed(F.lower(F.trim(column)) == v)


def any_of_each(values: Column, groups: list[list[str]]) -> Column:
    """Whether an array holds one of each group's values; empty groups ask for nothing."""
    return reduce(lambda a, b: a & b, [F.arrays_overlap(values, F.array(*map(F.lit, g))) for g in groups if g], F.lit(True))


def list_filter(asked: dict) -> Column:
    """The predicate of a list: ``city``, ``level``, ``type`` (private includes international), ``least`` pupils, ``languages`` (groups)."""
    kind = asked.get("type")
    by_type = closed(F.lower("school_type").isin("private", "international")) if (kind or "").strip().lower() == "private" else wanted(F.col("school_type"), kind)
    least = F.lit(True) if asked.get("least") is None else closed(F.col("num_pupils") >= asked["least"])
    return wanted(F.col("city"), asked.get("city")) & wanted(F.col("education_level"), asked.get("level")) & by_type & least & any_of_each(F.map_keys("name_i18n"), asked.get("languages", []))


ASKED = [
    ("nothing", {}), ("all", {"city": "all", "level": " ", "type": "ALL"}), ("city", {"city": " буковикрай "}), ("level", {"level": "KINDERGARTEN"}),
    ("private", {"type": "private"}), ("pupils", {"least": 100}), ("english", {"languages": [["en"], ["bg", "de"]]}), ("several", {"city": "Мравобечене", "level": "school", "type": "state", "least": 20}), ("none", {"city": "nowhere"}),
]


@query("""WITH s AS (SELECT DISTINCT school_id, lower(trim(city)) AS city, lower(trim(education_level)) AS lvl, lower(school_type) AS typ, num_pupils AS n, map_keys(name_i18n) AS k FROM schools)
SELECT 'nothing' AS variant, school_id FROM s UNION ALL SELECT 'all', school_id FROM s UNION ALL SELECT 'city', school_id FROM s WHERE city = 'буковикрай' UNION ALL SELECT 'level', school_id FROM s WHERE lvl = 'kindergarten'
UNION ALL SELECT 'private', school_id FROM s WHERE typ IN ('private', 'international') UNION ALL SELECT 'pupils', school_id FROM s WHERE n >= 100 UNION ALL SELECT 'english', school_id FROM s WHERE list_contains(k, 'en') AND (list_contains(k, 'bg') OR list_contains(k, 'de'))
UNION ALL SELECT 'several', school_id FROM s WHERE city = 'мравобечене' AND lvl = 'school' AND typ = 'state' AND n >= 20""")
def filtered_lists(t: Tables) -> DataFrame:
    """The ids under each of several filters, from one scan: a row is exploded into the variants it passes."""
    s = t.schools.select("school_id", "city", "education_level", "school_type", "num_pupils", "name_i18n")
    passed = F.array_compact(F.array(*[F.when(list_filter(a), F.lit(v)) for v, a in ASKED]))
    return s.select("school_id", F.explode(passed).alias("variant")).distinct().select("variant", "school_id")


STEM, NUMBER = r"trim(regexp_replace({0}, '[0-9].*$', ''))", "coalesce(TRY_CAST(regexp_extract({0}, '[0-9]+') AS BIGINT), 0)"


@query(f"""WITH s AS (SELECT DISTINCT school_id, city, {KEY.format("coalesce(name_i18n['bg'], '')")} AS k FROM schools), n AS (SELECT school_id, city, regexp_replace(k, '^(детска градина|детска ясла|(основно|начално|средно) училище|дг|дя|оу|ну|су) ', '') AS k FROM s)
SELECT city, school_id, row_number() OVER (PARTITION BY city ORDER BY {STEM.format('k')}, {NUMBER.format('k')}, school_id) AS place FROM n""")
def natural_order(t: Tables) -> DataFrame:
    """Names in each town sorted without their type words and with numbers by value."""
    k = F.regexp_replace(name_key(F.coalesce(F.col("name_i18n")["bg"], F.lit(""))), "^(детска градина|детска ясла|(основно|начално|средно) училище|дг|дя|оу|ну|су) ", "")
    stem, number = F.trim(F.regexp_replace(k, "[0-9].*$", "")), F.coalesce(F.regexp_extract(k, "[0-9]+", 0).try_cast("long"), F.lit(0))
    s = t.schools.select("school_id", "city", stem.alias("stem"), number.alias("number")).distinct()
    return s.select("city", "school_id", F.row_number().over(Window.partitionBy("city").orderBy("stem", "number", "school_id")).cast("long").alias("place"))


MODES = {"name": "name ASC", "pupils": "num_pupils DESC NULLS LAST", "type": "CASE WHEN school_type = 'state' THEN 1 ELSE 0 END", "level": "education_level ASC NULLS LAST", "newest": "created_at DESC NULLS LAST", "oldest": "created_at ASC NULLS LAST", "city": "city ASC NULLS LAST"}


@query("WITH s AS (SELECT DISTINCT school_id, name_i18n['bg'] AS name, num_pupils, school_type, education_level, created_at, city FROM schools) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, place, school_id FROM (SELECT school_id, row_number() OVER (ORDER BY {o}, school_id) AS place FROM s) WHERE place <= 50" for m, o in MODES.items()))
def sort_modes(t: Tables) -> DataFrame:
    """The first fifty under each sort mode; unknown values last, ties by id. Tasks keep their best fifty before anything is sorted as one."""
    s = t.schools.select("school_id", F.col("name_i18n")["bg"].alias("name"), "num_pupils", "school_type", "education_level", "created_at", "city").distinct()
    def first(mode: str, order: str) -> DataFrame:
        top = s.orderBy(F.expr(order.removesuffix("NULLS LAST").removesuffix(" ").removesuffix(" ASC").removesuffix(" DESC")).desc_nulls_last() if " DESC" in order else F.expr(order.removesuffix(" NULLS LAST").removesuffix(" ASC")).asc_nulls_last(), "school_id").limit(50)
        ids = F.collect_list("school_id")  # at most fifty, in their order
        return top.agg(ids.alias("ids")).select(F.lit(mode).alias("mode"), F.posexplode("ids").alias("pos", "school_id")).select("mode", (F.col("pos") + 1).cast("long").alias("place"), "school_id")

    return reduce(DataFrame.unionByName, [first(m, o) for m, o in MODES.items()])


@query("""SELECT price_id, category, row_number() OVER (PARTITION BY school_id ORDER BY coalesce(list_position(['tuition', 'food', 'transport', 'registration', 'materials'], category), 99), price_id) AS place FROM (SELECT DISTINCT price_id, school_id, category FROM pricing)""")
def domain_order(t: Tables) -> DataFrame:
    """Rows of each owner in the domain's own order of categories, stable within one."""
    order = ["tuition", "food", "transport", "registration", "materials"]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0)), F.lit(99))
    p = t.pricing.select("price_id", "school_id", "category").distinct()
    return p.select("price_id", "category", F.row_number().over(Window.partitionBy("school_id").orderBy(rank, "price_id")).cast("long").alias("place"))


@query("""WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(CAST(published_at AS VARCHAR), '') DESC, coalesce(doc_kind, '') DESC, coalesce(lang, '') DESC, n_chars DESC, coalesce(url, '') DESC, doc_id DESC) AS place FROM documents) SELECT source, doc_id, place FROM d""")
def six_key_order(t: Tables) -> DataFrame:
    """A descending order by six keys in which an unknown one counts as an empty text."""
    text = lambda c: F.desc(F.coalesce(F.col(c).cast("string"), F.lit("")))
    w = Window.partitionBy("source").orderBy(text("published_at"), text("doc_kind"), text("lang"), F.desc("n_chars"), text("url"), F.desc("doc_id"))
    return t.documents.select("source", "doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH r AS (SELECT city, school_id, row_number() OVER (PARTITION BY city ORDER BY school_id) AS place FROM (SELECT DISTINCT city, school_id FROM schools)), m AS (SELECT city, max(place) // 2 + 1 AS mid FROM r GROUP BY 1)
SELECT r.city, r.place, r.school_id FROM r JOIN m USING (city) WHERE place BETWEEN greatest(1, mid - 3) AND mid + 3""")
def page_around(t: Tables) -> DataFrame:
    """A window of a list around an index: three rows on both sides of each town's middle."""
    r = t.schools.select("city", "school_id").distinct().select("city", "school_id", F.row_number().over(Window.partitionBy("city").orderBy("school_id")).cast("long").alias("place"))
    m = t.schools.groupBy("city").agg((F.floor(F.count_distinct("school_id") / 2) + 1).alias("mid"))
    return r.join(m, "city").filter("place between greatest(1, mid - 3) and mid + 3").select("city", "place", "school_id")


SEARCHED = ["дг 15", "звънлива", "60", "сокобешево", "основно училище", "златна капка", "118 дг"]
_SEARCH_KEY = KEY.format("regexp_replace(regexp_replace(lower(name), '№ *|(no|nr)\\.? *([0-9])', '\\2', 'g'), '([0-9])[ -]?(ма|ва|то|ри|ти|та|st|nd|rd|th)([^\\p{L}]|$)', '\\1 ', 'g')")


def search_key(c: Column) -> Column:
    """A name's key with number signs and endings of ordinals dropped."""
    c = F.regexp_replace(F.lower(c), r"№ *|(no|nr)\.? *([0-9])", "$2")
    return name_key(F.regexp_replace(c, r"([0-9])[ -]?(ма|ва|то|ри|ти|та|st|nd|rd|th)([^\p{L}]|$)", "$1 "))


@query(f"SELECT DISTINCT location_id, {_SEARCH_KEY} AS key FROM place_pins WHERE name IS NOT NULL")
def search_keys(t: Tables) -> DataFrame:
    return t.place_pins.filter("name is not null").select("location_id", search_key(F.col("name")).alias("key")).distinct()


_Q = ", ".join(f"({i}, '{q}')" for i, q in enumerate(SEARCHED))
_HAS = "CASE WHEN regexp_matches(w, '^[0-9]+$') THEN list_contains(string_split(k, ' '), w) ELSE contains(' ' || k, ' ' || w) END"


@query(f"""WITH n AS (SELECT DISTINCT location_id, city, {_SEARCH_KEY} AS k FROM place_pins WHERE name IS NOT NULL), q(i, q) AS (VALUES {_Q}), w AS (SELECT i, q, unnest(string_split(q, ' ')) AS w FROM q),
h AS (SELECT i, location_id, k, min(CASE WHEN {_HAS} THEN 1 ELSE 0 END) AS own, min(CASE WHEN {_HAS} OR {KEY.format('city')} = w THEN 1 ELSE 0 END) AS every FROM n, w GROUP BY ALL)
SELECT q.q AS query, h.location_id, CASE WHEN h.k = q.q THEN 1 WHEN contains(' ' || h.k || ' ', ' ' || q.q || ' ') THEN CASE WHEN starts_with(h.k, q.q) THEN 2 ELSE 3 END WHEN own = 1 THEN 4 ELSE 5 END AS tier FROM h JOIN q USING (i) WHERE every = 1""")
def ranked_search(t: Tables) -> DataFrame:
    """Names that hold every word of a query, by tier: equal, phrase in front, phrase, all words, all words with the town's.

    A number is held whole, another word by its beginning. The queries are few, so each name is tested where it is read.
    """
    k, town = search_key(F.col("name")), name_key(F.col("city"))
    n = t.place_pins.filter("name is not null").select("location_id", k.alias("k"), town.alias("town")).distinct()
    has = lambda w: F.array_contains(F.split("k", " "), w) if w.isdigit() else F.concat(F.lit(" "), F.col("k")).contains(f" {w}")

    def tier(q: str) -> Column:
        ws = q.split()
        own = reduce(lambda a, b: a & b, [has(w) for w in ws])
        every = reduce(lambda a, b: a & b, [has(w) | closed(F.col("town") == w) for w in ws])
        phrase = F.concat(F.lit(" "), F.col("k"), F.lit(" ")).contains(f" {q} ")
        at = F.when(F.col("k") == q, 1).when(phrase & F.col("k").startswith(q), 2).when(phrase, 3).when(own, 4).otherwise(5)
        return F.when(every, F.struct(F.lit(q).alias("query"), at.alias("tier")))

    hits = n.select("location_id", F.explode(F.array_compact(F.array(*map(tier, SEARCHED)))).alias("h")).select("h.query", "location_id", "h.tier")
    return hits.groupBy("query", "location_id", "tier").agg(F.lit(1)).select("query", "location_id", "tier")


_LOOSE = "regexp_replace(replace(replace(replace(replace(replace({0}, 'sht', 'sh'), 'ya', 'ia'), 'yu', 'iu'), 'j', 'zh'), 'w', 'v'), 'y', 'i', 'g')"


@query(f"""WITH l AS (SELECT DISTINCT label_id, {_LOOSE.format(TRANS.format('english_name'))} AS k, {_LOOSE.format(TRANS.format('city_en'))} AS town FROM identity_labels WHERE english_name IS NOT NULL), p AS (SELECT DISTINCT location_id, {_LOOSE.format(TRANS.format('name'))} AS k, {_LOOSE.format(TRANS.format('city'))} AS town FROM place_pins WHERE name IS NOT NULL),
a AS (SELECT DISTINCT label_id, town, unnest(regexp_extract_all(k, '[a-z]+ [a-z]+$')) AS tail FROM (SELECT label_id, town, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS k FROM l)), b AS (SELECT DISTINCT location_id, town, unnest(regexp_extract_all(k, '[a-z]+ [a-z]+$')) AS tail FROM (SELECT location_id, town, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS k FROM p))
SELECT label_id, location_id FROM a JOIN b USING (town, tail)""")
def loose_spelling_search(t: Tables) -> DataFrame:
    """Latin names found among Cyrillic ones of their town by the last two words, spelling variants rewritten in order."""
    def loose(c: Column) -> Column:
        c = transliterate(c)
        for a, b in (("sht", "sh"), ("ya", "ia"), ("yu", "iu"), ("j", "zh"), ("w", "v"), ("y", "i")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    tail = lambda c: F.regexp_extract(F.trim(F.regexp_replace(loose(c), "[^a-z0-9]+", " ")), "[a-z]+ [a-z]+$", 0)
    a = t.identity_labels.filter("english_name is not null").select("label_id", loose(F.col("city_en")).alias("town"), tail(F.col("english_name")).alias("tail")).distinct().filter("tail != ''")
    b = t.place_pins.filter("name is not null").select("location_id", loose(F.col("city")).alias("town"), tail(F.col("name")).alias("tail")).distinct().filter("tail != ''")
    return a.join(b, ["town", "tail"]).select("label_id", "location_id")


@query()
def sound_search(t: Tables) -> DataFrame:
    """Labels whose last word sounds like the last word of a pin's name in the same town; tests hold the sound against a plain version."""
    last = lambda c: sound_key(F.regexp_extract(name_key(c), "[^ ]+$", 0))
    a = t.identity_labels.filter("english_name is not null").select("label_id", sound_key(F.col("city_en")).alias("town"), last(F.col("english_name")).alias("s")).distinct().filter("length(s) >= 3")
    b = t.place_pins.filter("name is not null").select("location_id", sound_key(F.col("city")).alias("town"), last(F.col("name")).alias("s")).distinct()
    return a.join(b, ["town", "s"]).select("label_id", "location_id").distinct()


@query("""SELECT DISTINCT location_id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lng END AS lng, NOT ok AS withheld FROM (SELECT location_id, lat, lng, coalesce(lat BETWEEN 41 AND 44.3 AND lng BETWEEN 22 AND 28.7 AND updated_at >= TIMESTAMP '2025-01-01', FALSE) AS ok FROM place_pins)""")
def gated_positions(t: Tables) -> DataFrame:
    """Pins whose position is out of bounds or long unchecked come out without it."""
    ok = closed(F.col("lat").between(41, 44.3) & F.col("lng").between(22, 28.7) & (F.col("updated_at") >= F.lit("2025-01-01").cast("timestamp_ntz")))
    return t.place_pins.select("location_id", F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lng")).alias("lng"), (~ok).alias("withheld")).distinct()


@query("""SELECT DISTINCT school_id, coalesce(name_i18n['en'], name_i18n['bg']) AS name, name_i18n['en'] IS NOT NULL AS overlaid FROM schools""")
def overlaid_names(t: Tables) -> DataFrame:
    """A locale's map laid over the base map: what the locale has wins, the rest shows through."""
    of = lambda lang: F.map_from_entries(F.transform(F.filter(F.map_entries("name_i18n"), lambda e: e["key"] == lang), lambda e: F.struct(F.lit("name").alias("key"), e["value"].alias("value"))))
    base, over = of("bg"), of("en")
    both = F.map_concat(F.map_filter(base, lambda k, _: F.element_at(over, k).isNull()), over)
    return t.schools.select("school_id", both["name"].alias("name"), F.element_at(over, "name").isNotNull().alias("overlaid")).distinct()


@query("""SELECT DISTINCT school_id, list_sort(list_filter(map_keys(name_i18n), lambda k: k <> 'bg')) AS other_languages, len(map_keys(name_i18n)) AS languages, website_url IS NOT NULL AS has_site, num_pupils >= 100 AS large FROM schools""")
def filter_columns(t: Tables) -> DataFrame:
    """A nested projection flattened into the columns that filters read."""
    keys = F.map_keys("name_i18n")
    return t.schools.select("school_id", F.sort_array(F.filter(keys, lambda k: k != "bg")).alias("other_languages"), F.size(keys).cast("long").alias("languages"), F.col("website_url").isNotNull().alias("has_site"), (F.col("num_pupils") >= 100).alias("large")).distinct()


@query("""SELECT entry_code, list_filter(other_names, lambda x: starts_with(lower(x), 'school') OR starts_with(lower(x), 'per ') OR starts_with(lower(x), 'на ')) AS kept FROM fee_vocab""")
def allowed_prefixes(t: Tables) -> DataFrame:
    """Only the tags of an array that begin with an allowed prefix."""
    return t.fee_vocab.select("entry_code", F.filter("other_names", lambda x: F.lower(x).startswith("school") | F.lower(x).startswith("per ") | F.lower(x).startswith("на ")).alias("kept"))


@query(r"""SELECT entry_code, list_sort(list_filter(other_names, lambda x: regexp_matches(x, '[а-яА-Я]'))) AS cyrillic, list_sort(list_filter(other_names, lambda x: NOT regexp_matches(x, '[а-яА-Я]'))) AS other FROM fee_vocab""")
def split_by_script(t: Tables) -> DataFrame:
    """An array parted in two by a predicate."""
    cyr = lambda x: x.rlike("[а-яА-Я]")
    return t.fee_vocab.select("entry_code", F.sort_array(F.filter("other_names", cyr)).alias("cyrillic"), F.sort_array(F.filter("other_names", lambda x: ~cyr(x))).alias("other"))

"""Column functions shared by queries: guarded ratios, gates, keys, dates and money. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, null where there is no base."""
    return F.round(F.when(whole != 0, part.cast("double") / whole), digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.when(whole != 0, 100.0 * part / whole), digits)


def closed(condition: Column) -> Column:
    """A condition in which unknown is false."""
    return F.coalesce(condition, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def finite(c: Column) -> Column:
    """The number, null where it is NaN or infinite."""
    v = c.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def name_key(c: Column) -> Column:
    """Letters and digits only, lower case, words one blank apart."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def digits_only(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit(""))


def transliterate(c: Column) -> Column:
    """Bulgarian letters of lower-case text in Latin ones: one-to-one letters in one pass, the others by replacement."""
    c = F.translate(F.lower(c), "абвгдезийклмнопрстуфхъь", "abvgdeziyklmnoprstufhay")
    for a, b in (("ж", "zh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sht"), ("ю", "yu"), ("я", "ya")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sound_key(c: Column) -> Column:
    """What of a transliterated word sounds alike: voiced and voiceless pairs as one, no vowels, no doubles."""
    c = transliterate(c)
    for a, b in (("sht", "s"), ("sh", "s"), ("zh", "s"), ("ch", "s"), ("ts", "s")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, "dbgvzwcqj", "tpkfsfkks")
    c = F.regexp_replace(c, "[^a-z0-9]|[aeiouy]", "")
    return F.regexp_replace(c, r"(.)\1+", "$1")


def canonical_url(url: Column) -> Column:
    """A url without scheme, www., port, query, fragment and trailing slash, in lower case."""
    c = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^www\.", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"^([^/:]+):[0-9]+", "$1"), r"/+$", "")


def school_year_start(c: Column) -> Column:
    """The first year of a text such as 2025/2026 or 2025-26; null where the second isn't the next."""
    a, b = F.regexp_extract(c, r"(20\d\d)\s*[-/]\s*(\d{4}|\d\d)", 1), F.regexp_extract(c, r"(20\d\d)\s*[-/]\s*(\d{4}|\d\d)", 2)
    first, second = a.try_cast("int"), b.try_cast("int")
    second = F.when(F.length(b) == 2, F.floor(first / 100) * 100 + second).otherwise(second)
    return F.when(second - first == 1, first)


def hash_share(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: its SHA-256's first 32 bits."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)

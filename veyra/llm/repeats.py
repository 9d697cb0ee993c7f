"""Lines that stand on many pages of one site.

Lines are parsed into templates by a token tree of fixed depth: the first levels are the site and the number of tokens, the next
ones the first tokens. Runs of digits are wildcard slots, and so is a level of a node that has too many children. All
lines of a leaf are one template, whose other tokens are slots where the lines differ. A tree is known by its nodes' sets of children and its
leaves' first and last tokens at each place, so partitions grow parts of it that merge as plain grouped aggregates. Templates
that cover too few pages are dropped. Of the lines under those that remain, the ones repeated word for word on enough pages are
``repeated_lines``; all of them are ``templated_lines``.

A line's tokens are read from its letters and digits alone (its key), so lines that are the same by the
key always stand under the same template, and the template's pages include all of theirs.

Defined results: pages without a url or text, and urls without a host, give no rows; a page repeated or
crawled again is one page; a line repeated within a page counts once but every occurrence is reported; lines are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.session import stage

SLOT = "*"
URL = r"^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/:?#\s]+)(?::\d*)?([^?#\s]*)"


def site_of(url: Column) -> Column:
    """A url's host without case, port and a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), URL, 1), r"^www\.|\.$", "")


def page_of(url: Column) -> Column:
    """A url's path without case and trailing slashes."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), URL, 2), "/+$", "")


def line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[^\p{L}\p{N}]+", ""))


def lines_of(pages: DataFrame, id_col: str = "page_id", url: str = "url", text: str = "raw_markdown") -> DataFrame:
    """(page_id, line_no, site, page, key) of every line with a letter or digit."""
    src = pages.filter(F.col(id_col).isNotNull() & F.col(url).isNotNull() & F.col(text).isNotNull())
    src = src.select(F.col(id_col).alias("page_id"), site_of(F.col(url)).alias("site"), page_of(F.col(url)).alias("page"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    out = src.select("page_id", (F.col("pos") + 1).cast("int").alias("line_no"), "site", "page", line_key(F.col("line")).alias("key"))
    return out.filter("key != '' and site != ''")


LINE = ["site", "k1", "k2"]


def tokens_of(key: Column, piece: int = 6) -> Column:
    """A key's tokens: runs of digits as slots, runs of letters in pieces."""
    return F.transform(F.regexp_extract_all(key, F.lit(rf"\p{{N}}+|\p{{L}}{{1,{piece}}}"), F.lit(0)), lambda t: F.when(t.rlike(r"^\p{N}"), F.lit(SLOT)).otherwise(t))


def leaves(keys: DataFrame, depth: int = 3, children: int = 32) -> DataFrame:
    """(site, k1, k2, leaf) for different lines (site, k1, k2, key): each line's leaf as the text of its path.

    A level of a node with more than ``children`` different tokens is one slot there.
    """
    toks = tokens_of(F.col("key"))
    out = keys.select(*LINE, toks.alias("t")).select(*LINE, F.size("t").cast("string").alias("leaf"), *[F.coalesce(F.get("t", F.lit(i)), F.lit("")).alias(f"t{i}") for i in range(depth)])
    for i in range(depth):
        wide = out.select("site", "leaf", f"t{i}").distinct().groupBy("site", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > children).select("site", "leaf", F.lit(SLOT).alias("slot"))
        out = out.join(wide, ["site", "leaf"], "left").withColumn("leaf", F.concat_ws(" ", "leaf", F.coalesce("slot", f"t{i}"))).drop("slot", f"t{i}")
    return out


def template_texts(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """(site, leaf, template): the tokens all lines of a leaf share, slots elsewhere."""
    at = placed.join(keys, LINE).select("site", "leaf", F.posexplode(tokens_of(F.col("key"))).alias("pos", "tok"))
    each = at.groupBy("site", "leaf", "pos").agg(F.min("tok").alias("a"), F.max("tok").alias("z")).select("site", "leaf", "pos", F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(F.lit(SLOT)).alias("tok"))
    whole = each.groupBy("site", "leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("x"))  # as many as a line has tokens
    return whole.select("site", "leaf", F.array_join(F.transform("x", lambda x: x["tok"]), " ").alias("template"))


def _placed(pages: DataFrame, least_pages: int, id_col: str, url: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(occurrences, different lines, lines of a page, lines under templates on at least ``least_pages`` pages)."""
    # pages are read and cut once; two 64-bit hashes stand for a line and one for a page, so texts cross no network again
    lines = lines_of(pages, id_col, url, text)
    hashed = stage(lines.select("page_id", "line_no", "site", F.xxhash64("page").alias("pg"), F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(7)).alias("k2"), "key"), "lines")
    # one row for a line of a page; a hot site is spread by its lines
    per_page = stage(hashed.select(*LINE, "pg").distinct(), "pages")
    keys = stage(hashed.groupBy(*LINE).agg(F.first("key").alias("key")), "keys")
    placed = stage(leaves(keys), "placed")
    covered = per_page.join(placed, LINE).select("site", "leaf", "pg").distinct().groupBy("site", "leaf").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    return hashed, keys, per_page, placed.join(covered.select("site", "leaf"), ["site", "leaf"], "left_semi")


def repeated_lines(pages: DataFrame, least_pages: int = 8, id_col: str = "page_id", url: str = "url", text: str = "raw_markdown") -> DataFrame:
    """(page_id, line_no) of every occurrence of a line that stands on at least ``least_pages`` pages of its site."""
    hashed, _, per_page, kept = _placed(pages, least_pages, id_col, url, text)
    exact = per_page.join(kept.select(*LINE), LINE, "left_semi").groupBy(*LINE).agg(F.count("pg").alias("pages")).filter(F.col("pages") >= least_pages).select(*LINE)
    return hashed.select("page_id", "line_no", *LINE).join(exact, LINE, "left_semi").select("page_id", "line_no").distinct()


def templated_lines(pages: DataFrame, least_pages: int = 8, id_col: str = "page_id", url: str = "url", text: str = "raw_markdown") -> DataFrame:
    """(page_id, line_no, template) of every line whose template covers at least ``least_pages`` pages of its site, slots and all."""
    hashed, keys, _, kept = _placed(pages, least_pages, id_col, url, text)
    kept = stage(kept, "kept")
    at = kept.join(template_texts(keys, kept), ["site", "leaf"]).select(*LINE, "template")
    return hashed.select("page_id", "line_no", *LINE).join(at, LINE).select("page_id", "line_no", "template").distinct()


def without_lines(pages: DataFrame, hits: DataFrame, id_col: str = "page_id", text: str = "raw_markdown") -> DataFrame:
    """(page_id, kept_text): each page's text without the lines in ``hits`` (page_id, line_no); a null text stays null."""
    # as many as a page has lines; a map finds each at once
    gone = hits.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("line_no", F.lit(True)))).alias("gone"))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(text).alias("text")).distinct().join(gone, "page_id", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: F.element_at("gone", (i + 1).cast("int")).isNull())
    return src.select("page_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))

"""The main body of web pages kept as markdown, apart from the furniture of their sites.

Each line goes through the standard library's streaming HTML parser (markdown marks become tags), whose
events give its ratio of text to tags, its share of link text, and whether it is a heading, a table row or a file. A side
column's head, an open sentence or a listing's date change what the ratio counts for. The ratios are smoothed along the page
with a Gaussian, and a threshold between their two clusters selects the regions of content: it decides every line. An exact
check then takes out of those regions the lines that common words of furniture name (notices about cookies, share prompts,
bylines, counters); such a line inside a text doesn't part it in two.

Defined results: a null or empty text gives no lines; lines without a letter or digit are never content;
a page repeated gives its lines once; texts and lines of any length are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of site furniture in Bulgarian and English.
COOKIES = r"(?:използва|разреш|приема|съгласявате).{0,60}бисквитк|бисквитк.{0,80}(?:политик|услов|поверителност|декларация)|(?:uses?|allow|accept).{0,30} cookies|cookie (?:policy|notice|settings)|на вашето устройство|data on your device|^вашата поверителност|^your privacy"
BUTTONS = r"приемам(?: всички)?|отказвам|разбрах|настройки|само необходимите|съгласен съм|accept(?: all)?|reject(?: all)?|decline|got it|settings|only necessary|i agree|ok"
NAVIGATION = (
    r"☰.*|меню|menu|към съдържанието|прескочи навигацията|skip to content|skip navigation|търсене|търси|search|вход|log ?in|регистрация|register|нагоре|back to top|последвайте ни|follow us|"
    r"достъпност|accessibility|начало|home|за нас|about us|новини|news|галерия|gallery|документи|documents|екип|our team|team|прием|admissions?|проекти|projects|такси|fees|седмично меню|weekly menu|"
    r"кариери|careers|профил на купувача|buyer profile|контакти|contacts?|карта на сайта|site ?map|политика за поверителност|privacy policy|общи условия|terms(?: of use)?|български|english|deutsch|bg|en|de|ru"
)
ASIDE_HEADS = r"вижте още|виж още|последни новини|предстоящи събития|най-четени|категории|архив|полезни връзки|see also|latest news|coming up|upcoming events|most read|categories|archive|useful links|related"
LANGUAGES = r"(?:bg|en|de|ru|fr|tr|mk|es)(?:[\s|/]+(?:bg|en|de|ru|fr|tr|mk|es))+"
INSERTED = [
    r"^(?:публикувано|добавено) от |^автор:|^текст и снимки:|^материалът е подготвен от|^posted by |^by the (?:editors|team) of|^words and pictures:|^written by ",
    r"^прочетено \d+ пъти|^видяно \d+ пъти|^read \d+ times|^\d+ (?:views|преглеждания)",
    r"^сподели(?:\s*:|\s*$)|^сподели с (?:приятели|други)|^споделете тази страница|^изпратете на приятел|^хареса ли ви|^share(?: this page|\s*:|\s*$| with friends)|^send to a friend|^tell other parents|^did you like|^like this page",
    r"^абонирайте се|^запишете се за .*бюлетин|^въведете имейл|^sign up for|^enter your e-?mail|^subscribe",
]
FURNITURE = [
    r"©|всички права запазени|all rights reserved",
    r"осведомителен характер|не представлява оферта|for information only|no offer by|без предизвестие; валидни|may change without notice|е разрешено само с посочване|may be used only with its source",
    r"^изработка:|^хостинг|^сайтът е създаден|^made by |^hosting:|^website by|^site (?:made|built) ",
    r"^работно време:|^office hours:",
    r"^политика за поверителност|^privacy policy",
]
# Fixed value: how a listing breaks an entry off or dates it.
LISTED = r"\[(?:прочет\w*|виж\w*|read|see|continue)\b[^\]]*\]|(?:…|\.\.\.)\s*(?:\([^)]*\)|,[^,.…]*)?\W*$|\(\d{1,2}[./]\d{1,2}[./]\d{4}\)\W*$"
_BUTTON = re.compile(rf"(?:(?:{BUTTONS})[\s|/,]*)+")
_NAV = re.compile(rf"(?:{NAVIGATION})")
_ASIDE = re.compile(rf"(?:{ASIDE_HEADS})")
_COOKIES, _FURN, _INSERT, _LISTED, _LANGS = (re.compile(p, re.I) for p in (COOKIES, "|".join(FURNITURE), "|".join(INSERTED), LISTED, LANGUAGES))
_FILE = re.compile(r"\.(?:pdf|docx?|xlsx?|odt|ods|pptx?|zip|rtf)(?:[?#]|$)", re.I)
_LINK = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_CONTACT = re.compile(r"^[\d\s+/()-]{6,}\|\s*\S+@\S+$|^\S+@\S+\s*\|\s*[\d\s+/()-]{6,}$")
_FIELD = re.compile(r"^[^:|.!?]{2,30}:\s.*\d|\|.*\d|\d.*\|")
_ITEM = re.compile(r"\s*[*•-]\s")
_MARK = re.compile(r"^[\s>*•·_#-]+|[\s*_»…↑▲]+$|\s+\.$")
_HAS = re.compile(r"[^\W_]")


class Events(HTMLParser):
    """Counts what the parser reports of one line: letters of text, of link text, of file links, and tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.clear()

    def clear(self):
        self.text = self.linked = self.files = self.tags = 0
        self.depth, self.to_file = 0, False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.depth += 1
            self.to_file = bool(_FILE.search(dict(attrs).get("href") or ""))

    def handle_endtag(self, tag):
        if tag == "a":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        n = len(data.strip())
        if self.depth and self.to_file:
            self.files += n
        elif self.depth:
            self.linked += n
        else:
            self.text += n


def _markup(line: str) -> str:
    """A markdown line with its links, images, cells and bold marks as tags; other text escaped."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out, at = [], 0
    for m in _LINK.finditer(line):
        out.append(esc(line[at : m.start()]))
        out.append(f'<img alt="{esc(m[2])}">' if m[1] else f'<a href="{esc(m[3])}">{esc(m[2])}</a>')
        at = m.end()
    out.append(esc(line[at:]))
    # the mark of a list's entry is no tag of its text
    return re.sub(r"\s\|\s", "<td>", re.sub(r"\*\*", "<b>", "".join(out)))


class Line(NamedTuple):
    """What one line tells by itself."""

    ratio: float  # text to tags
    cue: str  # what furniture its words name: FURNITURE_LINE, INSERT, SIDE, LISTING, or none
    head: bool
    data: bool  # a table row, a field with a figure, or a file
    sentence: bool


FURNITURE_LINE, INSERT, SIDE, LISTING = "furniture", "insert", "side", "listing"


def _bare(line: str) -> str:
    """The line's words, lower case, without marks around them."""
    s = _LINK.sub(lambda m: m[2], line)
    while (t := _MARK.sub("", s)) != s:
        s = t
    return s.strip().lower()


@lru_cache(maxsize=50_000)
def line_events(line: str) -> Line:
    """The events of a line with a letter or digit."""
    p = Events()
    p.feed(_markup(line))
    p.close()
    bare, shown = _bare(line), line.rstrip(" *_")
    row = line.strip().startswith("|") and "|" in bare
    parts = [x.strip() for x in re.split(r"\s*[|/>›»]\s*", bare.strip("|")) if x.strip()]
    ratio, cue = (p.text + p.files) / (1 + p.tags), ""
    if "![" in line and not _HAS.search(_LINK.sub("", line)):
        cue = FURNITURE_LINE  # an image alone
    elif _COOKIES.search(bare) and len(bare) > 30 or _BUTTON.fullmatch(bare) or _FURN.search(bare) or _CONTACT.search(bare) or _LANGS.fullmatch(bare) or _NAV.fullmatch(bare):
        cue = FURNITURE_LINE
    elif _INSERT.search(bare):
        cue = INSERT
    elif _ASIDE.fullmatch(bare):
        cue = SIDE
    elif _LISTED.search(shown):
        cue = LISTING
    elif not row and len(parts) >= 2 and all(len(x) < 40 for x in parts) and (_NAV.fullmatch(parts[0]) or _LANGS.fullmatch(parts[0]) or _NAV.match(parts[0]) and len(parts) > 2):
        cue = FURNITURE_LINE  # a menu in one line, a choice of languages, crumbs
    elif not p.files and p.linked > 2 * p.text and not row:
        cue = FURNITURE_LINE  # links with little beside them
    data = row or bool(p.files or _FIELD.search(bare))
    return Line(ratio, cue, bool(re.match(r"\s*#{1,6}\s", line)), data, ratio > 90 or ratio > 45 and shown.endswith((".", "!", "?")))


def threshold(x: np.ndarray, cut: float) -> float:
    """Between the centres of the two clusters of the values (2-means from both ends), at the share ``cut`` of the way."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(30):
        t = (lo + hi) / 2
        a, b = x[x <= t], x[x > t]
        if not len(a) or not len(b):
            break
        new = (float(a.mean()), float(b.mean()))
        if new == (lo, hi):
            break
        lo, hi = new
    return lo + cut * (hi - lo)


def densities(lines: list[str], found: list[Line], cap: float = 150.0, marked: float = 80.0) -> np.ndarray:
    """What each line counts for before smoothing: its ratio up to ``cap``; headings and data at least ``marked``; furniture and side columns nothing.

    A side column lasts from its head to a line that only a text has: a sentence, data, or a heading with no furniture right below.
    """
    solid = [not x.cue and (x.data or x.sentence) for x in found]
    out, side = np.zeros(len(found)), False
    for j, x in enumerate(found):
        below = next((y.cue for y in found[j + 1 :] if y.cue != INSERT), FURNITURE_LINE)
        heads = not x.cue and x.head and below not in (FURNITURE_LINE, SIDE)
        if x.cue == SIDE:
            side = True
        elif heads or solid[j]:
            side = False
        before_text = not x.cue and j + 1 < len(found) and solid[j + 1] and not _ITEM.match(lines[j])
        if x.cue or side and not before_text:
            continue
        out[j] = max(min(x.ratio, cap), marked if heads or x.data else 0.0)
    return out


def main_lines(text: str, sigma: float = 1.0, cut: float = 0.4) -> list[int]:
    """Numbers of the lines of a page's main body."""
    lines = text.split("\n")
    numbers = [i for i, line in enumerate(lines, 1) if _HAS.search(line)]
    if not numbers:
        return []
    lines = [lines[i - 1] for i in numbers]
    found = [line_events(line) for line in lines]
    # a byline or counter inside a text takes no part in the curve
    at = [j for j, x in enumerate(found) if x.cue != INSERT]
    if not at:
        return []
    r = densities(lines, found)[at]
    w = int(3 * sigma) + 1
    g = np.exp(-0.5 * (np.arange(-w, w + 1) / sigma) ** 2)
    curve = np.convolve(np.pad(r, w), g, mode="valid") / np.convolve(np.pad(np.ones(len(r)), w), g, mode="valid")
    # a page of one region has no second cluster: then what counts at all is content
    keep = curve > (threshold(curve, cut) if curve.max() > 2 * curve.min() else 0.0)
    return [numbers[j] for j, k in zip(at, keep) if k and not found[j].cue]


def main_body(pages: DataFrame, id_col: str = "page_id", text: str = "raw_markdown") -> DataFrame:
    """(page_id, line_no) for each line of each page's main body."""

    def parse(batches):
        for pdf in batches:
            rows = [(p, n) for p, t in zip(pdf["page_id"], pdf["text"]) for n in main_lines(t)]
            yield pd.DataFrame(rows, columns=["page_id", "line_no"]).astype({"page_id": "int64", "line_no": "int32"})

    src = pages.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(text).alias("text"))
    # pages are parsed where they are read; a page that repeats gives its lines again, and these are made one
    return src.mapInPandas(parse, "page_id long, line_no int").distinct()

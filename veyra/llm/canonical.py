"""Values typed freely, mapped to the entries of a reference list.

An automaton over the tokens of all names and aliases finds those that a value holds; the longest
mention wins. What holds none goes to token-set similarity, which forgives typing errors, another order of words and words
besides; an index of the tokens' deletion neighbourhoods meets only names that share a token. Each different value is looked at once.

Defined results: null and blank values (no letter or digit counts as blank only where nothing but white
space is there) give no row; a value that names entries of equal weight goes to the smaller code; rows
that repeat with the same value give one row; an empty list makes everything ``unmatched``; values are read whole.
"""

from __future__ import annotations

import json
import math
import os

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.llm.text import allowed, deletions, edits, latin, skeleton, tokens
from veyra.session import parallelism

# Words around a name that don't alter it, such as whose price it is.
BESIDES = {"цена", "цени", "ценоразпис", "такса", "такси", "за", "дете", "деца", "клас", "кл", "група", "гр", "а", "б", "в", "г", "год", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "price", "fee", "fees", "per", "for", "child", "class", "grade", "group"}


class Lexicon:
    """Names of one field: an automaton for exact mentions, and an index of tokens for the rest."""

    def __init__(self, names: list[tuple[str, str]]):
        self.forms: dict[tuple[str, ...], str] = {}
        for name, code in sorted(names, key=lambda x: (x[1], x[0])):
            t = tuple(tokens(name))
            for form in (t, tuple(latin(x) for x in t)):
                if form:
                    self.forms.setdefault(form, code)
        self.auto = ahocorasick.Automaton()
        self.holders: dict[str, list[tuple[str, ...]]] = {}  # token -> names that hold it
        self.index: dict[str, set[str]] = {}  # deletion key -> tokens
        for form in self.forms:
            self.auto.add_word(f" {' '.join(form)} ", form)
            for w in set(form):
                self.holders.setdefault(w, []).append(form)
        for w in self.holders:
            for key in deletions(w, allowed(len(w))) | deletions(skeleton(w), allowed(len(w))):
                self.index.setdefault(key, set()).add(w)
        self.longest = max(map(len, self.holders), default=0)
        self.held: dict[str, dict[str, int]] = {}
        if self.forms:
            self.auto.make_automaton()

    def mention(self, toks: list[str]) -> tuple[str, int] | None:
        """(code, length) of the longest mention, which no other one can overlap and win; of equal ones the smaller code."""
        if not self.forms:
            return None
        found = [(-len(form) - sum(map(len, form)), self.forms[form]) for _, form in self.auto.iter(f" {' '.join(toks)} ")]
        return (min(found)[1], -min(found)[0]) if found else None

    def near(self, v: str) -> dict[str, int]:
        """Tokens of names that the token can be, with the edits between them, as typed or by skeleton."""
        got = self.held.get(v)
        if got is None:
            if len(self.held) > 200_000:
                self.held.clear()
            got = {}
            if len(v) <= self.longest + 2:
                most = 2 if len(v) >= 7 else 1 if len(v) >= 3 else 0
                keys = deletions(v, most) | deletions(skeleton(v), most)
                for w in {w for k in keys for w in self.index.get(k, ())}:
                    n = allowed(len(w))
                    d = min(edits(w, v, n), edits(skeleton(w), skeleton(v), n))
                    if d <= n:
                        got[w] = d
            self.held[v] = got
        return got

    def similar(self, toks: list[str], least: float = 0.7) -> tuple[str, float, tuple[int, int]] | None:
        """(code, similarity, rank) of the name whose every token the value holds, give or take edits.

        Similarity is the share of the name's letters in those of both; words that only go beside a name don't count. Most letters
        win, then fewest edits, then the smaller code.
        """
        near = {v: self.near(v) for v in set(toks)}
        best = None
        for form in {f for got in near.values() for w in got for f in self.holders[w]}:
            left, wrong = list(toks), 0
            for w in form:
                d, v = min(((near[v][w], v) for v in left if w in near[v]), default=(None, ""))
                if d is None:
                    break
                wrong += d
                left.remove(v)
            else:
                n = sum(map(len, form))
                share = n / max(1, n + sum(len(v) for v in left if v not in BESIDES and not v.isdigit()))
                key = (2 * wrong - n, wrong, self.forms[form])
                if share >= least and (best is None or key < best[0]):
                    best = (key, share)
        return (best[0][2], best[1], (-best[0][0], -best[0][1])) if best else None

    def match(self, value: str) -> tuple[str, float, int, int, int]:
        """(code or ``unmatched``, similarity, rank): mentions before similar names, then as these rank."""
        toks = tokens(value)
        found = self.mention(toks)
        if found:
            return found[0], 1.0, 2, found[1], 0
        hit = self.similar(toks)
        return (hit[0], hit[1], 1, *hit[2]) if hit else ("unmatched", 0.0, 0, 0, 0)


def map_to_list(values: DataFrame, entries: DataFrame, code: str = "entry_code", field: str = "field", names: tuple[str, ...] = ("name_en", "name_bg"), lists: tuple[str, ...] = ("other_names",), aliases: dict[str, list[str]] | None = None, most_entries: int = 50_000) -> DataFrame:
    """(table_name, row_id, field, entry_code) for each value that isn't null or blank.

    ``values`` has (table_name, row_id, field, value). The list is read by the driver in parts of at most ``most_entries`` entries;
    with several parts each value takes the best of all parts by the ranking that holds within one.
    """
    ref = entries.filter(F.col(code).isNotNull() & F.col(field).isNotNull()).select(code, field, *names, *lists)
    parts = max(1, math.ceil(ref.count() / most_entries))
    vals = values.filter(F.col("value").isNotNull() & F.col("row_id").isNotNull() & F.col("value").rlike(r"[^\s\x{a0}]"))
    different = vals.select("field", "value").distinct().repartition(parallelism(values.sparkSession))
    picked = None
    for k in range(parts):
        part = ref if parts == 1 else ref.filter(F.pmod(F.xxhash64(code), F.lit(parts)) == k)
        by: dict[str, list[tuple[str, str]]] = {}
        for r in part.collect():
            own = [r[n] for n in names] + [x for c in lists for x in (r[c] or [])]
            own += [a for n in names for a in (aliases or {}).get(r[n], [])]
            by.setdefault(r[field], []).extend((x, r[code]) for x in own if x)
        lexicons: dict[str, Lexicon] = {}

        def look(batches, by=by, lexicons=lexicons):
            for pdf in batches:
                out = []
                for f, v in zip(pdf["field"], pdf["value"]):
                    if f not in lexicons:
                        lexicons[f] = Lexicon(by.get(f, []))
                    out.append((f, v, *lexicons[f].match(v)))
                yield pd.DataFrame(out, columns=["field", "value", "entry_code", "score", "how", "size", "wrong"])

        one = different.mapInPandas(look, "field string, value string, entry_code string, score double, how long, size long, wrong long")
        picked = one if picked is None else picked.unionByName(one)
    if parts > 1:
        picked = picked.groupBy("field", "value").agg(F.min_by("entry_code", F.struct(-F.col("how"), -F.col("size"), -F.col("wrong"), "entry_code")).alias("entry_code"))
    return vals.join(picked.select("field", "value", "entry_code"), ["field", "value"]).select("table_name", "row_id", "field", "entry_code").distinct()


def known_aliases(path: str = os.path.join(os.path.dirname(__file__), "fee_aliases.json")) -> dict[str, list[str]]:
    """A reference table of further names by an entry's own name."""
    with open(path, encoding="utf-8") as f:
        return {r["name"]: r["also"] for r in json.load(f)}


def fee_values(missed: DataFrame, lines: DataFrame) -> DataFrame:
    """The freely typed values of both fee tables as (table_name, row_id, field, value)."""
    a = missed.select(F.lit("missed_fees").alias("table_name"), F.col("fee_id").cast("long").alias("row_id"), F.expr("stack(2, 'category', category, 'period', period) as (field, value)"))
    b = lines.select(F.lit("fee_lines").alias("table_name"), F.col("line_id").cast("long").alias("row_id"), F.lit("label").alias("field"), F.col("label").alias("value"))
    return a.unionByName(b)

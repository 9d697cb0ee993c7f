"""Address records that denote one place.

An address is parsed into parts: locality, street or estate tokens, number, letter. Records meet in an index of the
deletion neighbourhoods of their street tokens, inside blocks of one locality (a postcode's locality
counts too, so neighbouring names of a town meet), one kind and one number: number and unit are hard vetoes. Candidate
forms are compared by the best assignment of tokens to tokens; every token must find its partner.

Defined results: null and useless addresses, and those without a number or a name, take no part; an id with several
addresses matches by any of them; repeated rows count once; the pair of an id with itself is none; an id that
occurs in both tables is one record; very long texts are read whole; the input's other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.llm.text import CYR, allowed, deletions, edits, latin, skeleton, unmix
from veyra.session import parallelism, stage

# Words of addresses in Bulgarian and their usual Latin spellings, in Latin letters.
STREET_WORDS = {"ul": "ul", "ulitsa": "ul", "st": "ul", "str": "ul", "street": "ul", "bul": "bul", "bst": "bul", "bulevard": "bul", "bd": "bul", "blvd": "bul", "boulevard": "bul", "pl": "pl", "ploshtad": "pl", "square": "pl", "sq": "pl"}
ESTATE_WORDS = {"zhk", "jk", "kv", "kvartal", "ks", "kompleks", "zhilishten"}
TOWN_WORDS = {"gr", "grad", "s", "selo", "town", "village"}
NUMBER_WORDS = {"no", "n", "nom", "nomer", "num", "№"}
BLOCK_WORDS = {"bl", "blok", "block"}
UNIT_WORDS = {"vh", "vhod", "et", "etazh", "ap", "apartament", "entrance", "floor", "apt"}
ASIDE_WORDS = {"do", "sreshtu", "zad", "pri", "parter", "vhod"}
LONE = str.maketrans("abcehkmoptxy", "авсенкмортху")
_SPLIT = re.compile(r"[,;()\[\]/]")
_TOKEN = re.compile(r"№|\d+|[^\W\d_]+\.?")


def _parts(address: str) -> list[list[str]]:
    """Tokens of each part between commas and brackets; a token keeps the dot that marks it as short."""
    s = address.lower()
    latin_text = not CYR.search(s)
    s = re.sub(r"б\s*-\s*д|b\s*-\s*d\b", "bd ", s)
    s = re.sub(r"\bк\s*-\s*с\b|\bk\s*-\s*s\b", "ks ", s)
    s = re.sub(r"\bж\s*\.?\s*к\b\.?|\bzh\s*\.?\s*k\b\.?", "zhk ", s)
    s = re.sub(r"\bп\s*\.?\s*к\s*\.?\s*(?=\d)|\bp\s*\.?\s*k\s*\.?\s*(?=\d)", " ", s)
    out = []
    for part in _SPLIT.split(s):
        toks = [unmix(t) for t in _TOKEN.findall(part)]
        if not latin_text:
            # a lone Latin letter in a Cyrillic address is the Cyrillic letter it looks like
            toks = [t.translate(LONE) if len(t.rstrip(".")) == 1 else t for t in toks]
        if toks:
            out.append(toks)
    return out


@lru_cache(maxsize=100_000)
def _is_town(token: str, town: str) -> bool:
    return bool(town) and edits(skeleton(token), town, 2 if len(town) > 6 else 1) <= (2 if len(town) > 6 else 1)


def parse(address: str | None, city: str | None) -> tuple[str, str, str, str, str, str] | None:
    """(locality, postcode, kind, type, number with letter, street tokens) or None without a numbered place."""
    if not address:
        return None
    town = skeleton("".join(re.findall(r"[^\W\d_]+", unmix((city or "").lower()))))
    postcode, kind, number, letter, style, said_town = "", "", "", "", "", ""
    names: list[str] = []
    for toks in _parts(address):
        i, own = 0, []
        while i < len(toks):
            t = toks[i]
            bare = latin(t.rstrip("."))
            nxt = toks[i + 1] if i + 1 < len(toks) else ""
            if bare in ASIDE_WORDS and not own and not (bare in UNIT_WORDS and nxt.isdigit()):
                break  # "by the park", "ground floor": the rest of the part tells nothing
            if bare in UNIT_WORDS and (nxt.isdigit() or len(nxt.rstrip(".")) == 1):
                i += 2
                continue
            if t.isdigit() and len(t) == 4 and not number_mark(toks, i):
                postcode = postcode or t
            elif t.isdigit():
                if not number:
                    number = str(int(t))
                    if i and latin(toks[i - 1].rstrip(".")) in BLOCK_WORDS:
                        kind = "estate"
                    if len(nxt.rstrip(".")) == 1 and nxt != "№" and not nxt.isdigit():
                        letter = latin(nxt.rstrip("."))
                        i += 1
            elif bare in NUMBER_WORDS or bare in BLOCK_WORDS:
                pass
            elif bare in STREET_WORDS and not own:
                style = STREET_WORDS[bare]
            elif bare in ESTATE_WORDS and not own:
                kind = "estate"
            elif bare in TOWN_WORDS and not own and nxt and not nxt.isdigit():
                said_town = latin(nxt.rstrip("."))
                i += 1
            elif _is_town(t.rstrip("."), town) and (len(toks) <= 2 or not own):
                said_town = bare
            elif len(bare) > 1:
                own.append(skeleton(t.rstrip(".")) + ("." if t.endswith(".") and i + 1 < len(toks) else ""))
            i += 1
        if own and not names:
            names = own
    if not number or not names:
        return None
    return town or skeleton(said_town), postcode, kind or "street", style, number + letter, " ".join(names)


def number_mark(toks: list[str], i: int) -> bool:
    return i > 0 and latin(toks[i - 1].rstrip(".")) in NUMBER_WORDS | BLOCK_WORDS


def parsed(records: DataFrame) -> DataFrame:
    """(id, loc, kind, style, num, name) of records (id, address, city) with a numbered place, each once.

    The locality is the row's town, else the town in the address, else that of its postcode; where the postcode
    is another town's, the record stands in both.
    """

    def read(batches):
        for pdf in batches:
            rows = [(i, *p) for i, a, c in zip(pdf["id"], pdf["address"], pdf["city"]) if (p := parse(a, c))]
            yield pd.DataFrame(rows, columns=["id", "loc", "postcode", "kind", "style", "num", "name"])

    src = records.filter("id is not null and address is not null").select("id", "address", "city").distinct()
    out = stage(src.mapInPandas(read, "id long, loc string, postcode string, kind string, style string, num string, name string").distinct(), "addresses")
    home = out.filter("postcode != '' and loc != ''").groupBy("postcode", "loc").count().groupBy("postcode").agg(F.max_by("loc", F.struct("count", "loc")).alias("home"))
    out = out.join(home, "postcode", "left")
    places = F.array_distinct(F.filter(F.array(F.col("loc"), F.coalesce("home", F.lit(""))), lambda x: x != ""))
    return out.select("id", F.explode(places).alias("loc"), "kind", "style", "num", "name").distinct()


def same_token(a: str, b: str) -> bool:
    """Whether two street tokens can be one word: equal, short for the other, or a few edits apart."""
    if a.endswith(".") or b.endswith("."):
        x, y = sorted((skeleton(a.rstrip(".")), skeleton(b.rstrip("."))), key=len)
        return len(x) >= 2 and edits(y[: len(x)], x, 1 if len(x) > 3 else 0) <= (1 if len(x) > 3 else 0)
    x, y = skeleton(a), skeleton(b)
    n = within(x, y)
    return edits(x, y, n) <= n


def within(x: str, y: str) -> int:
    """Edits between two words that may both hold a slip."""
    n = max(len(x), len(y))
    return 2 if n >= 6 else allowed(n)


def cheapest(costs: list[list[int | None]]) -> list[int] | None:
    """For each row of a square table its column in the cheapest one-to-one choice, by shortest augmenting paths; None is forbidden."""
    n, never = len(costs), 1 << 30
    up, down, owner = [0] * n, [0] * (n + 1), [-1] * (n + 1)  # column n stands for the row being placed
    for row in range(n):
        owner[n], at = row, n
        best, back, seen = [never] * n, [n] * n, [False] * (n + 1)
        while owner[at] >= 0:
            seen[at], r = True, owner[at]
            for c in range(n):
                if not seen[c] and costs[r][c] is not None and (d := costs[r][c] - up[r] - down[c]) < best[c]:
                    best[c], back[c] = d, at
            to = min((c for c in range(n) if not seen[c]), key=lambda c: best[c], default=n)
            if to == n or best[to] >= never:
                return None
            step = best[to]
            for c in range(n + 1):
                if seen[c]:
                    up[owner[c]] += step
                    down[c] -= step
                elif c < n and best[c] < never:
                    best[c] -= step
            at = to
        while at != n:
            owner[at], at = owner[back[at]], back[at]
        owner[n] = -1
    out = [0] * n
    for c in range(n):
        out[owner[c]] = c
    return out


def assign(a: list[str], b: list[str]) -> list[tuple[str, str]] | None:
    """The assignment of all tokens of a to all of b with the fewest edits, whatever their number; None where a token has no partner."""
    if a == b:
        return list(zip(a, b))
    if len(a) != len(b):
        joined = ("".join(a), "".join(b))  # words written together
        return [joined] if abs(len(a) - len(b)) == 1 and skeleton(joined[0]) == skeleton(joined[1]) else None
    costs = [[token_cost(x, y) for y in b] for x in a]
    if any(all(c is None for c in row) for row in costs):
        return None
    chosen = cheapest(costs)
    return chosen and [(x, b[c]) for x, c in zip(a, chosen)]


@lru_cache(maxsize=200_000)
def token_cost(a: str, b: str) -> int | None:
    """Edits between two street tokens that can be one word, else None."""
    return edits(skeleton(a.rstrip(".")), skeleton(b.rstrip(".")), 9) if same_token(a, b) else None


WORD, BEGINS, SHORT = 0, 1, 2


@lru_cache(maxsize=100_000)
def _token_keys(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed index entries of one street token and their roles: its deletion neighbourhood, and its beginning, by which only
    tokens cut short meet others."""
    w = skeleton(token.rstrip("."))
    own = [(w[:3], SHORT)] if token.endswith(".") else [*((k, WORD) for k in sorted(deletions(w, allowed(len(w))))), (w[:3], BEGINS)]
    return _hashed([k for k, _ in own]), np.array([r for _, r in own], dtype=np.int32)


def _hashed(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64).view(np.int64)


def _keys(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(entries, roles) of a street's tokens and of all of them written together, each once."""
    parts = [_token_keys(t) for t in set(name.split())]
    whole = _hashed(["=" + skeleton(name.replace(" ", "").replace(".", ""))])
    return np.concatenate([whole, *(k for k, _ in parts)]), np.concatenate([np.array([WORD], dtype=np.int32), *(r for _, r in parts)])


def origins(words: DataFrame, rare_share: float, evidence: float) -> DataFrame:
    """(w, n, of) for words (w, n), each once: the words that w can be a slip of, null where there are none.

    A word can be a slip of another within the edits allowed for its length that is written more, unless the counts tell that
    its share is above ``rare_share``: by a log-likelihood ratio above ``evidence``, so that few occurrences tell little and
    many leave the share alone to decide. The nearest words that are no slips themselves count, else the nearest ones.
    """

    def index(batches):
        for pdf in batches:
            ks = [sorted(deletions(w, allowed(len(w)))) for w in pdf["w"]]
            out = pdf.loc[pdf.index.repeat([len(k) for k in ks])].reset_index(drop=True)
            out["entry"] = [x for k in ks for x in k]
            yield out

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        most = [allowed(max(len(a), len(b))) for a, b in zip(x, y)]
        return pd.Series([d if (d := edits(a, b, m)) <= m else None for a, b, m in zip(x, y, most)], dtype="Int32")

    p = rare_share / (1 + rare_share)
    n = F.col("n") + F.col("zn")
    against = F.col("n") * F.log(F.col("n") / n / p) + F.col("zn") * F.log(F.col("zn") / n / (1 - p))
    entries = words.filter("not endswith(w, '.')").mapInPandas(index, "w string, n long, entry string")
    near = entries.join(entries.select("entry", F.col("w").alias("z"), F.col("n").alias("zn")).hint("merge"), "entry")
    near = near.filter(F.struct("zn", "z") > F.struct("n", "w")).filter((F.col("n") <= rare_share * F.col("zn")) | (against <= evidence)).select("w", "z").distinct()
    near = stage(near.withColumn("d", apart("w", "z")).filter("d is not null"), "slips")
    rank = F.struct(F.col("slip").isNotNull().alias("slip"), "d")
    near = near.join(near.select(F.col("w").alias("z"), F.lit(1).alias("slip")).distinct(), "z", "left").select("w", "z", rank.alias("rank"))
    of = near.groupBy("w").agg(F.collect_list(F.struct("rank", "z")).alias("all"), F.min("rank").alias("first"))
    return words.join(of.select("w", F.expr("transform(filter(all, x -> x.rank = first), x -> x.z)").alias("of")), "w", "left")


def two_names(slips: DataFrame, words: DataFrame, rare_share: float, evidence: float) -> DataFrame:
    """The rows of ``slips`` whose words x and y are two names: neither is a slip of the other, nor both of a third one.

    A word that can be a slip of none and is too rare to be told a name may be one of a word not seen; it is no other name
    than such a word or a slip.
    """
    known = origins(words, rare_share, evidence)
    unseen = F.col("of").isNull() & (F.col("n") * F.log(F.lit((1 + rare_share) / rare_share)) <= evidence)
    known = stage(known.select("w", F.array_union(F.array("w"), F.coalesce("of", F.array().cast("array<string>"))).alias("of"), unseen.alias("unseen"), F.col("of").isNotNull().alias("slip")), "origins")
    x, y = (known.select(F.col("w").alias(c), *(F.col(k).alias(c + k) for k in ("of", "unseen", "slip"))) for c in ("x", "y"))
    loose = F.expr("xunseen and (yunseen or yslip) or yunseen and xslip")
    return slips.join(x, "x").join(y, "y").filter(~F.arrays_overlap("xof", "yof") & ~loose).select(*slips.columns)


def same_place(records: DataFrame, rare_share: float = 0.05, evidence: float = 10.0) -> DataFrame:
    """(a_key, b_key, edits) for ids of ``records`` (id, address, city) whose addresses denote one place.

    Two different words are one if one is a slip of the other or both are slips of one word that is written more; what is a slip
    is told by shares (``rare_share``, ``evidence``: see ``origins``), so a larger table judges by the same rule.
    """
    spark = records.sparkSession
    rec = stage(parsed(records), "places")
    block = ["loc", "kind", "num"]
    forms = rec.select(*block, "style", "name").distinct()

    # forms and blocks go by 64-bit hashes through the index; what a collision lets in is compared and left out again
    names = stage(forms.select(*block, "name").distinct().select(*block, "name", F.xxhash64(*block).alias("blk"), F.xxhash64(*block, "name").alias("fid")), "forms")

    def index(batches):
        for pdf in batches:
            ks = [_keys(n) for n in pdf["name"]]
            if ks:
                n = [len(k) for k, _ in ks]
                yield pd.DataFrame({"key": np.concatenate([k for k, _ in ks]) ^ np.repeat(pdf["blk"].to_numpy(), n), "fid": np.repeat(pdf["fid"].to_numpy(), n), "role": np.concatenate([r for _, r in ks])})

    entries = stage(names.select("name", "blk", "fid").mapInPandas(index, "key long, fid long, role int"), "entries")
    # index entries meet by sorting: even a few of them would be a large table to build on the driver
    side = lambda role, c: entries.filter(role).select("key", F.col("fid").alias(c))
    near = side(F.col("role") == WORD, "fa").join(side(F.col("role") == WORD, "fb").hint("merge"), "key").filter("fa < fb").select("fa", "fb")
    cut = side(F.col("role") == SHORT, "fa").join(side(F.col("role") != WORD, "fb").hint("merge"), "key").filter("fa != fb").select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"))
    near = near.unionByName(cut).distinct().join(names.select(*block, F.col("name").alias("na"), F.col("fid").alias("fa")), "fa").join(names.select(*[F.col(c).alias(f"_{c}") for c in block], F.col("name").alias("nb"), F.col("fid").alias("fb")), "fb")
    near = near.filter(" and ".join(f"{c} = _{c}" for c in block)).select(*block, F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

    def compare(batches):
        for pdf in batches:
            rows = []
            for r in zip(*(pdf[c] for c in (*block, "a", "b"))):
                got = assign(r[3].split(), r[4].split())
                if got is not None:
                    differ = [(x, y) for x, y in got if skeleton(x) != skeleton(y) and not x.endswith(".") and not y.endswith(".")]
                    rows.append((*r, [skeleton(x) for x, _ in differ], [skeleton(y) for _, y in differ]))
            yield pd.DataFrame(rows, columns=[*block, "a", "b", "xs", "ys"])

    pairs = near.repartition(parallelism(spark), *block).mapInPandas(compare, "loc string, kind string, num string, a string, b string, xs array<string>, ys array<string>")
    pairs = stage(pairs, "pairs")

    @F.pandas_udf("array<string>")
    def skeletons(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [skeleton(t) for t in n.split()])

    counts = rec.select(F.explode(skeletons("name")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    slips = pairs.select(*block, "a", "b", F.explode(F.arrays_zip("xs", "ys")).alias("z")).select(*block, "a", "b", F.col("z.xs").alias("x"), F.col("z.ys").alias("y"))
    two = two_names(slips, counts, rare_share, evidence).select(*block, "a", "b").distinct()
    pairs = pairs.join(two, [*block, "a", "b"], "left_anti").select(*block, "a", "b", F.size("xs").alias("edits"))

    # every form goes with itself; forms are expanded to ids at the end
    pairs = pairs.unionByName(names.select(*block, F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0).alias("edits")))
    ids = rec.select(*block, "name", "style", "id")
    left = ids.select(*block, F.col("name").alias("a"), F.col("style").alias("sa"), F.col("id").alias("ia"))
    right = ids.select(*block, F.col("name").alias("b"), F.col("style").alias("sb"), F.col("id").alias("ib"))
    both = pairs.join(left, [*block, "a"]).join(right, [*block, "b"]).filter("ia != ib and (sa = sb or sa = '' or sb = '')")
    return both.groupBy(F.least("ia", "ib").alias("a_key"), F.greatest("ia", "ib").alias("b_key")).agg(F.min("edits").alias("edits"))

"""Records of several tables that mean one institution, without a common key.

Records, their attributes (name; number and address within town and type) and the attributes' tokens form a graph. Random
walks over it train skip-gram vectors of token features. A record that lacks a name or number takes it from where the walk
record - attribute - record - attribute leads; its vector joins its own name and the name most told with its number. Records
of one town and type are blocked by several tables of hyperplane hashes, as many as keep the modelled recall however large a
block grows. Candidates get their exact cosine; a calibrated curve, with agreeing numbers as further evidence, decides.
What it accepts goes through an exact check: two known numbers that differ never match, and names that stand alone must
match token by token, slips forgiven.

Defined results: records without a name, of no known type, or with the verdict known_bad take no part; an id with
several rows is one record that has what any of its rows says; repeated rows count once; a record with neither number nor
proper name matches nothing; an id that occurs in two tables pairs by its other ids only; names are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veyra.llm.addresses import assign, same_place, two_names
from veyra.llm.text import allowed, calibrate, edits, skeleton, tokens
from veyra.session import parallelism, stage

# Kinds of institution in Bulgarian and English with their short forms, and words that name none.
TYPES = [
    (("детска", "градина"), "dg"), (("детска", "ясла"), "dya"), (("основно", "училище"), "ou"), (("начално", "училище"), "nu"), (("средно", "училище"), "su"),
    (("primary", "school"), "ou"), (("elementary", "school"), "nu"), (("secondary", "school"), "su"), (("high", "school"), "su"),
    (("kindergarten",), "dg"), (("nursery",), "dya"), (("creche",), "dya"),
    (("дг",), "dg"), (("дя",), "dya"), (("оу",), "ou"), (("ну",), "nu"), (("су",), "su"), (("dg",), "dg"), (("dya",), "dya"), (("ou",), "ou"), (("nu",), "nu"), (("su",), "su"),
]
KIND_TYPES = {"kindergarten": "dg", "nursery": "dya", "дг": "dg", "дя": "dya", "оу": "ou", "ну": "nu", "су": "su"}
SKIPPED = {"гр", "град", "gr", "grad", "the", "no", "n", "ма", "ва", "то", "ри", "ти", "та", "th", "st", "nd", "rd", "филиал", "branch"}
BUILDING = ("сграда", "сгр", "корпус", "building")
ORDINALS = ("втора", "първа", "трета", "second", "first", "third")
_ORDINAL = re.compile(r"(\d+)(?:th|st|nd|rd|ма|ва|то|ри|ти|та)?")


@lru_cache(maxsize=200_000)
def _near(a: str, b: str) -> bool:
    n = allowed(len(b))
    return edits(a, b, n) <= n


@lru_cache(maxsize=100_000)
def _building(t: str) -> bool:
    return any(_near(t, b) for b in BUILDING)


@lru_cache(maxsize=100_000)
def _of_town(t: str, town: str) -> bool:
    most = 2 if len(town) > 6 else 1
    return bool(town) and edits(skeleton(t), town, most) <= most


def parse(name: str | None, city: str | None, kind: str | None = None) -> tuple[str, str, str | None, str] | None:
    """(locality, type, number, proper name by skeleton); None where the name is of no institution."""
    toks = tokens(name)
    town = skeleton("".join(tokens(city)))
    found = None
    for words, code in TYPES:
        for i in range(len(toks) - len(words) + 1):
            if all(_near(toks[i + k], w) for k, w in enumerate(words)):
                found = code
                toks = toks[:i] + toks[i + len(words) :]
                break
        if found:
            break
    if not toks and not found:
        return None
    number, rest = None, []
    for j, t in enumerate(toks):
        m = _ORDINAL.fullmatch(t)
        if m:
            if number is None and not (j and _building(toks[j - 1])):
                number = str(int(m[1]))
        elif t in SKIPPED or _building(t) or j + 1 < len(toks) and _building(toks[j + 1]) and any(_near(t, o) for o in ORDINALS):
            continue
        elif len(t) == 1 or _of_town(t, town):
            continue
        else:
            rest.append(skeleton(t))
    code = found or KIND_TYPES.get((kind or "").strip().lower())
    if code is None or (number is None and not rest):
        return None
    return town, code, number, " ".join(rest)


def features(name: str, buckets: int) -> list[int]:
    """Hashed 2- and 3-grams of a name's words, word ends marked, and the words themselves; a number is one word."""
    out = []
    for w in name.split():
        s = f"<{w}>"
        if not w[0].isdigit():
            out += [zlib.crc32(g.encode()) % buckets for n in (2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1))]
        out.append(zlib.crc32(s.encode()) % buckets)
    return out


def start_vectors(buckets: int, dim: int, rng: np.random.Generator) -> np.ndarray:
    """Random unit vectors, which features that no walk meets keep."""
    vec = rng.normal(size=(buckets, dim)).astype(np.float32)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def train(nodes: list[tuple[str, ...]], buckets: int = 1 << 14, dim: int = 32, pairs: int = 600_000, seed: int = 5) -> np.ndarray:
    """Skip-gram vectors (buckets, dim) of token features from walks over the graph of ``nodes``.

    A node row is one record: its name ('' if it has none) and the keys of its other attributes, '' where unknown. A walk
    goes record - attribute - token, back to a record that shares an attribute, and on to a token of its own. Every feature has
    a vector: one that no walk meets keeps its random start.
    """
    rng = np.random.default_rng(seed)
    vec = start_vectors(buckets, dim, rng)
    holders: dict[tuple[int, str], list[int]] = {}
    for i, row in enumerate(nodes):
        for k, a in enumerate(row):
            if a:
                holders.setdefault((k, a), []).append(i)
    named = [i for i, row in enumerate(nodes) if row[0]]
    if not named:
        return vec
    fx: dict[str, list[int]] = {}
    words = [row[0].split() for row in nodes]
    centre, context = [], []
    while len(centre) < pairs:
        at, walk = named[rng.integers(len(named))], []
        for _ in range(4):
            ws = words[at]
            if ws:
                w = ws[rng.integers(len(ws))]
                if w not in fx:
                    fx[w] = features(w, buckets)
                walk += fx[w]
            have = [k for k, a in enumerate(nodes[at]) if a]
            k = have[rng.integers(len(have))]
            near = holders[k, nodes[at][k]]
            at = near[rng.integers(len(near))]
        if len(walk) < 2:
            continue
        x = rng.integers(len(walk), size=32)
        y = rng.integers(len(walk), size=32)
        arr = np.array(walk)
        ok = arr[x] != arr[y]
        if not ok.any():
            pairs -= 32
        centre += arr[x[ok]].tolist()
        context += arr[y[ok]].tolist()
    vec = learnt(vec, np.array(centre), np.array(context), rng)
    return centred(vec, [row[0] for row in nodes if row[0]])


def learnt(vec: np.ndarray, c: np.ndarray, o: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Skip-gram vectors from the examples that feature ``c`` stands beside feature ``o``, started at ``vec``, which changes."""
    buckets, dim = vec.shape
    out = np.zeros_like(vec)
    # frequent features are drawn less often as noise than they occur
    count = np.bincount(o, minlength=buckets) ** 0.75
    noise = rng.choice(buckets, size=1_000_000, p=count / count.sum())
    for lr in (0.3, 0.2, 0.1):
        order = rng.permutation(len(c))
        for s in range(0, len(c), 4096):
            a, b = c[order[s : s + 4096]], o[order[s : s + 4096]]
            neg = noise[rng.integers(len(noise), size=(len(a), 4))]
            v = vec[a]
            targets = np.concatenate([b[:, None], neg], 1)
            u = out[targets]
            g = 1 / (1 + np.exp(-np.einsum("nd,nkd->nk", v, u)))
            g[:, 0] -= 1
            # a feature that a batch holds many times moves by a damped sum of its steps, and no vector grows beyond bounds
            for table, rows, step in ((out, targets.ravel(), (g[:, :, None] * v[:, None, :]).reshape(-1, dim)), (vec, a, np.einsum("nk,nkd->nd", g, u))):
                by = np.argsort(rows, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(rows[by]) > 0])
                move = np.add.reduceat(step[by], first)
                held = np.diff(np.r_[first, len(rows)])
                hit = rows[by][first]
                new = table[hit] - lr * move / np.sqrt(held)[:, None]
                table[hit] = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True) / 3, 1)
    return vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)


def moments(names, vec: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the names' mean features."""
    rows = np.stack([vec[features(n, len(vec))].mean(0) for n in names]).astype(float)
    return len(rows), rows.sum(0), rows.T @ rows


def centred(vec: np.ndarray, names: list[str]) -> np.ndarray:
    """What all names have in common tells none apart: their mean goes, and their main directions count less; little of either where names are few."""
    return levelled(vec, *moments(sorted(set(names)), vec))


def levelled(vec: np.ndarray, n: int, total: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """``centred`` by the moments of all different names."""
    dim, mean, known = vec.shape[1], total / n, n / (n + vec.shape[1])
    spread = outer / n - np.outer(mean, mean)
    val, axes = np.linalg.eigh(known * spread + ((1 - known) * np.trace(spread) / dim + 1e-6) * np.eye(dim))
    return ((vec - known * mean) @ (axes / val**0.25)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vectors(names, table: np.ndarray, held: dict | None = None) -> np.ndarray:
    """Unit vectors of names: the mean of their words' unit vectors. ``held`` keeps names and words between calls."""
    held = {} if held is None else held
    if len(held) > 200_000:
        held.clear()
    rows = []
    for name in names:
        got = held.get(name)
        if got is None:
            got = np.zeros(table.shape[1], dtype=np.float32)
            for w in name.split():
                if (word := held.get(("word", w))) is None:
                    word = held["word", w] = unit(table[features(w, len(table))].sum(0)[None])[0]
                got = got + word
            got = held[name] = unit(got[None])[0]
        rows.append(got)
    return np.stack(rows) if rows else np.zeros((0, table.shape[1]), dtype=np.float32)


def record_vectors(name, lead, num, table: np.ndarray, held: dict | None = None) -> np.ndarray:
    """Unit vectors of records: their own name and the name their number leads to; of a number alone where there is neither."""
    held = {} if held is None else held
    own = vectors([n or "" for n in name], table, held)
    led = vectors([x or "" for x in lead], table, held)
    bare = [f"{n}" if n and not a and not b else "" for a, b, n in zip(name, lead, num)]
    return unit(own + led + vectors(bare, table, held))


def parsed(records: DataFrame) -> DataFrame:
    """(src, id, loc, type, num, name) of records (src, id, name, city, kind), repeated rows once."""

    def read(batches):
        for pdf in batches:
            rows = [(s, i, *p) for s, i, n, c, k in zip(pdf["src"], pdf["id"], pdf["name"], pdf["city"], pdf["kind"]) if (p := parse(n, c, k))]
            yield pd.DataFrame(rows, columns=["src", "id", "loc", "type", "num", "name"])

    src = records.filter("id is not null and name is not null").select("src", "id", "name", "city", "kind")
    return src.mapInPandas(read, "src string, id long, loc string, type string, num string, name string").distinct()


def planes_for(n: int) -> int:
    """Hyperplanes for a block of n records: its buckets hold about one half of a record each."""
    return max(1, math.ceil(math.log2(2 * max(n, 1))))


@lru_cache(maxsize=256)
def tables_for(planes: int, probes: int, aim: float, recall: float, draws: int = 50_000) -> int:
    """Tables of ``planes`` hyperplanes by which a pair of cosine ``aim`` meets with chance ``recall``.

    The distances of a pair to a random plane are two normal variables whose correlation is the pair's cosine, so the chance of one
    table is that of such draws: the signs agree but for at most one plane, which is among the ``probes`` nearest to one side.
    """
    rng = np.random.default_rng(planes)
    x = rng.normal(size=(draws, planes))
    y = aim * x + math.sqrt(1 - aim * aim) * rng.normal(size=(draws, planes))
    wrong = (x > 0) != (y > 0)
    near = np.argsort(np.abs(x), axis=1)[:, :probes]
    p = (~wrong.any(1) | (wrong.sum(1) == 1) & np.take_along_axis(wrong, near, 1).any(1)).mean()
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(p, 1e-4), 1 - 1e-9))))


def candidates(ends: DataFrame, table: np.ndarray, aim: float = 0.75, recall: float = 0.95, probes: int = 3, seed: int = 11) -> DataFrame:
    """(a, b) with a < b: the ``end`` keys of ``ends`` (loc, type, end, name, lead, num) that share a bucket of a hash table.

    A block (loc, type) of n rows is hashed by about log2(2 n) hyperplanes, so buckets stay small however large it grows, and by as
    many tables as ``tables_for`` asks. One side also looks into the buckets across the hyperplanes nearest to it.
    """
    size = ends.groupBy("loc", "type").agg(F.count("*").alias("n"))
    most = planes_for(size.agg(F.max("n")).first()[0] or 1)
    tables = [tables_for(k, probes, aim, recall) for k in range(most + 1)]
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(max(tables), most, table.shape[1])).astype(np.float32)
    sized = ends.join(size, ["loc", "type"]).select(F.xxhash64("loc", "type").alias("block"), "end", "name", "lead", "num", "n")

    def hashes(probe: bool):
        def run(batches):
            held: dict = {}
            for pdf in batches:
                v = record_vectors(pdf["name"], pdf["lead"], pdf["num"], table, held)
                block, end, ks = pdf["block"].to_numpy(), pdf["end"].to_numpy(), np.array([planes_for(n) for n in pdf["n"]], dtype=int)
                for k in np.unique(ks):
                    at = np.flatnonzero(ks == k)
                    for t in range(tables[k]):
                        d = v[at] @ planes[t, :k].T
                        bits = ((d > 0) << np.arange(k)).sum(1).astype(np.int64)
                        found = [bits]
                        if probe:
                            near = np.argsort(np.abs(d), axis=1)[:, :probes]
                            found += [bits ^ (np.int64(1) << near[:, p]) for p in range(near.shape[1])]
                        for b in found:
                            yield pd.DataFrame({"block": block[at], "slot": t, "bits": b, "end": end[at]})

        return run

    schema = "block long, slot int, bits long, end long"
    sized = sized.repartition(parallelism(ends.sparkSession), "end")
    left, right = sized.mapInPandas(hashes(True), schema), sized.mapInPandas(hashes(False), schema)
    pairs = left.withColumnRenamed("end", "x").join(right.withColumnRenamed("end", "y").hint("merge"), ["block", "slot", "bits"]).filter("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def known_numbers(rec: DataFrame, records: DataFrame) -> DataFrame:
    """(loc, type, name, num, count): the numbers that names stand beside, in one row, in rows of one id, or at one address.

    An address only speaks where one source gives a name alone and another a number alone that has no name yet.
    """
    key = ["loc", "type"]
    by_id = rec.groupBy("src", "id", *key).agg(F.max("num").alias("num"), F.collect_set(F.nullif("name", F.lit(""))).alias("names"))
    told = rec.filter("num is not null and name != ''").select(*key, "name", "num").unionByName(by_id.filter("num is not null").select(*key, F.explode("names").alias("name"), "num"))
    told = stage(told.groupBy(*key, "name", "num").count(), "told")
    bare = by_id.filter("num is not null and size(names) = 0").join(told.select(*key, "num").distinct(), [*key, "num"], "left_anti")
    only = by_id.filter("num is null and size(names) > 0").select("src", "id", *key, F.explode("names").alias("name")).join(told.select(*key, "name").distinct(), [*key, "name"], "left_anti")
    ids = bare.select("id").unionByName(only.select("id")).distinct()
    beside = same_place(records.filter("address is not null").select("id", "address", "city").join(ids, "id", "left_semi")).selectExpr("a_key as x", "b_key as y")
    beside = beside.unionByName(beside.selectExpr("y as x", "x as y"))
    near = only.alias("o").join(beside, F.col("o.id") == F.col("x")).join(bare.alias("b"), (F.col("y") == F.col("b.id")) & (F.col("o.loc") == F.col("b.loc")) & (F.col("o.type") == F.col("b.type")) & (F.col("o.src") != F.col("b.src")))
    # one number at the place, else none is told
    near = near.groupBy("o.loc", "o.type", "o.name").agg(F.min("b.num").alias("num"), F.max("b.num").alias("other")).filter("num = other").select(*key, "name", "num", F.lit(1).cast("long").alias("count"))
    return told.unionByName(near)


def walked(ends: DataFrame, walks: int = 2, stops: int = 4, seed: int = 5) -> DataFrame:
    """(x, y, weight): the words that walks bring together, over the whole graph: ``walks`` of them from every end with a name.

    A walk goes end - attribute - end, each holder of an attribute as likely as any other, and takes a word at each stop.
    """
    named = F.col("name") != ""
    local = lambda c: F.when(F.col(c) != "", F.xxhash64(F.lit(c), "loc", "type", c))
    attrs = F.array_compact(F.array(F.when(named, F.xxhash64(F.lit("name"), "name")), local("num"), local("place")))
    held = ends.select("end", "name", F.explode(attrs).alias("attr"))
    holders = Window.partitionBy("attr")
    held = held.select("*", (F.row_number().over(holders.orderBy("end")) - 1).alias("pos"), F.count("*").over(holders).alias("n"))
    held = stage(held, "holders")
    hops = held.groupBy("end").agg(F.array_sort(F.collect_list(F.struct("attr", "n"))).alias("hops"))
    stop = stage(held.drop("n").join(hops, "end"), "stops")

    pick = lambda what, s, n: F.pmod(F.xxhash64("walk", F.lit(what), F.lit(s), F.lit(seed)), n)

    def word(s):
        ws = F.split("name", " ")
        return F.when(named, F.element_at(ws, (pick("word", s, F.size(ws)) + 1).cast("int")))

    at = stop.filter(named).select("end", "name", "hops").distinct()
    at = at.select(F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("k"), "*").withColumn("walk", F.xxhash64("end", "k"))
    at = at.select("walk", "hops", F.array(word(0)).alias("words"))
    for s in range(1, stops):
        at = at.select("walk", "words", F.element_at("hops", (pick("attr", s, F.size("hops")) + 1).cast("int")).alias("hop"))
        at = at.select("walk", "words", F.col("hop.attr").alias("attr"), pick("pos", s, F.col("hop.n")).alias("pos"))
        at = at.join(stop.select("attr", "pos", "name", "hops"), ["attr", "pos"])
        at = at.select("walk", "hops", F.concat("words", F.array(word(s))).alias("words"))

    # of a walk's features any two are as likely a pair; the weight is that of two features, as a whole number, so that sums are exact
    w = at.select(F.array_compact("words").alias("ws"))
    count = F.aggregate("ws", F.lit(0), lambda n, x: n + F.when(x.rlike(r"^\p{Nd}"), 1).otherwise(2 * F.length(x) + 2))
    w = w.select("ws", F.greatest(F.round(F.lit(1e9) / count / count), F.lit(1)).cast("long").alias("one"))
    w = w.select("one", "ws", F.posexplode("ws").alias("i", "a")).select("one", "i", "a", F.posexplode("ws").alias("j", "b")).filter("i <= j")
    both = F.when((F.col("i") < F.col("j")) & (F.col("a") == F.col("b")), F.col("one") * 2).otherwise(F.col("one"))
    return w.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum(both).alias("weight"))


def beside(words: DataFrame, buckets: int) -> DataFrame:
    """(c, o, weight) with c < o: how often two features stand in one walk, by the pairs of ``walked``; at most ``buckets`` squared rows."""

    def spread(batches):
        fx: dict[str, np.ndarray] = {}
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                keys, weights = [], []
                for x, y, w in zip(*(pdf[k].iloc[start : start + 2000] for k in ("x", "y", "weight"))):
                    if len(fx) > 200_000:
                        fx.clear()
                    for t in (x, y):
                        if t not in fx:
                            fx[t] = np.array(features(t, buckets), dtype=np.int64)
                    a, b = np.repeat(fx[x], len(fx[y])), np.tile(fx[y], len(fx[x]))
                    keys.append(np.minimum(a, b) * buckets + np.maximum(a, b))
                    weights.append(np.full(len(a), w if x == y else 2 * w))
                key, weight = np.concatenate(keys), np.concatenate(weights)
                by = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(key[by]) > 0])
                got = key[by][first]
                out = pd.DataFrame({"c": got // buckets, "o": got % buckets, "weight": np.add.reduceat(weight[by], first)})
                yield out[out["c"] != out["o"]]

    words = words.repartition(parallelism(words.sparkSession), "x", "y")
    return words.mapInPandas(spread, "c long, o long, weight long").groupBy("c", "o").agg(F.sum("weight").alias("weight"))


def fit_vectors(ends: DataFrame, examples: int, buckets: int = 1 << 14, dim: int = 32, least: int = 32, seed: int = 5) -> np.ndarray:
    """Skip-gram vectors (buckets, dim) of token features from walks of all ``ends``, however many there are.

    The walks' pairs are counted where they are. The steps of learning are drawn by these counts: about ``examples``, and about
    ``least`` for every feature that any walk meets, so none keeps its random start because a table is large.
    """
    rng = np.random.default_rng(seed)
    vec = start_vectors(buckets, dim, rng)
    met = stage(beside(walked(ends, seed=seed), buckets), "beside")
    met = met.unionByName(met.select(F.col("o").alias("c"), F.col("c").alias("o"), "weight"))
    of = met.groupBy("c").agg(F.sum("weight").cast("double").alias("all"))
    every = of.agg(F.sum("all")).first()[0] or 1.0
    rate = F.col("weight") * F.greatest(F.lit(examples / every), least / F.col("all"))
    chance = F.pmod(F.xxhash64("c", "o", F.lit(seed)), F.lit(1_000_000)) / 1e6
    drawn = met.join(of, "c").select("c", "o", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).alias("n")).filter("n > 0")
    drawn = drawn.toPandas().sort_values(["c", "o"])  # at most about examples + least * buckets rows
    if len(drawn):
        vec = learnt(vec, *(np.repeat(drawn[k].to_numpy(), drawn["n"]) for k in ("c", "o")), rng)

    def sums(batches):
        got = [moments(pdf["name"], vec) for pdf in batches if len(pdf)]
        if got:
            n, total, outer = (sum(x) for x in zip(*got))
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "square": [outer.ravel().tolist()]})

    names = ends.filter("name != ''").select("name").distinct()
    got = names.mapInPandas(sums, "n long, total array<double>, square array<double>").toPandas()  # a row for each partition
    if not len(got):
        return vec
    return levelled(vec, int(got["n"].sum()), np.sum(got["total"].tolist(), axis=0), np.sum(got["square"].tolist(), axis=0).reshape(dim, dim))


def same_institution(records: DataFrame, examples: int = 600_000, aim: float = 0.75, recall: float = 0.95, least_cosine: float = 0.6, least: float = 0.5, rare_share: float = 0.05, evidence: float = 10.0, fit=None) -> DataFrame:
    """(a_key, b_key, confidence) for records of two different sources that mean one institution.

    ``records`` has (src, id, name, city, kind, address). Vectors are fitted to walks from all records in about ``examples`` steps
    (``fit``: another way to get them); every record is hashed and compared. Names alone must reach ``least_cosine``, which spares the exact check
    of pairs far apart; what passes needs the confidence ``least``.
    """
    spark, key = records.sparkSession, ["loc", "type"]
    rec = stage(parsed(records), "entities")
    told = stage(known_numbers(rec, records), "numbers")
    # walks: a record without number goes to the numbers of its name (its id's own, if known), one with a number to the name most told with it
    lead = told.groupBy(*key, "num").agg(F.max_by("name", F.struct("count", "name")).alias("lead"))
    own = rec.groupBy("src", "id", *key).agg(F.max("num").alias("idnum"))
    full = rec.join(own, ["src", "id", *key]).withColumn("num", F.coalesce("num", "idnum")).drop("idnum")
    without = full.filter("num is null").drop("num").join(told.select(*key, "name", "num").distinct(), [*key, "name"], "left")
    full = full.filter("num is not null").unionByName(without.select(*full.columns))
    place = records.filter("id is not null and address is not null").groupBy("src", "id").agg(F.min(F.lower("address")).alias("place"))
    on = stage(full.withColumn("end", F.xxhash64(*key, F.coalesce("num", F.lit("")), "name")), "on")
    ends = on.join(place, ["src", "id"], "left").groupBy("end", *key, "num", "name").agg(F.count("*").alias("written"), F.min("place").alias("place"))
    ends = stage(ends.join(lead, [*key, "num"], "left"), "ends")
    table = (fit or fit_vectors)(ends, examples)

    # exact cosines of the candidates
    def cosines(batches):
        held: dict = {}
        for pdf in batches:
            side = lambda s: [pdf[s + c].tolist() for c in ("name", "lead", "num")]
            (na, la, ka), (nb, lb, kb) = side("a"), side("b")
            joint = (record_vectors(na, la, ka, table, held) * record_vectors(nb, lb, kb, table, held)).sum(1)
            text = lambda n, x: [a or b or "" for a, b in zip(n, x)]
            plain = (vectors(text(na, la), table, held) * vectors(text(nb, lb), table, held)).sum(1)
            same = [None if x is None or y is None else x == y for x, y in zip(ka, kb)]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "aname": text(na, la), "bname": text(nb, lb), "joint": joint.astype(float), "plain": plain.astype(float), "same": pd.array(same, dtype="boolean")})

    about = ends.select("end", "name", "lead", "num")
    side = lambda s: about.select(F.col("end").alias(s), *(F.col(c).alias(s + c) for c in ("name", "lead", "num")))
    pairs = candidates(ends.select(*key, "end", "name", "lead", "num"), table, aim, recall)
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").repartition(parallelism(spark), "a")
    schema = "a long, b long, aname string, bname string, joint double, plain double, same boolean"
    pairs = stage(pairs.mapInPandas(cosines, schema), "candidates")

    def compare(batches):
        for pdf in batches:
            got = [assign(a.split(), b.split()) for a, b in zip(pdf["aname"], pdf["bname"])]
            differ = [[(x, y) for x, y in g or () if x != y] for g in got]
            pdf = pdf.assign(fits=[g is not None for g in got], xs=[[x for x, _ in d] for d in differ], ys=[[y for _, y in d] for d in differ])
            yield pdf[pdf["fits"]].drop(columns="fits")

    near = pairs.filter((F.col("plain") >= least_cosine) & (F.col("aname") != "") & (F.col("bname") != ""))
    fits = stage(near.mapInPandas(compare, schema + ", xs array<string>, ys array<string>"), "fits")
    words = on.filter("name != ''").select(F.explode(F.split("name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    slips = fits.select("a", "b", F.explode(F.arrays_zip("xs", "ys")).alias("z")).select("a", "b", F.col("z.xs").alias("x"), F.col("z.ys").alias("y"))
    fits = fits.join(two_names(slips, words, rare_share, evidence).select("a", "b").distinct(), ["a", "b"], "left_anti").select("a", "b", "plain", "joint", "same")
    fits = stage(fits, "alike")

    # names found alike whose numbers are both known tell how far a cosine can be trusted
    judged = fits.filter("same is not null").groupBy(F.round("plain", 2).alias("c")).agg(F.count("*").alias("n"), F.sum(F.col("same").cast("int")).alias("m")).collect()  # at most 201 rows
    cs, ms = [], []
    for c, n, m in judged:
        n_kept = min(n, 400)
        yes = round(m / n * n_kept)
        cs += [c] * n_kept
        ms += [1] * yes + [0] * (n_kept - yes)
    few = len(cs) < 20 or not 0 < sum(ms) < len(ms)
    slope, shift = (20.0, -13.0) if few else calibrate(np.array(cs, dtype=float), np.array(ms, dtype=float))
    # how much more often numbers agree beside one name than beside any two names of a block
    rates = pairs.filter("same is not null").agg(F.avg(F.when(F.col("aname") == F.col("bname"), F.col("same").cast("int"))).alias("m"), F.avg(F.when(F.col("plain") < least_cosine, F.col("same").cast("int"))).alias("u")).first()
    m, u = min(max(rates.m or 0.9, 0.5), 0.999), min(max(rates.u or 1e-3, 1e-3), 0.4)
    agree = math.log(m / u)
    curve = lambda c, more=0.0: 1 / (1 + F.exp(-(c * slope + shift + more)))
    by_name = fits.filter("same is null").select("a", "b", curve(F.col("plain")).alias("conf"))
    by_number = pairs.filter("same").select("a", "b", curve(F.col("joint"), agree).alias("conf"))
    itself = ends.select(F.col("end").alias("a"), F.col("end").alias("b"), curve(F.lit(1.0), F.when(F.col("num").isNotNull(), agree).otherwise(0.0)).alias("conf"))
    found = by_name.unionByName(by_number).filter(F.col("conf") >= least).unionByName(itself)

    x, y = (on.select(F.col("end").alias(e), F.col("src").alias("s" + e), F.col("id").alias("i" + e)).distinct() for e in ("a", "b"))
    both = found.join(x, "a").join(y, "b").filter("sa != sb and ia != ib")
    return both.groupBy(F.least("ia", "ib").alias("a_key"), F.greatest("ia", "ib").alias("b_key")).agg(F.max("conf").alias("confidence"))


def judged(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(verdict, labels, matched, share, confidence) of labels of each verdict: how many of them a matcher links, and how surely at best."""
    ids = matches.select(F.explode(F.array("a_key", "b_key")).alias("label_id"), "confidence").groupBy("label_id").agg(F.max("confidence").alias("c"))
    own = labels.select("label_id", "verdict").distinct().join(ids, "label_id", "left")
    out = own.groupBy("verdict").agg(F.count("*").alias("labels"), F.count("c").alias("matched"), F.round(F.avg("c"), 4).alias("confidence"))
    return out.select("verdict", "labels", "matched", F.round(F.col("matched") / F.col("labels"), 4).alias("share"), "confidence")


def institution_records(dz: DataFrame, labels: DataFrame, points: DataFrame, known_bad: bool = False) -> DataFrame:
    """The three tables as (src, id, name, city, kind, address); labels known to name no institution only if ``known_bad``."""
    a = dz.selectExpr("'dz' as src", "dz_id as id", "name_full as name", "city", "dz_kind as kind", "address")
    b = labels.filter(F.lit(known_bad) | F.expr("verdict is null or verdict != 'known_bad'")).selectExpr("'label' as src", "label_id as id", "english_name as name", "city_en as city", "cast(null as string) as kind", "cast(null as string) as address")
    # a point's kind is no type of institution by itself: libraries and kitchens bear schools' names
    c = points.selectExpr("'point' as src", "point_id as id", "name", "city", "cast(null as string) as kind", "address")
    return a.unionByName(b).unionByName(c)

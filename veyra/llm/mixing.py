"""A mix of sources in target shares of tokens, small sources repeated up to a cap.

Each source's documents are put in a random order and cut into blocks of about equal tokens. A quota of blocks follows
from the shares; a splitting tree halves the output shards and draws, by the multivariate hypergeometric law, how many
blocks of each source go left and right, so every shard's share is as random as in one shuffle, yet totals are exact.
Blocks are permuted by a keyed bijection and find their shard by walking down the tree; a node's draw is seeded by its place,
so every task sees the same tree and none holds it whole. Shards shuffle their documents locally.

Defined results: a source without documents or with share 0, null or negative gives nothing, and its share goes to the
others in proportion; null texts and documents without tokens add nothing and are left out; repeated ids count once;
empty tables give an empty mix; the whole is as large as the scarcest source allows, unless ``tokens`` asks for less.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.session import stage


class SplitTree:
    """Ranges of the sources' permuted blocks by output shard, from recursive hypergeometric halving.

    A node covers shards [lo, hi) and, of each source, blocks [start, start + have); its draw is seeded by (seed, lo, hi).
    """

    def __init__(self, blocks: list[int], shards: int, seed: int, held: int = 100_000):
        self.root = (0, shards, np.zeros(len(blocks), dtype=np.int64), np.array(blocks, dtype=np.int64))
        self.seed, self.held, self.cuts = seed, held, {}

    def _left(self, lo: int, hi: int, have: np.ndarray) -> np.ndarray:
        got = self.cuts.get((lo, hi))
        if got is None:
            take = round(int(have.sum()) * ((lo + hi) // 2 - lo) / (hi - lo))
            got = np.random.default_rng((self.seed, lo, hi)).multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
            if len(self.cuts) < self.held:
                self.cuts[lo, hi] = got
        return got

    def shard(self, source: int, position: int) -> int:
        """The shard that the block at ``position`` of a source's permuted blocks goes to."""
        lo, hi, start, have = self.root
        while hi - lo > 1:
            left = self._left(lo, hi, have)
            if position < start[source] + left[source]:
                hi, have = (lo + hi) // 2, left
            else:
                lo, start, have = (lo + hi) // 2, start + left, have - left
        return lo

    def quotas(self) -> np.ndarray:
        """(shards x sources) blocks of each; only for small trees."""
        lo, hi, _, have = self.root
        out, stack = np.zeros((hi, len(have)), dtype=np.int64), [(lo, hi, have)]
        while stack:
            lo, hi, have = stack.pop()
            if hi - lo == 1:
                out[lo] = have
            else:
                left = self._left(lo, hi, have)
                stack += [(lo, (lo + hi) // 2, left), ((lo + hi) // 2, hi, have - left)]
        return out


def permuted(i: int, n: int, key: int) -> int:
    """Where a keyed bijection of 0 .. n-1 puts i: Feistel rounds on the next power of four, walked on until within n."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = i >> half, i & mask
        for r in range(4):
            h = (b * 0x9E3779B97F4A7C15 + key * 0xC2B2AE3D27D4EB4F + r * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
            a, b = b, a ^ (h >> 32 & mask)
        i = a << half | b
        if i < n:
            return i


def mix_size(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """Tokens of the largest mix in which no source exceeds its repeats."""
    return min((available[s] * repeats[s] / shares[s] for s in shares), default=0.0)


def mix(docs: DataFrame, targets: DataFrame, tokens: int | None = None, shard_tokens: int = 1_000_000, shard_blocks: int = 64, part_docs: int = 200_000, fill_from: int = 20_000, seed: int = 17) -> DataFrame:
    """(shard, position, source, doc_id, copy_no, tokens) of the mix, for ``docs`` (doc_id, source, tokens) and ``targets``
    (source, target_share, max_repeats).

    A shard holds about ``shard_tokens`` in ``shard_blocks`` blocks, however many shards there are. The driver holds a row for each target
    and for each part of about ``part_docs`` documents of a source, and at most ``fill_from`` documents from which the quotas' last
    gaps are filled, those that follow the cut first.
    """
    spark = docs.sparkSession
    schema = "shard int, position long, source string, doc_id long, copy_no int, tokens long"
    goals = {r[0]: (float(r[1]), int(r[2])) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").distinct().collect()}
    named = spark.createDataFrame([(s,) for s in sorted(goals)], "source string")
    own = stage(docs.filter("doc_id is not null and tokens > 0").select("source", "doc_id", "tokens").join(F.broadcast(named), "source").distinct(), "mixdocs")
    held = {r[0]: math.ceil(r[1] / part_docs) for r in own.groupBy("source").count().collect()}
    if not held:
        return spark.createDataFrame([], schema)
    cuts = spark.createDataFrame(sorted(held.items()), "source string, cuts int")
    # parts are stretches of the random order, so a hot source is many tasks
    h = F.xxhash64("doc_id", F.lit(seed))
    own = own.join(F.broadcast(cuts), "source").withColumn("h", h).withColumn("part", F.floor((F.shiftrightunsigned("h", 32) * F.col("cuts")) / F.lit(1 << 32)).cast("int"))
    own = own.withColumn("o", F.shiftrightunsigned("h", 1)).drop("cuts", "h")
    sums = {(r[0], r[1]): int(r[2]) for r in own.groupBy("source", "part").agg(F.sum("tokens")).collect()}
    total: dict[str, int] = {}
    before: dict[tuple[str, int], int] = {}
    for (s, p), n in sorted(sums.items()):
        before[s, p] = total.get(s, 0)
        total[s] = total.get(s, 0) + n
    shares = {s: goals[s][0] for s in total}
    whole = sum(shares.values())
    shares = {s: v / whole for s, v in shares.items()}
    size = mix_size(total, shares, {s: goals[s][1] for s in total})
    size = min(size, tokens) if tokens else size
    quota = {s: shares[s] * size for s in shares}
    block = max(1.0, shard_tokens / shard_blocks)
    shards = max(1, math.ceil(size / shard_tokens))
    names = sorted(quota)
    copies = {s: math.ceil(quota[s] / total[s] - 1e-12) for s in names}
    # block b of a copy holds the documents that begin in its stretch of the permuted source; only the last copy is cut short
    a_copy = {s: math.ceil(total[s] / block - 1e-12) for s in names}
    blocks = {s: (copies[s] - 1) * a_copy[s] + max(1, math.ceil((quota[s] - (copies[s] - 1) * total[s]) / block - 1e-12)) for s in names}
    tree = SplitTree([blocks[s] for s in names], shards, seed)

    base = spark.createDataFrame([(s, p, n) for (s, p), n in before.items()], "source string, part int, start long")
    run = own.join(F.broadcast(base), ["source", "part"]).selectExpr("source", "doc_id", "tokens", "start + coalesce(sum(tokens) over (partition by source, part order by o, doc_id rows between unbounded preceding and 1 preceding), 0) as at")
    run = stage(run, "mixrun")
    # the last copy of a source takes what ends within its quota, and then what still fits of the documents that follow
    rest = {s: quota[s] % total[s] if quota[s] < total[s] * copies[s] else 0.0 for s in names}
    ends = spark.createDataFrame([(s, float(rest[s])) for s in names], "source string, rest double")
    run_rest = run.join(F.broadcast(ends), "source")
    cut = {r[0]: int(r[1]) for r in run_rest.filter("at + tokens <= rest").groupBy("source").agg(F.max(F.col("at") + F.col("tokens"))).collect()}
    gaps = spark.createDataFrame([(s, cut.get(s, 0), int(rest[s]) - cut.get(s, 0)) for s in names], "source string, cut long, gap long")
    spare = run.join(F.broadcast(gaps), "source").filter("gap > 0 and at >= cut and at < cut + 8 * gap and tokens <= gap").orderBy("at", "source", "doc_id").select("source", "tokens", "doc_id").limit(fill_from).collect()
    gap = {s: int(rest[s]) - cut.get(s, 0) for s in names}
    fill: set[tuple[str, int]] = set()
    for s, n, d in sorted(map(tuple, spare), key=lambda r: (r[0], -r[1], r[2])):
        if n <= gap[s]:
            fill.add((s, d))
            gap[s] -= n

    def draw(batches):
        at_shard: dict[tuple[str, int], int] = {}
        for pdf in batches:
            rows = []
            for s, d, n, at in zip(pdf["source"], pdf["doc_id"], pdf["tokens"], pdf["at"]):
                for c in range(copies[s]):
                    late = c == copies[s] - 1 and (s, d) in fill
                    if at + n <= quota[s] - c * total[s] + 1e-6 or late:
                        b = min(c * a_copy[s] + int(at // block), blocks[s] - 1)
                        to = at_shard.get((s, b))
                        if to is None:
                            if len(at_shard) > 200_000:
                                at_shard.clear()
                            k = names.index(s)
                            to = at_shard[s, b] = tree.shard(k, permuted(b, blocks[s], seed + 1000 * k))
                        rows.append((to, s, d, c + 1, n))
            yield pd.DataFrame(rows, columns=["shard", "source", "doc_id", "copy_no", "tokens"]).astype({"shard": "int32", "doc_id": "int64", "copy_no": "int32", "tokens": "int64"})

    drawn = run.mapInPandas(draw, "shard int, source string, doc_id long, copy_no int, tokens long")
    return drawn.selectExpr("shard", f"cast(row_number() over (partition by shard order by xxhash64(doc_id, copy_no, shard, {seed}), doc_id, copy_no) as bigint) as position", "source", "doc_id", "copy_no", "tokens")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share, most_copies) of each target."""
    per = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("copy_no").alias("most_copies"))
    whole = mixed.agg(F.sum("tokens").alias("whole")).scalar()
    out = targets.select("source", "target_share", "max_repeats").distinct().join(per, "source", "left")
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / whole, F.lit(0.0)), 6).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))

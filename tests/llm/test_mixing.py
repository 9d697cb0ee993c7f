import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veyra.llm.mixing import SplitTree, mix, mix_report, mix_size, permuted

DOCS = "doc_id long, source string, tokens long, shard string"
TARGETS = "source string, target_share double, max_repeats int, tokens string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=6), st.integers(1, 17), st.integers(0, 99))
def test_splitting_tree_is_exact(blocks, shards, seed):
    q = SplitTree(blocks, shards, seed).quotas()
    assert q.sum(0).tolist() == blocks and (q >= 0).all()
    assert q.sum(1).max() - q.sum(1).min() <= shards.bit_length() + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 99))
def test_blocks_walk_down_to_the_quotas(blocks, shards, seed):
    tree = SplitTree(blocks, shards, seed, held=seed)  # whatever is held of it
    want = SplitTree(blocks, shards, seed).quotas()
    for j, n in enumerate(blocks):
        assert sorted(permuted(i, n, seed) for i in range(n)) == list(range(n))
        at = [tree.shard(j, permuted(i, n, seed)) for i in range(n)]
        assert [at.count(k) for k in range(shards)] == want[:, j].tolist()


def test_shards_stay_even_however_many_there_are():
    blocks, shards = [40_000_000, 20_000_000, 4_000_000], 1_000_000
    tree = SplitTree(blocks, shards, 3)
    at = [tree.shard(0, permuted(i, blocks[0], 1)) for i in range(0, blocks[0], 80_000)]
    assert len(set(at)) > 480 and max(at) > 990_000 and min(at) < 10_000


def make(spark, extra=()):
    rows = [(i, "a", 10 + i % 90, "x") for i in range(600)] + [(1000 + i, "b", 5 + i % 40, "x") for i in range(120)] + [(2000 + i, "c", 20, "x") for i in range(30)] + [(3000, "other", 50, "x"), (3001, None, 5, "x"), (3002, "a", None, "x"), (3003, "a", 0, "x"), (None, "a", 9, "x")]
    return spark.createDataFrame(rows + list(extra), DOCS)


def test_shares_repeats_and_disjoint_draws(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, ""), ("b", 0.3, 4, ""), ("c", 0.15, 3, ""), ("none", 0.05, 2, ""), ("zero", 0.0, 2, ""), (None, 0.3, 1, "")], TARGETS)
    docs = make(spark, [(0, "a", 10, "x")])
    out = mix(docs, targets, shard_tokens=1500)
    rows = out.collect()
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows) and {r.source for r in rows} == {"a", "b", "c"}
    whole = sum(r.tokens for r in rows)
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 3)):
        mine = [r for r in rows if r.source == s]
        assert sum(r.tokens for r in mine) / whole == pytest.approx(share / 0.95, abs=0.01)
        assert max(r.copy_no for r in mine) <= most
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in by.values()) and len(by) > 1
    report = {r.source: r for r in mix_report(out, targets).collect()}
    assert report["none"].tokens == 0 and report["a"].actual_share == pytest.approx(0.526, abs=0.01)


def test_size_is_set_by_the_scarcest_source():
    assert mix_size({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == 40


def test_asked_size_and_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1, "")], TARGETS)
    assert sum(r.tokens for r in mix(make(spark), targets, tokens=2000).collect()) == pytest.approx(2000, abs=60)
    assert mix(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mix(make(spark), spark.createDataFrame([], TARGETS)).count() == 0

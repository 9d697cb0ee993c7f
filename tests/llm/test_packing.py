from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from veyra.llm.packing import Plan, pack, packing_report
from veyra.llm.sizes import sized

SIZES = "doc_id long, tokens long, rest long, pack_code string"
PACKS = "pack_code string, capacity_tokens int, doc_id int"


def containers(plan):
    out = defaultdict(list)
    for s, runs in plan.runs.items():
        for _, items, first, each in runs:
            for i in range(items):
                out[first + i // each].append(s)
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=25))
def test_plan_holds_every_item_once(counts):
    plan = Plan(counts, 60)
    boxes = containers(plan)
    got = defaultdict(int)
    for b in boxes.values():
        assert sum(b) <= 60 and sum(3 * s > 60 for s in b) <= 2
        for s in b:
            got[s] += 1
    assert dict(got) == counts and sorted(boxes) == list(range(1, plan.containers + 1))
    # no worse than the bound any fit keeps: all but one container more than half full
    assert sum(2 * sum(b) <= 60 for b in boxes.values()) <= 1


def test_pieces_capacity_and_hot_size(spark):
    rows = [(i, 7, 0, "x") for i in range(300)] + [(1000 + i, 1 + i * 37 % 250, 0, "x") for i in range(200)] + [(2000, 0, 0, "x"), (2001, None, 0, "x"), (2002, 300, 0, "x"), (2002, 300, 0, "x"), (None, 5, 0, "x")]
    out = pack(spark.createDataFrame(rows, SIZES), spark.createDataFrame([("s", 100, 1), ("b", 1000, 1), ("z", 0, 1), (None, 5, 1)], PACKS), part_docs=80).collect()
    for code, cap in (("s", 100), ("b", 1000)):
        mine = [r for r in out if r.pack_code == code]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r.container_no] += r.tokens
            pieces[r.doc_id].append(r)
        assert all(0 <= v <= cap for k, v in fill.items() if k) and fill[0] == 0
        for d, n in {r[:2] for r in rows if r[0] is not None}:
            ps = sorted(pieces[d], key=lambda r: r.piece_no)
            assert sum(r.tokens for r in ps) == (n or 0) and len(ps) == max(1, -(-(n or 0) // cap))
            assert [r.first_token for r in ps] == [1 + i * cap for i in range(len(ps))]
        whole = sum(fill.values())
        used = sorted(k for k in fill if k)
        assert used == list(range(1, len(used) + 1)) and len(used) <= whole / cap * 1.02 + 1
    report = {r.pack_code: r for r in packing_report(spark.createDataFrame(out), spark.createDataFrame([("s", 100, 1), ("b", 1000, 1)], PACKS)).collect()}
    assert report["s"].filled > 0.97


def test_empty(spark):
    packs = spark.createDataFrame([("s", 100, 1)], PACKS)
    assert pack(spark.createDataFrame([], SIZES), packs).count() == 0
    assert pack(spark.createDataFrame([(1, 5, 0, "x")], SIZES), spark.createDataFrame([], PACKS)).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "един два три", 9), (2, None, 9), (3, "", 9), (4, "дума " * 50_000, 9), (None, "x", 9)], "doc_id long, text string, tokens int")
    got = {r.doc_id: r.tokens for r in sized(df).collect()}
    assert got[2] == got[3] == 0 and 3 <= got[1] < 12 and got[4] >= 50_000 and len(got) == 4

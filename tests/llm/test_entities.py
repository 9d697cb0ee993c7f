import numpy as np

from veyra.llm.addresses import assign
from veyra.llm.entities import candidates, centred, features, fit_vectors, parse, planes_for, same_institution, start_vectors, tables_for, train, unit

COLS = "src string, id long, name string, city string, kind string, address string"
R = [
    ("dz", 1, "Детска градина № 21 „Снежна чучулига“", "Градец", "ДГ", "ул. Роза 5"),
    ("point", 101, "ДГ № 21", "Градец", None, None),
    ("point", 102, "Cнежнa чучулига (ДГ 21) - сграда 2", "Градец", None, None),
    ("label", 201, "Snezhna Chuchuliga Kindergarten", "Gradets", None, None),
    ("label", 202, "21st Kindergarten 'Snejna Chuchuliga'", "Gradets", None, None),
    ("label", 203, "Snezhna Chuchuliga Nursery", "Gradets", None, None),
    ("point", 103, "ДЯ Снежна чучулига", "Градец", None, None),
    ("point", 104, "ДГ № 22", "Градец", None, "жк Люлин бл. 3"),
    ("dz", 2, "Детска градина „Тиха гора“", "Градец", "ДГ", "ж.к. „Люлин“, блок 3"),
    ("label", 204, "Tiha Gora Kindergarten", "Gradets", None, None),
    ("dz", 3, "ДГ № 21 Снежна чучулига", "Другаде", "ДГ", None),
    ("point", 105, "Общинска библиотека Снежна чучулига", "Градец", None, None),
    ("dz", 4, None, "Градец", None, None),
    ("dz", 5, "", None, None, None),
    ("dz", 6, "№ 9 Ранна зора", "Градец", "ОУ", None),
    ("point", 106, "ОУ 9", "Градец", None, None),
]


def test_matches_by_any_attribute_and_across_a_third_record(spark):
    out = same_institution(spark.createDataFrame(R + R[:4], COLS)).collect()
    got = {(r.a_key, r.b_key) for r in out}
    first = {1: "dz", 101: "p", 102: "p", 201: "l", 202: "l"}
    want = {(a, b) for a in first for b in first if a < b and first[a] != first[b]} | {(103, 203), (2, 104), (2, 204), (104, 204), (6, 106)}
    assert got == want
    assert all(0 <= r.confidence <= 1 for r in out)


def test_every_name_found_alike_and_every_number_of_a_name_counts(spark):
    # 2 is alike 1 and the often written name, which 1 is too far from; one name is told with two numbers
    rows = [("dz", 1, "ДГ Пепрда", "Градец", "ДГ", None), ("point", 2, "ДГ Пеперда", "Градец", None, None)]
    rows += [("dz", 10 + i, "ДГ Пеперуда", "Градец", "ДГ", None) for i in range(6)]
    rows += [("dz", 20, "ДГ № 5 Ясен бряг", "Градец", "ДГ", None), ("dz", 21, "ДГ № 6 Ясен бряг", "Градец", "ДГ", None), ("point", 22, "ДГ Ясен бряг", "Градец", None, None), ("label", 23, "Kindergarten No 6", "Gradets", None, None)]
    got = {(r.a_key, r.b_key) for r in same_institution(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {(1, 2), (20, 22), (21, 22), (21, 23), (22, 23)} | {(2, 10 + i) for i in range(6)}


def test_names():
    assert parse("195-ма ДГ Сребъърна вълна", "X")[1:] == ("dg", "195", "сребаарна вална")
    assert parse("OУ Тиха гора, втора сграда", "X")[1:] == ("ou", None, "тиха гора")
    assert parse("Elementary School No. 99 Zelena Kashtichka", "Y")[1:3] == ("nu", "99")
    assert parse("Спортна зала Дивна царевица", "X") is None and parse(None, None) is None


FIRSTS, SECONDS = ["снежна", "тиха", "горска", "пастра", "летяща", "златна", "мадра", "росна", "дивна", "синя"], ["гора", "вална", "кащичка", "пеперуда", "звездичка", "лястовица", "поляна", "тиква", "ракета", "планета"]


def slipped(rng, name):
    while True:
        i = int(rng.integers(1, len(name) - 2))
        if " " not in name[i - 1 : i + 3]:
            return name[:i] + [name[i + 1 :], name[i + 1] + name[i] + name[i + 2 :], name[i] + name[i:]][int(rng.integers(3))]


def ends_of(spark, names):
    rows = [("л", "dg", i, n, None, None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "loc string, type string, end long, name string, lead string, num string")


def test_blocking_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    names = [f"{a} {b}" for a in FIRSTS for b in SECONDS]
    names = sorted({*names, *(slipped(rng, n) for n in names * 3)})
    nodes = [(n, "", "") for n in names]
    got = {(r.a, r.b) for r in candidates(ends_of(spark, names), train(nodes, pairs=200_000)).collect()}
    true = {(i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if assign(a.split(), b.split()) is not None}
    assert len(true & got) >= 0.9 * len(true)
    assert len(got) < 0.5 * len(names) * (len(names) - 1) / 2


def test_tables_grow_so_that_modelled_recall_stays():
    rng = np.random.default_rng(4)
    for n in (500, 10_000, 100_000):
        k = planes_for(n)
        t = tables_for(k, 3, 0.75, 0.95)
        v, z = unit(rng.normal(size=(300, 32))), rng.normal(size=(300, 32))
        w = 0.75 * v + np.sqrt(1 - 0.75**2) * unit(z - (z * v).sum(1, keepdims=True) * v)  # cosine 0.75
        hit = np.zeros(300, dtype=bool)
        for _ in range(t):
            p = rng.normal(size=(32, k))
            x, y = v @ p, w @ p
            wrong = (x > 0) != (y > 0)
            near = np.argsort(np.abs(x), axis=1)[:, :3]
            hit |= ~wrong.any(1) | (wrong.sum(1) == 1) & np.take_along_axis(wrong, near, 1).any(1)
        assert hit.mean() >= 0.9, (n, t, hit.mean())


def records_with_slips(rng):
    """Institutions with number and name in one source, and with a name that holds a slip in the other; (rows, true pairs)."""
    rows, true = [], set()
    for i, (a, b) in enumerate((a, b) for a in FIRSTS for b in SECONDS):
        rows += [("dz", 1000 + i, f"ДГ № {i + 1} {a} {b}", "Градец", None, None), ("dz", 3000 + i, f"ДГ {i + 1} {slipped(rng, f'{a} {b}')}", "Градец", None, None)]
        rows += [("point", 2000 + i, f"ДГ {slipped(rng, f'{a} {b}')}", "Градец", None, None)]
        true |= {(1000 + i, 2000 + i)}
    return rows, true


def test_the_trained_vectors_decide(spark):
    rows, true = records_with_slips(np.random.default_rng(8))
    df = spark.createDataFrame(rows, COLS)
    pairs = lambda out: {(r.a_key, r.b_key) for r in out.collect()}
    trained = pairs(same_institution(df))
    rand = pairs(same_institution(df, fit=lambda ends, sample: centred(start_vectors(1 << 14, 32, np.random.default_rng(1)), [r.name for r in ends.select("name").distinct().collect() if r.name])))
    assert len(trained & true) >= 0.9 * len(true)
    assert len(rand & true) < 0.9 * len(trained & true)  # untrained vectors lose rows
    wrong = {p for p in trained if (p[0] - p[1]) % 1000}
    assert len(wrong) <= 0.02 * len(trained)


def test_all_ends_fit_the_vectors_however_many_they_are(spark):
    rng = np.random.default_rng(6)
    names = sorted({f"{slipped(rng, a + ' ' + b)}" for a in FIRSTS for b in SECONDS})
    ends = spark.createDataFrame([("л", "dg", i, n, None, None, None) for i, n in enumerate(names)], "loc string, type string, end long, name string, lead string, num string, place string")
    start, vec = start_vectors(1 << 14, 32, np.random.default_rng(5)), fit_vectors(ends, len(names) // 10)
    met = np.zeros(len(vec), dtype=bool)
    met[[f for n in names for f in features(n, len(vec))]] = True
    # features of no name keep their start but for one map of them all; one of any name has left it
    start = np.c_[start, np.ones(len(start))]
    off = np.linalg.norm(start @ np.linalg.lstsq(start[~met], vec[~met], rcond=None)[0] - vec, axis=1)
    assert off[~met].max() < 1e-3 < 1e-2 < off[met].min()


def test_empty(spark):
    assert same_institution(spark.createDataFrame([], COLS)).count() == 0

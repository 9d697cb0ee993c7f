import random
from itertools import permutations

from veyra.llm.addresses import assign, cheapest, parse, same_place

COLS = "id long, address string, city string"
A = [
    (1, "1007 Глоганищица, ул. „Шафранова градина“ ном. 14", "Глоганищица"),
    (2, "ШАФРАНОВА ГРАДИНА №14, вх. 2, ет. 1 (гр. Глоганищица)", "Глоганищица"),
    (3, "ul. Shafranova gradina No14", "Глоганищица"),
    (4, "ул. Шаф. градина 14", "Глоганищица"),
    (5, "ул. Шафрнаова градина 14", "Глоганищица"),
    (6, "ул. Шафранова градина 14 А", "Глоганищица"),
    (7, "ул. Шафранова градина 15", "Глоганищица"),
    (8, "ул. Шафранова 14", "Глоганищица"),
    (9, "ул. Шафранова градина 14", "Песелидол"),
    (10, "бул. Шафранова градина 14", "Глоганищица"),
    (11, "жк Шумнатица бл. 14", "Глоганищица"),
    (12, "блок 14, ж.к. „Шумнатица“, до парка", "Глоганищица"),
    (13, "до гарата", "Глоганищица"),
    (14, None, "Глоганищица"),
    (15, "", None),
    (16, "32 A, st. Kamashitova skala, 1189 Разацерица", None),
    (17, "ул. Kaмъшитoвa cкaлa 32-А, 1189 Разацерица", "Разацерица"),
    (None, "ул. Шафранова градина 14", "Глоганищица"),
]


def pairs(spark, rows):
    return {(r.a_key, r.b_key) for r in same_place(spark.createDataFrame(rows, COLS)).collect()}


def test_same_and_different_places(spark):
    # the boulevard of the same name is another street, yet one without a kind of street may be either
    got = pairs(spark, A + A[:3])
    one = {1, 2, 3, 4, 5}
    want = {(a, b) for a in one for b in one if a < b} | {(2, 10), (11, 12), (16, 17)}
    assert got == want


def test_two_common_names_one_letter_apart_differ(spark):
    rows = [(i, f"ул. {'Калинова' if i % 2 else 'Малинова'} чешма {i // 20 + 1}", "Градец") for i in range(40)]
    got = pairs(spark, rows)
    assert got and all(a % 2 == b % 2 for a, b in got)


def test_two_slips_of_one_word_are_one_place_however_often_each_is_made(spark):
    # the two slips are written about alike often; only the word they are slips of tells that they are none of two names
    for k in (1, 8):
        word = [(i, f"ул. Бистришка {i % 200 + 1}", "Градец") for i in range(40 * k)]
        slips = [(1000 + 2 * i + j, f"ул. {w} {i + 500}", "Градец") for i in range(k) for j, w in enumerate(("Бистрешка", "Бистртшка"))]
        got = pairs(spark, word + slips)
        assert {(1000 + 2 * i, 1001 + 2 * i) for i in range(k)} <= got
    # a slip belongs to the nearest word alone
    rows = [(i, f"ул. {('Габарска', 'Рибарска')[i % 2]} {i % 50 + 1}", "Градец") for i in range(200)] + [(300, "ул. Габарскк 900", "Градец"), (301, "ул. Рибарскк 900", "Градец")]
    assert (300, 301) not in pairs(spark, rows)


def test_parts():
    assert parse("кв. „Пясъчника“, блок 4 б", "Песелидол")[2:5] == ("estate", "", "4b")
    assert parse("Ул. «Kestenova porta» No98, Humikadevo, 1217 гр. Хумикадево", "Хумикадево")[1:2] == ("1217",)
    assert parse("адресът се уточнява", "X") is None and parse(None, None) is None
    assert assign(["градина"], ["градина", "роща"]) is None


def test_empty_and_very_long(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, "до парка, " * 20_000 + "ул. Роза 5", "Г"), (2, "ул. Роза 5", "Г")]) == {(1, 2)}


def test_assignment_is_the_cheapest_for_any_number_of_tokens():
    words = "роза липа бреза топола ясен дъб бор кестен върба".split()
    for n in (2, 6, 7, 9):
        swapped = [words[1], words[0], *words[2:n]]
        assert sorted(assign(words[:n], swapped)) == sorted(zip(words[:n], words[:n]))
        assert assign(words[:n], [*words[1:n], "планина"]) is None
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 5)
        costs = [[rng.choice([None, 0, 1, 2, 3]) for _ in range(n)] for _ in range(n)]
        best = min((sum(costs[i][p[i]] for i in range(n)) for p in permutations(range(n)) if all(costs[i][p[i]] is not None for i in range(n))), default=None)
        got = cheapest(costs)
        assert (got is None) == (best is None) and (got is None or sorted(got) == list(range(n)) and sum(costs[i][got[i]] for i in range(n)) == best)

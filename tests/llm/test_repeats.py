from pyspark.sql import functions as F

from veyra.llm.repeats import LINE, leaves, lines_of, repeated_lines, templated_lines, without_lines

COLS = "page_id long, url string, raw_markdown string, site string, key string, line_no int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", "k", 1) for r in rows], COLS)


def test_lines_on_enough_pages(spark):
    rows = [(i, f"https://WWW.Shop.example:443/p{i}/", f"Всички права!\nстраница {i}\n\nобщо  {i % 2}\nвсички ПРАВА") for i in range(8)]
    rows += [(50, "http://shop.example/P0", "Всички права"), (51, "shop.example/p1?x#y", "друго"), (60, "https://b.example/1", "Всички права"), (61, None, "Всички права"), (62, "https://b.example/2", None), (63, "", "x")]
    rows += [(70 + i, "https://c.example/same", "навсякъде") for i in range(9)]
    got = {(r.page_id, r.line_no) for r in repeated_lines(pages(spark, rows + rows[:2])).collect()}
    assert got == {(i, n) for i in range(8) for n in (1, 5)} | {(50, 1)}


def test_templates_are_removed_with_their_slots(spark):
    rows = [(i, "https://a.example/%d" % i, f"Прочетено {i * 7} пъти, Градец\nСтара новина номер {i} от {chr(1072 + i) * 4}\nсамо тук {chr(1072 + i) * 3}") for i in range(8)]
    rows += [(50 + i, "https://b.example/%d" % i, "Прочетено 3 пъти, Градец") for i in range(7)]
    got = {(r.page_id, r.line_no): r.template for r in templated_lines(pages(spark, rows)).collect()}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in range(8)}  # counters differ, the template is one; seven pages are too few
    assert len({v for k, v in got.items() if k[1] == 1}) == 1 and "*" in got[0, 1]
    assert {(r.page_id, r.line_no) for r in repeated_lines(pages(spark, rows)).collect()} == set()


def test_a_node_of_many_children_is_a_slot_and_equal_lines_share_a_leaf(spark):
    rows = [(i, "https://a.example/%d" % i, f"{chr(1072 + i % 32)}{chr(1072 + i // 32)}бвгде край\nобщо за всички") for i in range(100)]
    keys = lines_of(pages(spark, rows)).select("site", F.xxhash64("key").alias("k1"), F.lit(0).cast("long").alias("k2"), "key").dropDuplicates(LINE)
    at = {r.key: r.leaf for r in keys.join(leaves(keys), LINE).collect()}
    assert len(at) == 101 and len(set(at.values())) == 2
    assert len({r.leaf for r in leaves(keys, children=1000).collect()}) > 90


def test_removal_and_empty(spark):
    df = pages(spark, [(1, "https://a.example/1", "a\nb\n\nc"), (2, "https://a.example/2", None), (3, "https://a.example/3", "")])
    hits = spark.createDataFrame([(1, 2), (1, 4), (3, 1)], "page_id long, line_no int")
    assert {r.page_id: r.kept_text for r in without_lines(df, hits).collect()} == {1: "a\n", 2: None, 3: ""}
    assert repeated_lines(pages(spark, [])).count() == 0


def test_very_long_lines(spark):
    rows = [(i, f"https://a.example/{i}", "дълъг " * 20_000) for i in range(8)]
    assert repeated_lines(pages(spark, rows)).count() == 8

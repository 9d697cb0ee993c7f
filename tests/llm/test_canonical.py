from veyra.llm.canonical import fee_values, known_aliases, map_to_list

VALUES = "table_name string, row_id long, field string, value string"
ENTRIES = "entry_code string, field string, name_en string, name_bg string, other_names array<string>, value string"
LIST = [
    ("C01", "category", "tuition", "такса обучение", ["school fee"], "x"),
    ("C02", "category", "food", "хранене", ["meals"], "x"),
    ("P02", "period", "yearly", "годишно", ["per year", "на година"], "x"),
    ("P01", "period", "monthly", "месечно", None, "x"),
    ("L01", "label", "full-day care", "целодневна грижа", [], "x"),
    ("L02", "label", "half-day care", "полудневна грижа", [], "x"),
    (None, "label", "nothing", "нищо", [], "x"),
]


def run(spark, values, entries=LIST, **kw):
    rows = [("t", i, f, v) for i, (f, v) in enumerate(values)]
    out = map_to_list(spark.createDataFrame(rows, VALUES), spark.createDataFrame(entries, ENTRIES), aliases=known_aliases(), **kw)
    return {r.row_id: r.entry_code for r in out.collect()}


CASES = [
    ("category", "ТАКСА ОБУЧЕНИЕ", "C01"), ("category", "такса_за_обучение", "C01"), ("category", "тaкca oбучeниe", "C01"), ("category", "taksa obuchenie", "C01"), ("category", "fee school", "C01"), ("category", "tuiion", "C01"),
    ("category", "hranene", "C02"), ("category", "хранене в стола", "C02"), ("category", "ДДС", "unmatched"), ("category", "—", "unmatched"), ("period", "food", "unmatched"),
    ("period", "p.a.", "P02"), ("period", "веднъж на две години", "unmatched"), ("period", "гoдишнo *", "P02"), ("period", "p.m.", "P01"),
    ("label", "1. целодневна-грижа / Ценоразпис 2026/2027", "L01"), ("label", "цена полдневна грижа за дете", "L02"), ("label", "Ремонт на покрива", "unmatched"),
]


def test_cases(spark):
    assert run(spark, [c[:2] for c in CASES]) == {i: c[2] for i, c in enumerate(CASES)}


def test_null_blank_repeats_ties_and_long(spark):
    assert run(spark, [("category", None), ("category", "  "), ("category", ""), ("category", " ")]) == {}
    assert run(spark, [("category", "food tuition")]) == {0: "C01"}
    assert run(spark, [("category", "x " * 50_000 + "food")]) == {0: "C02"}
    df = spark.createDataFrame([("t", 1, "category", "food")] * 3, VALUES)
    assert map_to_list(df, spark.createDataFrame(LIST, ENTRIES)).count() == 1


def test_empty_list_and_a_list_read_in_parts(spark):
    assert run(spark, [("category", "food")], entries=[]) == {0: "unmatched"}
    assert run(spark, [c[:2] for c in CASES], most_entries=2) == {i: c[2] for i, c in enumerate(CASES)}


def test_the_number_of_parts_changes_nothing(spark):
    entries = [("A", "category", "school bus", None, None, ""), ("B", "category", "bus", None, None, ""), ("C", "category", "fee", None, None, ""), ("D", "category", "lunch menu", None, None, ""), ("E", "category", "menu card", None, None, "")]
    values = [("category", v) for v in ("school bus fee", "bus fee", "lunch menu card", "scool buss", "menu lunhc", "shcool", "fees bus")]
    want = run(spark, values, entries)
    assert want[0] == "A" and want[1] == "B" and want[2] == "D"
    for n in (1, 2, 3):
        assert run(spark, values, entries, most_entries=n) == want


def test_fee_values_reads_three_columns(spark):
    a = spark.createDataFrame([(1, "a", "b", "z")], "fee_id long, category string, period string, value string")
    b = spark.createDataFrame([(2, "c", "z")], "line_id long, label string, field string")
    assert sorted(map(tuple, fee_values(a, b).collect())) == [("fee_lines", 2, "label", "c"), ("missed_fees", 1, "category", "a"), ("missed_fees", 1, "period", "b")]

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veyra.sources import files, sinks


def test_wide_scores_with_preamble_two_header_rows_and_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Резултати 2024\n\nКод,Училище,БЕЛ,,МАТ,\n,,Ср. успех,Явили се,Ср. успех,Явили се\n1,Първо,\"45,5\",20,0,10\n2,Второ,-,,60.25,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Код;Училище;БЕЛ Ср. успех;БЕЛ Явили се\n3;Трето;50;7\n;;1;1\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("nothing here", encoding="utf-8")
    got = {tuple(r) for r in files.wide_scores(spark, str(tmp_path), {"code": ["Код", "Код по НЕИСПУО"], "school": ["Училище"]}, ("Ср. успех",), ("Явили се",)).collect()}
    assert got == {("a.csv", "1", "Първо", "бел", 45.5, 20), ("a.csv", "2", "Второ", "мат", 60.25, None), ("b.csv", "3", "Трето", "бел", 50.0, 7)}


def test_register_drops_bad_coordinates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("rn;street;n;e\n1;A;42,7;23.3\n2;B;x;23\n3;C;99;23\n4;D;;\n")
    assert [r.rn for r in files.address_register(spark, str(tmp_path / "r.csv")).collect()] == ["1"]


def test_feature_collection_keeps_the_better(spark, tmp_path):
    f = lambda k, q: {"type": "Feature", "properties": {"id": k, "q": q}, "geometry": {"type": "Point", "coordinates": [23, 42]}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [f("a", 1), f("a", 5), f("b", 2), f(None, 9)]}))
    got = {r.key: r.properties["q"] for r in files.feature_collection(spark, str(tmp_path / "g.json"), "id", "q").collect()}
    assert got == {"a": "5", "b": "2"}


def test_dump_timetable_elements_and_partitions(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1\ta\\tb\t\\N\n2\tx\\\\y\tz\n\\.\n")
    assert [tuple(r) for r in files.copy_dump(spark, str(tmp_path / "d.txt"), ["i", "s", "n"]).collect()] == [("1", "a\tb", None), ("2", "x\\y", "z")]
    (tmp_path / "stop_times.txt").write_text('trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,08:00:10,08:01:00,"S,1",1\nT1,25:00:00,25:00:00,S2,2\n')
    assert [tuple(r) for r in files.timetable(spark, str(tmp_path)).collect()] == [("T1", 1, "S,1", 28810, 28860), ("T1", 2, "S2", 90000, 90000)]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "way", "id": 7, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"a": "b"}}]}))
    assert files.elements(spark, str(tmp_path / "o.json")).first().lat == 1.0
    for c in ("x", "y"):
        (tmp_path / "p" / f"city={c}").mkdir(parents=True)
        (tmp_path / "p" / f"city={c}" / "1.json").write_text('{"v": 1}\n')
    assert files.partitioned_json(spark, str(tmp_path / "p"), "v int, city string").filter("city = 'x'").count() == 1


def test_copy_dump_reads_each_escape_once(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\\\\tb\tc\\td\t\\\\N\n")
    assert tuple(files.copy_dump(spark, str(tmp_path / "e.txt"), ["x", "y", "z"]).first()) == ("a\\tb", "c\td", "\\N")


def test_packed_numbers_round_trip():
    v = np.array([42.12345, 42.1, -7.0, 0.0])
    assert files.unpack_deltas(files.pack_deltas(v)) == pytest.approx(v)


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = str(tmp_path / "s.xlsx")
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Име</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    spark.dataSource.register(files.SheetSource)
    got = spark.read.format("sheet").option("path", p).load().orderBy("row").collect()
    assert [r.cells for r in got] == [["Име", None, "5"], [None, "x"]]


def test_merge_into_partitions_touches_only_these(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, part string")
    sinks.merge_partitions(spark, path, df([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")]), ["k"], ["part"])
    before = {f for f in map(str, (tmp_path / "t" / "part=y").iterdir())}
    sinks.merge_partitions(spark, path, df([(2, "B", "x"), (4, "d", "x")]), ["k"], ["part"])
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "part").collect())) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "y"), (4, "d", "x")]
    assert {f for f in map(str, (tmp_path / "t" / "part=y").iterdir())} == before


def test_replace_json_and_calendar(spark, tmp_path):
    p = str(tmp_path / "r")
    sinks.replace_table(spark.range(3).toDF("i"), p)
    sinks.replace_table(spark.range(5).toDF("i"), p)
    assert spark.read.parquet(p).count() == 5
    df = spark.createDataFrame([(1, None, "secret")], "a int, b string, c string")
    assert sinks.allowlisted_json(df, ["a", "b"]).first().value == '{"a":1}'
    ev = spark.createDataFrame([(1, "2025-09-15", "Прием, " * 20)], "id int, d string, s string").withColumn("d", F.to_date("d"))
    text = sinks.calendar_lines(ev, "id", "d", "s").first().value
    assert "DTSTART;VALUE=DATE:20250915" in text and all(len(x.encode()) <= 75 for x in text.split("\r\n"))
    assert text.replace("\r\n ", "").count("Прием\\,") == 20

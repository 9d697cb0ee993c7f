import json

import pytest
from pyspark.sql import functions as F

from veyra.functions.html import signals, table_sections
from veyra.operators.places import joined_rings, nearest_edges
from veyra.sources.recorded import RecordedSource, changed_items, digest, map_extract, paged, reused_snapshot, road_rules


def test_answers_are_replayed_page_by_page(spark, tmp_path):
    for branch, pages in {"a": [({"b": [{"y": 1, "x": 2}, {"z": None}]}, 2), ({"b": []}, 3), ({"b": [{"k": 3}]}, None), ({"b": [{"never": 1}]}, 4)], "c": [({"b": [7]}, 2)]}.items():
        (tmp_path / branch).mkdir()
        for i, (items, nxt) in enumerate(pages):
            (tmp_path / branch / f"{i:03}.json").write_text(json.dumps({"items": items, "next": nxt}))
    spark.dataSource.register(RecordedSource)
    df = spark.read.format("recorded").option("path", str(tmp_path)).option("items", "items.b").load()
    got = sorted(map(tuple, df.collect()))
    assert [(b, p, i) for b, p, i, _ in got] == [("a", 1, '{"x":2,"y":1}'), ("a", 1, '{"z":null}'), ("a", 3, '{"k":3}'), ("c", 1, "7")]
    assert got[0][3] == digest({"x": 2, "y": 1}) and list(paged(lambda p: None, "items")) == []
    new = df.filter("item != '7'").withColumn("hash", F.when(F.col("item").contains("k"), "other").otherwise(F.col("hash")))
    assert {r.item: r.state for r in changed_items(df, new, ["branch", "item"]).collect()} == {'{"x":2,"y":1}': "same", '{"z":null}': "same", '{"k":3}': "changed", "7": "gone"}


def test_a_snapshot_is_kept_while_it_does_not_change():
    assert reused_snapshot(lambda tag: (200, "t1", "body"), None) == ("t1", "body")
    assert reused_snapshot(lambda tag: (304, None, None) if tag == "t1" else (200, "t2", "new"), ("t1", "body")) == ("t1", "body")
    with pytest.raises(OSError):
        reused_snapshot(lambda tag: (500, None, None), None)


def test_map_extract_and_rules(spark, tmp_path):
    (tmp_path / "m.osm").write_text("""<osm><node id="1" lat="42.5" lon="23.1"/><node id="2" lat="42.6" lon="23.2"><tag k="a" v="b"/></node>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary_link"/><tag k="maxspeed" v="30 mph"/></way><way id="8"><nd ref="2"/><tag k="building" v="yes"/></way>
<way id="9"><nd ref="1"/><tag k="highway" v="service"/><tag k="access" v="private"/></way><relation id="5"><member type="way" ref="7" role="from"/><tag k="highway" v="x"/></relation></osm>""")
    df = map_extract(spark, str(tmp_path), ["highway"])
    assert sorted((r.type, r.id) for r in df.collect()) == [("node", 1), ("node", 2), ("relation", 5), ("way", 7), ("way", 9)]
    speed, cars = road_rules(F.col("tags"))
    assert {r.id: (r.s, r.c) for r in df.filter("type = 'way'").select("id", speed.alias("s"), cars.alias("c")).collect()} == {7: (48.3, True), 9: (20.0, False)}
    assert df.filter("type = 'relation'").first().members[0].ref == 7


def test_rings_and_edges(spark):
    p = lambda *xs: [{"lng": float(x), "lat": float(y)} for x, y in xs]
    rows = [(1, p((0, 0), (1, 0))), (1, p((1, 1), (1, 0))), (1, p((1, 1), (0, 1), (0, 0))), (2, p((5, 5), (6, 6))), (2, p((6, 6), (7, 5))), (3, None), (3, [])]
    df = spark.createDataFrame(rows, "id long, piece array<struct<lng double, lat double>>")
    got = {r.id: (len(r.ring), r.closed) for r in joined_rings(df, "id", "piece").collect()}
    assert got == {1: (5, True), 2: (3, False)}
    pts = spark.createDataFrame([(1, 42.0, 23.0), (2, 42.0, 24.0)], "id long, lat double, lng double")
    edges = spark.createDataFrame([(22.99, 42.005, 23.01, 42.005), (22.99, 42.005, 22.99, 42.005)], "x1 double, y1 double, x2 double, y2 double")
    near = nearest_edges(pts, edges, 1200.0).groupBy("id").agg(F.min("metres").alias("m")).collect()
    assert [(r.id, round(r.m, 1)) for r in near] == [(1, 556.6)]


def test_html():
    page = """<html><head><title> A &amp; B </title><meta property="og:site_name" content="S"><meta name="description" content="D"><script type="application/ld+json">{"@type": "School"}</script>
    <script type="application/ld+json">{broken</script><style>.x{}</style></head><body><h1>Head</h1><p>One <b>two</b></p><a href="../x?y">link <img alt="pic"></a><a href="../x?y">again</a><noscript><a href="/no">no</a></noscript></body></html>"""
    got = signals(page, "https://h.example/a/b")
    assert (got["title"], got["site"], got["description"], got["data"]) == ("A & B", "S", "D", [{"@type": "School"}])
    assert got["links"] == {"https://h.example/x?y": "link pic"} and got["text"].split("\n")[:2] == ["Head", "One two"]
    assert signals(None)["text"] == "" and signals("<p>x")["text"] == "x"
    table = "<table><tr><th>First</th></tr><tr><td>a</td><td>1</td></tr><tr></tr><tr><td colspan=2>Second </td></tr><tr><td>b</td><td> 2 </td></tr></table>"
    assert table_sections(table) == [("First", ["a", "1"]), ("Second", ["b", "2"])]

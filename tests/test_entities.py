import json
import sqlite3

import pytest
from golden import OPTIONS, TYPE, pathbuilder, quads

from quadloom.operators import entities
from quadloom.operators.graph import build_graph
from quadloom.operators.lookup import Lookup, join_public, page_links
from quadloom.sinks import export


@pytest.fixture(scope="module")
def extracted(spark):
    pb = pathbuilder()
    g = build_graph(quads(spark), **OPTIONS)
    return g, entities.extract_all(g, pb, persist=True)


def test_nested(extracted):
    _, tables = extracted
    rows = {r.uri: r for r in entities.nested(tables["obj"]).collect()}
    assert set(rows) == {"a1", "a2"}
    a = rows["a1"]
    assert [(v.value, v.lang) for v in a.field__label] == [("Krug", "de")] * 2
    assert [v.value for v in a.field__maker] == ["Anna"] and [v.value for v in a.field__maker_ref] == ["b1"]
    assert [c.uri for c in a.bundle__part] == ["p1"] and [v.value for v in a.bundle__part[0].field__plabel] == ["Handle"]
    b = rows["a2"]
    assert b.field__label == [] and b.bundle__part == [] and [v.value for v in b.field__maker] == ["Anna"]
    assert b.path == ["a2"]


def test_mask_loses_the_inferred_maker(spark):
    pb = pathbuilder()
    g = build_graph(quads(spark), masks=pb.masks(TYPE), **OPTIONS)
    rows = {r.uri: r for r in entities.nested(entities.extract(g, pb.bundles[0])).collect()}
    assert [v.value for v in rows["a1"].field__maker] == ["Anna"] and rows["a2"].field__maker == []


def test_wide_and_long(extracted):
    _, tables = extracted
    t = tables["obj"]
    rows = {r.uri: r for r in entities.wide(t).collect()}
    assert rows["a1"].field__label == "Krug; Krug" and rows["a2"].field__label is None
    assert {r.field__label for r in entities.wide(t, cell_format="pair").collect()} == {"{Krug de}; {Krug de}", None}
    with pytest.raises(ValueError):
        entities.wide(t, cell_format="x")
    child = entities.wide(t.children[0]).collect()
    assert [(r.uri, r.parent, r.field__plabel) for r in child] == [("p1", "a1", "Handle")]
    frames = export.tables(tables, "long")
    assert set(frames) == {"bundle__obj", "field__obj__label", "field__obj__maker", "field__obj__maker_ref", "bundle__part", "field__part__plabel"}
    assert [tuple(r) for r in frames["field__obj__label"].collect()] == [("a1", "Krug", "de")] * 2


def test_all_triples_and_text(extracted):
    g, tables = extracted
    t = entities.all_triples(g, tables["obj"])
    lines = {(r.uri, r.line) for r in export.ntriples(t).collect()}
    assert ("a1", '<a1> <label> "Krug"@de .') in lines and ("a1", '<p1> <label> "Handle" .') in lines
    assert ("a1", "<a1> <madeBy> <b1> .") in lines
    assert ("a1", "<a1> <madeBy> <b2> .") in {(r.uri, r.line) for r in export.ntriples(t, canonical=False).collect()}
    turtle = {r.uri: r.turtle for r in export.turtle(t).collect()}
    assert '<a1> <type> <Object> ;\n    <madeBy> <b1> ;\n    <label> "Krug"@de, "Krug"@de ;\n    <hasPart> <p1> .' in turtle["a1"]
    view = {r.uri: r for r in export.graph_view(t).collect()}
    assert ["a1", "hasPart", "p1"] in view["a1"].edges and ["p1", "label", "Handle", ""] in view["a1"].literals


def test_files(extracted, tmp_path, spark):
    _, tables = extracted
    frames = export.tables(tables)
    export.to_csv(frames, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv/bundle__obj"))
    assert {(r.uri, r.field__label) for r in back.collect()} == {("a1", "Krug; Krug"), ("a2", None)}
    export.to_parquet(frames, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq/bundle__part")).count() == 1
    for _ in range(2):  # the second run replaces the first
        export.to_sqlite(frames, str(tmp_path / "x.db"), batch_size=1)
    db = sqlite3.connect(tmp_path / "x.db")
    assert db.execute("select uri, parent, field__plabel from bundle__part").fetchall() == [("p1", "a1", "Handle")]
    export.to_json(tables, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/obj")).count() == 2
    j = {r.uri: json.loads(r.json) for r in export.json_rows(tables["obj"]).collect()}
    assert j["a2"]["field__label"] == [] and j["a1"]["bundle__part"][0]["uri"] == "p1"
    with pytest.raises(ValueError):
        list(export.batches(iter([(1, 2)]), 2, 10, 1))


def test_lookup(extracted, spark):
    g, tables = extracted
    look = Lookup(g, tables)
    assert look.bundle_names() == ["obj"] and look.entities("obj").count() == 2
    uris = spark.createDataFrame([("b2",), ("a1",), ("zz",)], "uri string")
    assert {tuple(r) for r in look.bundle_of(uris).select("uri", "canonical", "bundle").collect()} == {("b2", "b1", None), ("a1", "a1", "obj"), ("zz", "zz", None)}
    assert [r.label for r in look.aliases("b1").collect()] == ["b2"] and look.aliases("b2").count() == 0
    found = look.first_bundle(spark.createDataFrame([(1, ["zz", "a2", "a1"]), (2, ["zz"])], "id int, uris array<string>")).collect()
    assert [tuple(r) for r in found] == [(1, "a2", "obj")]
    assert look.entity("a1", "obj").first().uri == "a1" and look.entity("zz", "obj").count() == 0
    assert [r.uri for r in look.page("obj", 1, 5).collect()] == ["a2"] and look.page("obj", 2).count() == 0
    assert look.navigate("x", ["http://h"]).count() == 0
    assert look.resolve(" a1 ") == ("obj", "a1") and look.resolve("zz") is None


def test_pages_and_addresses():
    assert join_public("http://h/base/", "/a/1") == ["http://h/base/a/1", "https://h/base/a/1"]
    assert page_links(250, 100, 100) == {"first": 0, "previous": 0, "next": 200, "last": 200}
    assert page_links(0, 0, 100) == {"first": None, "previous": None, "next": None, "last": None}


def test_load_and_export_from_files(spark, tmp_path):
    from golden import STATEMENTS

    from quadloom.plans.load import export_all, load
    from quadloom.sources.pathbuilder import dumps_xml

    lines = [f"<{s}> <{p}> " + (f"<{o}>" if o else f'"{v}"' + (f"@{lang}" if lang else "")) + " <g> .\n" for s, p, o, v, lang in STATEMENTS]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.nq").write_text("".join(lines))
    (tmp_path / "in/x.xml").write_text(dumps_xml(pathbuilder()))
    g, bundles, look = load(spark, str(tmp_path / "in"), **OPTIONS)
    s = g.stats().first()
    assert (s.direct, s.inverse, s.datum, s.conflict, s.masked_pred, s.masked_data) == (6, 1, 4, 2, 5, 1)
    assert look.resolve("a1") == ("obj", "a1")
    for target, name in (("sqlite", "o.db"), ("csv", "csv"), ("parquet", "pq"), ("json", "json")):
        export_all(bundles, target, str(tmp_path / name))
    assert spark.read.parquet(str(tmp_path / "pq/bundle__obj")).count() == 2
    with pytest.raises(ValueError):
        export_all(bundles, "xlsx", "x")

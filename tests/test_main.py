"""The command line over the golden graph, and exports to databases and documents."""

import io
import json
import sqlite3

import pytest
from golden import OPTIONS, STATEMENTS, pathbuilder

from quadloom.__main__ import main
from quadloom.functions.terms import RDF_TYPE
from quadloom.plans.stages import Stages
from quadloom.sinks import export
from quadloom.sources.pathbuilder import dumps_xml


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    at = tmp_path_factory.mktemp("source")
    term = lambda x: f"<{RDF_TYPE}>" if x == OPTIONS["type_predicate"] else f"<{x}>"
    lines = [f"<{s}> {term(p)} " + (f"<{o}>" if o else f'"{v}"' + (f"@{lang}" if lang else "")) + " .\n" for s, p, o, v, lang in STATEMENTS]
    (at / "x.nq").write_text("".join(lines))
    (at / "x.xml").write_text(dumps_xml(pathbuilder()))
    return str(at)


@pytest.fixture
def run(spark, source):
    def call(command, *args):
        out = io.StringIO()
        named = ["--same-as", ",".join(OPTIONS["same_as"]), "--inverse-of", ",".join(OPTIONS["inverse_of"])]
        return main([command, source, *named, *args], spark, out), out.getvalue()

    return call


def test_view(run, spark):
    assert run("view") == (0, "obj\n")
    assert run("view", "--bundle", "obj", "--skip", "1") == (0, "a2\n")
    code, text = run("view", "--bundle", "obj", "--uri", "a1")
    assert code == 0 and json.loads(text)["bundle__part"][0]["uri"] == "p1"
    assert json.loads(run("view", "--get", "a1")[1]) == {"bundle": "obj", "uri": "a1"}
    assert run("view", "--get", "zz") == (1, "null\n") and run("view", "--bundle", "none")[0] == 1


def test_triples_and_bench(run):
    code, text = run("triples", "--bundle", "obj", "--uri", "a1")
    assert code == 0 and '<p1> <label> "Handle" .' in text.splitlines()
    assert "<hasPart> <p1>" in run("triples", "--bundle", "obj", "--format", "ttl")[1]
    code, text = run("bench")
    done = json.loads(text)
    assert [s["stage"] for s in done["stages"]] == ["schema", "graph", "bundles", "counts"] and done["stages"][3]["entities"] == {"obj": 2}
    assert done["stages"][3]["direct"] == 6 and done["seconds"] > 0


def test_export(run, spark, tmp_path):
    assert run("export", "--to", str(tmp_path / "o.db"), "--format", "sqlite", "--batch-size", "1")[0] == 0
    db = sqlite3.connect(tmp_path / "o.db")
    assert db.execute("select uri, parent, field__plabel from bundle__part").fetchall() == [("p1", "a1", "Handle")]
    assert run("export", "--to", str(tmp_path / "o.json"), "--format", "json-document")[0] == 0
    whole = json.loads((tmp_path / "o.json").read_text())
    assert list(whole) == ["obj"] and [e["uri"] for e in whole["obj"]] == ["a1", "a2"]
    with pytest.raises(SystemExit):
        main(["export", "a", "b", "c", "--to", "x"], spark)


def test_jdbc(run, spark, tmp_path):
    """Through Spark's JDBC writer into the database whose driver comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    for _ in range(2):  # the second run replaces the first
        assert run("export", "--to", url, "--format", "jdbc", "--batch-size", "1")[0] == 0
    rows = spark.read.jdbc(url, '"bundle__part"').collect() if _quoted(spark, url) else spark.read.jdbc(url, "bundle__part").collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [("p1", "a1", "Handle")]
    with pytest.raises(ValueError):
        export.to_jdbc({}, url, batch_size=0)


def _quoted(spark, url):
    try:
        spark.read.jdbc(url, "bundle__part").schema
        return False
    except Exception:
        return True


def test_stages_note_failures():
    s = Stages()
    with s.stage("one") as done:
        done(rows=3)
    with pytest.raises(KeyError), s.stage("two"):
        raise KeyError("x")
    assert [r["stage"] for r in s.done] == ["one", "two"] and s.done[0]["rows"] == 3 and s.done[1]["error"].startswith("KeyError")

import pytest

from quadloom.functions.html import local_url, replace_links, replace_links_column
from quadloom.functions.terms import parse_predicates
from quadloom.sources import nquads
from quadloom.sources.pathbuilder import dumps_xml, find_source, loads_xml

LINES = [
    '<s> <p> <o> <g> .',
    '_:b1 <p> _:b2 .',
    '<s> <p> "a\\tb\\n\\"q\\" \\\\ \\u00e9 \\U0001F600 \\uD83D\\uDE00 \\\'"@en-GB <g>.',
    '<s> <p> "1"^^<int> . # note',
    '"lit" <p> <o> .',
    '<s> "lit" <o> .',
    "",
    "# only a comment",
    '<s> <p> "raw\ttab" .',
    '<s> <p> "" .',
    '<s\\u0041> <p> <o> _:g .',
]


def parse(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    return nquads.parse_lines(df, **options).orderBy("ord").collect()


def test_statements(spark):
    rows = {r.ord: r for r in parse(spark, LINES)}
    assert sorted(rows) == [0, 1, 2, 3, 8, 9, 10]
    assert tuple(rows[0])[1:] == ("s", "p", "o", None, "", None, "g")
    assert (rows[1].s, rows[1].o, rows[1].graph) == ("_:b1", "_:b2", "")
    assert rows[2].value == 'a\tb\n"q" \\ é 😀 😀 \'' and rows[2].lang == "en-GB" and rows[2].graph == "g"
    assert (rows[3].value, rows[3].datatype, rows[3].lang) == ("1", "int", "")
    assert rows[8].value == "raw\ttab" and rows[9].value == "" and rows[9].o is None
    assert rows[10].s == "sA" and rows[10].graph == "_:g"


def test_bad_lines(spark):
    bad = ["<s> <p> .", '<s> <p> "x\\q" .', "<s> <p> <o>", "<s> <p> <o> ."]
    with pytest.raises(Exception, match="not a statement"):
        parse(spark, bad)
    assert [r.ord for r in parse(spark, bad, on_bad_line="skip")] == [3]
    rows = parse(spark, bad, on_bad_line="quarantine")
    assert [r.bad for r in rows] == [*bad[:3], None] and rows[0].s is None and rows[3].s == "s"
    with pytest.raises(ValueError):
        parse(spark, bad, on_bad_line="x")


def test_files_keep_their_order(spark, tmp_path):
    for f in "cab":
        (tmp_path / f"{f}.nq").write_text("".join(f"<{f}> <p> <{i}> .\n" for i in range(50)))
    rows = nquads.read_nquads(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.s, r.o) for r in rows] == [(f, str(i)) for f in "abc" for i in range(50)]
    assert [r.ord for r in rows] == list(range(150))


def test_round_trip(spark, tmp_path):
    rows = [(i, "s", "p", None if v is not None else "o", v, "", None, "g") for i, v in enumerate(["", "a\\b", "tab\t", 'q"', "\r\n\b\f", "é😀", "\\u0041", None])]
    q = spark.createDataFrame(rows, nquads.QUADS)
    nquads.write_nquads(q.coalesce(1), str(tmp_path / "out"))
    back = nquads.read_nquads(spark, str(tmp_path / "out")).collect()
    assert {tuple(r)[1:] for r in back} == {tuple(r)[1:] for r in q.collect()}


XML = """<pathbuilderinterface>
<path><id>b</id><weight>1</weight><enabled>1</enabled><group_id>0</group_id><is_group>1</is_group><path_array><x>A</x></path_array><uuid>u</uuid></path>
<path><id>f</id><group_id>b</group_id><path_array><x>A</x><y>p</y><x>B</x></path_array><datatype_property>d</datatype_property></path>
<path><id>g</id><group_id>b</group_id><path_array><x>A</x></path_array><datatype_property>empty</datatype_property></path>
<path><id>off</id><enabled>0</enabled><group_id>b</group_id><path_array><x>A</x></path_array></path>
<path><id>c</id><group_id>b</group_id><is_group>1</is_group><path_array><x>A</x><y>q</y><x>C</x></path_array></path>
<path><id>h</id><group_id>c</group_id><path_array><x>A</x><y>q</y></path_array><datatype_property>e</datatype_property></path>
</pathbuilderinterface>"""


def test_pathbuilder_xml():
    pb = loads_xml(XML)
    (b,) = pb.bundles
    assert b.machine_name == "b" and b.is_toplevel and b.path.extra == {"uuid": "u"}
    assert [f.id for f in b.child_fields] == ["f", "g"]
    assert b.child_fields[0].steps() == ["A", "p", "B", "d"] and b.child_fields[1].steps() == ["A"]
    c = pb.bundle("c")
    assert c.parent is b and c.uri_index == 1 and b.uri_index == 0 and pb.bundle("x") is None
    assert pb.masks("t") == ({"t", "p", "q"}, {"d", "e", "empty"})
    assert len(pb.problems()) == 1 and pb.problems()[0].startswith("h:")
    again = loads_xml(dumps_xml(pb))
    assert [x.machine_name for x in again.walk()] == ["b", "c"] and again.bundle("b").child_fields == b.child_fields


def test_find_source(tmp_path):
    with pytest.raises(ValueError, match=r"exactly one \.nq"):
        find_source(str(tmp_path))
    nq, xml = tmp_path / "a.nq", tmp_path / "a.xml"
    nq.write_text("")
    xml.write_text("")
    assert find_source(str(tmp_path)) == (str(nq), str(xml)) == find_source(str(xml), str(nq))
    with pytest.raises(FileNotFoundError):
        find_source(str(xml), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        find_source()


def test_predicates():
    assert parse_predicates(" a, b\n\nc,,\n ") == ["a", "b", "c"]


def test_links(spark):
    text = '<p class="x">see <a title="t" href="u1">it</a> &amp; <IMG src="u2"><br/>'
    assert replace_links(text, str.upper) == '<p class="x">see <a title="t" href="U1">it</a> &amp; <img src="U2"/><br/>'
    df = spark.createDataFrame([(text,), (None,)], "html string")
    assert [r[0] for r in df.select(replace_links_column(df.html, str.upper)).collect()][1] is None
    urls = spark.createDataFrame([("http://h/base/a?q#f",), ("http://other/base",), (None,)], "u string")
    assert [r[0] for r in urls.select(local_url(urls.u, ["http://h/base"])).collect()] == ["/base/a?q#f", "http://other/base", None]


@pytest.mark.parametrize(
    "text",
    [
        "<title>a &am</title>b &amp<p>&c d&#12 &#x1F z&amp;</p> &lt",
        "R&# a; &# b; ",
        '<?xml version="1.0"?><![CDATA[ a & b ]]><![if x]><![y[z]]></P ></>',
        """<p title="it's" class=x hidden  lang='&eacute;'>1 < 2 <3""",
        "<!-- <br> &am --><!--><script>'<a href=\"/n\">' &am</script>",
        "<p title='x>",
    ],
)
def test_links_leave_the_rest(text):
    link = '<a href="%s/x?a=1&amp;b=2">'
    assert replace_links(text + link % "", lambda u: "h" + u) == text + link % "h"


def test_links_forms():
    for before, after in [
        ("<A  HREF = '/x\"y' title=z>", '<a  href="h/x&quot;y" title=z>'),
        ('<a href="/x?a=1&copy=2&b" href="/y">', '<a href="h/x?a=1&copy=2&b" href="/y">'),
        ("<img alt='>' src=/x/>", '<img alt=\'>\' src="h/x/" />'),
        ("<img src=/x width=5><hr noshade><br /><input>", '<img src="h/x" width=5 /><hr noshade/><br /><input/>'),
        ("<script>'<a href=\"/x\">' &am", "<script>'<a href=\"/x\">' &am"),
        ('a &am <a href="/x', 'a &am <a href="/x'),
    ]:
        assert replace_links(before, lambda u: "h" + u) == after

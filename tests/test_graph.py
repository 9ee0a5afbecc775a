import random

import pytest
from golden import OPTIONS, SCHEMA, STATEMENTS, TYPE, pathbuilder, quads

from quadloom.functions.terms import DATA, INVERSE, REGULAR
from quadloom.operators.components import connected_components
from quadloom.operators.graph import Graph, build_graph
from quadloom.operators.identity import canonical_labels, fold_in_order
from quadloom.operators.paths import PathSet, compile_path


def edge(g, s, p, o):
    rows = g.edges.filter((g.edges.s_c == s) & (g.edges.p_c == p) & (g.edges.o_c == o)).collect()
    return rows[0] if rows else None


def test_golden_without_mask(spark):
    g = build_graph(quads(spark), **OPTIONS)
    assert {tuple(r) for r in g.canon.collect()} == {("C2", "C1"), ("b2", "b1")}
    assert {tuple(r) for r in g.inverse.collect()} == {("made", "madeBy"), ("madeBy", "made")}
    s = g.stats().first()
    assert (s.direct, s.inverse, s.datum, s.conflict, s.masked_pred, s.masked_data) == (10, 2, 5, 6, 0, 0)
    e = edge(g, "a1", "madeBy", "b1")
    assert (e.role, e.s_l, e.o_l) == (REGULAR, "a1", "b2")
    e = edge(g, "b1", "made", "a1")
    assert (e.role, e.s_l, e.p_l, e.o_l) == (REGULAR, "b1", "made", "a1")
    e = edge(g, "a2", "madeBy", "b1")
    assert (e.role, e.s_l, e.p_l, e.o_l) == (INVERSE, "b1", "made", "a2")
    assert g.triple_count() == 15 + 5


def test_golden_with_reference_mask(spark):
    g = build_graph(quads(spark), masks=pathbuilder().masks(TYPE), **OPTIONS)
    s = g.stats().first()
    assert (s.direct, s.inverse, s.datum, s.conflict, s.masked_pred, s.masked_data) == (6, 1, 4, 2, 5, 1)
    e = edge(g, "b1", "made", "a1")
    assert (e.role, e.s_l, e.p_l, e.o_l) == (INVERSE, "a1", "madeBy", "b2")
    assert edge(g, "a2", "madeBy", "b1") is None


def test_closed_mask_keeps_the_inverse_partner(spark):
    g = build_graph(quads(spark), masks=pathbuilder().masks(TYPE), mask_mode="closed", **OPTIONS)
    assert edge(g, "a2", "madeBy", "b1").role == INVERSE
    with pytest.raises(ValueError):
        build_graph(quads(spark), masks=pathbuilder().masks(TYPE), mask_mode="other", **OPTIONS)


def test_save_and_load(spark, tmp_path):
    g = build_graph(quads(spark), **OPTIONS)
    g.save(str(tmp_path))
    h = Graph.load(spark, str(tmp_path), TYPE)
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, h.edges.collect()))
    assert h.stats().first() == g.stats().first()


def test_representative_follows_the_order(spark):
    assert fold_in_order([("A", "C"), ("B", "C")]) == {"A": "B", "B": "B", "C": "B"}
    assert fold_in_order([("earth", "world")])["world"] == "earth"
    same = spark.createDataFrame([(1, "A", "C"), (2, "B", "C")], "ord long, s string, o string")
    for mode in ("driver", "distributed"):
        assert {tuple(r) for r in canonical_labels(same, mode).collect()} == {("A", "B"), ("C", "B")}


def naive_fold(pairs):
    canon = {}
    for same, old in pairs:
        canon.setdefault(same, same)
        canon.setdefault(old, old)
        gone, to = canon[old], canon[same]
        for k in canon:
            if canon[k] == gone:
                canon[k] = to
    return canon


@pytest.mark.parametrize("seed", range(30))
def test_fold_is_the_sequential_one(seed):
    r = random.Random(seed)
    pairs = [(str(r.randrange(25)), str(r.randrange(25))) for _ in range(r.randrange(1, 40))]
    assert fold_in_order(pairs) == naive_fold(pairs)


def test_distributed_identity_equals_the_driver_fold(spark):
    r = random.Random(5)
    rows = [(i, f"n{r.randrange(120)}", f"n{r.randrange(120)}") for i in range(100)]
    same = spark.createDataFrame(rows, "ord long, s string, o string")
    a = {tuple(x) for x in canonical_labels(same, "driver").collect()}
    assert a == {tuple(x) for x in canonical_labels(same, "distributed").collect()} and a
    with pytest.raises(ValueError):
        canonical_labels(same, "driver", driver_limit=10)


def test_inverse_map_rules(spark):
    def inv(*pairs, same=()):
        rows = [(i, a, p, b, None, "", None, "") for i, (a, p, b) in enumerate([*[(x, "inverseOf", y) for x, y in pairs], *[(x, "sameAs", y) for x, y in same]])]
        return {tuple(x) for x in build_graph(spark.createDataFrame(rows, SCHEMA), **OPTIONS).inverse.collect()}

    assert inv(("x", "y"), ("x", "z")) == {("x", "z"), ("y", "x"), ("z", "x")}
    assert inv(("x", "x")) == set()
    assert inv(("x", "y"), same=[("x", "y")]) == {("x", "x")}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)] + [(7, None)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root}


def test_hop_graph(spark):
    """A random graph of three hops with inverses and identical labels; every path and role is known."""
    n, r = 120, random.Random(1)
    rows = [("0", "inv", "-1", None), ("1", "inv", "-2", None)]
    for i in range(0, n, 2):
        rows.append((str(3 * i + 8), "same", f"-{3 * i + 8}", None))
    body = []
    for i in range(n):
        a, b, c = str(3 * i + 6), str(3 * i + 7), str(3 * i + 8)
        body.append((a, "0", b, None) if i % 4 in (0, 1) else (b, "-1", a, None))
        body.append((b, "1", c, None) if i % 4 in (0, 2) else (c, "-2", b, None))
        body += [(a, "2", "2", None), (b, "3", "3", None)]
        body.append((f"-{c}" if i % 4 == 0 else c, "3", None, str(i)))
    body += [(str(r.randrange(n)), p, str(r.randrange(n)), None) for p in "45" for _ in range(100)]
    q = spark.createDataFrame([(i, s, p, o, v, "", None, "") for i, (s, p, o, v) in enumerate(rows + body)], SCHEMA)
    g = build_graph(q, same_as=["same"], inverse_of=["inv"])
    ps = PathSet.starting(g, "2", "2").connected("0").ending("3", "3").connected("1").connected("3")
    triples = {x.tid: x for x in g.triples.collect()}
    got = {int(x.value): x for x in ps.paths().collect()}
    assert sorted(got) == list(range(n)) and ps.size().first().size == n
    for i, x in got.items():
        a, b, c = str(3 * i + 6), str(3 * i + 7), str(3 * i + 8)
        assert x.nodes == [a, b, c] and x.edges == ["0", "1", "3"] and x.has_datum
        t = [triples[k] for k in x.tids]
        assert [(k.s_subject, k.s_predicate, k.s_object) for k in t] == [(a, "2", "2"), (b, "3", "3"), (a, "0", b), (b, "1", c), (c, "3", None)]
        assert [k.role for k in t] == [REGULAR, REGULAR, REGULAR if i % 4 in (0, 1) else INVERSE, REGULAR if i % 4 in (0, 2) else INVERSE, DATA]
        assert (t[2].subject, t[2].predicate) == ((a, "0") if i % 4 in (0, 1) else (b, "-1"))
        assert t[4].subject == (f"-{c}" if i % 4 == 0 else c)


def test_paths_are_a_bag_and_may_be_empty(spark):
    g = build_graph(quads(spark), **OPTIONS)
    assert compile_path(g, ["Object", "label"]).size().first().size == 2
    assert compile_path(g, []).paths().count() == 0
    assert compile_path(g, ["Nowhere", "label"]).size().first().size == 0
    assert compile_path(g, ["Object", "label", "Person"]).size().first().size == 0


def test_empty_graph(spark):
    g = build_graph(quads(spark, []), **OPTIONS)
    assert g.stats().first().asDict() == dict.fromkeys(["direct", "datum", "masked_pred", "masked_data", "inverse", "conflict"], 0)
    assert len(STATEMENTS) == 17


@pytest.mark.parametrize("n", [200, 5000])
def test_many_inverse_statements(spark, n):
    """As table or as constants of the plan: the last statement of a property counts, in both directions."""
    stated = [(i, f"p{i * 7 % (n // 2)}", "inv", f"q{i * 11 % (n // 3)}") for i in range(n)]
    facts = [(n + i, f"s{i}", f"p{i}", f"o{i}") for i in range(n // 2)]
    rows = [(i, s, p, o, None, "", None, "") for i, s, p, o in stated + facts]
    g = build_graph(spark.createDataFrame(rows, SCHEMA), inverse_of=["inv"])
    inverse = {}
    for _, a, _, b in stated:
        inverse[a], inverse[b] = b, a
    got = {(r.s_c, r.p_c, r.o_c) for r in g.edges.filter("role = 1").collect()}
    assert got == {(o, inverse[p], s) for _, s, p, o in facts if p in inverse}
    assert {r.p: r.inv for r in g.inverse.collect()} == inverse


def test_saved_predicates_take_many_files(spark, tmp_path):
    rows = [(i, f"s{i}", "type", f"o{i % 3}", None, "", None, "") for i in range(2000)]
    g = build_graph(spark.createDataFrame(rows, SCHEMA).repartition(4), inverse_of=[])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g.save(str(tmp_path / "g"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "g" / "edges").glob("part-*.parquet"))) > 1
    back = Graph.load(spark, str(tmp_path / "g"))
    assert back.edges.count() == 2000 and back.having("type", "o1").count() == 667


def test_ranks_are_roles_before_tids(spark):
    """Of equal edges a path sees the one that the whole graph keeps."""
    rows = [(5, "a", "p", "b"), (3, "a", "p", "b"), (-7, "p", "inv", "q"), (-2, "b", "q", "a"), (1, "c", "q", "d")]
    q = spark.createDataFrame([(i, s, p, o, None, "", None, "") for i, s, p, o in rows], SCHEMA)
    g = build_graph(q, inverse_of=["inv"])
    for p in ("p", "q"):
        got = {(r.s, r.dst, r.tid) for r in g.step(p).collect()}
        assert got == {(r.s_c, r.o_c, r.tid) for r in g.edges.filter(g.edges.p_c == p).collect()}
    assert {(r.s, r.tid) for r in g.having("p", "b").collect()} == {("a", 6)}

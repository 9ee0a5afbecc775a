"""A graph of 17 statements whose every derived table is known."""

from quadloom.sources.pathbuilder import Path, from_paths

TYPE = "type"
#: (s, p, o, value, lang), in order from 1.
STATEMENTS = [
    ("C1", "eqClass", "C2", None, ""),
    ("b1", "sameAs", "b2", None, ""),
    ("made", "inverseOf", "madeBy", None, ""),
    ("a1", "type", "Object", None, ""),
    ("a1", "type", "Object", None, ""),
    ("b1", "type", "Person", None, ""),
    ("a1", "madeBy", "b2", None, ""),
    ("b1", "made", "a1", None, ""),
    ("a1", "label", None, "Krug", "de"),
    ("a1", "label", None, "Krug", "de"),
    ("b2", "name", None, "Anna", ""),
    ("a1", "hasPart", "p1", None, ""),
    ("p1", "type", "Part", None, ""),
    ("p1", "label", None, "Handle", ""),
    ("a2", "type", "Object", None, ""),
    ("b1", "made", "a2", None, ""),
    ("a2", "note", None, "x", ""),
]
SCHEMA = "ord long, s string, p string, o string, value string, lang string, datatype string, graph string"


def quads(spark, statements=STATEMENTS):
    rows = [(i, s, p, o, v, lang, None, "g") for i, (s, p, o, v, lang) in enumerate(statements, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def pathbuilder():
    return from_paths(
        [
            Path("obj", ["Object"], is_group=True),
            Path("label", ["Object"], "label", group_id="obj"),
            Path("maker", ["Object", "madeBy", "Person"], "name", group_id="obj"),
            Path("maker_ref", ["Object", "madeBy", "Person"], group_id="obj"),
            Path("part", ["Object", "hasPart", "Part"], is_group=True, group_id="obj"),
            Path("plabel", ["Object", "hasPart", "Part"], "label", group_id="part"),
        ]
    )


OPTIONS = {"same_as": ["sameAs", "eqClass"], "inverse_of": ["inverseOf"], "type_predicate": TYPE}

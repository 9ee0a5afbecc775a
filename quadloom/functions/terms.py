"""Vocabulary constants, roles of triples, and the schemas of the graph's tables."""

from __future__ import annotations

from pyspark.sql import types as T

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OWL = "http://www.w3.org/2002/07/owl#"
#: Predicates whose statements declare two labels identical, and two properties inverse.
SAME_AS = (OWL + "sameAs", OWL + "equivalentClass", OWL + "equivalentProperty")
INVERSE_OF = (OWL + "inverseOf",)

#: Why a triple is in the graph; of conflicting ones the smaller role stays.
REGULAR, INVERSE, DATA = 0, 1, 2

#: Starts the name of a literal's own node, which no label can have.
DATUM_PREFIX = "\0d"

QUADS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("s", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("o", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("datatype", T.StringType()),
        T.StructField("graph", T.StringType()),
    ]
)


def parse_predicates(text: str) -> list[str]:
    """Names from a list that commas or line ends separate; blanks are dropped."""
    return [p for p in (x.strip() for x in text.replace("\n", ",").split(",")) if p]

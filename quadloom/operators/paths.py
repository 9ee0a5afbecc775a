"""Path queries: chains of joins over the graph's adjacency.

A ``PathSet`` is a bag of paths.  Each step is one equi-join whose right side is
the adjacency of one predicate, so the filter reaches the scan and Catalyst
picks the join.  Two ways to the same node are two paths; two equal
literals are two values.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import DATUM_PREFIX
from quadloom.operators.graph import Graph
from quadloom.sources.pathbuilder import Path


@dataclasses.dataclass(frozen=True)
class PathSet:
    """``df`` has n0 .. n{last}, value, lang, ``done`` (triples of earlier nodes) and ``here`` (of the last)."""

    graph: Graph
    df: DataFrame
    last: int
    edges: tuple[str, ...] = ()

    @classmethod
    def starting(cls, graph: Graph, predicate: str, obj: str) -> PathSet:
        """Paths of one node: the subjects of (., predicate, obj)."""
        c = graph.canonical([predicate, obj])
        none = F.lit(None).cast("string")
        found = graph.having(c[predicate], c[obj])
        return cls(graph, found.select(F.col("s").alias("n0"), none.alias("value"), none.alias("lang"), F.array().cast("array<bigint>").alias("done"), F.array("tid").alias("here")), 0)

    def connected(self, predicate: str) -> PathSet:
        """One hop further along ``predicate``, to nodes and to literals."""
        p = self.graph.canonical([predicate])[predicate]
        step = self.graph.step(p).select(F.col("s").alias("_s"), F.col("dst").alias(f"n{self.last + 1}"), F.col("value").alias("_value"), F.col("lang").alias("_lang"), F.col("tid").alias("_tid"))
        joined = self.df.join(step, F.col(f"n{self.last}") == F.col("_s"))
        nodes = [f"n{i}" for i in range(self.last + 2)]
        df = joined.select(*nodes, F.col("_value").alias("value"), F.col("_lang").alias("lang"), F.concat("done", "here").alias("done"), F.array("_tid").alias("here"))
        return PathSet(self.graph, df, self.last + 1, (*self.edges, p))

    def ending(self, predicate: str, obj: str) -> PathSet:
        """Only paths whose last node has (node, predicate, obj); that triple goes before the edge to the node."""
        c = self.graph.canonical([predicate, obj])
        found = self.graph.having(c[predicate], c[obj]).select(F.col("s").alias("_s"), F.col("tid").alias("_tid"))
        joined = self.df.join(found, F.col(f"n{self.last}") == F.col("_s"))
        df = joined.withColumn("here", F.concat(F.array("_tid"), "here")).drop("_s", "_tid")
        return PathSet(self.graph, df, self.last, self.edges)

    @property
    def has_datum(self) -> Column:
        return F.col("value").isNotNull() & F.col(f"n{self.last}").startswith(DATUM_PREFIX)

    def paths(self) -> DataFrame:
        """nodes, edges, value, lang, has_datum, tids: a literal is not among the nodes."""
        nodes = F.array(*[f"n{i}" for i in range(self.last + 1)])
        datum = self.has_datum
        edges = F.array(*[F.lit(e) for e in self.edges]) if self.edges else F.array().cast("array<string>")
        return self.df.select(F.when(datum, F.slice(nodes, 1, self.last)).otherwise(nodes).alias("nodes"), edges.alias("edges"), F.when(datum, F.col("value")).alias("value"), F.when(datum, F.col("lang")).alias("lang"), datum.alias("has_datum"), F.concat("done", "here").alias("tids"))

    def values(self) -> DataFrame:
        """n0, value, lang: the literal, else the last node's label."""
        return self.df.select("n0", F.coalesce("value", F.col(f"n{self.last}")).alias("value"), F.coalesce("lang", F.lit("")).alias("lang"), F.concat("done", "here").alias("tids"))

    def size(self) -> DataFrame:
        """One row: how many paths there are."""
        return self.df.agg(F.count("*").alias("size"))

    def triples(self) -> DataFrame:
        """A row for each triple of each path: ``tids`` names the path, ``at`` the place in it."""
        spread = self.paths().select("tids", F.posexplode("tids").alias("at", "tid"))
        return spread.join(self.graph.triples, "tid")

    def render(self) -> DataFrame:
        """One text a path: nodes with the edges between them, then the literal; for reading only."""
        p = self.paths()
        hops = F.zip_with("nodes", "edges", lambda n, e: F.concat_ws(" ", n, e))
        return p.select(F.concat(F.array_join(hops, " "), F.when(F.col("has_datum"), F.concat(F.lit(' "'), F.col("value"), F.lit('"'))).otherwise(F.lit(""))).alias("path"))


def empty(graph: Graph) -> PathSet:
    none = F.lit(None).cast("string")
    df = graph.spark.range(0).select(none.alias("n0"), none.alias("value"), none.alias("lang"), F.array().cast("array<bigint>").alias("done"), F.array().cast("array<bigint>").alias("here"))
    return PathSet(graph, df, 0)


def extend(paths: PathSet, steps: list[str], first: int) -> PathSet:
    """Walk ``steps``, the first of which has place ``first`` in its path: even places are classes, odd ones properties."""
    for i, step in enumerate(steps, first):
        paths = paths.connected(step) if i % 2 else paths.ending(paths.graph.type_predicate, step)
    return paths


def compile_path(graph: Graph, path: Path | list[str]) -> PathSet:
    """The paths of a path's steps; none for an empty one."""
    steps = path.steps() if isinstance(path, Path) else list(path)
    if not steps:
        return empty(graph)
    return extend(PathSet.starting(graph, graph.type_predicate, steps[0]), steps[1:], 1)

"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.scratch import materialize


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` only, and no ``b`` is an ``a``: then each ``b`` is its component's smallest node."""
    ends = links.select(F.col("a").alias("x"), "b").unionAll(links.select(F.col("b").alias("x"), F.lit(None).cast(dict(links.dtypes)["b"]).alias("b")))
    of = ends.groupBy("x").agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count("b").alias("up"), F.count("*").alias("n"))
    return of.filter("least < most or (up > 0 and up < n)").isEmpty()


def _stars(pairs: DataFrame) -> DataFrame:
    """Every (u, v) of ``pairs`` as (v, least of u and u's neighbours)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return pairs.join(least, pairs.u == F.col("_u")).select("u", "v", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, component): the smallest node that can be reached.

    Alternates large-star and small-star contraction: the edges of a node with
    many neighbours move to its smallest neighbour, so chains shrink by a
    constant factor a round and stars finish in one; a round that leaves stars only is the last.  Minima are pre-aggregated
    map-side; the joins back are plain equi-joins that adaptive execution may
    split at a hot node.  Each round is a scratch table.  Loops and repeated
    edges are fine; edges with a null end are ignored.
    """
    e = edges.select(F.col("a").alias("a0"), F.col("b").alias("b0")).filter("a0 is not null and b0 is not null")
    e = materialize(e.select(F.greatest("a0", "b0").alias("a"), F.least("a0", "b0").alias("b")).distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).unionAll(e.select(F.col("b").alias("node"))).distinct()
    links = e.filter("a <> b")
    for _ in range(max_rounds):
        if _is_forest_of_stars(links):
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _stars(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        links = materialize(small.filter("a <> b").distinct(), "stars")
    else:
        if not _is_forest_of_stars(links):
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    found = links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("_a"), "component")
    return nodes.join(found, F.col("node") == F.col("_a"), "left").select("node", F.coalesce("component", "node").alias("component"))

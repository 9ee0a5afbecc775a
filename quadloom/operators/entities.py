"""Entities: the paths of bundles and fields, grouped by the entity they describe.

For each bundle the root path is computed once and extended for its fields and
child bundles where their paths start with it; others are walked from the root.
An entity has one row per (bundle, uri) - of several paths to it the last one
counts - and every value of every path.  Children belong to each parent that a
path leads from.  Fields without values are empty arrays.

``nested`` holds all values and children of an entity in one row, and so in one
task; where an entity may have more of them than fit there (a class with a third of
all rows below it), ``long`` and ``links`` give the same content in rows.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.graph import Graph
from quadloom.operators.paths import PathSet, compile_path, extend
from quadloom.plans.scratch import materialize
from quadloom.sources.pathbuilder import Bundle, Path, Pathbuilder


@dataclasses.dataclass
class BundleTables:
    """entity (uri, path, tids), links (parent, uri), and by field (uri, value, lang, path, tids).

    ``rows`` are the root paths that entities are grouped from; fields named in
    ``own`` and links that are ``inside`` extend the root path of the bundle (of the
    parent), so that each of their uris (parents) is an entity.
    """

    bundle: Bundle
    rows: DataFrame
    links: DataFrame | None
    fields: dict[str, DataFrame]
    children: list[BundleTables]
    own: frozenset[str] = frozenset()
    inside: bool = False

    @functools.cached_property
    def entity(self) -> DataFrame:
        last = self.rows.groupBy("uri").agg(F.max(F.struct("tids", "path")).alias("x"))
        return last.select("uri", F.col("x.path").alias("path"), F.col("x.tids").alias("tids"))

    def of_entities(self, name: str) -> DataFrame:
        """The values of a field whose uri is an entity."""
        values = self.fields[name]
        return values if name in self.own else values.join(self.rows.select("uri").distinct(), "uri", "left_semi")

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def _extends(steps: list[str], known: PathSet | None, prefix: list[str]) -> bool:
    return known is not None and bool(prefix) and steps[: len(prefix)] == prefix


def _walk(graph: Graph, path: Path, steps: list[str], known: PathSet | None, prefix: list[str]) -> PathSet:
    if _extends(steps, known, prefix):
        return extend(known, steps[len(prefix) :], len(prefix))
    return compile_path(graph, path)


def extract(graph: Graph, bundle: Bundle, parent: Bundle | None = None, above: PathSet | None = None, persist: bool = False) -> BundleTables:
    """The tables of ``bundle`` and all below it; ``persist`` writes root paths with joins, which several tables share, as scratch tables."""
    steps = bundle.path.steps()
    prefix = parent.path.path_array if parent else []
    root = _walk(graph, bundle.path, steps, above, prefix)
    if persist and root.last:
        root = dataclasses.replace(root, df=materialize(root.df, "root-paths"))
    k = bundle.uri_index
    # a path too short to have a node there describes no entity
    uri = F.col(f"n{k}") if k <= root.last else F.lit(None).cast("string")
    nodes = F.array(*[f"n{i}" for i in range(root.last + 1)])
    tids = F.concat("done", "here")
    rows = root.df.select(uri.alias("uri"), nodes.alias("path"), tids.alias("tids")).filter("uri is not null")
    links = None
    if parent is not None:
        links = root.df.select(F.col(f"n{parent.uri_index}").alias("parent"), uri.alias("uri")).filter("uri is not null").distinct()
    fields, own = {}, set()
    for f in bundle.child_fields:
        ps = _walk(graph, f, f.steps(), root, bundle.path.path_array)
        if k > ps.last:
            ps = dataclasses.replace(ps, df=ps.df.filter(F.lit(False)).withColumn(f"n{k}", F.lit(None).cast("string")))
        elif _extends(f.steps(), root, bundle.path.path_array) and k <= root.last:
            own.add(f.machine_name)
        value = F.coalesce("value", F.col(f"n{ps.last}"))
        p = F.array(*[f"n{i}" for i in range(ps.last + 1)])
        p = F.when(ps.has_datum, F.slice(p, 1, ps.last)).otherwise(p)
        fields[f.machine_name] = ps.df.select(F.col(f"n{k}").alias("uri"), value.alias("value"), F.coalesce("lang", F.lit("")).alias("lang"), p.alias("path"), tids.alias("tids"))
    children = [extract(graph, c, bundle, root, persist) for c in bundle.child_bundles]
    return BundleTables(bundle, rows, links, fields, children, frozenset(own), _extends(steps, above, prefix))


def extract_all(graph: Graph, pb: Pathbuilder, persist: bool = False) -> dict[str, BundleTables]:
    """By machine name, for the top-level bundles."""
    return {b.machine_name: extract(graph, b, persist=persist) for b in pb.bundles}


def _gathered(t: BundleTables, item: dict[str, Column]) -> DataFrame:
    """uri, path, tids and an array of items for each field, in the order of their tids, from one grouping of all rows."""
    none = F.lit(None).cast("string")
    parts = [t.rows.select("uri", F.lit(-1).alias("_at"), "tids", none.alias("value"), none.alias("lang"), "path")]
    parts += [values.select("uri", F.lit(i).alias("_at"), "tids", "value", "lang", "path") for i, values in enumerate(t.fields.values())]
    x = F.struct("tids", *[c.alias(n) for n, c in item.items()])
    lists = [F.array_sort(F.collect_list(F.when(F.col("_at") == i, x))).alias(f"_list{i}") for i in range(len(t.fields))]
    root = F.max(F.when(F.col("_at") == -1, F.struct("tids", "path"))).alias("_root")
    # values of a uri that is no entity of the bundle make a group without a root
    rows = functools.reduce(DataFrame.unionAll, parts).groupBy("uri").agg(root, *lists).filter("_root is not null")
    return rows.select("uri", F.col("_root.path").alias("path"), F.col("_root.tids").alias("tids"), *[F.col(f"_list{i}").alias(f"field__{n}") for i, n in enumerate(t.fields)])


def nested(t: BundleTables) -> DataFrame:
    """One row an entity: uri, path, tids, an array of values for each field, and of entities for each child bundle.

    Arrays follow the triples that led to their items; a value whose uri is no
    entity of the bundle, and a child without its parent, are left out.
    """
    parts = ("value", "lang", "path", "tids")
    out = _gathered(t, {n: F.col(n) for n in parts[:3]})
    lists = [F.transform(f"field__{n}", lambda x: F.struct(*[x[p].alias(p) for p in parts])).alias(f"field__{n}") for n in t.fields]
    out = out.select("uri", "path", "tids", *lists)
    for c in t.children:
        child = nested(c)
        inner = F.struct(F.col("tids"), *[F.col(x) for x in child.columns if x != "tids"])
        listed = c.links.join(child, "uri").groupBy(F.col("parent").alias("_parent")).agg(F.array_sort(F.collect_list(inner)).alias("_list"))
        kind = dict(listed.dtypes)["_list"]
        out = out.join(listed, F.col("uri") == F.col("_parent"), "left").withColumn(f"bundle__{c.bundle.machine_name}", F.coalesce("_list", F.array().cast(kind))).drop("_parent", "_list")
    return out


def triple_ids(t: BundleTables) -> DataFrame:
    """(uri, tid): every triple of an entity, its values and its children, once each."""
    own = t.entity.select("uri", F.explode("tids").alias("tid"))
    for name in t.fields:
        own = own.unionAll(t.of_entities(name).select("uri", F.explode("tids").alias("tid")))
    for c in t.children:
        below = triple_ids(c).withColumnRenamed("uri", "_child")
        reached = c.links if c.inside else c.links.join(t.entity.select(F.col("uri").alias("parent")), "parent", "left_semi")
        own = own.unionAll(reached.join(below, reached.uri == below._child).select(F.col("parent").alias("uri"), "tid"))
    return own.distinct()


def all_triples(graph: Graph, t: BundleTables) -> DataFrame:
    """``triple_ids`` with the triples themselves."""
    return triple_ids(t).join(graph.triples, "tid")


def wide(t: BundleTables, separator: str = "; ", cell_format: str = "value") -> DataFrame:
    """uri, parent (for a child bundle: a row for each), and one text for each field; null without values.

    ``cell_format``: ``value``, or ``pair`` for ``{value lang}``.
    """
    if cell_format not in ("value", "pair"):
        raise ValueError(f"cell_format: {cell_format}")
    cell = F.col("value") if cell_format == "value" else F.concat(F.lit("{"), F.col("value"), F.lit(" "), F.col("lang"), F.lit("}"))
    out = _gathered(t, {"cell": cell})
    cells = [F.when(F.size(f"field__{n}") > 0, F.array_join(F.col(f"field__{n}")["cell"], separator)).alias(f"field__{n}") for n in t.fields]
    out = out.select("uri", *cells)
    if t.links is not None:
        out = out.join(t.links, "uri").select("uri", "parent", *[f"field__{n}" for n in t.fields])
    return out


def long(t: BundleTables) -> dict[str, DataFrame]:
    """``field__<bundle>__<field>`` to (uri, value, lang), a row for each value."""
    return {f"field__{t.bundle.machine_name}__{name}": t.of_entities(name).select("uri", "value", "lang") for name in t.fields}

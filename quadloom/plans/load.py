"""From files to a graph and its entities, and from a graph to files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from quadloom.functions.terms import INVERSE_OF, RDF_TYPE, SAME_AS
from quadloom.operators.entities import BundleTables, extract_all
from quadloom.operators.graph import Graph, build_graph
from quadloom.operators.lookup import Lookup
from quadloom.plans.stages import Stages
from quadloom.sinks import export
from quadloom.sources.nquads import read_nquads
from quadloom.sources.pathbuilder import Pathbuilder, find_source, load_xml


def load_graph(
    spark: SparkSession,
    path: str | list[str],
    pathbuilder: Pathbuilder | None = None,
    same_as: Iterable[str] = SAME_AS,
    inverse_of: Iterable[str] = INVERSE_OF,
    mask_mode: str = "reference",
    on_bad_line: str = "error",
    type_predicate: str = RDF_TYPE,
) -> Graph:
    """The graph of files of quads; with a schema, only the triples that its paths need (see ``mask_mode``)."""
    masks = pathbuilder.masks(type_predicate) if pathbuilder is not None else None
    return build_graph(read_nquads(spark, path, on_bad_line), same_as, inverse_of, masks, mask_mode, type_predicate=type_predicate, persist=True)


def load(spark: SparkSession, *source: str, stages: Stages | None = None, **options) -> tuple[Graph, dict[str, BundleTables], Lookup]:
    """Graph, entities by bundle, and lookup of a folder (or of a schema's and a quads' file); ``stages`` notes what each stage took."""
    stages = stages if stages is not None else Stages()
    with stages.stage("schema") as done:
        nq, xml = find_source(*source, spark=spark)
        pb = load_xml(xml, spark)
        done(bundles=sum(1 for _ in pb.walk()))
    with stages.stage("graph"):
        graph = load_graph(spark, nq, pb, **options)
    with stages.stage("bundles") as done:
        bundles = extract_all(graph, pb, persist=True)
        done(bundles=len(bundles))
    return graph, bundles, Lookup(graph, bundles)


def export_all(bundles: dict[str, BundleTables], target: str, path: str, shape: str = "wide", **options) -> None:
    """All bundles to ``csv``, ``parquet``, ``sqlite``, ``json``, ``json-document`` or ``jdbc`` (``path``: a folder, a file or a URL)."""
    if target in ("json", "json-document"):
        (export.to_json if target == "json" else export.to_json_document)(bundles, path)
        return
    writers = {"csv": export.to_csv, "parquet": export.to_parquet, "sqlite": export.to_sqlite, "jdbc": export.to_jdbc}
    if target not in writers:
        raise ValueError(f"target: {target}")
    writers[target](export.tables(bundles, shape), path, **options)

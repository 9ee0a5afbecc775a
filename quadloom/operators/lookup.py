"""Finding entities by URI, and pages of them."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.frames import local
from quadloom.operators.entities import BundleTables, nested
from quadloom.operators.graph import Graph, canonicalize


@dataclasses.dataclass
class Lookup:
    """What a viewer needs to know of the top-level bundles; a URI in several counts as of the first name."""

    graph: Graph
    bundles: dict[str, BundleTables]

    @functools.cached_property
    def index(self) -> DataFrame:
        """(uri, bundle), a row for each pair."""
        out = local(self.graph.spark, [], uri="string", bundle="string")
        for name, t in self.bundles.items():
            out = out.unionAll(t.entity.select("uri", F.lit(name).alias("bundle")))
        return out

    def bundle_names(self) -> list[str]:
        return sorted(self.bundles)

    def entities(self, bundle: str) -> DataFrame:
        return self.bundles[bundle].entity

    def canonical(self, uris: DataFrame) -> DataFrame:
        """``uris`` (uri) with its canonical label, or itself."""
        return canonicalize(uris, self.graph.canon, canonical="uri")

    def aliases(self, uri: str) -> DataFrame:
        """The other labels of a canonical one (given as such)."""
        return self.graph.canon.filter(F.col("canonical") == uri).select("label")

    def bundle_of(self, uris: DataFrame) -> DataFrame:
        """``uris`` (uri) with canonical and bundle; bundle is null if no entity has the uri."""
        first = self.index.groupBy(F.col("uri").alias("_uri")).agg(F.min("bundle").alias("bundle"))
        return self.canonical(uris).join(first, F.col("canonical") == F.col("_uri"), "left").drop("_uri")

    def first_bundle(self, candidates: DataFrame) -> DataFrame:
        """(id, uris array) to (id, uri, bundle): the first candidate that is an entity; ids without one are left out."""
        spread = candidates.select("id", F.posexplode("uris").alias("at", "uri"))
        found = self.bundle_of(spread).filter("bundle is not null")
        return found.groupBy("id").agg(F.min(F.struct("at", "uri", "bundle")).alias("x")).select("id", F.col("x.uri").alias("uri"), F.col("x.bundle").alias("bundle"))

    def resolve(self, uri: str) -> tuple[str, str] | None:
        """(bundle, canonical URI) of one URI, with blanks around it dropped; None if it is no entity."""
        r = self.bundle_of(local(self.graph.spark, [(uri.strip(),)], uri="string")).first()
        return (r.bundle, r.canonical) if r.bundle is not None else None

    def entity(self, uri: str, bundle: str) -> DataFrame:
        """The entity with all its values and children, found by any of its labels."""
        one = local(self.graph.spark, [(uri,)], uri="string")
        key = self.canonical(one).select(F.col("canonical").alias("_key"))
        rows = nested(self.bundles[bundle])
        return rows.join(key, F.col("uri") == F.col("_key")).drop("_key")

    def page(self, bundle: str, skip: int = 0, limit: int = 100) -> DataFrame:
        """URIs from place ``skip`` on, in order of first appearance; an empty page is an error for the caller to show."""
        rows = self.bundles[bundle].entity.orderBy("tids", "uri").select("uri")
        return rows.offset(max(0, skip)).limit(min(1000, max(1, limit)))

    def navigate(self, path: str, public_urls: list[str]) -> DataFrame:
        """The entity that a local path names under one of the public addresses, over http or https."""
        return self.first_bundle(self.graph.spark.createDataFrame([(0, [u for p in public_urls for u in join_public(p, path)])], "id int, uris array<string>"))


def join_public(public: str, path: str) -> list[str]:
    """The path below a public address, with each of both schemes."""
    rest = public.split("://", 1)[-1].rstrip("/")
    return [f"{scheme}://{rest}/{path.lstrip('/')}" for scheme in ("http", "https")]


def page_links(total: int, skip: int, limit: int) -> dict[str, int | None]:
    """Where the first, previous, next and last pages start; None where there is none."""
    last = (total - 1) // limit * limit if total > 0 else None
    return {"first": 0 if skip > 0 else None, "previous": max(0, skip - limit) if skip > 0 else None, "next": skip + limit if skip + limit < total else None, "last": last if last is not None and last > skip else None}

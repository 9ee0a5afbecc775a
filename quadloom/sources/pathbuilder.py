"""The query schema: a tree of bundles (kinds of entity) and fields, each with a path.

A path alternates classes and properties: even places are classes, odd ones
properties.  A field may end in a datatype property.  Cardinality is kept as
information and never enforced.
"""

from __future__ import annotations

import dataclasses
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path as FilePath

from pyspark.sql import SparkSession


@dataclasses.dataclass
class Path:
    """One path; ``datatype`` "" or "empty" means none."""

    id: str
    path_array: list[str]
    datatype_property: str = ""
    is_group: bool = False
    group_id: str = ""
    name: str = ""
    enabled: bool = True
    weight: int = 0
    cardinality: int = -1
    extra: dict[str, str] = dataclasses.field(default_factory=dict)

    @property
    def machine_name(self) -> str:
        return self.id

    @property
    def datatype(self) -> str:
        return "" if self.datatype_property in ("", "empty") else self.datatype_property

    def steps(self) -> list[str]:
        """The path with its datatype property, as the query compiler walks it."""
        if not self.path_array:
            return []
        return [*self.path_array, *([self.datatype] if self.datatype and not self.is_group else [])]

    def problems(self) -> list[str]:
        """What is legal but likely unmeant."""
        if self.datatype and not self.is_group and len(self.path_array) % 2 == 0:
            return [f"{self.id}: the path has an even length, so its datatype property is read as a class"]
        return []


@dataclasses.dataclass
class Bundle:
    path: Path
    parent: Bundle | None = dataclasses.field(default=None, repr=False)
    child_bundles: list[Bundle] = dataclasses.field(default_factory=list)
    child_fields: list[Path] = dataclasses.field(default_factory=list)

    @property
    def machine_name(self) -> str:
        return self.path.machine_name

    @property
    def is_toplevel(self) -> bool:
        return self.parent is None

    @property
    def uri_index(self) -> int:
        """The place of the entity's node among the path's nodes."""
        return 0 if self.is_toplevel else len(self.path.path_array) // 2

    def walk(self) -> Iterator[Bundle]:
        yield self
        for b in self.child_bundles:
            yield from b.walk()


@dataclasses.dataclass
class Pathbuilder:
    bundles: list[Bundle] = dataclasses.field(default_factory=list)

    def walk(self) -> Iterator[Bundle]:
        for b in self.bundles:
            yield from b.walk()

    def bundle(self, machine_name: str) -> Bundle | None:
        return next((b for b in self.walk() if b.machine_name == machine_name), None)

    def masks(self, type_predicate: str) -> tuple[set[str], set[str]]:
        """Predicates of object triples, and of data triples, that any path needs."""
        objects, data = {type_predicate}, set()
        for b in self.walk():
            for p in (b.path, *b.child_fields):
                objects.update(p.path_array[1::2])
            # the property itself, also where it is "empty"
            data.update(f.datatype_property for f in b.child_fields if f.datatype_property)
        return objects, data

    def problems(self) -> list[str]:
        return [x for b in self.walk() for p in (b.path, *b.child_fields) for x in p.problems()]


def from_paths(paths: list[Path]) -> Pathbuilder:
    """Build the tree; a path whose group is unknown ("0", "") is top-level, and only groups can be."""
    enabled = [p for p in paths if p.enabled]
    bundles = {p.id: Bundle(p) for p in enabled if p.is_group}
    out = Pathbuilder()
    for p in sorted(enabled, key=lambda p: p.weight):
        group = bundles.get(p.group_id)
        if p.is_group:
            b = bundles[p.id]
            if group is not None and group is not b:
                b.parent = group
                group.child_bundles.append(b)
            else:
                out.bundles.append(b)
        elif group is not None:
            group.child_fields.append(p)
    return out


FIELDS = {"id", "group_id", "path_array", "datatype_property", "is_group", "name", "enabled", "weight", "cardinality"}


def _int(text: str, otherwise: int) -> int:
    try:
        return int(text)
    except ValueError:
        return otherwise


def loads_xml(text: str) -> Pathbuilder:
    """From XML: ``<path>`` elements with a child for each attribute; ``path_array`` holds
    its steps as elements in order, whatever their names."""
    paths = []
    for e in ET.fromstring(text).iter("path"):
        get = lambda k, e=e: (e.findtext(k) or "").strip()
        array = e.find("path_array")
        paths.append(
            Path(
                id=get("id"),
                path_array=[(x.text or "").strip() for x in (array if array is not None else [])],
                datatype_property=get("datatype_property"),
                is_group=get("is_group") in ("1", "true", "TRUE"),
                group_id=get("group_id"),
                name=get("name"),
                enabled=get("enabled") not in ("0", "false", "FALSE"),
                weight=_int(get("weight"), 0),
                cardinality=_int(get("cardinality"), -1),
                extra={c.tag: (c.text or "").strip() for c in e if c.tag not in FIELDS},
            )
        )
    return from_paths(paths)


def load_xml(path: str, spark: SparkSession | None = None) -> Pathbuilder:
    """From a file: through Spark's readers if a session is given, which reach shared stores too; else of this machine."""
    if spark is None:
        return loads_xml(FilePath(path).read_text(encoding="utf-8"))
    # one row a file: a folder that Spark wrote has one with content
    return loads_xml("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def dumps_xml(pb: Pathbuilder) -> str:
    """The inverse of ``loads_xml``."""
    root = ET.Element("pathbuilderinterface")
    for b in pb.walk():
        group = b.parent.path.id if b.parent else "0"
        for p, g in [(b.path, group), *((f, b.path.id) for f in b.child_fields)]:
            e = ET.SubElement(root, "path")
            values = {"id": p.id, "weight": p.weight, "enabled": int(p.enabled), "group_id": g, "cardinality": p.cardinality, "datatype_property": p.datatype_property, "is_group": int(p.is_group), "name": p.name, **p.extra}
            for k, v in values.items():
                ET.SubElement(e, k).text = str(v)
            array = ET.SubElement(e, "path_array")
            for i, step in enumerate(p.path_array):
                ET.SubElement(array, "xy"[i % 2]).text = step
    return ET.tostring(root, encoding="unicode")


def find_source(*args: str, spark: SparkSession | None = None) -> tuple[str, str]:
    """(quads file, pathbuilder file): two files, pathbuilder first; or a folder with one of each.

    With a session they are looked up in the store that their address names, where a
    folder that Spark wrote counts as a file.
    """
    if len(args) not in (1, 2):
        raise ValueError("expected a folder, or a pathbuilder file and a quads file")
    if len(args) == 2:
        xml, nq = args
        for f in (xml, nq):
            if not _is_file(f, spark):
                raise FileNotFoundError(f"not a regular file: {f}")
        return nq, xml
    found = []
    for kind in ("nq", "xml"):
        files = _files(args[0], kind, spark)
        if len(files) != 1:
            raise ValueError(f"need exactly one .{kind} file in {args[0]}, got {len(files)}")
        found += files
    return found[0], found[1]


def _is_file(path: str, spark: SparkSession | None) -> bool:
    if spark is None:
        return FilePath(path).is_file()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _files(folder: str, kind: str, spark: SparkSession | None) -> list[str]:
    if spark is None:
        return sorted(str(f) for f in FilePath(folder).glob(f"*.{kind}") if f.is_file())
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in there if f.getPath().getName().endswith(f".{kind}"))

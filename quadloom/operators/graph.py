"""The graph: canonical triples with provenance, inferred inverses, masks and counts.

``edges`` holds one row per canonical (s, p, o): of several, the one with the
smaller role, then the earlier.  ``data`` is a bag of literals.  Both keep the
labels as they were written.  ``adj`` is what paths walk: edges and literals,
each literal a node of its own.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.frames import local
from quadloom.functions.terms import DATA, DATUM_PREFIX, INVERSE, INVERSE_OF, RDF_TYPE, REGULAR, SAME_AS
from quadloom.operators.identity import canonical_labels
from quadloom.plans.scratch import materialize


#: Up to so many properties become constants of the plan, so that a filter on one predicate prunes the rest.
INLINE = 1000
#: Role and tid as one number: role * SPAN + tid, for tids (twice the place in the order) below half of it.
SPAN_BITS = 60
SPAN = 1 << SPAN_BITS


def canonicalize(df: DataFrame, canon: DataFrame | None, **columns: str) -> DataFrame:
    """``df`` with new columns, each the canonical label of the column it names; ``canon`` None: no two labels are the same."""
    for new, old in columns.items():
        if canon is None:
            df = df.withColumn(new, F.col(old))
            continue
        c = canon.select(F.col("label").alias("_label"), F.col("canonical").alias("_canonical"))
        df = df.join(c, F.col(old) == F.col("_label"), "left").withColumn(new, F.coalesce("_canonical", F.col(old))).drop("_label", "_canonical")
    return df


def inverse_map(quads: DataFrame, canon: DataFrame | None, inverse_of: Iterable[str] = INVERSE_OF) -> DataFrame:
    """(p, inv) of canonical properties: both directions of each statement, the last one written counts.

    A property declared inverse to itself by one label is ignored; two labels with
    one canonical label make a symmetric property.
    """
    names = list(inverse_of)
    stated = quads.filter(F.col("p").isin(names) if names else F.lit(False)).filter(F.col("o").isNotNull() & (F.col("s") != F.col("o")))
    stated = canonicalize(stated.select("ord", "s", "o"), canon, left="s", right="o")
    pairs = stated.select(F.explode(F.array(F.struct("ord", F.lit(0).alias("turn"), F.col("left").alias("p"), F.col("right").alias("inv")), F.struct("ord", F.lit(1).alias("turn"), F.col("right").alias("p"), F.col("left").alias("inv")))).alias("x"))
    return pairs.groupBy("x.p").agg(F.max_by("x.inv", F.struct("x.ord", "x.turn")).alias("inv"))


def _few(df: DataFrame) -> list | None:
    """The rows of a table of names, if it is small enough to become constants of a plan."""
    rows = df.limit(INLINE + 1).collect()
    return rows if len(rows) <= INLINE else None


def _in(column: str, names: Iterable[str]) -> Column:
    names = sorted(names)
    return F.col(column).isin(names) if names else F.lit(False)


def _accepted(spark: SparkSession, mask: Iterable[str] | None, mode: str, canon: DataFrame | None, inverse: DataFrame) -> set[str] | DataFrame | None:
    """The predicates as written that a mask lets pass (None: all; a table if there are many); ``closed`` adds aliases and inverse partners."""
    if mode not in ("reference", "closed", "none"):
        raise ValueError(f"mask_mode: {mode}")
    if mask is None or mode == "none":
        return None
    names = set(mask)
    if mode == "reference":
        return names
    wanted = canonicalize(local(spark, [(n,) for n in sorted(names)], p="string"), canon, c="p").select("c")
    wanted = wanted.unionAll(wanted.join(inverse, wanted.c == inverse.p).select("inv")).distinct()
    accepted = wanted if canon is None else wanted.unionAll(canon.join(wanted, canon.canonical == wanted.c, "left_semi").select("label"))
    few = _few(accepted.toDF("p"))
    return accepted.toDF("p") if few is None else {r.p for r in few}


def _masked(quads: DataFrame, accepted: set[str] | DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) rows by the literal predicate."""
    if accepted is None:
        return quads, quads.filter(F.lit(False))
    if isinstance(accepted, set):
        return quads.filter(_in("p", accepted)), quads.filter(~_in("p", accepted))
    return quads.join(accepted, "p", "left_semi"), quads.join(accepted, "p", "left_anti")


@dataclasses.dataclass
class Graph:
    spark: SparkSession
    quads: DataFrame
    canon: DataFrame
    inverse: DataFrame
    edges: DataFrame
    data: DataFrame
    masked_objects: DataFrame
    masked_data: DataFrame
    inserted: DataFrame
    type_predicate: str = RDF_TYPE
    #: makes the edges and literals of a set of predicates as written, or None where ``edges`` and ``data`` are tables
    narrow: Narrow | None = None

    @functools.cached_property
    def adj(self) -> DataFrame:
        """s, p, dst, tid, and value and lang where dst is a literal's node."""
        none = F.lit(None).cast("string")
        e = self.edges.select(F.col("s_c").alias("s"), F.col("p_c").alias("p"), F.col("o_c").alias("dst"), none.alias("value"), none.alias("lang"), "tid")
        d = self.data.select(F.col("s_c").alias("s"), F.col("p_c").alias("p"), F.concat(F.lit(DATUM_PREFIX), F.col("node").cast("string")).alias("dst"), "value", "lang", "tid")
        return e.unionAll(d)

    def canonical(self, labels: Iterable[str]) -> dict[str, str]:
        """Canonical labels of a list of names, such as a schema's properties."""
        names = list(labels)
        if self.narrow is not None:
            return {n: self.narrow.known.get(n, n) for n in names}
        known = {r.label: r.canonical for r in self.canon.filter(_in("label", names)).collect()}
        return {n: known.get(n, n) for n in names}

    def step(self, predicate: str) -> DataFrame:
        """The rows of ``adj`` for one canonical predicate."""
        if self.narrow is None:
            return self.adj.filter(F.col("p") == predicate)
        none = F.lit(None).cast("string")
        e = self.narrow.links(predicate).select("s", F.lit(predicate).alias("p"), "dst", none.alias("value"), none.alias("lang"), "tid")
        d = self.narrow.data(predicate).select(F.col("s_c").alias("s"), F.col("p_c").alias("p"), F.concat(F.lit(DATUM_PREFIX), F.col("node").cast("string")).alias("dst"), "value", "lang", "tid")
        return e.unionAll(d)

    def having(self, predicate: str, obj: str) -> DataFrame:
        """(s, tid) of the edges with one canonical predicate and object; no literal is meant."""
        if self.narrow is None:
            return self.edges.filter((F.col("p_c") == predicate) & (F.col("o_c") == obj)).select(F.col("s_c").alias("s"), "tid")
        return self.narrow.links(predicate, obj).filter(F.col("dst") == obj).select("s", "tid")

    @functools.cached_property
    def triples(self) -> DataFrame:
        """Every triple with both kinds of labels, its literal, role and graph, by ``tid``."""
        none = F.lit(None).cast("string")
        shared = ["tid", "role", "graph"]
        e = self.edges.select(*shared, F.col("s_l").alias("subject"), F.col("p_l").alias("predicate"), F.col("o_l").alias("object"), F.col("s_c").alias("s_subject"), F.col("p_c").alias("s_predicate"), F.col("o_c").alias("s_object"), none.alias("value"), none.alias("lang"))
        d = self.data.select("tid", F.lit(DATA).cast("tinyint").alias("role"), "graph", F.col("s_l").alias("subject"), F.col("p_l").alias("predicate"), none.alias("object"), F.col("s_c").alias("s_subject"), F.col("p_c").alias("s_predicate"), none.alias("s_object"), "value", "lang")
        return e.unionAll(d)

    def stats(self) -> DataFrame:
        """One row: direct, datum, masked_pred, masked_data, inverse, conflict.

        A group of equal triples counts by the role of its first; each further
        one is a conflict in both of the two orders an index would keep.
        """
        groups = self.inserted.groupBy("s_c", "p_c", "o_c").agg(F.min_by("role", "tid").alias("first"), F.count("*").alias("n"))
        g = groups.agg(F.coalesce(F.sum((F.col("first") == REGULAR).cast("long")), F.lit(0)).alias("direct"), F.coalesce(F.sum((F.col("first") == INVERSE).cast("long")), F.lit(0)).alias("inverse"), (2 * F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).cast("long").alias("conflict"))
        count = lambda df, name: df.agg(F.count("*").alias(name))
        parts = [g, count(self.data, "datum"), count(self.masked_objects, "masked_pred"), count(self.masked_data, "masked_data")]
        # four frames of one row each
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)
        return out.select("direct", "datum", "masked_pred", "masked_data", "inverse", "conflict")

    def triple_count(self) -> int:
        """Rows inserted, repeats and inverses included."""
        return self.inserted.count() + self.data.count()

    def identity_map(self) -> DataFrame:
        """(label, canonical) where the two differ."""
        return self.canon

    def save(self, path: str) -> None:
        """Write the tables below ``path``; edges and literals are laid out by predicate for pruning."""
        for name in ("canon", "inverse", "inserted", "masked_objects", "masked_data", "quads"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        for name in ("edges", "data"):
            t = getattr(self, name)
            # by ranges of both, so that a predicate with many statements takes many tasks
            t.repartitionByRange("p_c", "s_c").sortWithinPartitions("p_c", "s_c").write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, type_predicate: str = RDF_TYPE) -> Graph:
        names = ("quads", "canon", "inverse", "edges", "data", "masked_objects", "masked_data", "inserted")
        return cls(spark, *[spark.read.parquet(f"{path}/{n}") for n in names], type_predicate)


def _regular(kept: DataFrame, canon: DataFrame | None) -> DataFrame:
    r = canonicalize(kept.filter("o is not null"), canon, s_c="s", p_c="p", o_c="o")
    return r.select("s_c", "p_c", "o_c", F.col("s").alias("s_l"), F.col("p").alias("p_l"), F.col("o").alias("o_l"), F.lit(REGULAR).cast("tinyint").alias("role"), "graph", (F.col("ord") * 2).alias("tid"))


def _inferred(regular: DataFrame, inverse: DataFrame, few: dict[str, str] | None) -> DataFrame:
    """The inverse triples of ``regular``: canonical ends swapped, written labels kept.

    The properties of ``few`` filter, so that scans are pruned; what each is inverse to
    comes from a join with the table of pairs.
    """
    i = regular if few is None else regular.filter(_in("p_c", few))
    if few is not None and len(set(few.values())) == 1:
        i = i.withColumn("inv", F.lit(next(iter(few.values()))))
    else:
        i = i.join(inverse.select(F.col("p").alias("_p"), "inv"), F.col("p_c") == F.col("_p"))
    return i.select(F.col("o_c").alias("s_c"), F.col("inv").alias("p_c"), F.col("s_c").alias("o_c"), "s_l", "p_l", "o_l", F.lit(INVERSE).cast("tinyint").alias("role"), "graph", (F.col("tid") + 1).alias("tid"))


def _literals(kept: DataFrame, canon: DataFrame | None) -> DataFrame:
    d = canonicalize(kept, canon, s_c="s", p_c="p")
    return d.select("s_c", "p_c", F.col("s").alias("s_l"), F.col("p").alias("p_l"), F.col("ord").alias("node"), "value", F.coalesce("lang", F.lit("")).alias("lang"), "graph", (F.col("ord") * 2).alias("tid"))


@dataclasses.dataclass
class Narrow:
    """The statements of one canonical predicate only: what is filtered is the predicate as written, which reaches the scans.

    A group of equal triples has one canonical predicate, so conflicts can be resolved in such a part.
    """

    kept_objects: DataFrame
    kept_data: DataFrame
    canon: DataFrame | None
    known: dict[str, str]
    inverse: dict[str, str]
    #: statements by predicate as written, and which of them the masks let pass (None: all)
    parts: Mapping[str, DataFrame] | None = None
    objects: set[str] | None = None
    literals: set[str] | None = None

    def _rows(self, kept: DataFrame, accepted: set[str] | None, test: str, names: set[str]) -> DataFrame:
        if self.parts is None:
            return kept.filter(_in("p", names))
        mine = [self.parts[n] for n in sorted(names) if n in self.parts and (accepted is None or n in accepted)]
        if not mine:
            return kept.filter(F.lit(False))
        return functools.reduce(DataFrame.unionAll, mine).filter(test)

    @functools.cached_property
    def _aliases(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for alias, canonical in self.known.items():
            out.setdefault(canonical, {canonical}).add(alias)
        return out

    def written(self, *labels: str) -> set[str]:
        """All labels whose canonical label is one of ``labels``."""
        return set().union(*[self._aliases.get(x, {x}) for x in labels])

    def links(self, predicate: str, obj: str | None = None) -> DataFrame:
        """s, dst, tid of the predicate's edges, without written labels: a path needs no more of a statement.

        Of equal edges the smallest role, then the smallest tid counts; both are one number here.
        """
        of = functools.partial(self._rows, self.kept_objects, self.objects, "o is not null")

        def ends(rows: DataFrame, role: int) -> DataFrame:
            rows = canonicalize(rows.select("ord", "s", "o"), self.canon, s_c="s", o_c="o")
            rank = F.lit(role * SPAN).cast("long") + F.col("ord") * 2 + role
            return rows.select("s_c", "o_c", rank.alias("rank")) if role == REGULAR else rows.select(F.col("o_c").alias("s_c"), F.col("s_c").alias("o_c"), rank.alias("rank"))

        rows = of(self.written(predicate))
        out = ends(rows if obj is None else rows.filter(_in("o", self.written(obj))), REGULAR)
        partners = [p for p, inv in self.inverse.items() if inv == predicate]
        if partners:
            rows = of(self.written(*partners))
            out = out.unionAll(ends(rows if obj is None else rows.filter(_in("s", self.written(obj))), INVERSE))
        best = out.groupBy("s_c", "o_c").agg(F.min("rank").alias("rank"))
        role = F.shiftright(F.col("rank") + SPAN // 2, SPAN_BITS)
        return best.select(F.col("s_c").alias("s"), F.col("o_c").alias("dst"), (F.col("rank") - role * F.lit(SPAN)).alias("tid"))

    def data(self, predicate: str) -> DataFrame:
        return _literals(self._rows(self.kept_data, self.literals, "o is null and value is not null", self.written(predicate)), self.canon)


def resolve_conflicts(inserted: DataFrame) -> DataFrame:
    """One row per canonical triple: the smallest role, then the earliest."""
    rest = ("s_l", "p_l", "o_l", "role", "graph", "tid")
    best = inserted.groupBy("s_c", "p_c", "o_c").agg(F.min(F.struct("role", "tid", "s_l", "p_l", "o_l", "graph")).alias("x"))
    return best.select("s_c", "p_c", "o_c", *[F.col(f"x.{c}") for c in rest])


def build_graph(
    quads: DataFrame,
    same_as: Iterable[str] = SAME_AS,
    inverse_of: Iterable[str] = INVERSE_OF,
    masks: tuple[Iterable[str], Iterable[str]] | None = None,
    mask_mode: str = "reference",
    same_as_mode: str = "auto",
    type_predicate: str = RDF_TYPE,
    persist: bool = False,
    parts: Mapping[str, DataFrame] | None = None,
) -> Graph:
    """The graph of ``quads`` (ord, s, p, o, value, lang, graph); ``ord`` lies between -2^58 and 2^58.

    ``masks``: the predicates that object and data triples must have (see
    ``Pathbuilder.masks``).  Mode ``reference`` tests the predicate as written and
    before inverses are inferred; ``closed`` first adds aliases and inverse
    partners of the masks; ``none`` keeps all.  ``persist`` writes the triples as
    scratch tables, for graphs that many paths will walk.  ``parts``: the same
    statements by predicate, for sources that have them apart; a step of a path is
    then planned from its own.
    """
    names = list(same_as)
    stated = quads.filter(F.col("p").isin(names) if names else F.lit(False)).filter("o is not null")
    canon = canonical_labels(stated, same_as_mode)
    few = _few(canon)
    known = None if few is None else {r.label: r.canonical for r in few}
    used = None if known == {} else canon
    inverse = inverse_map(quads, used, inverse_of)
    few = _few(inverse)
    pairs = None if few is None else {r.p: r.inv for r in few}
    if pairs is not None:
        inverse = local(quads.sparkSession, list(pairs.items()), p="string", inv="string")
    objects, data = masks if masks is not None else (None, None)
    pass_o, pass_d = (_accepted(quads.sparkSession, m, mask_mode, used, inverse) for m in (objects, data))
    kept_o, no_o = _masked(quads.filter("o is not null"), pass_o)
    kept_d, no_d = _masked(quads.filter("o is null and value is not null"), pass_d)
    regular = _regular(kept_o, used)
    inserted = regular.unionAll(_inferred(regular, inverse, pairs))
    literals = _literals(kept_d, used)
    edges = resolve_conflicts(inserted)
    narrow = None
    if persist:
        # sorted by predicate, so that a path's step reads its own row groups and pages only
        edges, literals = (materialize(t.sortWithinPartitions("p_c", "s_c"), n) for t, n in ((edges, "edges"), (literals, "data")))
    elif known is not None and pairs is not None:
        constant = not any(isinstance(x, DataFrame) for x in (pass_o, pass_d))
        narrow = Narrow(kept_o, kept_d, used, known, pairs, *((parts, pass_o, pass_d) if constant else ()))
    return Graph(quads.sparkSession, quads, canon, inverse, edges, literals, no_o, no_d, inserted, type_predicate, narrow)

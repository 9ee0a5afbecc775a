"""Classes of identical labels.

Statements count in order: ``a same-as b`` gives every label of b's class the
canonical label of a.  The classes are connected components; which label stands
for one depends on the order of its statements.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.frames import local
from quadloom.operators.components import connected_components
from quadloom.plans.scratch import materialize

SCHEMA = "label string, canonical string"


def fold_in_order(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Canonical label of each label of ``pairs`` (same, old), taken one after the other."""
    canon: dict[str, str] = {}
    members: dict[str, list[str]] = {}
    for same, old in pairs:
        for x in (same, old):
            if x not in canon:
                canon[x] = x
                members[x] = [x]
        to, gone = canon[same], canon[old]
        if to == gone:
            continue
        # the smaller list moves; the name of the class is settled apart from it
        small, large = members.pop(gone), members.pop(to)
        if len(small) > len(large):
            small, large = large, small
        large.extend(small)
        for x in large if canon[large[0]] != to else small:
            canon[x] = to
        for x in small:
            canon[x] = to
        members[to] = large
    return canon


def _fold_component(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "s", "o"])
    canon = fold_in_order(list(zip(rows["s"], rows["o"], strict=True)))
    return pd.DataFrame({"label": list(canon), "canonical": list(canon.values())})


def canonical_labels(same: DataFrame, mode: str = "auto", driver_limit: int = 200_000) -> DataFrame:
    """(label, canonical) for the labels whose canonical label is another; from ``same`` (ord, s, o).

    ``driver``: one fold on the driver, for at most ``driver_limit`` statements;
    ``distributed``: components first, then the fold of each on its own (a task
    holds the statements of one component); ``auto`` chooses by their number.
    """
    spark = same.sparkSession
    same = same.select("ord", "s", "o").filter("s is not null and o is not null")
    if mode not in ("auto", "driver", "distributed"):
        raise ValueError(f"mode: {mode}")
    if mode != "distributed":
        rows = same.limit(driver_limit + 1).collect()
        if len(rows) <= driver_limit:
            canon = fold_in_order([(r.s, r.o) for r in sorted(rows)])
            return local(spark, [(k, v) for k, v in canon.items() if k != v], label="string", canonical="string")
        if mode == "driver":
            raise ValueError(f"more than {driver_limit} statements")
    same = materialize(same, "same")
    comp = connected_components(same.select(F.col("s").alias("a"), F.col("o").alias("b")))
    rows = same.join(comp, same.s == comp.node).select("component", "ord", "s", "o")
    found = rows.groupBy("component").applyInPandas(_fold_component, SCHEMA)
    return materialize(found.filter("label <> canonical"), "canon")

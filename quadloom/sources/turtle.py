"""Statements of a Turtle text, for the part of the format that ``sinks.export`` writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IRIs, blank nodes, literals with language or datatype, and the marks between them.
TOKEN = r'<[^>]*>|_:[^\s<>",;]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?|[;,.]'
STATE = "struct<s:string,p:string,rows:array<struct<s:string,p:string,o:string>>>"


def statements(text: Column) -> Column:
    """Array of (s, p, o), terms as they are written; ``;`` keeps the subject, ``,`` also the predicate."""
    none = F.lit(None).cast("string")

    def state(s: Column, p: Column, rows: Column) -> Column:
        return F.struct(s.alias("s"), p.alias("p"), rows.alias("rows")).cast(STATE)

    def step(at: Column, token: Column) -> Column:
        row = F.array(F.struct(at["s"].alias("s"), at["p"].alias("p"), token.alias("o")))
        return (
            F.when(token == ".", state(none, none, at["rows"]))
            .when(token == ";", state(at["s"], none, at["rows"]))
            .when(token == ",", at)
            .when(at["s"].isNull(), state(token, none, at["rows"]))
            .when(at["p"].isNull(), state(at["s"], token, at["rows"]))
            .otherwise(state(at["s"], at["p"], F.concat(at["rows"], row)))
        )

    start = state(none, none, F.array())
    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), start, step)["rows"]

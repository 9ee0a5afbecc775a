"""N-Quads: reading lines into the ``quads`` table and writing them back.

Terms keep their lexical form: IRIs without brackets, blank nodes with ``_:``,
literals as value, language and datatype.  All of it is built-in expressions; a
text is unescaped only if it has a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.functions.terms import QUADS
from quadloom.plans.scratch import materialize

IRI = r'<([^\x00-\x20<>"{}|^`]*)>'
NODE = r"(_:[^\s<>\"]+?)"
LITERAL = r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^\x00-\x20<>"{}|^`]*)>)?'
TERM = rf"(?:{IRI}|{NODE}|{LITERAL})"
#: Groups: subject 1-5, predicate 6-10, object 11-15, graph 16-17.
STATEMENT = rf"^\s*{TERM}\s*{TERM}\s*{TERM}\s*(?:{IRI}|{NODE})?\s*\.\s*(?:#.*)?$"
BLANK = r"^\s*(?:#.*)?$"

#: A text's pieces: surrogate pairs, code points, short escapes, and what stands between.
PIECE = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|(?s)\\.|[^\\]+"
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: Column) -> Column:
    """The text without escapes; null if one of them is not an escape of the format."""

    def piece(x: Column) -> Column:
        kind = F.substring(x, 2, 1)
        plain = F.when(~x.startswith("\\"), x)
        short = plain
        for k, v in ESCAPES.items():
            short = short.when((F.length(x) == 2) & (kind == k), F.lit(v))
        four = (kind == "u") & (F.length(x) >= 6)
        digits = F.regexp_replace(x, r"\\u", "")
        return short.when(four, F.decode(F.unhex(digits), "UTF-16BE")).when((kind == "U") & (F.length(x) == 10), F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32"))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), piece)
    whole = F.when(F.forall(pieces, lambda x: x.isNotNull()), F.array_join(pieces, ""))
    return F.when(~F.contains(text, F.lit("\\")), text).otherwise(whole)


def escape(text: Column) -> Column:
    """The inverse of ``unescape`` with the format's short escapes."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f"), ('"', '"')):
        t = F.replace(t, F.lit(raw), F.lit("\\" + name))
    return t


def parse_lines(lines: DataFrame, on_bad_line: str = "error") -> DataFrame:
    """``lines`` (ord, line) to the ``quads`` schema.

    Blank and comment lines, and statements whose subject or predicate is a
    literal, are skipped.  A line that is no statement, or has an unknown escape,
    stops the job (``error``), is skipped (``skip``), or is kept beside the others
    with null terms and its text in column ``bad`` (``quarantine``).
    """
    if on_bad_line not in ("error", "skip", "quarantine"):
        raise ValueError(f"on_bad_line: {on_bad_line}")
    rows = lines.filter(F.col("line").isNotNull() & ~F.col("line").rlike(BLANK))
    group = lambda n: F.regexp_extract("line", STATEMENT, n)
    full = F.col("line").rlike(STATEMENT)

    def label(first: int) -> Column:
        return F.when(group(first) != "", unescape(group(first))).when(group(first + 1) != "", group(first + 1))

    # a literal is told from the others by the quote that starts it
    rows = rows.withColumn("_ok", full).withColumn("_s", label(1)).withColumn("_p", label(6)).withColumn("_o", label(11))
    rows = rows.withColumn("_literal", F.col("_ok") & F.col("_o").isNull() & (group(11) == "") & (group(12) == ""))
    rows = rows.withColumn("_value", F.when(F.col("_literal"), unescape(group(13))))
    no_label = F.col("_ok") & ((F.col("_s").isNull() & (group(1) == "")) | (F.col("_p").isNull() & (group(6) == "")))
    rows = rows.filter(~no_label)
    good = F.col("_ok") & F.col("_s").isNotNull() & F.col("_p").isNotNull() & (F.col("_o").isNotNull() | F.col("_value").isNotNull())
    if on_bad_line == "error":
        message = F.concat(F.lit("not a statement: "), F.col("line"))
        rows = rows.withColumn("_s", F.when(good, F.col("_s")).otherwise(F.raise_error(message).cast("string")))
    elif on_bad_line == "skip":
        rows = rows.filter(good)
    literal = F.col("_literal")
    columns = [
        F.col("ord"),
        F.col("_s").alias("s"),
        F.col("_p").alias("p"),
        F.col("_o").alias("o"),
        F.col("_value").alias("value"),
        F.when(literal, group(14)).otherwise(F.lit("")).alias("lang"),
        F.when(literal & (group(15) != ""), group(15)).alias("datatype"),
        F.coalesce(F.when(group(16) != "", unescape(group(16))), group(17)).alias("graph"),
    ]
    if on_bad_line == "quarantine":
        keep = [F.when(good, c).alias(n) for c, n in zip(columns[1:], QUADS.names[1:], strict=True)]
        return rows.select(columns[0], *keep, F.when(~good, F.col("line")).alias("bad"))
    return rows.select(*columns)


def read_nquads(spark: SparkSession, path: str | list[str], on_bad_line: str = "error") -> DataFrame:
    """Files of statements as ``quads``; ``ord`` follows file name, then place in the file.

    The order is fixed by writing it to a scratch table: task ids alone would not
    keep it from one plan to the next.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")
    )
    lines = materialize(lines, "lines")
    # offsets of the splits from their counts, so that no task has to number all lines
    split = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = lines.join(split.select("_file", "_block", "_first", "_base"), ["_file", "_block"])
    return parse_lines(at.select((F.col("_base") + F.col("_id") - F.col("_first")).alias("ord"), "line"), on_bad_line)


def _label(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def literal(value: Column, lang: Column, datatype: Column | None = None) -> Column:
    text = F.concat(F.lit('"'), escape(value), F.lit('"'))
    typed = F.lit(None).cast("string") if datatype is None else datatype
    return F.when(F.coalesce(lang, F.lit("")) != "", F.concat(text, F.lit("@"), lang)).when(typed.isNotNull(), F.concat(text, F.lit("^^<"), typed, F.lit(">"))).otherwise(text)


def to_lines(quads: DataFrame) -> DataFrame:
    """``quads`` as one column ``line``, with ``ord``."""
    o = F.when(F.col("o").isNotNull(), _label(F.col("o"))).otherwise(literal(F.col("value"), F.col("lang"), F.col("datatype")))
    graph = F.when(F.coalesce("graph", F.lit("")) != "", F.concat(F.lit(" "), _label(F.col("graph")))).otherwise(F.lit(""))
    return quads.select("ord", F.concat(_label(F.col("s")), F.lit(" "), _label(F.col("p")), F.lit(" "), o, graph, F.lit(" .")).alias("line"))


def write_nquads(quads: DataFrame, path: str) -> None:
    to_lines(quads).select("line").write.text(path)

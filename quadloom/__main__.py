"""Command line: ``python -m quadloom`` or ``spark-submit quadloom/__main__.py``.

    export  SOURCE... --to wide.db --format sqlite     entities to files or a database
    view    SOURCE... [--bundle B [--uri U]] [--get U] bundles, a page of one, an entity, or where a URI is
    triples SOURCE... --bundle B [--uri U]             an entity's triples as N-Triples or Turtle
    bench   SOURCE...                                  load only, and print what the stages took

SOURCE is a folder with one .nq and one .xml file, or the schema's file and the quads' file.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quadloom.functions.terms import INVERSE_OF, SAME_AS, parse_predicates  # noqa: E402
from quadloom.operators import entities  # noqa: E402
from quadloom.plans.load import export_all, load  # noqa: E402
from quadloom.plans.ship import ship  # noqa: E402
from quadloom.plans.stages import Stages  # noqa: E402
from quadloom.sinks import export  # noqa: E402


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quadloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("source", nargs="+")
    shared.add_argument("--same-as", help="predicates of equal labels, apart by commas or lines")
    shared.add_argument("--inverse-of", help="predicates of inverse properties")
    shared.add_argument("--mask", choices=("reference", "closed", "none"), default="reference")
    shared.add_argument("--bad-lines", choices=("error", "skip"), default="error")
    e = sub.add_parser("export", parents=[shared])
    e.add_argument("--to", required=True)
    e.add_argument("--format", choices=("csv", "parquet", "sqlite", "json", "json-document", "jdbc"), default="csv")
    e.add_argument("--shape", choices=("wide", "long"), default="wide")
    e.add_argument("--batch-size", type=int, default=1000)
    v = sub.add_parser("view", parents=[shared])
    v.add_argument("--bundle")
    v.add_argument("--uri")
    v.add_argument("--get", help="any label of an entity, to find its bundle")
    v.add_argument("--public", action="append", default=[], help="public address that a local path in --get is below")
    v.add_argument("--skip", type=int, default=0)
    v.add_argument("--limit", type=int, default=100)
    t = sub.add_parser("triples", parents=[shared])
    t.add_argument("--bundle", required=True)
    t.add_argument("--uri")
    t.add_argument("--format", choices=("nt", "ttl"), default="nt")
    sub.add_parser("bench", parents=[shared])
    args = p.parse_args(argv)
    if len(args.source) > 2:
        p.error("SOURCE is a folder or two files")
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run one command; results go to ``out`` (standard output), 1 is returned where nothing was found."""
    out = out or sys.stdout
    args = _arguments(sys.argv[1:] if argv is None else argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("quadloom").getOrCreate()
    ship(spark)
    stages = Stages()
    try:
        graph, bundles, look = load(
            spark,
            *args.source,
            stages=stages,
            same_as=SAME_AS if args.same_as is None else parse_predicates(args.same_as),
            inverse_of=INVERSE_OF if args.inverse_of is None else parse_predicates(args.inverse_of),
            mask_mode=args.mask,
            on_bad_line=args.bad_lines,
        )
        if args.command == "bench":
            with stages.stage("counts") as done:
                done(**graph.stats().first().asDict(), entities={n: t.entity.count() for n, t in bundles.items()})
            print(stages.to_json(), file=out)
            return 0
        if args.command == "export":
            options = {"shape": args.shape} | ({"batch_size": args.batch_size} if args.format in ("sqlite", "jdbc") else {})
            export_all(bundles, args.format, args.to, **options)
            return 0
        if args.command == "view" and args.get is not None:
            found = look.navigate(args.get, args.public).first() if args.public else None
            hit = (found.bundle, found.uri) if found else look.resolve(args.get)
            print(json.dumps({"bundle": hit[0], "uri": hit[1]} if hit else None), file=out)
            return 0 if hit else 1
        if args.bundle is None:
            for name in look.bundle_names():
                print(name, file=out)
            return 0
        if args.bundle not in bundles:
            print(f"no bundle {args.bundle}", file=sys.stderr)
            return 1
        if args.command == "triples":
            rows = entities.all_triples(graph, bundles[args.bundle])
            if args.uri is not None:
                rows = rows.filter(F.col("uri") == graph.canonical([args.uri])[args.uri])
            text = export.ntriples(rows).orderBy("uri", "tid").select("line") if args.format == "nt" else export.turtle(rows).orderBy("uri").select("turtle")
            n = 0
            for (line,) in text.toLocalIterator():
                print(line, file=out)
                n += 1
            return 0 if n else 1
        if args.uri is None:
            rows = look.page(args.bundle, args.skip, args.limit).select("uri")
        else:
            rows = look.entity(args.uri, args.bundle)
            rows = rows.select(F.to_json(F.struct(*rows.columns)))
        n = 0
        for (line,) in rows.collect():
            print(line, file=out)
            n += 1
        return 0 if n else 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())

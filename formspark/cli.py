"""Command line over the library: merge, analyze, progress and reset on folders of record files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import in_ranges
from .operators import quality
from .sources import files, sinks
from .streaming import incremental

#: columns that quality reports look at; the last two of a record are always blank
ACTIVE = files.RECORD_COLUMNS[:12]
RULE_COLUMNS = {
    "serial": "Serial No", "epic": "EPIC ID", "name_en": "Name (English)", "name_ta": "Name (Tamil)", "rel_en": "Relation Name (English)",
    "rel_ta": "Relation Name (Tamil)", "rel_type": "Relation Type", "house": "House No", "age": "Age", "gender": "Gender", "part": "Part No", "ac": "AC No",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="formspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("merge", "page files to one ordered table"), ("analyze", "fill rates, completeness and anomalies"), ("preview", "the first rows")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        if name == "merge":
            c.add_argument("output")
        c.add_argument("--part", help="part numbers, like 1,5,10-20")
        c.add_argument("--page", help="page numbers; needs --part")
        c.add_argument("--limit", type=int, default=0)
        c.add_argument("--all", action="store_true", help="every directory AC-... below the input")
        c.add_argument("--validate", action="store_true", help="only the first page")
        c.add_argument("--dry-run", action="store_true", help="show the pages that would be read, and how many more there are")
        c.add_argument("--workers", type=int, default=0, help="cores of a local session")
        c.add_argument("--cross-check", action="store_true", help="keep the two columns of the cross-check")
        if name == "merge":
            c.add_argument("--force", action="store_true", help="parts that the manifest names as well")
    reset = sub.add_parser("reset", help="drop manifest rows, of all or of some parts")
    reset.add_argument("manifest")
    reset.add_argument("--part")
    reset.add_argument("--yes", action="store_true", help="do not ask")
    return p


def selected(spark: SparkSession, args):
    if args.page and not args.part:
        raise SystemExit("--page needs --part")
    rows = files.record_files(spark, f"{args.input.rstrip('/')}/AC-*" if args.all else args.input)
    if not args.cross_check:
        rows = rows.drop(*files.CHECK_COLUMNS)
    if args.part:
        rows = rows.where(in_ranges(F.expr("try_cast(`Part No` as int)"), args.part))
    if args.page:
        rows = rows.where(in_ranges(F.col("page"), args.page))
    if args.validate:
        rows = rows.join(rows.agg(F.min("file").alias("file")), "file", "left_semi")
    return rows.orderBy("file").limit(args.limit) if args.limit else rows


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("formspark")
        spark = (builder.master(f"local[{args.workers}]") if getattr(args, "workers", 0) else builder).getOrCreate()
    if getattr(args, "dry_run", False):
        pages = selected(spark, args).select(F.col("file").alias("key")).distinct()
        shown, more = incremental.dry_run(pages)
        shown.show(truncate=False)
        print(f"and {more} more")
    elif args.command == "merge":
        rows, out = selected(spark, args), args.output.rstrip("/")
        written, left = sinks.merge_parts(rows.drop("file", "page"), f"{out}.parts", f"{out}.manifest", force=args.force)
        print(f"{written} parts merged, {left} left as they were")
        sinks.write_merged(rows.drop("file", "part_key", "page"), out)
    elif args.command == "preview":
        selected(spark, args).limit(10).show(truncate=40)
    elif args.command == "analyze":
        rows = selected(spark, args)
        quality.fill_rates(rows, ACTIVE).show(len(ACTIVE), truncate=False)
        quality.complete_rows(rows, ACTIVE, ["AC No"]).show(truncate=False)
        rules = quality.anomaly_rules(RULE_COLUMNS, ["RVJ", "MDJ", "IOD", "JOD"], ["Father", "Husband", "Mother", "Other"])
        quality.anomalies(rows, rules, ["file", "page"]).orderBy("type").show(len(rules), truncate=False)
    elif args.command == "reset":
        if not args.yes and input(f"Drop rows of {args.manifest}? [y/N] ").lower() != "y":
            return 1
        keep = ~in_ranges(F.col("part_no").cast("int"), args.part) if args.part else F.lit(False)
        incremental.reset(spark, args.manifest, F.coalesce(keep, F.lit(True)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

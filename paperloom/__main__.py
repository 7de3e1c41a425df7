"""python -m paperloom INPUT... [-o OUT]: convert files to Markdown documents and a report.

Runs as any Spark application does: the session's master and settings come from the
environment or spark-submit."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.masking import CATEGORIES, default_categories
from .functions.pages import Options
from .messages import DONE
from .operators.units import REPORT, first_warnings, report_bytes
from .plans.convert import convert
from .sources.files import collect, street_list
from .sources.sinks import write_report, write_tree

#: Rows of the report, and warnings, that are printed; the report itself is written whole.
SHOWN = 200


def options_of(args: argparse.Namespace) -> Options:
    wanted = () if args.anonymize == "none" else tuple(args.anonymize.split(","))
    return Options.of({
        "dpi": args.dpi, "image_format": args.image_format, "heading_mode": args.heading_mode, "figure_legends": not args.no_legends,
        "ignore_images": args.no_images, "write_images": not args.no_images, "speaker_notes": not args.no_notes, "previews": False, "anonymize": wanted,
        **{k: v for k, v in (("margin_top", args.margin_top), ("margin_bottom", args.margin_bottom)) if v is not None},
    })


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("documents", nargs="+")
    p.add_argument("-o", "--out", default="out")
    p.add_argument("--pages", default="", help="'3', '3-9' or '3,7,11-13'")
    p.add_argument("--dpi", type=int, default=110)
    p.add_argument("--image-format", choices=("png", "jpg"), default="jpg")
    p.add_argument("--margin-top", type=float)
    p.add_argument("--margin-bottom", type=float)
    p.add_argument("--heading-mode", choices=("hybrid", "toc", "fontsize"), default="hybrid")
    for name in ("legends", "images", "notes"):
        p.add_argument(f"--no-{name}", action="store_true")
    p.add_argument("--anonymize", default=",".join(default_categories()), help=f"of {', '.join(CATEGORIES)}, or none")
    p.add_argument("--streets", help="file with street names, one a line")
    p.add_argument("--stdout", action="store_true", help="print the one document")
    return p


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the store that the path is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(where).isDirectory()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    paths = [os.path.abspath(p) if "://" not in p and os.path.exists(p) else p for p in args.documents]
    files = collect(spark, paths, [is_folder(spark, p) for p in paths])
    made = convert(files, options_of(args), args.pages, streets=street_list(spark, args.streets))
    report = made.report()
    if args.stdout:
        documents = made.documents().select("document").take(2)
        if len(documents) != 1:
            print("--stdout takes exactly one document", file=sys.stderr)
            return 2
        sys.stdout.write(documents[0].document)
    else:
        folders = report.join(made.files.select("doc_id", F.col("relative").alias("pad")), "pad").filter("map <> ''").select("doc_id", F.col("map").alias("folder"))
        slugs = made.files.select("doc_id", "slug")
        out = args.out if "://" in args.out else os.path.abspath(args.out)
        write_tree(made.documents().join(folders, "doc_id").join(slugs, "doc_id"), made.figures.join(folders, "doc_id"), out)
        write_report(made.report(ordered=True), REPORT, f"{args.out}/overzicht", order=("input_no", "pad"))
    failed = report.filter(F.col("status") != DONE).count()
    shown = made.report(ordered=True).orderBy("input_no", "pad").limit(SHOWN)
    print(report_bytes(shown, REPORT, "input_no", "pad").decode("utf-8-sig"), file=sys.stderr)
    names = made.files.select("doc_id", F.col("relative").alias("pad"))
    for row in first_warnings(made.units).join(names, "doc_id").orderBy("pad", "nr").limit(SHOWN).collect():
        print(f"{row.pad} {row.unit_no}: {row.warning}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())

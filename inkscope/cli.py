"""Command line: ``python -m inkscope.cli PATH... [options]``.

Scans directory trees or single files with a local or given Spark session and
writes a report to standard output.  Exit codes: 2 after an error, 1 with
``--fail`` if something calls for action, else 0.  ``--fix`` writes cleaned files
below ``--out``, or in place of the files with ``--in-place``.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .binary.document import document_reports, fix_documents
from .binary.media import strip_media
from .operators import identity
from .operators.detect import findings, reported_payloads, reported_words
from .operators.ignore import Config
from .operators.summary import exit_code
from .options import Options
from .plans.scan import scan_files, scan_summary
from .sinks import reports as sinks
from .sources import discovery, files
from .sources.codec import image_format
from .tables import parse_excluded


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkscope", description="Find marks that a reader cannot see.")
    p.add_argument("paths", nargs="*", default=["."])
    out = p.add_mutually_exclusive_group()
    out.add_argument("--json", action="store_true")
    out.add_argument("--sarif", action="store_true")
    p.add_argument("--fix", action="store_true")
    p.add_argument("--out", help="where --fix writes")
    p.add_argument("--in-place", action="store_true", help="--fix replaces each changed file, atomically")
    p.add_argument("--stdin", action="store_true", help="scan standard input; with --fix the text goes to standard output")
    p.add_argument("--stdin-name", default="")
    p.add_argument("--fail", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--fix-homoglyphs", action="store_true")
    p.add_argument("--strip-metadata", nargs="?", const="ai", default="none", choices=("none", "ai", "all"))
    p.add_argument("--config")
    p.add_argument("--baseline")
    p.add_argument("--write-baseline", action="store_true")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--no-gitignore", action="store_true")
    p.add_argument("--no-default-ignores", action="store_true")
    for name in ("ignore-dir", "pattern", "exclude-char"):
        p.add_argument(f"--{name}", action="append", default=[])
    return p


def _options(args, config: Config) -> Options:
    return Options(
        strict=args.strict or config.strict, clean=args.fix, fix_homoglyphs=args.fix_homoglyphs, mixed_script=config.mixed_script or "report",
        excluded=parse_excluded([*args.exclude_char, *config.exclude]), formats=dict(config.formats or {}),
    )


def _scan(spark: SparkSession, args, config: Config) -> DataFrame:
    parts = []
    for target in args.paths:
        place = Path(target)
        if place.is_file():  # a named file passes all rules
            parts.append(files.single(spark, place.read_bytes(), target))
            continue
        rules = [] if args.no_gitignore or config.no_gitignore else discovery.ignore_patterns(target)
        tree = files.scan_tree(
            spark, str(place.resolve()), args.pattern or list(config.patterns), rules, (*args.ignore_dir, *config.ignore_dirs),
            not (args.no_default_ignores or config.no_default_ignores), not args.no_recursive,
        )
        base = "" if target == "." else target.rstrip("/") + "/"
        parts.append(tree.withColumn("path", F.concat(F.lit(base), "path")))
    return reduce(DataFrame.unionByName, parts)


def _save(rows, root: str) -> int:
    count = 0
    for r in rows.toLocalIterator():
        place = Path(root, r.path)
        place.parent.mkdir(parents=True, exist_ok=True)
        part = place.with_name(place.name + ".part")
        part.write_bytes(bytes(r.content))
        if place.exists():
            shutil.copymode(place, part)
        os.replace(part, place)
        count += 1
    return count


def _cleaned(found: DataFrame, options: Options, mode: str) -> DataFrame:
    """(path, content) of the files that cleaning changes."""
    image = image_format(F.col("content")).isNotNull()
    texts = api.scan_bytes(found.where(~image), options).where("error is null and changed").select("path", F.col("cleaned").alias("content"))
    docs = fix_documents(found.where(~image), options, mode).where("changed").select("path", "content")
    media = found.where(image).select("path", strip_media(F.col("content"), F.lit(mode)).alias("s")).where("s.changed").select("path", "s.content")
    return texts.unionByName(docs).unionByName(media)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.fix and not args.stdin and not args.out and not args.in_place:
        print("inkscope: --fix needs --out or --in-place", file=sys.stderr)
        return 2
    try:
        config = Config.load(Path(args.config).read_text(encoding="utf-8")) if args.config else discovery.find_config(args.paths[0])[0]
        options = _options(args, config)
    except (ValueError, OSError) as problem:
        print(f"inkscope: {problem}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("inkscope").getOrCreate()
    if args.stdin:
        data = sys.stdin.buffer.read()
        found = files.single(spark, data, args.stdin_name)
        if args.fix:
            sys.stdout.buffer.write(bytes(api.scan_bytes(found, options).first().cleaned))
    else:
        found = _scan(spark, args, config)
    found = found.cache()
    try:
        reports = scan_files(found, options).cache()
        where = args.baseline or discovery.BASELINE_NAME
        if args.write_baseline:
            sinks.write_baseline(identity.baseline_entries(identity.with_identity(identity.report_items(reports))), where)
            return 0
        known, baselined = None, 0
        if args.baseline:
            known = files.load_baseline(spark, where)
            for r in identity.stale_entries(identity.with_identity(identity.report_items(reports)), known).toLocalIterator():
                print(f"inkscope: stale baseline entry {r.id} {r.path}", file=sys.stderr)
            reports = identity.without_accepted(reports, known).cache()
            baselined = reports.agg(F.sum("baselined")).first()[0] or 0
            reports = reports.drop("baselined")
        total = scan_summary(reports)
        stream = sys.stderr if args.stdin and args.fix else sys.stdout
        if args.sarif:
            texts = files.text_documents(found).where("error = ''").select("path", "text")
            bodies = document_reports(found.where(image_format(F.col("content")).isNull())).where("text <> ''").select("path", "text")
            texts = texts.unionByName(bodies)
            pay = reported_payloads(texts, options).where("not suppressed")
            mixed = reported_words(texts, options).where("not suppressed")
            chars = findings(texts, options)
            results = sinks.sarif_results(chars, pay, mixed)
            if known is not None:
                results = results.join(known.select(F.col("id").alias("identity")), "identity", "left_anti")
            text, dropped = sinks.sarif(results, sinks.sarif_rules(chars, results))
            print(text, file=stream)
            if dropped:
                print(f"inkscope: {dropped} results beyond the limit of {sinks.SARIF_LIMIT} were left out", file=sys.stderr)
        elif not args.quiet:
            for line in sinks.json_report(reports, total) if args.json else sinks.text_report(reports, total, baselined):
                print(line, file=stream)
        if args.fix and not args.stdin:
            print(f"{_save(_cleaned(found, options, args.strip_metadata), '' if args.in_place else args.out)} file(s) written", file=sys.stderr)
        return exit_code(total, total.first().errors, args.fail).first().exit_code
    finally:
        found.unpersist()


if __name__ == "__main__":
    sys.exit(main())

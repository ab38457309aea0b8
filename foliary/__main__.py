"""Command line: ``python -m foliary COMMAND ...``.

Exit codes: 0 done, 2 bad input or refused, 3 an unforeseen fault, 4 done but a gate is closed.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from foliary import reports, settings, sinks


def _packages(args):
    from foliary.session import session
    from foliary.sources import docx

    spark = session(args.master, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark, docx.read(spark, args.packages)


def analyze(args) -> int:
    """Statistics and findings of packages."""
    from foliary.sources import docx

    _, packages = _packages(args)
    found, summary = docx.findings(packages), docx.package_report(packages)
    sinks.write_text(args.out / "analysis_summary.md", reports.analysis(summary, found))
    sinks.write_table(found, str(args.out / "findings"), overwrite=True)
    return 2 if not summary.where("error is not null").isEmpty() else 0


def inspect(args) -> int:
    """Effective formats and table evidence of packages."""
    from foliary.operators.formats import Formats, table_evidence

    _, packages = _packages(args)
    found = Formats(packages)
    for name, rows in {"paragraph_formats": found.paragraph_formats(), "run_groups": found.run_groups(), "warnings": found.warnings(), "tables": table_evidence(packages)}.items():
        sinks.write_table(rows, str(args.out / name), overwrite=True)
    return 0


def classify(args) -> int:
    """Roles of the blocks of packages."""
    from pyspark.sql import functions as F

    from foliary.operators.classify import classify as decide
    from foliary.sources import docx

    _, packages = _packages(args)
    found = decide(docx.blocks(packages))
    sinks.write_table(found, str(args.out / "decisions"), overwrite=True)
    sinks.write_text(args.out / "structure_summary.md", reports.report("Structure", {"Roles": found.groupBy("role", "scope", "review").agg(F.count("*").alias("blocks"))}))
    return 0


def check_profile(args) -> int:
    """Whether a rule profile keeps its contract."""
    from foliary.session import session
    from foliary.sources import profiles

    spark = session(args.master, **{"spark.ui.enabled": "false"})
    found = profiles.load(spark, args.profile)
    sinks.write_text(args.out / "profile_summary.md", reports.report(found.manifest["name"], {"Rules": found.rules.groupBy("scope", "status").count(), "Coverage": found.coverage.groupBy("state").count()}))
    return 0


def compare(args) -> int:
    """Whether packages of the same name in two folders have the same content."""
    from pyspark.sql import functions as F

    from foliary.operators.integrity import identity_diff, unit_fingerprints
    from foliary.sources import docx

    spark, before = _packages(args)
    name = F.element_at(F.split("doc_id", "/"), -1).alias("doc_id")
    prints = lambda df: unit_fingerprints(docx.fingerprint_units(df.select(name, "content")))
    changed = identity_diff(prints(before), prints(docx.read(spark, args.other)), "doc_id", "fingerprint")
    sinks.write_text(args.out / "delivery_summary.md", reports.report("Delivery", {"Changed": changed}))
    return 0 if changed.isEmpty() else 4


def show_settings(args) -> int:
    """The settings that the environment gives."""
    print(settings.load())
    return 0


COMMANDS = {f.__name__.replace("_", "-"): f for f in (analyze, inspect, classify, check_profile, compare, show_settings)}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliary", description=__doc__.splitlines()[0])
    parser.add_argument("--master", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        sub = commands.add_parser(name, help=f.__doc__)
        if f is not show_settings:
            sub.add_argument("profile" if f is check_profile else "packages")
            if f is compare:
                sub.add_argument("other")
            sub.add_argument("--out", type=Path, required=True)
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if "out" in args:
            args.out = sinks.contained(args.out, Path(settings.load().data_dir))
        return COMMANDS[args.command](args)
    except ValueError as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  the last resort of a command line
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())

"""Command line: dump, validate, version, and service mode."""

from __future__ import annotations

import argparse
import os
import stat
import sys

from weir.security import Insecure

VERSION = "0.1.0"
# Exit codes: success, bad usage or configuration, refusal for insecurity, failure while running.
OK, USAGE, INSECURE, FAILED = 0, 2, 3, 4


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weir")
    top.add_argument("--config", default="/etc/weir/weir.toml")
    commands = top.add_subparsers(dest="command")
    d = commands.add_parser("dump", help="export captured sources as JSONL")
    d.add_argument("--kmsg", nargs="?", const="/dev/kmsg", metavar="PATH")
    d.add_argument("--dmesg", nargs="?", const=True, metavar="PATH")
    d.add_argument("--journal", nargs="?", const=True, metavar="PATH")
    d.add_argument("--journal-unit", action="append", default=[], metavar="UNIT")
    d.add_argument("--syslog-bsd", action="append", default=[], metavar="PATH")
    d.add_argument("--syslog-rfc5424", action="append", default=[], metavar="PATH")
    d.add_argument("--since", default="")
    d.add_argument("--until", default="")
    d.add_argument("--output", "-o", default="", help="a file in time order, or a folder (ending with /) of files written in parallel")
    d.add_argument("--gzip", action="store_true")
    d.add_argument("--max-lines", type=int, default=0)
    v = commands.add_parser("validate", help="check a configuration")
    v.add_argument("--skip-fs-checks", action="store_true")
    v.add_argument("path")
    commands.add_parser("version")
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("weir").config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate()  # larger methods are not compiled by the JVM


def run_dump(args: argparse.Namespace) -> int:
    from weir.operators.filters import time_range
    from weir.plans import dump
    from weir.sinks.files import write_jsonl, write_ordered

    try:
        within = time_range(args.since, args.until)
    except ValueError as failure:
        print(failure, file=sys.stderr)
        return USAGE
    device = bool(args.kmsg) and os.path.exists(args.kmsg) and stat.S_ISCHR(os.stat(args.kmsg).st_mode)  # a file holds captured records
    live = dump.captured(args.dmesg is True, args.journal is True, args.journal_unit, within=within, kmsg=args.kmsg if device else "")
    given = {name: live.get(name) if asked else value for name, value, asked in (("dmesg", args.dmesg, args.dmesg is True), ("journal", args.journal, args.journal is True), ("kmsg", args.kmsg, device))}
    inputs = dump.sources(args.syslog_bsd, args.syslog_rfc5424, journal_units=args.journal_unit, **given)
    if not inputs and not (args.dmesg or args.journal or args.kmsg):
        print("dump: no sources given", file=sys.stderr)
        return USAGE
    spark = _session()
    if live and not spark.sparkContext.master.startswith("local["):
        print("dump: the running system is captured on the driver, which needs a local session", file=sys.stderr)
        return USAGE
    try:
        records = dump.dump(spark, inputs, within, args.max_lines)
        if args.output.endswith("/"):
            write_jsonl(records, args.output, args.gzip)
            print(f"wrote {args.output}", file=sys.stderr)
            return OK
        written = write_ordered(records, args.output, args.gzip)
    except (OSError, ValueError) as failure:
        print(f"dump: {failure}", file=sys.stderr)
        return FAILED
    print(f"wrote {written} entries", file=sys.stderr)
    return OK


def run_validate(args: argparse.Namespace) -> int:
    from weir import config

    try:
        config.load(args.path, args.skip_fs_checks)
    except Insecure as failure:
        print(f"insecure: {failure}", file=sys.stderr)
        return INSECURE
    except (config.ConfigError, OSError) as failure:
        print(failure, file=sys.stderr)
        return USAGE
    print(f"{args.path}: OK")
    return OK


def run_service(args: argparse.Namespace) -> int:
    from weir import config, service

    try:
        loaded = config.load(args.config)
    except Insecure as failure:
        print(f"insecure: {failure}", file=sys.stderr)
        return INSECURE
    except (config.ConfigError, OSError) as failure:
        print(failure, file=sys.stderr)
        return USAGE
    try:
        service.run(_session(), loaded)
    except RuntimeError as failure:
        print(failure, file=sys.stderr)
        return FAILED
    return OK


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    if args.command == "version":
        print(f"weir {VERSION}")
        return OK
    return {"dump": run_dump, "validate": run_validate, None: run_service}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())

"""Bounded sources: captured text files and journal exports."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import text
from weir.operators import parsers
from weir.operators.filters import TimeRange, journal_priority, journal_units

CAPTURE_SECONDS = 30


def lines(spark: SparkSession, path: str | list[str], separator: str = "\n", isolated: bool = False) -> DataFrame:
    """(value, file, line_ord): records between separators; files may be patterns, and an unfinished last line counts.

    line_ord orders lines by file, then by place in it.  isolated: a file that
    cannot be read to its end gives what was read of it.
    """
    reader = spark.read.option("lineSep", separator)
    if isolated:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("line_ord"))


@dataclass(frozen=True)
class Source:
    """A captured input: where it is, how it is parsed, and the label its records carry."""

    path: str
    parser: str
    label: str
    options: dict[str, Any] = field(default_factory=dict)
    units: tuple[str, ...] = ()
    priority: int = 0

    def parsed(self, spark: SparkSession, isolated: bool = False) -> DataFrame:
        """All records and failures; touches the path now, so that a broken source fails here."""
        if self.parser == "journald":
            raw = lines(spark, self.path, "\n\n", isolated).withColumn("value", F.trim(F.col("value"), F.lit(" \t\r\n"))).where("value <> ''")
        else:
            raw = lines(spark, self.path, isolated=isolated)
        out = parsers.build(self.parser, self.options).parse(raw)
        return out.withColumns({"src": F.lit(self.label), "msg": text.repair_utf8(F.col("msg"))})

    def read(self, spark: SparkSession, within: TimeRange = TimeRange(), isolated: bool = False) -> DataFrame:
        """Records that were read, in the time range and of the journal's units and priority."""
        good = self.parsed(spark, isolated).where(F.col("error_class").isNull()).drop("error_class")
        return within.apply(good.where(journal_units(self.units) & journal_priority(self.priority)))


def journal_arguments(units: tuple[str, ...] = (), priority: int = 0, directory: str = "", follow: bool = False, since: str = "", until: str = "") -> list[str]:
    """The journalctl command whose export a journal source reads."""
    out = ["journalctl", "-o", "export", "--no-pager"]
    out += ["-f"] * follow + ([f"--directory={directory}"] if directory else [])
    for unit in units:
        out += ["--unit", unit]
    out += ["--priority", str(priority)] if priority > 0 else []
    out += ["--since", since] if since else []
    return out + (["--until", until] if until else [])


def dmesg_arguments() -> list[str]:
    return ["dmesg", "--kernel", "--time-format=iso"]


def capture(command: list[str], path: str, seconds: float = CAPTURE_SECONDS) -> str:
    """Runs a command on the driver and keeps its output in a file; fails with the end of its error output."""
    with open(path, "wb") as out:
        try:
            done = subprocess.run(command, stdout=out, stderr=subprocess.PIPE, timeout=seconds, check=False)
        except FileNotFoundError:
            raise OSError(f"{command[0]}: not found") from None
        except subprocess.TimeoutExpired:
            raise OSError(f"{command[0]}: no end after {seconds} s") from None
    if done.returncode:
        raise OSError(f"{command[0]}: exit {done.returncode}: {done.stderr.decode(errors='replace').strip()[-200:]}")
    return path

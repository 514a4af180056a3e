"""The ordered merge of several sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from weir import schema
from weir.operators.retention import running_in_place


def order() -> list[Column]:
    """Unknown times first, then by time; ties by source and then by arrival."""
    return [F.col("ts").asc_nulls_first(), F.col("ts_ns").asc_nulls_first(), F.col("src_ord").asc(), F.col("line_ord").asc()]


def merge(sources: Sequence[DataFrame], max_lines: int = 0, written: Observation | None = None) -> DataFrame:
    """Records of all sources (canonical columns and line_ord) in one chronological order.

    max_lines keeps the earliest; 0 or less keeps all.  With a cap the plan is a
    top-n of each partition, without one a range-partitioned sort.  `written`
    observes the number of rows.
    """
    if not sources:
        raise ValueError("nothing to merge")
    columns = [*schema.COLUMNS, "src_ord", "line_ord"]
    numbered = [s.withColumn("src_ord", F.lit(k)).select(*columns) for k, s in enumerate(sources)]
    out = reduce(DataFrame.unionByName, numbered).orderBy(*order())
    if max_lines > 0:
        out = out.limit(max_lines)
    return out.observe(written, F.count(F.lit(1)).alias("written")) if written else out


def positions(ordered: DataFrame, into: str = "position") -> DataFrame:
    """Adds each row's place, from 1, in the order in which the plan delivers its rows."""
    one = "_one"
    return running_in_place(ordered.withColumn(one, F.lit(1).cast("bigint")), one, into).drop(one)

"""Column functions on raw log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir import schema

#: Rows' fixed cost in the byte budget, and that of one entry of fields.
ENTRY_COST, FIELD_COST = 64, 8
MAX_LINE_BYTES = 64 * 1024


def trim_newline(value: Column) -> Column:
    """Without one trailing line feed, and then one carriage return."""
    cut = F.when(F.endswith(value, F.lit("\n")), F.left(value, F.char_length(value) - 1)).otherwise(value)
    return F.when(F.endswith(cut, F.lit("\r")), F.left(cut, F.char_length(cut) - 1)).otherwise(cut)


def repair_utf8(value: Column) -> Column:
    """Each run of ill-formed bytes as one replacement character."""
    return F.regexp_replace(F.make_valid_utf8(value), "�+", "�")


def dash_is_empty(value: Column) -> Column:
    return F.when(value == "-", F.lit("")).otherwise(value)


def integer(text: Column) -> Column:
    """A whole number with an optional sign and no spaces, or null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def nonnegative(text: Column) -> Column:
    """integer(), and 0 for what is none or negative."""
    return F.greatest(F.coalesce(integer(text), F.lit(0)), F.lit(0))


def cap_line(raw: Column, limit: int = MAX_LINE_BYTES) -> tuple[Column, Column]:
    """(text, truncated): a raw line, its line feed included, cut to `limit` bytes.

    As the reader's buffer is the limit too, a line whose content alone is that
    long counts as truncated though only its line feed was cut.
    """
    data = raw.cast("binary")
    long = F.octet_length(data) > limit
    content = F.when(F.endswith(raw, F.lit("\n")), F.octet_length(data) - 1).otherwise(F.octet_length(data))
    return F.when(long, F.substring(data, 1, limit).cast("string")).otherwise(raw), long | (content >= limit)


def entry_cost() -> Column:
    """Bytes that a record takes of a byte budget."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    keys = F.octet_length(F.array_join(F.map_keys("fields"), "")) + F.octet_length(F.array_join(F.map_values("fields"), ""))
    fields = F.when(F.coalesce(F.size("fields"), F.lit(0)) > 0, keys + FIELD_COST * F.size("fields")).otherwise(0)
    return (ENTRY_COST + size("msg") + size("host") + size("proc") + size("src") + fields).cast("bigint")


def split_priority(df: DataFrame, value: str) -> DataFrame:
    """Adds _pri_error, _pri and _rest of a line that begins with <PRI>."""
    v = F.col(value)
    digits = F.regexp_extract(v, r"^<([0-9]{1,3})>", 1)
    df = df.withColumn("_pri_digits", digits)
    number = F.col("_pri_digits").try_cast("int")
    error = (
        F.when((F.octet_length(v) < 3) | ~F.startswith(v, F.lit("<")), schema.INVALID_FORMAT)
        .when((F.col("_pri_digits") == "") | (number > schema.MAX_PRIORITY), schema.INVALID_PRIORITY)
    )
    return df.withColumns({"_pri_error": error, "_pri": number, "_rest": F.substr(v, F.char_length("_pri_digits") + 3)})

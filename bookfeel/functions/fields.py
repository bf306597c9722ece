"""Column expressions over dates, counts, flags and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dump's date form without its day name, and the instant that
# stands for "no date" (1 July 1970 00:00 at -07:00).
DUMP_DATE = "MMM d HH:mm:ss Z yyyy"
NO_DATE_SECONDS = 15_663_600
_YEAR_1970 = 365 * 86_400

# Map bins, right-closed, with labels and colours.
COUNT_BINS = [
    (5, "1-5", "#2c7bb6"),
    (10, "6-10", "#66c2a5"),
    (50, "11-50", "#abdda4"),
    (100, "51-100", "#ffffbf"),
    (500, "101-500", "#fdae61"),
    (1000, "501-1000", "#f46d43"),
    (100000, "1001+", "#d73027"),
]
NO_BIN_COLOUR = "#cccccc"

# What counts as yes.
TRUE_WORDS = ["y", "yes", "true", "1", "t"]


def dump_date(c: Column) -> Column:
    """Instant of a dump date such as ``Sun Jul 30 07:44:10 -0700 2017``."""
    parsed = F.try_to_timestamp(F.substring(c, 5, 64), F.lit(DUMP_DATE))
    return F.coalesce(parsed, F.timestamp_seconds(F.lit(NO_DATE_SECONDS)))


def read_hours(start: Column, end: Column) -> Column:
    """Hours from start to end, two decimals; null for a 1970 date or a negative span."""

    def in_1970(c: Column) -> Column:
        return F.unix_seconds(c).between(0, _YEAR_1970 - 1)

    micros = F.unix_micros(end) - F.unix_micros(start)
    usable = ~in_1970(start) & ~in_1970(end) & (micros >= 0)
    return F.when(usable, F.round(micros / F.lit(3.6e9), 2))


def shelves_total(shelves: Column) -> Column:
    """Sum of the shelf counts, 0 for no shelves."""
    return F.coalesce(
        F.aggregate(shelves, F.lit(0).cast("long"), lambda acc, s: acc + s["count"].cast("long")),
        F.lit(0).cast("long"),
    )


def series_flag(series: Column) -> Column:
    return F.when(F.size(series) > 0, F.lit("Y")).otherwise(F.lit("N"))


def flag_to_int(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(TRUE_WORDS), F.lit(False)).cast("int")


def count_bin(c: Column) -> Column:
    """Label of the right-closed bin; null below 0 and above the last edge."""
    label = F.when(c < 0, None)
    for edge, name, _ in COUNT_BINS:
        label = label.when(c <= edge, name)
    return label


def bin_colour(c: Column) -> Column:
    colour = F.when(c < 0, NO_BIN_COLOUR)
    for edge, _, value in COUNT_BINS:
        colour = colour.when(c <= edge, value)
    return colour.otherwise(NO_BIN_COLOUR)


def parse_latlng(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def numeric_display(c: Column) -> Column:
    """Text of a number with every ``.0`` taken out; empty for a missing value."""
    return F.coalesce(F.replace(c.cast("string"), F.lit(".0"), F.lit("")), F.lit(""))


def clean_year(c: Column) -> Column:
    return F.coalesce(F.trim(F.translate(c.cast("string"), "[]'", "")), F.lit(""))


def century_label(c: Column) -> Column:
    return F.when(c < 0, F.concat(F.abs(c).cast("string"), F.lit("th c. BCE"))).otherwise(
        F.concat(c.cast("string"), F.lit("th c. CE"))
    )


def era_anchor(c: Column) -> Column:
    return F.concat(F.lit("era-"), c.cast("int").cast("string"))

"""Text time keys: ISO weeks, months and their display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltgrid.functions.text import as_column, strip


def iso_week(ts: Column | str) -> Column:
    """``2020-W05``; the year is the week-based year."""
    ts = as_column(ts)
    year = F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0")
    week = F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0")
    return F.concat(year, F.lit("-W"), week)


def month_key(ts: Column | str) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM")


def parse_created_at(raw: Column | str) -> Column:
    """Wall-clock timestamp of a text date, null when it cannot be read."""
    text = strip(as_column(raw).cast("string"))
    text = F.when((text != "") & (text != "nan"), text)
    parsed = [text.try_cast("timestamp_ntz")]
    for pattern in ("yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyyMMdd"):
        parsed.append(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"))
    return F.coalesce(*parsed)


def week_monday(week: Column | str) -> Column:
    """Monday of an ISO week key; null when the key is malformed."""
    week = as_column(week)
    valid = week.rlike(r"^\d{4}-W\d{2}$")
    year = F.substring(week, 1, 4).try_cast("int")
    number = F.substring(week, 7, 2).try_cast("int")
    first = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    return F.when(valid, F.date_add(first, (number - 1) * 7))


def _short(day: Column) -> Column:
    return F.concat(F.month(day), F.lit("月"), F.day(day), F.lit("日"))


def _full(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("年"), _short(day))


def week_full_range(week: Column | str) -> Column:
    start = week_monday(week)
    end = F.date_add(start, 6)
    tail = F.when(F.year(start) == F.year(end), _short(end)).otherwise(_full(end))
    return F.concat(_full(start), F.lit("-"), tail)


def week_short_range(week: Column | str) -> Column:
    start = week_monday(week)
    end = F.date_add(start, 6)
    return (
        F.when(F.year(start) != F.year(end), F.concat(_full(start), F.lit("-"), _full(end)))
        .when(F.month(start) == F.month(end), F.concat(_short(start), F.lit("-"), F.day(end), F.lit("日")))
        .otherwise(F.concat(_short(start), F.lit("-"), _short(end)))
    )


def week_axis_range(week: Column | str) -> Column:
    start = week_monday(week)
    return F.concat(
        F.date_format(start, "MM.dd"), F.lit("-"), F.date_format(F.date_add(start, 6), "MM.dd")
    )


def month_label(month: Column | str) -> Column:
    """``2020-01`` to ``2020年1月``; other text is returned unchanged."""
    month = as_column(month)
    label = F.concat(
        F.substring(month, 1, 4), F.lit("年"), F.substring(month, 6, 2).try_cast("int"), F.lit("月")
    )
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), label).otherwise(month)


def month_short_label(month: Column | str) -> Column:
    month = as_column(month)
    label = F.concat(F.substring(month, 6, 2).try_cast("int"), F.lit("月"))
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), label).otherwise(month)

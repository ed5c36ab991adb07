"""Month arithmetic on an integer axis: m = 12 * year + month - 1."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(date) -> Column:
    date = _col(date)
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def parse_month(text) -> Column:
    """Month index of a date or a YYYY-MM string; NULL when it is neither."""
    text = _col(text).cast("string")
    as_date = F.coalesce(
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
        F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd"),
    )
    return month_index(as_date)


def month_of_year(m) -> Column:
    """0 for January … 11 for December."""
    return F.pmod(_col(m), F.lit(12)).cast("int")


def year_of(m) -> Column:
    return F.floor(_col(m) / 12).cast("int")


def month_date(m) -> Column:
    return F.make_date(year_of(m), month_of_year(m) + 1, F.lit(1))


def month_end(m) -> Column:
    return F.last_day(month_date(m))


def month_label(m) -> Column:
    return F.date_format(month_date(m), "yyyy-MM")


def target_month(origin, horizon) -> Column:
    return (_col(origin) + _col(horizon)).cast("int")


def year_bridges(origin, horizon) -> Column:
    """Calendar-year crossings between origin and target (12 months ahead counts one)."""
    return F.floor((month_of_year(origin) + _col(horizon)) / 12).cast("int")


def release_month(m, lag) -> Column:
    return (_col(m) + _col(lag)).cast("int")


def release_date(m, lag) -> Column:
    """First day after the observation month plus whole months of release lag."""
    return month_date(_col(m) + 1 + _col(lag))


def delay_timing(target, delay) -> dict[str, Column]:
    target, delay = _col(target), _col(delay)
    return {
        "decision": (target - 1).cast("int"),
        "origin": (target - 1 - delay).cast("int"),
        "horizon": (delay + 1).cast("int"),
    }

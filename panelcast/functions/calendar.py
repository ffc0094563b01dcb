"""Calendar columns as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(c) -> Column:
    """Text ``yyyymmdd`` to a date."""
    return F.to_date(F.col(c) if isinstance(c, str) else c, "yyyyMMdd")


def weekday_monday(c) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(c) + 1


def weekday_label(c) -> Column:
    return F.date_format(c, "E")


def month_label(c) -> Column:
    return F.date_format(c, "MMM")


def year_month(c) -> Column:
    return F.date_format(c, "yyyy-MM")


def weekend_label(c) -> Column:
    return F.when(F.weekday(c) >= 5, "Weekend").otherwise("Workday")


def add_calendar(df: DataFrame, date_col: str = "ts") -> DataFrame:
    """All calendar columns in one projection."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "month_label": month_label(d),
            "year_month": year_month(d),
            "day": F.dayofmonth(d),
            "day_of_year": F.dayofyear(d),
            "day_of_week": F.dayofweek(d),
            "day_of_week_monday": weekday_monday(d),
            "day_of_week_label": weekday_label(d),
            "weekend": weekend_label(d),
            "days_since_origin": F.unix_date(d).cast("double"),
        }
    )

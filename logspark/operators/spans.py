"""Time spans and calendars used by the reports."""

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def as_datetime(value) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(str(value))


def start_of_day(as_of) -> datetime:
    return as_datetime(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def instant(value) -> Column:
    """Literal instant in the session zone, foldable so that it reaches the scan."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp")


def day(value) -> Column:
    return F.lit(as_datetime(value).date())


def within(df: DataFrame, start=None, end=None, inclusive_end: bool = False) -> DataFrame:
    """Rows of ``[start, end)``; on a table with ``log_date`` the partitions are pruned as well."""
    has_day = "log_date" in df.columns
    if start is not None:
        df = df.filter(F.col("ts") >= instant(start))
        if has_day:
            df = df.filter(F.col("log_date") >= day(start))
    if end is not None:
        limit = instant(end)
        df = df.filter(F.col("ts") <= limit if inclusive_end else F.col("ts") < limit)
        if has_day:
            df = df.filter(F.col("log_date") <= day(end))
    return df


def last_days(as_of, days: int) -> tuple[datetime, datetime]:
    """Span of the last ``days`` calendar days, the day of ``as_of`` included."""
    today = start_of_day(as_of)
    return today - timedelta(days=days - 1), today + timedelta(days=1)


def calendar(spark: SparkSession, as_of, days: int, name: str = "log_date") -> DataFrame:
    start, end = last_days(as_of, days)
    first, last = F.lit(start.date()), F.lit((end - timedelta(days=1)).date())
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(name)
    )

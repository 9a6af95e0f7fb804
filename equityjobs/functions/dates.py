"""Korean dates and buckets; clocks come in as columns or literals, never from the system."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"D": "day", "W": "week", "M": "month"}


def korean_time(moment: Column | str) -> Column:
    return F.from_utc_timestamp(F.col(moment) if isinstance(moment, str) else moment, "Asia/Seoul")


def korean_date(moment: Column | str) -> Column:
    return F.to_date(korean_time(moment))


def effective_date(published: str = "published_at", sent: str = "sent_at") -> Column:
    """The published date, else the Korean date of sending."""
    return F.coalesce(F.col(published), korean_date(sent))


def period_start(days: int, now: datetime) -> Column:
    """Korean today minus ``days``."""
    return F.date_sub(korean_date(F.lit(now).cast("timestamp")), days)


def bucket(day: Column, unit: str) -> Column:
    """first day of the day, week (from Monday) or month."""
    return F.to_date(F.date_trunc(UNITS[unit], day))


def expected_trading_day(now: Column, cutoff_hour: int = 20) -> Column:
    """today on a weekday from the cutoff on (Korean time), else the nearest weekday before."""
    local = korean_time(now)
    today = F.to_date(local)
    weekday = F.weekday(today)  # 0 is Monday
    back = F.when(weekday == 0, 3).when(weekday == 6, 2).otherwise(1)
    return F.when((weekday < 5) & (F.hour(local) >= cutoff_hour), today).otherwise(F.date_sub(today, back))


def days_before(day: date, days: int) -> Column:
    return F.date_sub(F.lit(day), days)

"""Half-open UTC periods, their automatic choice, and the side a row falls on."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Period = tuple[datetime, datetime]
_DAY = timedelta(days=1)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6}\d*)?(?:Z|[+-]\d{2}:\d{2})")


def _instant(text: str) -> datetime:
    """An RFC 3339 time with zone, as naive UTC."""
    if not _RFC3339.fullmatch(text):
        raise ValueError("a period takes a date or two times with zone")
    t = datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
    if not 1970 <= t.year <= 2200:
        raise ValueError("years of a period go from 1970 to 2200")
    return t


def parse(text: str) -> Period:
    """A UTC date (the whole day), or ``start/end`` of times with zone; the end is not part of the period."""
    if _DATE.fullmatch(text):
        start = datetime.fromisoformat(text)
        if not 1970 <= start.year <= 2199:
            raise ValueError("dates of a period go from 1970 to 2199")
        return start, start + _DAY
    parts = text.split("/")
    if len(parts) != 2:
        raise ValueError("a period is a UTC date or start/end")
    start, end = map(_instant, parts)
    if end <= start:
        raise ValueError("a period must end after its start")
    return start, end


def automatic(rows: DataFrame, days: int = 7, now: datetime | None = None) -> tuple[Period, Period] | None:
    """The last ``days`` whole days and as many before them; None where the rows span
    less. The first and last day observed count as partial, the day of ``now`` (naive UTC) and
    later ones as unfinished."""
    low, high = rows.agg(F.min("start_time"), F.max("start_time")).first()
    if low is None:
        return None
    midnight = lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0)
    start = midnight(low) if low == midnight(low) else midnight(low) + _DAY
    end = midnight(high) if now is None else min(midnight(high), midnight(now))
    if end - start < 2 * days * _DAY:
        return None
    return (end - 2 * days * _DAY, end - days * _DAY), (end - days * _DAY, end)


def validate(before: Period, after: Period, now: datetime | None = None) -> None:
    """Periods that are compared must be equally long, apart and, with ``now``, over."""
    if before[1] - before[0] != after[1] - after[0]:
        raise ValueError("periods differ in length")
    if before[1] > after[0]:
        raise ValueError("periods overlap or are in the wrong order")
    if now is not None and after[1] > now:
        raise ValueError("the periods are not over")


def sided(rows: DataFrame, before: Period, after: Period) -> DataFrame:
    """The rows from the start of ``before`` to the end of ``after`` with their ``side``; the
    bounds are plain comparisons, which reach the scan."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    near = rows.filter((F.col("start_time") >= at(before[0])) & (F.col("start_time") < at(after[1])))
    return near.withColumn("side", side(F.col("start_time"), before, after))


def side(start_time: Column, before: Period, after: Period) -> Column:
    """0 before, 1 after, -1 outside (a null time is outside)."""
    within = lambda p: (start_time >= F.lit(p[0]).cast("timestamp_ntz")) & (start_time < F.lit(p[1]).cast("timestamp_ntz"))
    return F.when(within(before), 0).when(within(after), 1).otherwise(-1)


#: Automatic periods for DuckDB, over ``usage``: one row of bounds.
SQL = """bounds AS (SELECT date_trunc('day', max(start_time)) AS b2, date_trunc('day', max(start_time)) - INTERVAL 7 DAY AS b1, date_trunc('day', max(start_time)) - INTERVAL 14 DAY AS b0 FROM usage),
sided AS (SELECT c.*, CASE WHEN start_time >= b0 AND start_time < b1 THEN 0 WHEN start_time >= b1 AND start_time < b2 THEN 1 ELSE -1 END AS side FROM classified c CROSS JOIN bounds)"""

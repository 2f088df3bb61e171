"""Time columns and the driver-side range parser. Nothing reads the clock: callers pass ``as_of``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def at(moment: datetime) -> Column:
    """Timestamp literal; a naive moment counts as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return F.lit(moment)


def before(moment: datetime, **delta: float) -> Column:
    return at(moment - timedelta(**delta))


def parse_timestamp(value: Column) -> Column:
    """ISO text with a full date (``Z`` or offset; naive means UTC) or the classic feed format; anything else is null."""
    dated = value.rlike(r"^\s*\d{4,6}-\d{1,2}-\d{1,2}(?:[T ]|\s*$)")
    classic = F.regexp_extract(value, r"^[A-Za-z]{3} ([A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$", 1)
    return F.coalesce(F.when(dated, value.try_cast("timestamp")), F.try_to_timestamp(classic, F.lit("MMM dd HH:mm:ss Z yyyy")))


def market_day_cutoff(ts: Column) -> Column:
    """Last 16:00 New York on a weekday at or before ``ts`` (no holidays), as an instant."""
    local = F.from_utc_timestamp(ts, EASTERN)
    day = F.weekday(local)
    back = (
        F.when(day == 5, 1)
        .when(day == 6, 2)
        .when((F.hour(local) < 16) & (day == 0), 3)
        .when(F.hour(local) < 16, 1)
        .otherwise(0)
    )
    close = F.date_sub(F.to_date(local), back).cast("timestamp") + F.expr("INTERVAL 16 HOURS")
    return F.to_utc_timestamp(close, EASTERN)


def et_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, EASTERN))


def et_day_bounds(day: Column) -> tuple[Column, Column]:
    """UTC start and end of an Eastern calendar day (23 or 25 hours long where clocks change)."""
    start = F.to_utc_timestamp(day.cast("date").cast("timestamp"), EASTERN)
    end = F.to_utc_timestamp(F.date_add(day.cast("date"), 1).cast("timestamp"), EASTERN)
    return start, end


def _cutoff_of(as_of: datetime) -> datetime:
    from zoneinfo import ZoneInfo

    local = as_of.astimezone(ZoneInfo(EASTERN))
    back = {5: 1, 6: 2}.get(local.weekday(), 0 if local.hour >= 16 else 3 if local.weekday() == 0 else 1)
    close = (local - timedelta(days=back)).replace(hour=16, minute=0, second=0, microsecond=0)
    return close.astimezone(timezone.utc)


def time_range(spec: str, as_of: datetime) -> tuple[datetime | None, datetime | None]:
    """``today``, ``24h``/``7d``/``2w``/``1m``, a day, or ``A..B`` -> two literals that push down to the scan."""
    spec = spec.strip().lower()
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    if spec == "today":
        return _cutoff_of(as_of), None
    if found := re.fullmatch(r"(\d+)([hdwm])", spec):
        hours = {"h": 1, "d": 24, "w": 24 * 7, "m": 24 * 30}[found[2]]
        return as_of - timedelta(hours=int(found[1]) * hours), None
    first, dots, last = spec.partition("..")
    try:
        start = datetime.strptime(first, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        end = datetime.strptime(last if dots else first, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    except ValueError:
        return None, None
    return start, end + timedelta(days=1)


def in_range(ts: Column, since: datetime | None, until: datetime | None) -> Column:
    """Half-open; a null time fails as soon as one bound is given."""
    if since is None and until is None:
        return F.lit(True)
    test = ts.isNotNull()
    if since is not None:
        test = test & (ts >= at(since))
    if until is not None:
        test = test & (ts < at(until))
    return test


def vision_age_ok(created_at: Column, max_age_days: int | None, as_of: datetime) -> Column:
    if max_age_days is None:
        return F.lit(True)
    return F.coalesce(created_at >= before(as_of, days=max(0, max_age_days)), F.lit(False))


def quiet_hours(ts: Column, tz: str = "UTC", start: int = 23, end: int = 8) -> Column:
    """The local hour lies in the quiet window, which may wrap around midnight."""
    hour = F.hour(F.from_utc_timestamp(ts, tz))
    if start > end:
        return (hour >= start) | (hour < end)
    return (hour >= start) & (hour < end)

"""Half-open date bounds of search keys and filter presets, in UTC, with an injected now."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?")


def moment(stamp: datetime) -> Column:
    """A literal of the instant; a datetime without a zone is in UTC, whatever the zone of the host."""
    return F.lit(stamp if stamp.tzinfo else stamp.replace(tzinfo=timezone.utc))


@dataclass(frozen=True)
class Bounds:
    """start <= t < end; None is open."""

    start: datetime | None = None
    end: datetime | None = None


def period(text: str) -> Bounds | None:
    """The year, month or day that text names; None if it names none."""
    found = _DATE.fullmatch(text.strip())
    if not found:
        return None
    year, month, day = (int(x) if x else None for x in found.groups())
    try:
        start = datetime(year, month or 1, day or 1)
        if day:
            return Bounds(start, start + timedelta(days=1))
        if month:
            return Bounds(start, datetime(year + month // 12, month % 12 + 1, 1))
        return Bounds(start, datetime(year + 1, 1, 1))
    except ValueError:
        return None


def search_bounds(key: str, value: str) -> Bounds | None:
    """date:Y, date:Y-M, date:Y-M-D or date:a..b (swapped if inverted); after: from a period's start on;
    before: up to the end of a period, so a year is included."""
    if key == "date" and ".." in value:
        a, b = (period(x) for x in value.split("..", 1))
        if a is None or b is None:
            return None
        return Bounds(min(a.start, b.start), max(a.end, b.end))
    found = period(value)
    if found is None:
        return None
    return {"date": found, "after": Bounds(found.start, None), "before": Bounds(None, found.end)}.get(key)


def preset_bounds(preset: str, now: datetime, start: str | None = None, end: str | None = None) -> Bounds:
    """today, week (7 days back), month (30 days back), custom (inclusive days, swapped if inverted)."""
    midnight = datetime(now.year, now.month, now.day)
    if preset == "today":
        return Bounds(midnight, midnight + timedelta(days=1))
    if preset in ("week", "month"):
        return Bounds(midnight - timedelta(days=7 if preset == "week" else 30), None)
    a, b = period(start or ""), period(end or "")
    if a and b:
        return Bounds(min(a.start, b.start), max(a.end, b.end))
    return Bounds(a.start if a else None, b.end if b else None)

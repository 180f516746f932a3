"""Time functions: named periods, file times, generalized times, calendar and minute buckets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: 100 ns ticks between 1601 and 1970, and the file time that means never.
FILETIME_EPOCH, FILETIME_NEVER = 116444736000000000, 9223372036854775807


def _months(start: datetime, n: int) -> datetime:
    year, month = divmod(start.year * 12 + start.month - 1 + n, 12)
    return start.replace(year=year, month=month + 1)


def period(name: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """(start, end) of a named period as seen at ``now``; an end of None is open."""
    hour = now.replace(minute=0, second=0, microsecond=0)
    day = hour.replace(hour=0)
    month = day.replace(day=1)
    quarter = month.replace(month=(month.month - 1) // 3 * 3 + 1)
    fixed = {
        "PastHour": (hour - timedelta(hours=1), hour), "CurrentHour": (hour, hour + timedelta(hours=1)),
        "PastDay": (day - timedelta(days=1), day), "CurrentDay": (day, day + timedelta(days=1)), "Today": (day, day + timedelta(days=1)), "Yesterday": (day - timedelta(days=1), day),
        "PastMonth": (_months(month, -1), month), "CurrentMonth": (month, _months(month, 1)), "PastQuarter": (_months(quarter, -3), quarter), "CurrentQuarter": (quarter, _months(quarter, 3)),
        "Everything": (None, None),
    }
    if name in fixed:
        return fixed[name]
    for n in (3, 7, 14):
        if name == f"Last{n}Days":
            return day - timedelta(days=n), None
    for n in (1, 2, 3, 6, 12, 16, 24):
        if name == f"Last{n}Hour{'s' * (n > 1)}":
            return now - timedelta(hours=n), now
    for n in (15, 30):
        if name == f"Last{n}Minutes":
            return now - timedelta(minutes=n), now
    for at, weekday in enumerate(_DAYS):
        if name == f"TillLast{weekday}":
            return day - timedelta(days=(day.weekday() - at) % 7), None
    raise ValueError(f"no period {name!r}")


def in_period(time: Column, name: str, now: datetime) -> Column:
    """Rows of a named period; ends are exclusive for calendar periods and inclusive for those that end now."""
    start, end = period(name, now)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (time >= F.lit(start))
    if end is not None:
        inside = inside & ((time <= F.lit(end)) if end == now else (time < F.lit(end)))
    return F.coalesce(inside, F.lit(False))


def from_filetime(ticks: Column) -> Column:
    """The instant of a 64-bit file time; 0 and the greatest value mean never and give null."""
    t = ticks.cast("long")
    return F.when((t > 0) & (t < FILETIME_NEVER), F.timestamp_micros(F.floor((t - FILETIME_EPOCH) / 10).cast("long")))


def from_generalized(text: Column) -> Column:
    """The instant of ``yyyyMMddHHmmss[.f](Z|+hhmm)``; null if malformed."""
    shape = r"^(\d{14})(?:[.,](\d+))?(Z|[+-]\d{4})$"
    part = lambda n: F.regexp_extract(text, shape, n)
    zone = F.when(part(3) == "Z", "+00:00").otherwise(F.concat(F.substring(part(3), 1, 3), F.lit(":"), F.substring(part(3), 4, 2)))
    micros = F.rpad(F.substring(part(2), 1, 6), 6, "0")
    return F.when(text.rlike(shape), F.try_to_timestamp(F.concat(part(1), F.lit("."), micros, zone), F.lit("yyyyMMddHHmmss.SSSSSSxxx")))


def parse_utc(text: Column) -> Column:
    """An instant from text; without an offset it is UTC (the session's zone); null if malformed."""
    return F.try_to_timestamp(text)


#: Orders of date parts that ``parse_loose`` tries behind ISO forms: month first, as text without a culture is read.
_LOOSE = ("M/d/yyyy H:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "M/d/yyyy h:mm a", "M/d/yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d", "d MMM yyyy H:mm:ss", "d MMM yyyy", "d MMM yyyy H:mm:ss 'GMT'")


def parse_loose(text: Column) -> Column:
    """An instant from text of one of several common forms, direction marks left out; null if none fits."""
    plain = F.trim(F.regexp_replace(text, r"\p{Cf}|^\s*[A-Za-z]{3},\s*", ""))  # marks, and a day's name before a date
    return F.coalesce(F.try_to_timestamp(plain), *[F.try_to_timestamp(plain, F.lit(f)) for f in _LOOSE])


def calendar_start(time: Column, unit: str, zone: str = "UTC") -> Column:
    """The instant at which the hour, day, ISO week or month of ``time`` begins in ``zone``."""
    if unit == "Hour":  # an hour keeps its own offset, also where clocks are set back
        offset = F.unix_micros(F.from_utc_timestamp(time, zone)) - F.unix_micros(time)
        return F.timestamp_micros(F.unix_micros(F.date_trunc("HOUR", F.timestamp_micros(F.unix_micros(time) + offset))) - offset)
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(time, zone)), zone)


def calendar_end(start: Column, unit: str, zone: str = "UTC") -> Column:
    """Where the bucket that begins at ``start`` ends."""
    if unit == "Hour":
        return start + F.expr("INTERVAL 1 HOUR")
    local = F.from_utc_timestamp(start, zone)
    step = {"Day": F.expr("INTERVAL 1 DAY"), "Week": F.expr("INTERVAL 7 DAY"), "Month": F.expr("INTERVAL 1 MONTH")}[unit]
    return F.to_utc_timestamp(local + step, zone)


def bucket_label(start: Column, unit: str, zone: str = "UTC") -> Column:
    """``yyyy-MM-dd[ HH:00] +hh:mm`` of a bucket's start."""
    local = F.from_utc_timestamp(start, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(start)) / 60_000_000).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:00" if unit == "Hour" else "yyyy-MM-dd"), F.lit(" "), offset)


def minute_bucket(time: Column, minutes: int) -> Column:
    """``time`` floored to multiples of N minutes counted from year 1."""
    step = minutes * 60_000_000
    offset = 719162 * 86_400_000_000 % step
    m = F.unix_micros(time)
    return F.timestamp_micros(m - F.pmod(m + F.lit(offset), F.lit(step)))


def receive_lag(received: Column, created: Column) -> Column:
    """Seconds from creation to receipt, never under 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(received) - F.unix_micros(created)) / 1e6)

"""Next runs of schedules. "Local" minutes are minutes of the UTC day: the stored time zone isn't read.
All functions are column expressions over epoch milliseconds, minutes of the day and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000


def _day(now: Column) -> Column:
    return F.floor(now / DAY)


def daily(now: Column, minutes: Column) -> Column:
    """The earliest minute strictly after now, today or tomorrow; now itself without minutes."""
    slots = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda d: F.transform(minutes, lambda m: (_day(now) + d) * DAY + m.cast("long") * 60_000)))
    return F.coalesce(F.array_min(F.filter(slots, lambda t: t > now)), now)


def weekly(now: Column, minutes: Column, mask: Column) -> Column:
    """As daily, on days whose bit is set: bit 0 is Sunday. An empty mask means every day."""
    powers = F.array(*(F.lit(1 << k) for k in range(7)))
    on = lambda d: mask.bitwiseAND(F.get(powers, ((_day(now) + d + 4) % 7).cast("int"))) != 0
    days = F.filter(F.sequence(F.lit(0), F.lit(7)), on)
    slots = F.flatten(F.transform(days, lambda d: F.transform(minutes, lambda m: (_day(now) + d) * DAY + m.cast("long") * 60_000)))
    found = F.coalesce(F.array_min(F.filter(slots, lambda t: t > now)), now)
    return F.when(mask == 0, daily(now, minutes)).otherwise(found)


def monthly(now: Column, minutes: Column, mask: Column, months: int = 24) -> Column:
    """The first slot after now on a day of the month whose bit is set (bit 0: the first). Days that a month lacks are
    left out. Looks at two years of days, and returns now where none fits."""
    days = F.sequence(F.lit(0), F.lit(months * 31))
    date = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), (_day(now) + d).cast("int"))
    powers = F.array(*(F.lit(1 << k) for k in range(31)))
    on = F.filter(days, lambda d: mask.cast("long").bitwiseAND(F.element_at(powers, F.dayofmonth(date(d)))) != 0)
    # two days with a slot are enough: today's may be over
    near = F.slice(on, 1, 2)
    slots = F.flatten(F.transform(near, lambda d: F.transform(minutes, lambda m: (_day(now) + d) * DAY + m.cast("long") * 60_000)))
    return F.coalesce(F.array_min(F.filter(slots, lambda t: t > now)), now)


def valid_minutes(minutes: Column) -> Column:
    """One to eight sorted, different minutes of the day, at least thirty apart, also over midnight."""
    gaps = F.transform(F.sequence(F.lit(1), F.size(minutes)), lambda k: F.when(k < F.size(minutes), F.get(minutes, k) - F.get(minutes, k - 1)).otherwise(F.get(minutes, F.lit(0)) + 1440 - F.get(minutes, k - 1)))
    sizes = (F.size(minutes) >= 1) & (F.size(minutes) <= 8)
    return F.coalesce(sizes & F.forall(minutes, lambda m: (m >= 0) & (m < 1440)) & F.forall(gaps, lambda g: g >= 30), F.lit(False))

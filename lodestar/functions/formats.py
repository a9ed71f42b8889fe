"""Durations, rates and clock times as text. Exact halves are rounded up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(ms: Column) -> Column:
    """1000 ms and more in seconds with two digits; from 100 none, from 1 one, below two digits of milliseconds."""
    return (F.when(ms >= 1000, F.format_string("%.2fs", ms / 1000)).when(ms >= 100, F.format_string("%.0fms", ms))
            .when(ms >= 1, F.format_string("%.1fms", ms)).otherwise(F.format_string("%.2fms", ms)))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def time_ago(ts: Column, now: Column) -> Column:
    """How long ago in the largest whole unit, as 5 min. ago; in 5 min. for what is to come; now for less than a second."""
    far = now.cast("double") - ts.cast("double")
    n = F.floor(F.abs(far))
    units = ((31_536_000, "yr."), (2_592_000, "mo."), (604_800, "wk."), (86_400, "day"), (3600, "hr."), (60, "min."), (1, "sec."))
    text = F.lit(None)
    for size, unit in reversed(units):
        count = F.floor(n / size)
        name = F.when(count == 1, "day").otherwise("days") if unit == "day" else F.lit(unit)
        text = F.when(n >= size, F.concat(count.cast("string"), F.lit(" "), name)).otherwise(text)
    return F.when(far.isNull(), F.lit(None)).when(n == 0, "now").when(far > 0, F.concat(text, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), text))


def speed_text(per_second: Column) -> Column:
    """Items a second from one on, else seconds an item; empty for no speed."""
    return (F.when(per_second >= 1, F.format_string("%.1f items/s", per_second))
            .when(per_second > 0, F.format_string("%.1f s/item", 1 / per_second)).otherwise(F.lit("")))


def eta_seconds(remaining: Column, per_second: Column) -> Column:
    return F.when(per_second > 0, remaining / per_second)


def eta_text(seconds: Column) -> Column:
    """Rounded seconds below a minute, whole minutes below an hour, else hours, with minutes if there are any."""
    hours, minutes = F.floor(seconds / 3600).cast("string"), F.floor(seconds % 3600 / 60)
    return (F.when(seconds < 60, F.format_string("%.0f s", seconds))
            .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
            .when(minutes > 0, F.concat(hours, F.lit(" h "), minutes.cast("string"), F.lit(" min"))).otherwise(F.concat(hours, F.lit(" h"))))


def progress(completed: Column, total: Column) -> Column:
    """A share from 0 to 1; 0 where there is no total."""
    return F.when(total > 0, completed / total).otherwise(F.lit(0.0))


def is_progress(completed: Column, total: Column) -> Column:
    return F.coalesce((total > 0) & (completed >= 0) & (completed <= total), F.lit(False))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000


def phase(state: Column, pending: Column) -> Column:
    """What a view shows for a build's state: a ready index with pending assets counts as partial."""
    return (F.when(state.isin("building", "preparing"), "running").when(state == "failed", "failed")
            .when(state == "ready", F.when(pending > 0, "partial").otherwise("done")).otherwise("empty"))

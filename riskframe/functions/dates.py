from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


def period_start(ts: Column, grain: str = "day") -> Column:
    """Start of the period as ``timestamp_ntz``.

    Goes through a date, because ``date_trunc`` would pass a zoneless time
    through the session's time zone.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    day = ts.cast("date")
    start = day if grain == "day" else F.trunc(day, grain)
    return start.cast("timestamp_ntz")

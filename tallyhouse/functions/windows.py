"""Time grains, windows and metric names."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_TIME = "all time"

# The grains the command line offers.
BATCH_GRAINS = ("all time", "14 days", "7 days", "1 day", "12 hours", "1 hour")
STREAM_GRAINS = ("30 minutes", "5 minutes", "1 minute", "30 seconds")


UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds(grain: str) -> int:
    """Length of a grain such as ``12 hours``."""
    count, unit = grain.split()
    return int(count) * UNIT_SECONDS[unit.rstrip("s")]


def grain_text(grain: str) -> str:
    return "_".join(grain.split())


def metric_name(metric: str, grain: str) -> str:
    return f"{metric}__{grain_text(grain)}"


def event_window(grain: str, slide: str | None = None) -> Column:
    """Half-open ``[start, end)`` window, aligned to the epoch."""
    if slide is None:
        return F.window("sent_at", grain)
    return F.window("sent_at", grain, slide)


def window_end(grain: str, slide: str | None = None) -> Column:
    """The label of an event's window. Grouping by this one timestamp gives the
    same groups as the (start, end) pair with a narrower key."""
    return event_window(grain, slide)["end"]


def time_literal(moment: datetime) -> Column:
    """A time as a zone-less literal (UTC is meant), comparable with either
    timestamp type. Text keeps it clear of the driver's own time zone."""
    if moment.tzinfo:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def run_time(as_of: datetime | None) -> Column:
    """The time stamped on all-time rows: the given one, or now."""
    return F.current_timestamp() if as_of is None else time_literal(as_of).cast("timestamp")

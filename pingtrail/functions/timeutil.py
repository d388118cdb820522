"""Time arithmetic on exact microseconds (session zone UTC), and interval binning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

US = 1_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Epoch microseconds; zone-less timestamps are read in the session zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(float(US))


def from_seconds(epoch: Column | str) -> Column:
    """Fractional epoch seconds to a timestamp."""
    return F.timestamp_seconds(col(epoch))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(col(us).cast("bigint"))


def us_of(span_seconds: float) -> int:
    return int(round(span_seconds * US))


def round_micros(us: Column, every_s: float, how: str = "nearest") -> Column:
    step = us_of(every_s)
    shift = {"nearest": step // 2, "floor": 0, "ceil": step - 1}[how]
    moved = us + F.lit(shift)
    return moved - F.pmod(moved, F.lit(step))


def round_time(ts: Column | str, every_s: float, how: str = "nearest") -> Column:
    """Round to a multiple of ``every_s`` seconds; ties of ``nearest`` go up."""
    return from_micros(round_micros(micros(ts), every_s, how))


def parse_time(text: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss", strict: bool = False) -> Column:
    """Text to timestamp; dirty text gives null unless ``strict``."""
    return (F.to_timestamp if strict else F.try_to_timestamp)(col(text), F.lit(fmt))


def clock(ts: Column | str) -> Column:
    return F.date_format(col(ts), "HH:mm:ss")


def local_date_text(ts: Column | str, shift_s: int = -21600) -> Column:
    return F.date_format(from_micros(micros(ts) + F.lit(us_of(shift_s))), "MM-dd-yyyy")


def local_clock(ts: Column | str, shift_s: int = -21600) -> Column:
    return clock(from_micros(micros(ts) + F.lit(us_of(shift_s))))


def solar_date(ts: Column | str, lon: Column | str) -> Column:
    """Calendar date of local mean solar time, so that dusk belongs to the day it ends."""
    offset = F.floor(col(lon) * (240.0 * US) + 0.5).cast("bigint")
    return F.to_date(from_micros(micros(ts) + offset))


def cut(value: Column | str, breaks: list[float], right: bool = True) -> Column:
    """Label of the interval holding ``value``; null outside. ``breaks`` may end in infinity."""
    value = col(value)
    out = None
    for lo, hi in zip(breaks, breaks[1:]):
        low, high = (f"{b:g}" if b != float("inf") else "Inf" for b in (lo, hi))
        if right:
            inside, label = (value > lo) & (value <= hi), f"({low},{high}]"
        else:
            inside, label = (value >= lo) & (value < hi), f"[{low},{high})"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out

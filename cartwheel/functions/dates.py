"""Trailing windows, bounded slices and week buckets over a daily date column.

Two families of windows exist and differ at the lower bound:

* candidate windows include it: ``t_dat >= last_day - window``;
* feature weeks exclude it: ``last_day - 7(i+1) < t_dat <= last_day - 7i``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# name -> (unit, amount); months and years follow the calendar and clamp at month end
WINDOWS = {"all": None, "1w": ("days", 7), "1m": ("months", 1), "1y": ("months", 12)}


def last_day(frame: DataFrame, end: Column | str | None = None) -> Column:
    """The given day, or the latest day of ``frame`` as a scalar subquery (one row, run once)."""
    if end is None:
        return frame.agg(F.max("t_dat")).scalar()
    return F.lit(end).cast("date") if isinstance(end, str) else end


def with_last_day(frame: DataFrame, end: Column | str | None = None, name: str = "_end") -> DataFrame:
    """Attach the last day as a column, so that a plan holds the subquery once."""
    return frame.withColumn(name, last_day(frame, end))


def last_day_value(frame: DataFrame) -> str:
    """The latest day as text. One small job; flows that use the day many times pass it on
    as a literal, which reaches the scans as a pushed filter."""
    return str(frame.agg(F.max("t_dat")).first()[0])


def _move(day: Column, window: str, sign: int) -> Column:
    unit, amount = WINDOWS[window]
    if unit == "days":
        return F.date_add(day, sign * amount)
    return F.add_months(day, sign * amount)


def window_start(day: Column, window: str) -> Column:
    return _move(day, window, -1)


def in_window(end: Column, window: str) -> Column:
    """Condition of a trailing window."""
    if WINDOWS[window] is None:
        return F.lit(True)
    return F.col("t_dat") >= window_start(end, window)


def in_slice(end: Column, start: str, length: str) -> Column:
    """Condition of ``[end - start, end - start + length]``, both bounds included.

    ``length`` has no effect when ``start`` is "all", nor when it is "all" itself.
    """
    if WINDOWS[start] is None or WINDOWS[length] is None:
        return in_window(end, start)
    begin = window_start(end, start)
    return (F.col("t_dat") >= begin) & (F.col("t_dat") <= _move(begin, length, 1))


def trailing(history: DataFrame, window: str = "all", end: Column | str | None = None) -> DataFrame:
    """Rows of the trailing window that ends at the latest day of ``history``."""
    if WINDOWS[window] is None:
        return history
    return history.filter(in_window(last_day(history, end), window))


def window_slice(history: DataFrame, start: str, length: str, end: Column | str | None = None) -> DataFrame:
    """Rows of a bounded slice before the latest day of ``history``."""
    if WINDOWS[start] is None:
        return history
    rows = with_last_day(history, end)
    return rows.filter(in_slice(F.col("_end"), start, length)).drop("_end")


def slice_grid(windows: Sequence[str] = tuple(WINDOWS)) -> dict[str, tuple[str, str]]:
    """The distinct slices of the start × length product, by name.

    Every length of start "all" is the whole history; one of them is kept.
    """
    return {"all": ("all", "all")} | {f"{s}+{l}": (s, l) for s in windows if s != "all" for l in windows}


def tag_windows(history: DataFrame, conditions: Mapping[str, Column], name: str = "win") -> DataFrame:
    """Each row once per window it lies in: all windows in one pass over the facts."""
    inside = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]))
    return history.withColumn(name, F.explode(inside))


def week_bucket(end: Column, date_col: str = "t_dat") -> Column:
    """0 for the seven days up to ``end``, 1 for the seven before, and so on."""
    return F.floor(F.datediff(end, F.col(date_col)) / 7).cast("int")

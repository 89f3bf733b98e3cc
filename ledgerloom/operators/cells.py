"""Calendar cells: spans of days cut into whole years, months and single days.

A span [lo, hi) is covered by few cells (at most two rims of days and of months, and the years
between), a day lies in exactly three. So "which spans hold this day" is an equality join of three
rows per day, and what a cell knows about all spans that cover it can be folded into one row before
any day meets it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ceil(d: Column, unit: str) -> Column:
    start = F.trunc(d, unit)
    return F.when(start == d, d).otherwise(F.add_months(start, 12 if unit == "year" else 1))


def _steps(lo: Column, hi: Column, unit: str) -> Column:
    """Cells of the unit that start in [lo, hi)."""
    every = F.sequence(lo, F.date_sub(hi, 1), F.expr(f"interval 1 {unit}"))
    return F.when(lo < hi, F.transform(every, lambda x: F.struct(F.lit(unit[0]).alias("unit"), x.alias("start")))).otherwise(F.array().cast("array<struct<unit:string,start:date>>"))


def span_cells(lo: Column, hi: Column) -> Column:
    """array<struct<unit,start>> that covers the days of [lo, hi) once; empty if there are none."""
    m0, m1 = _ceil(lo, "month"), F.trunc(hi, "month")
    y0, y1 = _ceil(m0, "year"), F.trunc(m1, "year")
    months = F.when(y0 <= y1, F.concat(_steps(m0, y0, "month"), _steps(y0, y1, "year"), _steps(y1, m1, "month"))).otherwise(_steps(m0, m1, "month"))
    return F.when(m0 <= m1, F.concat(_steps(lo, m0, "day"), months, _steps(m1, hi, "day"))).otherwise(_steps(lo, hi, "day"))


def day_cells(d: Column) -> Column:
    """The three cells a day lies in."""
    return F.array(*[F.struct(F.lit(u[0]).alias("unit"), (d if u == "day" else F.trunc(d, u)).alias("start")) for u in ("day", "month", "year")])


def after_last(last: Column) -> Column:
    """An end for open spans: the first day of the year behind ``last``, so that they cost no rim."""
    return F.add_months(F.trunc(last, "year"), 12)

"""Row-level numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the turbine transfer curve: wind speeds (m/s) and rated output.
CUT_IN, RATED, CUT_OUT = 3.0, 12.0, 25.0


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_below(c: str | Column, floor: float = 0.0) -> Column:
    return F.greatest(column(c), F.lit(float(floor)))


def magnitude(u: str | Column, v: str | Column) -> Column:
    u, v = column(u), column(v)
    return F.sqrt(u * u + v * v)


def bearing(u: str | Column, v: str | Column) -> Column:
    """Angle of the vector in degrees, -180 to 180."""
    return F.degrees(F.atan2(column(v), column(u)))


def degree_circle(name: str, degrees: str | Column) -> dict[str, Column]:
    rad = F.radians(column(degrees))
    return {f"{name}_sin": F.sin(rad), f"{name}_cos": F.cos(rad)}


def circular_step(now: Column, before: Column) -> Column:
    """Shortest way round between two bearings in degrees; 0 where there is no earlier one."""
    gap = F.abs(now - before)
    return F.coalesce(F.least(gap, F.lit(360.0) - gap), F.lit(0.0))


def safe_divide(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    num, den = column(num), column(den)
    return F.when(den != 0, num / den).otherwise(F.lit(float(default)))


def transfer_curve(speed: str | Column, rated_power: float = 1.0) -> Column:
    """Output of a turbine: linear between cut-in and rated speed, flat to cut-out, else 0."""
    s = column(speed)
    rising = (s - CUT_IN) / (RATED - CUT_IN) * rated_power
    return (
        F.when(s < CUT_IN, F.lit(0.0))
        .when(s < RATED, rising)
        .when(s < CUT_OUT, F.lit(float(rated_power)))
        .otherwise(F.lit(0.0))
    )


def derate(y: str | Column, cover: str | Column, share: float = 0.7) -> Column:
    return column(y) * (F.lit(1.0) - F.lit(share) * column(cover))

"""Scores and labels as Columns: quotients by zero are 0, halves round up, results stay in their ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def percentage(covered: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(covered * 100.0, total), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def safety(average: Column, above: Column, coverage: Column | float = 0.0) -> Column:
    """100 less 0.3 a point of missing coverage, 2 a point of average complexity over 10, and 2 a file above it."""
    cover = coverage if isinstance(coverage, Column) else F.lit(coverage)
    return _clamp(F.lit(100.0) - (F.lit(100.0) - cover) * 0.3 - F.greatest(average - 10.0, F.lit(0.0)) * 2 - above * 2)


def risk(direct: Column, transitive: Column, complexity: Column, coverage: Column) -> Column:
    """5 a direct dependent, 2 a transitive one, 2 a point of complexity, 0.3 a point of missing coverage; at most 100."""
    return F.least(F.lit(100.0), F.round(direct * 5.0 + transitive * 2.0 + complexity * 2.0 + (F.lit(100.0) - coverage) * 0.3))


def health(average: Column, coverage: Column, opportunities: Column) -> Column:
    """100 less 3 a point of average complexity over 10 (30 at most), 0.4 a point of missing coverage and 0.5 an
    opportunity (30 at most), rounded."""
    complex_ = F.when(average > 10, F.least(F.lit(30.0), (average - 10) * 3.0)).otherwise(F.lit(0.0))
    return _clamp(F.round(F.lit(100.0) - complex_ - (F.lit(100.0) - coverage) * 0.4 - F.least(F.lit(30.0), opportunities * 0.5)))


def risk_label(x: Column) -> Column:
    return F.when(x > 70, "high").when(x > 40, "medium").otherwise("low")


def safety_label(x: Column) -> Column:
    return F.when(x >= 80, "high").when(x >= 60, "medium").otherwise("low")


def coverage_label(x: Column) -> Column:
    return F.when(x >= 80, "good").when(x >= 50, "fair").otherwise("poor")


def ratio_label(x: Column) -> Column:
    return F.when(x > 0.5, "good").when(x > 0.2, "fair").otherwise("poor")


def impact_label(x: Column) -> Column:
    return F.when(x < 20, "low").when(x < 50, "medium").when(x < 80, "high").otherwise("critical")


def meets(overall: Column, threshold: float | None) -> Column:
    """Null where no threshold (or 0) is given."""
    return (overall >= F.lit(float(threshold))) if threshold else F.lit(None).cast("boolean")


def shown(x: Column, digits: int = 1) -> Column:
    """``x`` with ``digits`` decimals, rounded by its exact binary value, halves up (away from zero): 1.005 gives 1.00.

    Twice the number of units is split into a double and its exact error, so no rounding comes before the last one.
    Numbers of 2^52 units and more have no fraction to round; null gives null.
    """
    x = x.cast("double")
    y, unit = F.abs(x), 2.0 * 10**digits
    wide = y * F.lit(134217729.0)
    high = wide - (wide - y)
    near = y * F.lit(unit)
    error = (high * F.lit(unit) - near) + (y - high) * F.lit(unit)
    whole = F.floor(near).cast("bigint")
    rest = (near - whole.cast("double")) + error
    n = F.when(whole % 2 == 0, whole).when(rest < 0, whole - 1).otherwise(whole + 1)
    n = F.shiftright(n, 1)
    right = n % 10**digits
    left = F.call_function("div", n - right, F.lit(10**digits))
    text = F.concat(left.cast("string"), F.lit("." if digits else ""), F.lpad(right.cast("string"), digits, "0") if digits else F.lit(""))
    small = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.when(near < F.lit(2.0**52), small).otherwise(F.format_string(f"%.{digits}f", x))

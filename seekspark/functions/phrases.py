"""What a results page and a dashboard say: dates, ages, counts, the state of the index, the chart of its growth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THIN = "\u2009"


def _utc(seconds: Column, pattern: str) -> Column:
    """In UTC, whatever the session's zone."""
    at = F.timestamp_add("SECOND", seconds.try_cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    # Java writes a plus before years of five digits.
    return F.coalesce(F.translate(F.date_format(at, pattern), "+", ""), F.lit("unknown"))


def format_date(seconds: Column) -> Column:
    return _utc(seconds, "dd MMM yyyy, HH:mm 'UTC'")


def format_clock(seconds: Column) -> Column:
    return _utc(seconds, "HH:mm")


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def elapsed_phrase(seconds: Column) -> Column:
    """A duration, as short as it stays clear."""
    return F.when(seconds < 60, F.concat(_whole(seconds), F.lit(" s"))).when(seconds < 3600, F.concat(_whole(seconds / 60), F.lit(" min"))).otherwise(F.format_string("%.1f h", seconds / 3600.0))


def format_age(seconds: Column) -> Column:
    age = seconds.try_cast("double")
    return F.when(age.isNull(), "never").when(age < 5, "just now").otherwise(F.concat(elapsed_phrase(age), F.lit(" ago")))


def format_count(value: Column) -> Column:
    """Thin spaces between thousands; 0 for what is no number."""
    return F.translate(F.format_number(F.coalesce(value.try_cast("long"), F.lit(0).cast("long")), 0), ",", THIN)


BOUND = "\u00a0"


def format_bytes(value: Column) -> Column:
    """In the largest unit up to TB that leaves 1 or more; one decimal under 10."""
    out = F.concat(value.cast("long").cast("string"), F.lit(BOUND + "B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        size = value / float(1024**k)
        out = F.when(size >= 1, F.concat(F.when(size < 10, F.format_string("%.1f", size)).otherwise(F.format_string("%.0f", size)), F.lit(BOUND + unit))).otherwise(out)
    return F.when(value.isNull(), "—").otherwise(out)


def format_duration(seconds: Column) -> Column:
    """Seconds, minutes and seconds, hours and minutes, or days."""
    part = lambda n, unit: F.concat(_whole(n), F.lit(BOUND + unit))
    minutes = F.concat(part(seconds / 60, "min "), F.lpad(_whole(seconds % 60), 2, "0"), F.lit(BOUND + "s"))
    hours = F.concat(part(seconds / 3600, "h "), part(seconds % 3600 / 60, "min"))
    return F.when(seconds.isNull(), "—").when(seconds < 60, part(seconds, "s")).when(seconds < 3600, minutes).when(seconds < 86400, hours).otherwise(part(seconds / 86400, "d"))


def _rate(per_minute: Column) -> Column:
    return F.translate(F.format_number(F.bround(per_minute, 0), 0), ",", " ")


def growth_state(available: Column, idle: Column, per_minute: Column, age_s: Column) -> Column:
    """One phrase for the indexer: nothing known, idle, quiet for a while with its average, running, or its rate."""
    rate = F.coalesce(per_minute, F.lit(0.0))
    quiet = F.concat(F.lit("quiet "), elapsed_phrase(age_s), F.lit(" · "), _rate(rate), F.lit("/min avg"))
    return (
        F.when(~F.coalesce(available, F.lit(False)), "no index reading yet").when(F.coalesce(idle, F.lit(False)), "indexer idle")
        .when(F.coalesce(age_s > 60, F.lit(False)), quiet).when(rate <= 0, "indexer running").otherwise(F.concat(F.lit("indexing "), _rate(rate), F.lit("/min")))
    )


def growth_is_live(available: Column, idle: Column, age_s: Column) -> Column:
    """Whether something is happening now, which is less than not being idle."""
    return F.coalesce(available, F.lit(False)) & ~F.coalesce(idle, F.lit(False)) & F.coalesce(age_s <= 60, F.lit(True))


def positive_int(raw: str | None, default: int, minimum: int = 1) -> int:
    """A whole number from a query string; ``default`` for anything else or less."""
    try:
        value = int(raw) if raw is not None else default
    except ValueError:
        return default
    return value if raw is None or value >= minimum else default


def tangents(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the points of a monotone cubic (Fritsch and Carlson): between two points the curve stays between their values."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    step, rise = np.diff(x), np.diff(y)
    slope = np.divide(rise, step, out=np.zeros(n - 1), where=step != 0)
    out = np.empty(n)
    out[0], out[-1] = slope[0], slope[-1]
    out[1:-1] = np.where(slope[:-1] * slope[1:] <= 0, 0.0, (slope[:-1] + slope[1:]) / 2)
    # A limit on one stretch changes what the next begins with, so they go one by one.
    for i, s in enumerate(slope.tolist()):
        if not s:
            out[i : i + 2] = 0.0
        elif (r := math.hypot(*(out[i : i + 2] / s))) > 3.0:
            out[i : i + 2] *= 3.0 / r
    return out


def with_tangents(points: DataFrame, x: str = "x", y: str = "y", by: str | None = None) -> DataFrame:
    """``points`` with ``tangent``, series by series: a series is as many points as a chart has."""
    names = points.columns

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x, kind="stable")
        return rows[names].assign(tangent=tangents(rows[x].to_numpy(float), rows[y].to_numpy(float)))

    return points.groupBy(F.lit(0) if by is None else by).applyInPandas(each, f"{points._jdf.schema().toDDL()}, tangent double")


def smooth_path(x: list[float], y: list[float]) -> str:
    """An SVG path of the monotone curve through some points."""
    if not len(x):
        return ""
    m, out = tangents(np.asarray(x, float), np.asarray(y, float)), [f"M {x[0]:.3f} {y[0]:.3f}"]
    for i in range(len(x) - 1):
        third = (x[i + 1] - x[i]) / 3
        near, far = (x[i] + third, y[i] + m[i] * third), (x[i + 1] - third, y[i + 1] - m[i + 1] * third)
        out.append("C " + " ".join(f"{v:.3f}" for v in (*near, *far, x[i + 1], y[i + 1])))
    return " ".join(out)

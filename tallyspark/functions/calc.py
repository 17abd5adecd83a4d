"""Column functions for measures, dates and small geometry; all stay inside JVM expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard bar diameters in mm, and the divisor of the unit-weight rule d*d/162 (kg/m).
STANDARD_SIZES = (6, 8, 10, 12, 16, 20, 25, 32)
UNIT_WEIGHT_DIVISOR = 162.0
SNAP_TOLERANCE = 2.0
BUSINESS_MINUTES = 330


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def unit_weight(dia: Column) -> Column:
    """kg per metre of a bar of ``dia`` mm."""
    return dia * dia / F.lit(UNIT_WEIGHT_DIVISOR)


def bar_weight(dia: Column, length_mm: Column, count: Column | int = 1) -> Column:
    return unit_weight(dia) * length_mm / 1000 * count


def snap_diameter(dia: Column, sizes: Sequence[int] = STANDARD_SIZES, tolerance: float = SNAP_TOLERANCE) -> Column:
    """Nearest standard size, the smaller of two equally near; null beyond ``tolerance``."""
    best = F.array_min(F.array(*(F.struct(F.abs(dia - s).alias("off"), F.lit(s).alias("size")) for s in sizes)))
    return F.when(best["off"] <= tolerance, best["size"])


def _distance(a: Column, b: Column, axes: Sequence[str]) -> Column:
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in axes), F.lit(0.0)))


def polyline_length(points: Column, axes: Sequence[str] = ("x", "y")) -> Column:
    """Sum of the distances of consecutive points; 0 for fewer than two."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    steps = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: _distance(a, b, axes))
    return F.aggregate(steps, F.lit(0.0), lambda total, d: total + d)


def chord_length(points: Column, axes: Sequence[str] = ("x", "y")) -> Column:
    """Distance of the first and last point: shorter than the path of a bent bar."""
    return F.when(F.size(points) > 0, _distance(F.element_at(points, 1), F.element_at(points, -1), axes))


def bend_deduction(segments: Column, dia: Column, closed: bool = False) -> Column:
    """Cut length in the segments' unit: their sum less two diameters a bend. A closed tie counts
    eight bends, an open bar one fewer than its segments."""
    total = F.aggregate(segments, F.lit(0.0), lambda s, x: s + x)
    bends = F.lit(8) if closed else F.greatest(F.size(segments) - 1, F.lit(0))
    return total - bends * 2 * dia


def count_by_pitch(extent: Column, pitch: Column) -> Column:
    return F.when(pitch > 0, F.floor(extent / pitch) + 1)


def canonical_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction of a segment in [0, pi)."""
    angle = F.pmod(F.atan2(y1 - y0, x1 - x0), F.lit(math.pi))
    return F.when(F.abs(angle - math.pi) < 1e-12, F.lit(0.0)).otherwise(angle)


def normal_offset(x: Column, y: Column, angle: Column) -> Column:
    """Signed distance of a line with ``angle`` through (x, y) from the origin."""
    return y * F.cos(angle) - x * F.sin(angle)


def along(x: Column, y: Column, angle: Column) -> Column:
    return x * F.cos(angle) + y * F.sin(angle)


def orientation(x0: Column, y0: Column, x1: Column, y1: Column, points: Column | int = 2, tolerance_degrees: float = 3.0) -> Column:
    """``shape`` for more than two points, else ``h``, ``v`` or ``diag`` by angle."""
    degrees = F.degrees(canonical_angle(x0, y0, x1, y1))
    return (
        F.when(_col(points) > 2, "shape")
        .when((degrees <= tolerance_degrees) | (degrees >= 180 - tolerance_degrees), "h")
        .when(F.abs(degrees - 90) <= tolerance_degrees, "v")
        .otherwise("diag")
    )


def box_orientation(width: Column, height: Column) -> Column:
    return F.when(width > 2 * height, "Horizontal").when(height > 2 * width, "Vertical").otherwise("Other")


def shoelace_area(points: Column) -> Column:
    """Absolute area of a polygon of (x, y) points; the ring need not be closed."""
    after = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.least(F.size(points), F.lit(1))))
    cross = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def net_volume(width: Column, height: Column, thickness: Column, opening_areas: Column) -> Column:
    """Cubic metres of a panel in mm without its openings."""
    holes = F.aggregate(opening_areas, F.lit(0.0), lambda s, a: s + F.abs(a))
    return (width * height - holes) * thickness / 1e9


def arc_sweep(start: Column, end: Column, full_circle: bool = True) -> Column:
    """Degrees swept from start to end; equal angles are a full circle if ``full_circle``."""
    sweep = F.pmod(end - start, F.lit(360.0))
    return F.when(sweep == 0, F.lit(360.0)).otherwise(sweep) if full_circle else sweep


def arc_points(cx: Column, cy: Column, radius: Column, start: Column, end: Column, parts: int = 16) -> Column:
    """``parts`` + 1 points along an arc given in degrees."""
    sweep = arc_sweep(start, end)
    step = lambda i: F.radians(start + sweep * i / parts)
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.struct((cx + radius * F.cos(step(i))).alias("x"), (cy + radius * F.sin(step(i))).alias("y")))


def drop_collinear(points: Column, sine: float = 0.02) -> Column:
    """Points without the inner vertices at which the path, seen from the last kept one, goes straight on."""
    element = "array<struct<x:double,y:double>>"

    def step(kept, i):
        here, after, last = F.element_at(points, i), F.element_at(points, i + 1), F.element_at(kept, -1)
        ax, ay, bx, by = here["x"] - last["x"], here["y"] - last["y"], after["x"] - here["x"], after["y"] - here["y"]
        size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
        straight = (size == 0) | ((F.abs(ax * by - ay * bx) < sine * size) & (ax * bx + ay * by > 0))
        return F.when(straight, kept).otherwise(F.concat(kept, F.array(F.struct(here["x"].alias("x"), here["y"].alias("y")))))

    inner = F.aggregate(F.sequence(F.lit(2), F.size(points) - 1), F.slice(points, 1, 1).cast(element), step)
    return F.when(F.size(points) > 2, F.concat(inner, F.slice(points, -1, 1).cast(element))).otherwise(points.cast(element))


def affine(value: Column, from_low, from_high, to_low, to_high) -> Column:
    """Proportional map of one interval onto another."""
    return _col(to_low) + (value - _col(from_low)) * (_col(to_high) - _col(to_low)) / F.nullif(_col(from_high) - _col(from_low), F.lit(0))


def mirror(x: Column, width) -> Column:
    return _col(width) - x


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is zero."""
    return F.try_divide(part * 100.0, whole.cast("double"))


def percent_delta(found: Column, expected: Column) -> Column:
    return percent(found - expected, expected)


def ladder_at_least(value: Column, ladder: Sequence[float]) -> Column:
    """Least value of an ascending ladder that is at least ``value``, else its last."""
    steps = F.array(*map(F.lit, ladder))
    return F.coalesce(F.array_min(F.filter(steps, lambda s: s >= value)), F.element_at(steps, -1))


def near(a: Column, b: Column, absolute: float, relative: float = 0.0) -> Column:
    """Equality within max(absolute, relative * the larger size); nulls are unequal."""
    limit = F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(F.abs(a - b) <= limit, F.lit(False))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d))


def business_time(ts: Column, minutes: int = BUSINESS_MINUTES) -> Column:
    """UTC to the wall clock of the business zone, as a timestamp without zone."""
    return ts.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes))


def business_day(ts: Column, minutes: int = BUSINESS_MINUTES) -> Column:
    return business_time(ts, minutes).cast("date")


def to_instant(day: Column, clock: Column, minutes: int = BUSINESS_MINUTES) -> Column:
    """Local date and ``HH:MM:SS`` to UTC, without zone."""
    local = F.concat_ws(" ", day.cast("string"), clock).cast("timestamp_ntz")
    return F.when(clock.isNotNull(), local - F.make_dt_interval(mins=F.lit(minutes)))


def date_preset(name: str, today: Column) -> tuple[Column, Column]:
    """(first, last) day, both inside: this-week, last-week, this-month or last-30."""
    monday = F.date_trunc("week", today).cast("date")
    return {
        "this-week": (monday, today),
        "last-week": (F.date_sub(monday, 7), F.date_sub(monday, 1)),
        "this-month": (F.date_trunc("month", today).cast("date"), today),
    }.get(name, (F.date_sub(today, 29), today))

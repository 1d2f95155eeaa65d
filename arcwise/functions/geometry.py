"""Plane geometry of three neighbouring points, as column expressions.

The exact form of each expression (which differences, which powers) decides how ties and straight
stretches come out, so the formulas keep to one shape throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this length the sum of two opposite unit directions is rounding noise, not a direction.
NO_DIRECTION = 1e-12


def _square(value: Column) -> Column:
    return value * value


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(_square(x) + _square(y))


def _divide(value: Column, by: Column) -> Column:
    return value / F.nullif(by, F.lit(0.0))


def _inner_only(prev_x, prev_y, x, y, next_x, next_y, value: Column) -> Column:
    """``value`` at points with both neighbours and a moving step ahead, 0 elsewhere."""
    is_end = prev_x.isNull() | prev_y.isNull() | next_x.isNull() | next_y.isNull()
    stands_still = _square(next_x - x) + _square(next_y - y) == 0
    return F.when(is_end | stands_still, 0.0).otherwise(value)


def curvature(prev_x, prev_y, x, y, next_x, next_y) -> Column:
    """Signed discrete curvature, cross(step in, step out) / |step in|^3; NULL after a zero step in."""
    in_x, in_y, out_x, out_y = x - prev_x, y - prev_y, next_x - x, next_y - y
    value = _divide(in_x * out_y - in_y * out_x, F.pow(_square(in_x) + _square(in_y), F.lit(1.5)))
    return _inner_only(prev_x, prev_y, x, y, next_x, next_y, value)


def tangent(prev_x, prev_y, x, y, next_x, next_y) -> Column:
    """Heading of the step ahead, in radians."""
    return _inner_only(prev_x, prev_y, x, y, next_x, next_y, F.atan2(next_y - y, next_x - x))


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    size = _length(x, y)
    return _divide(x, size), _divide(y, size)


def bisector(back_x, back_y, ahead_x, ahead_y) -> tuple[Column, Column]:
    """Unit bisector of two unit directions; NULL where they cancel (a straight stretch)."""
    mid_x, mid_y = (back_x + ahead_x) / 2, (back_y + ahead_y) / 2
    size = _length(mid_x, mid_y)
    size = F.when(size >= NO_DIRECTION, size)
    return mid_x / size, mid_y / size


def angle_between(back_x, back_y, ahead_x, ahead_y) -> Column:
    """Angle between two directions, folded into [0, pi]."""
    gap = F.abs(F.atan2(back_y, back_x) - F.atan2(ahead_y, ahead_x))
    return F.when(gap > math.pi, 2 * math.pi - gap).otherwise(gap)


def turning_weight(ratio: Column) -> Column:
    """2 for a full reversal of direction down to 0 for straight on, given angle / pi."""
    return 2 * (1 - _square(ratio))


def oscillation(amplitude: Column, phase: Column, offset: Column, time: Column) -> Column:
    return amplitude * F.sin(phase * time + offset)


def rounded(value: Column, digits: int | None) -> Column:
    """Rounded for comparison, with -0.0 folded into 0.0; unchanged without ``digits``."""
    return value if digits is None else F.round(value, digits) + F.lit(0.0)

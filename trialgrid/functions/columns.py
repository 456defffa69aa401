"""Scalar expressions over position, gaze, marker and signal columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PI = math.pi
MISSING, LOST = 1e8, 32768


def flip_y(y: Column, height: Column | float) -> Column:
    """Screen row counted from the other end."""
    return (height if isinstance(height, Column) else F.lit(height)) - y


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")


def seconds(ms: Column) -> Column:
    return ms / 1000.0


def heading(degrees: Column) -> Column:
    """Unit vector of a heading: struct(dx, dy) = (sin, cos)."""
    return F.struct(F.sin(F.radians(degrees)).alias("dx"), F.cos(F.radians(degrees)).alias("dy"))


def viewport(gaze: Column, size: float, low: float = 0.0) -> Column:
    """Gaze relative to the screen's centre in units of its size; null off the screen."""
    return F.when(gaze.between(low, size), (gaze - size / 2) / size)


def to_sensor(x: Column, sensor_width: float, screen_width: float) -> Column:
    return sensor_width * (x - 0.5 * screen_width) / screen_width


def focal_plane_width(fov_degrees: Column | float, focal: Column | float) -> Column:
    fov = fov_degrees if isinstance(fov_degrees, Column) else F.lit(float(fov_degrees))
    return F.lit(2.0) * focal * F.tan(F.radians(fov) / 2)


def clean_sample(x: Column) -> Column:
    """Null for the two ways in which recorders mark a missing sample."""
    return F.when((x < MISSING) & (F.abs(x) < LOST) & ~F.isnan(x), x)


def swap_yz(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    return df.withColumns({y: F.col(z), z: F.col(y)})


def inside_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in the rectangle (x0, y0, x1, y1), borders included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def impacts(x: Column, y: Column, z: Column, pillars: Sequence[tuple[float, float, float, float]], pillar_height: float, arena: tuple[float, float, float, float], height: float) -> Column:
    """Whether a point is inside a pillar below its height, or not inside the arena."""
    hit = ~(inside_box(x, y, arena) & z.between(0.0, height))
    for box in pillars:
        hit = hit | (inside_box(x, y, box) & (z < pillar_height))
    return hit


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def amplitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def log_amplitude(re: Column, im: Column) -> Column:
    return F.log(F.hypot(re, im))


def phase_difference(a: Column, b: Column) -> Column:
    """Angle between two phases, in [0, pi]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(a - b))))


def outside_view(gx: Column, gy: Column, head_degrees: Column, half_degrees: float = 30.0) -> Column:
    """Whether a gaze vector points more than ``half_degrees`` off the head's direction."""
    angle = F.atan2(gx, gy) - F.radians(head_degrees)
    return F.cos(angle) < math.cos(math.radians(half_degrees))


def marker_class(marker: Column) -> Column:
    """1 for a start marker (11-19), 2 for a cue (20-29), 3 for an end (31-49); null otherwise."""
    return F.when((marker > 10) & (marker < 20), 1).when((marker >= 20) & (marker < 30), 2).when((marker > 30) & (marker < 50), 3)


def message_marker(message: Column) -> Column:
    """Trigger number of a trial message; null for any other message."""
    wanted = message.rlike("^(Start Trial|End Trial|Cue Offset|Timeout)")
    return F.when(wanted, F.element_at(F.split(F.trim(message), r"\s+"), -1).try_cast("int"))

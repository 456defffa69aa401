"""Gaze rays and what they meet."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_sample
from ..sources.io import kept
from .asof import asof_join
from .intervals import interval_mask
from .surfaces import BOUNDS, PILLAR_HEIGHT, PILLARS, WALL_HEIGHT, Box, label_points
from .trials import trial_slice

INFINITY = float("inf")


def gaze_direction(vx: Column, vy: Column, heading_degrees: Column, fov_degrees: float = 60.0, near: float = 0.3, aspect: float = 1.78) -> tuple[Column, Column, Column]:
    """Direction (dx, dy, dz) of a gaze at (vx, vy) on the screen, from -0.5 to 0.5, for a head at ``heading_degrees``.

    The horizontal part has length 1; the vertical part is the sine of the elevation.
    """
    height = 2 * near * math.tan(math.radians(fov_degrees) / 2)
    turn = F.atan2(vx * height * aspect, F.lit(near)) + F.radians(heading_degrees)
    return F.sin(turn), F.cos(turn), F.sin(F.atan2(vy * height, F.lit(near)))


def _enter(p: Sequence[Column], d: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    """Ray length at which a box is entered; infinite if it is missed."""
    near, far = F.lit(0.0), F.lit(INFINITY)
    for at, step, a, b in zip(p, d, low, high, strict=True):
        first, second = F.try_divide(F.lit(a) - at, step), F.try_divide(F.lit(b) - at, step)
        inside = at.between(a, b)
        lo = F.when(step == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(INFINITY))).otherwise(F.least(first, second))
        hi = F.when(step == 0, F.when(inside, F.lit(INFINITY)).otherwise(F.lit(-1.0))).otherwise(F.greatest(first, second))
        near, far = F.greatest(near, lo), F.least(far, hi)
    return F.when(near <= far, near).otherwise(F.lit(INFINITY))


def _leave(p: Sequence[Column], d: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    """Ray length at which the arena is left."""
    ends = [F.when(step > 0, F.try_divide(F.lit(b) - at, step)).when(step < 0, F.try_divide(F.lit(a) - at, step)) for at, step, a, b in zip(p, d, low, high, strict=True)]
    return F.least(*ends)


def ray_hit(df: DataFrame, position: Sequence[str] = ("px", "py", "pz"), direction: Sequence[str] = ("dx", "dy", "dz"), pillars: Sequence[Box] = PILLARS, arena: Box = BOUNDS, pillar_height: float = PILLAR_HEIGHT, height: float = WALL_HEIGHT, step: float = 0.01) -> DataFrame:
    """The last free point (gx, gy, gz) of a ray that goes in steps until one lies in an obstacle.

    The step is found in closed form: the least entry over all obstacles, in
    steps, rounded up, less one. Nothing is looped over.
    """
    p, d = [F.col(c) for c in position], [F.col(c) for c in direction]
    entries = [_enter(p, d, (b[0], b[1], -1.0), (b[2], b[3], pillar_height)) for b in pillars]
    leave = _leave(p, d, (arena[0], arena[1], 0.0), (arena[2], arena[3], height))
    hit = F.least(*[F.ceil(e / step) for e in entries], F.floor(leave / step) + 1) if entries else F.floor(leave / step) + 1
    length = F.greatest(hit - 1, F.lit(0)) * step
    return df.withColumns({g: at + length * along for g, at, along in zip(("gx", "gy", "gz"), p, d, strict=True)})


def view_cone(df: DataFrame, heading: str = "dir", half_degrees: float = 30.0, **arena) -> DataFrame:
    """Ends of the two borders of a flat view cone: :func:`ray_hit` at heading -/+ half the field of view."""
    out = df.withColumns({"dz": F.lit(0.0), "pz": F.lit(1.0)})
    for name, turn in (("left", -half_degrees), ("right", half_degrees)):
        a = F.radians(F.col(heading) + turn)
        out = ray_hit(out.withColumns({"dx": F.sin(a), "dy": F.cos(a)}), **arena)
        out = out.withColumnsRenamed({"gx": f"{name}_x", "gy": f"{name}_y"}).drop("gz", "dx", "dy")
    return out.drop("dz", "pz")


def override_objects(labels: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surface labels replaced by logged object names where there is one."""
    return labels.join(objects.select(*keys, F.col("object").alias("__object")), list(keys), "left").withColumn("kind", F.coalesce("__object", "kind")).drop("__object")


def viewed_objects(gaze: DataFrame, surfaces: DataFrame, objects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaze samples with ``object``: what the recording names for a sample (keys, object), or else the kind of surface it lies on.

    ``keys`` name a sample. Samples on no surface that the recording says nothing
    of have a null object.
    """
    keys = list(keys)
    labels = label_points(gaze, surfaces, keys).groupBy(*keys).agg(F.min("kind").alias("__kind"))
    named = objects.select(*keys, F.col("object").alias("__object"))
    out = gaze.join(labels, keys, "left").join(named, keys, "left")
    return out.withColumn("object", F.coalesce("__object", "__kind")).drop("__object", "__kind")


def slice_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most frequent object and the mean position of each slice; of equally frequent objects the least."""
    return df.groupBy(*keys).agg(F.mode("object", True).alias("object"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def eye_trial(samples: DataFrame, trials: DataFrame, fixations: DataFrame, recorded: DataFrame, keys: Sequence[str], *, bucket: float | None = None) -> DataFrame:
    """Gaze of the recorded eyes by trial: (keys, eye, t, gx, gy, trial, fixated), lost samples null.

    ``samples`` is (keys, eye, t, gx, gy); a trial runs as in
    :func:`~trialgrid.operators.trials.trial_slice`, and a sample is fixated as
    in :func:`~trialgrid.operators.intervals.interval_mask`. ``recorded`` lists
    the eyes (keys, eye) that count.
    """
    keys = list(keys)
    own = samples.join(recorded.select(*keys, "eye"), [*keys, "eye"], "left_semi").withColumns({c: clean_sample(F.col(c)) for c in ("gx", "gy")})
    eyes = recorded.select(*keys, "eye")
    marked = kept(interval_mask(own, fixations.join(eyes, keys), [*keys, "eye"], bucket=bucket), "marked")
    cut = trial_slice(marked, trials.join(eyes, keys), [*keys, "eye"], bucket=bucket)
    # a trial's first sample is fixated if any fixation began before, as no sample comes before it
    begun = fixations.where("t_end >= t_start").groupBy(*keys).agg(F.min("t_start").alias("__begun"))
    first = F.col("t") == F.min("t").over(Window.partitionBy(*keys, "eye", "trial"))
    out = cut.join(begun, keys, "left").withColumn("fixated", F.when(first, F.coalesce(F.col("__begun") <= F.col("t"), F.lit(False))).otherwise(F.col("fixated")))
    return out.drop("__begun")


def gaze_with_pose(gaze: DataFrame, positions: DataFrame, keys: Sequence[str], pose: Sequence[str] = ("px", "py", "dir"), *, bucket: float | None = None) -> DataFrame:
    """Gaze samples with the last head pose at or before each."""
    return asof_join(gaze, positions, keys, "t", pose, "backward", bucket=bucket).drop("t_match")

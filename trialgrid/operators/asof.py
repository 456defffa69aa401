"""As-of joins: each event with the nearest earlier or later sample of another stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import between_join, in_buckets


def asof_join(
    events: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    time: str = "t",
    values: Sequence[str] = ("x", "y"),
    direction: str = "forward",
    *,
    bucket: float | None = None,
    drop_unmatched: bool = True,
) -> DataFrame:
    """Events with ``values`` and the time (``t_match``) of the matching sample of the same keys.

    ``forward`` takes the first sample at or after the event, ``backward`` the
    last at or before it. Both streams go through one window; nothing is paired
    that does not match. A key's rows are dealt into time buckets, ``bucket``
    wide, so that a long session does not stand in one task (see :func:`~trialgrid.operators.ordered.in_buckets`).

    Events without a match are dropped unless told otherwise. Of samples at the
    same time, the one with the greatest values is taken going backward, the
    least going forward. Rows with a null time match nothing.
    """
    forward = direction == "forward"
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    keys, values = list(keys), list(values)
    extra = [c for c in events.columns if c not in (*keys, time)]
    sample = F.struct(F.col(time).alias("t_match"), *values)
    left = events.select(*keys, F.col(time).alias("__t"), F.struct(F.lit(1).alias("__one"), *extra).alias("__event"))
    right = samples.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("__t"), sample.alias("__sample"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = in_buckets(both, keys, "__t", bucket, ["__sample"], pick=F.min if forward else F.max, later=forward)
    parts = [*keys, "__bucket"]
    # the window runs towards the event, so a running value is enough; a sample at the event's time comes before it
    event = F.col("__event").isNotNull()
    order = [F.col("__t").desc_nulls_first(), event, F.col("__sample").desc()] if forward else [F.col("__t"), event, F.col("__sample")]
    so_far = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__found", F.last("__sample", ignorenulls=True).over(so_far)).where("__event is not null")
    if drop_unmatched:
        out = out.where("__found is not null")
    return out.select(
        *keys, F.col("__t").alias(time), *[F.col(f"__event.{c}").alias(c) for c in extra], *[F.col(f"__found.{c}").alias(c) for c in ("t_match", *values)]
    )


def spikes_at_positions(spikes: DataFrame, trials: DataFrame, samples: DataFrame, session: str = "session", values: Sequence[str] = ("x", "y"), direction: str = "forward", *, exclude_last: bool = False, bucket: float | None = None) -> DataFrame:
    """Spikes of every trial, zeroed at its start, with the position then held.

    ``trials`` has (session, trial, t1, t3) on the spikes' clock; ``samples`` has
    (session, trial, t, values) zeroed at the trial's start. With
    ``exclude_last`` a trial's final sample matches nothing.
    """
    inside = between_join(spikes, trials.select(session, "trial", "t1", "t3"), [session], "t", "t1", "t3", bucket=bucket)
    inside = inside.withColumn("t", F.col("t") - F.col("t1")).drop("t1", "t3")
    if exclude_last:
        last = Window.partitionBy(session, "trial")
        samples = samples.withColumn("__last", F.max("t").over(last)).where("t < __last").drop("__last")
    return asof_join(inside, samples, [session, "trial"], "t", values, direction, bucket=bucket)


def fixated_views(spikes: DataFrame, gaze: DataFrame, keys: Sequence[str], *, bucket: float | None = None) -> DataFrame:
    """Spikes with the gaze point that follows, where that sample lies in a fixation."""
    found = asof_join(spikes, gaze, keys, "t", ("x", "y", "z", "fixated"), "forward", bucket=bucket)
    return found.where("fixated").drop("fixated")

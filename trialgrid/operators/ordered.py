"""Work along a key's order: long keys are dealt into buckets, each told what lies outside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW = "__row"
#: Rows of a key that a bucket has room for where no width is given.
ROWS = 1 << 16


def packed(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, order, __row) with the other columns in ``__row``, which is never null."""
    extra = [F.col(c) for c in df.columns if c not in (*keys, order)]
    return df.select(*keys, order, F.struct(F.lit(1).alias("__one"), *extra).alias(_ROW))


def unpacked(df: DataFrame, like: DataFrame, keys: Sequence[str], order: str, *more: str) -> DataFrame:
    """The rows of :func:`packed` with the columns of ``like`` and ``more``; added rows go."""
    names = [F.col(c) if c in (*keys, order) else F.col(f"{_ROW}.`{c}`").alias(c) for c in like.columns if c not in more]
    return df.where(f"{_ROW} is not null").select(*names, *more)


def measured(df: DataFrame, keys: Sequence[str], order: str) -> Column:
    """A bucket width for ``order``: room for ``ROWS`` rows of the densest key, were its rows spread evenly.

    It is found by one more pass over ``df`` when the query runs. A stretch that
    is denser than its key's mean makes its buckets fuller by the same factor.
    """
    gaps = df.groupBy(*keys).agg(((F.max(order) - F.min(order)) / F.count(order)).alias("gap")).where("gap > 0")
    return gaps.agg(F.coalesce(F.min("gap") * ROWS, F.lit(1.0)).alias("width")).scalar()


def in_buckets(df: DataFrame, keys: Sequence[str], order: str, width: float | Column | None, carried: Sequence[str], *, pick=F.max, later: bool = False) -> DataFrame:
    """``df`` with ``__bucket``, the order column in steps of ``width``, and a row for what lies before each bucket.

    The added row of a bucket holds in ``carried`` what ``pick`` makes of all the
    key's earlier (or ``later``) buckets and is null elsewhere, so it comes first
    in a window of the bucket whose nulls come first. Only one row per bucket is
    ordered by key alone. Rows with a null order have a bucket of their own.
    Without a width one is :func:`measured`; an infinite one leaves keys whole.
    """
    width = measured(df, keys, order) if width is None else width
    dealt = df.withColumn("__bucket", F.floor(F.col(order) / width))
    each = dealt.groupBy(*keys, "__bucket").agg(*[pick(c).alias(c) for c in carried])
    along = F.col("__bucket").desc_nulls_first() if later else F.col("__bucket").asc_nulls_first()
    before = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    edges = each.withColumns({c: pick(c).over(before) for c in carried}).where("__bucket is not null")
    edges = edges.where(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in carried]))
    return dealt.unionByName(edges, allowMissingColumns=True)


def ranked(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], name: str = "n", *, total: str | None = None, bucket: float | Column | None = None) -> DataFrame:
    """``df`` with ``name``, the number of each row in its key's order, from 1, and with ``total`` the key's rows.

    Rows are counted by key and bucket of the first order column, the counts are
    added up along the buckets, and rows are numbered inside each bucket, after
    all that lie before it: no task sorts a whole key. ``bucket`` is a width
    (see :func:`in_buckets`), or a column that grows with the order. Rows with
    a null order come first; equal ones are numbered in any order.
    """
    order, keys = [order] if isinstance(order, str) else list(order), list(keys)
    if not isinstance(bucket, Column):
        bucket = F.floor(F.col(order[0]) / (measured(df, keys, order[0]) if bucket is None else bucket))
    rows = df.select(*keys, bucket.alias("__bucket"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], F.struct(*df.columns).alias(_ROW))
    along = Window.partitionBy(*keys)  # one row for each bucket
    before = along.orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__size"))
    edges = edges.withColumns({"__before": F.coalesce(F.sum("__size").over(before), F.lit(0)), "__total": F.sum("__size").over(along)}).drop("__size")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(F.col(_ROW).isNotNull(), *[F.col(f"__o{k}").asc_nulls_first() for k in range(len(order))])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("__before", "__total")}
    out = rows.unionByName(edges, allowMissingColumns=True).withColumns({**held, "__n": F.row_number().over(inside)}).where(f"{_ROW} is not null")
    kept = [F.col(f"{_ROW}.`{c}`").alias(c) for c in df.columns if c not in (name, total)]
    more = [F.col("__total").alias(total)] if total else []
    return out.select(*kept, (F.col("__n") - 1 + F.col("__before")).alias(name), *more)


def neighbour(df: DataFrame, keys: Sequence[str], time: str, name: str, *, later: bool = False, bucket: float | None = None) -> DataFrame:
    """``df`` with the time of the row before, or the ``later`` one, of the same key; null at the ends.

    ``bucket`` is a width in units of time: see :func:`in_buckets`.
    """
    pick = F.lead if later else F.lag
    dealt = in_buckets(packed(df, keys, time), keys, time, bucket, [time], pick=F.min if later else F.max, later=later)
    found = dealt.withColumn(name, pick(time).over(Window.partitionBy(*keys, "__bucket").orderBy(time)))
    return unpacked(found, df, keys, time, name)


#: A cell of the cover holds 2 ** TOP buckets at most, so that no task gets more of a key.
TOP = 10


def cover(low: Column, high: Column, top: int = TOP) -> Column:
    """Cells (level, cell) that make up the buckets from ``low`` to ``high``: cell c of level l holds 2**l buckets from c * 2**l on.

    At each level below ``top`` there are two cells at most, one at either end,
    and at ``top`` all between them. An empty range has no cells.
    """
    down = lambda c, level: F.call_function("shiftright", c, level)
    first = lambda level: -down(-low, level)  # noqa: E731  # the first whole cell, and the one after the last
    end = lambda level: down(high + 1, level)
    cell = lambda level, c: F.struct(level.alias("level"), c.alias("cell"))

    def ends(level: Column) -> Column:
        both = F.array(F.when(first(level) % 2 != 0, cell(level, first(level))), F.when(end(level) % 2 != 0, cell(level, end(level) - 1)))
        return F.when(first(level) < end(level), F.array_compact(both)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    lower = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), ends))
    whole = F.when(first(F.lit(top)) < end(F.lit(top)), F.sequence(first(F.lit(top)), end(F.lit(top)) - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(lower, F.transform(whole, lambda c: cell(F.lit(top), c)))


def between_join(samples: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, low: str, high: str, inside: Column | None = None, *, bucket: float | None = None) -> DataFrame:
    """Samples with the spans of their keys that hold them, ``low`` and ``high`` included.

    Time is dealt into buckets of a width in its units (:func:`measured` on the
    samples if none is given). A span is listed by its :func:`cover`, some cells
    for each level and no more, a sample by the cells above its bucket at those
    levels that the spans use. ``inside`` narrows the condition. Null times and
    bounds, and spans that end before they begin, hold nothing.
    """
    keys = list(keys)
    within = F.col(time).between(F.col(low), F.col(high))
    within = within if inside is None else within & inside
    width = measured(samples, keys, time) if bucket is None else bucket
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    real = spans.where(F.col(low) <= F.col(high)).withColumns({"__from": at(low), "__upto": at(high)})
    listed = real.withColumn("__c", F.explode(cover(F.col("__from"), F.col("__upto")))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c", "__from", "__upto")
    used = listed.agg(F.collect_set("__level")).scalar()  # a few numbers
    placed = samples.withColumn("__bucket", at(time)).withColumn("__level", F.explode(used)).withColumn("__cell", F.call_function("shiftright", F.col("__bucket"), F.col("__level"))).drop("__bucket")
    return placed.join(listed, [*keys, "__level", "__cell"]).where(within).drop("__level", "__cell")

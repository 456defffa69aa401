"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a fixed hash of its id, its text and its number among rows that agree
in both. For a source, the rows below a threshold
are taken once more than the rest; the threshold comes from sums of sizes by
source and hash bucket, first over coarse buckets, then over the one bucket that
the budget ends in, then over the single hashes of that. Nothing is sorted and
no step holds more than one bucket's sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, keep

KEY_BITS = 60


def _key(base: Column, number: Column) -> Column:
    """A row's hash: the first 60 bits of the MD5 of its base and number."""
    return F.conv(F.substring(F.md5(F.concat(base, F.lit("|"), number.cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Word targets of sources, from ``sizes`` (source, src, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the total. A target stops at ``repeats`` times its source's size; the excess
    is shared again by weight. That ends where ``target = min(weight * level,
    cap)`` for one level, found by running sums over the sources in order of
    cap / weight. There is one row per source, which these windows hold.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left") / F.col("open"))
    w = w.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return w.select("src", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _narrow(rows: DataFrame, cuts: DataFrame, shift: int, bits: int) -> DataFrame:
    """Of each source's bucket [low, low + 2**(shift + bits)), the part in which its budget ends."""
    inside = rows.join(cuts, "src").where(
        (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + F.lit(1 << (shift + bits)))
    )
    part = F.shiftleft(F.shiftright("key", shift), shift)
    sums = inside.groupBy("src", part.alias("part"), "rest", "below").agg(F.sum("size").alias("size"))
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("src").orderBy("part"))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    return over.groupBy("src", "rest").agg(
        F.min("part").alias("low"), F.min_by(F.col("upto") - F.col("size"), "part").alias("below")
    )


def _numbered(sized: DataFrame) -> DataFrame:
    """(row, number): rows that agree in source, id and text numbered from 1, where there are several.

    Numbers are counted by the part of the table that a row lies in, so that no
    task numbers more than one part's rows of a group.
    """
    several = sized.groupBy("src", "base").agg(F.count("*").alias("n")).where("n > 1").select("src", "base")
    rows = sized.select("src", "base", "row", F.shiftright("row", 33).alias("part")).join(several, ["src", "base"])
    counts = rows.groupBy("src", "base", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src", "base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("src", "base", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("src", "base", "part").orderBy("row"))
    return rows.withColumn("inside", inside).join(counts, ["src", "base", "part"]).select("row", (F.col("before") + F.col("inside")).alias("number"))


def _mix(docs: DataFrame, weights: Sequence[int], repeats: int, doc_id: str, text: str, source: str, coarse: Sequence[int], carried: Column) -> DataFrame:
    """(carried, size, source_size, target, taken): what of each row is taken."""
    src = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    base = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    row = F.monotonically_increasing_id()
    sized = docs.select(row.alias("row"), carried.alias("carried"), F.col(source).cast("string").alias("source"), src.alias("src"), word_count(F.col(text)).alias("size"), base.alias("base"))
    sized = keep(sized, "mix-sizes")
    numbers = keep(_numbered(sized), "mix-numbers")
    sizes = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, repeats)
    whole = F.coalesce(F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(repeats)), F.lit(0)).cast("long")
    targets = keep(
        targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    keyed = sized.join(numbers, "row", "left").withColumn("key", _key(F.col("base"), F.coalesce("number", F.lit(1))))
    rows = keyed.select("src", "key", "size")
    cuts = targets.where("rest > 0").select("src", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    left = KEY_BITS
    for bits in coarse:
        left -= bits
        cuts = keep(_narrow(rows, cuts, left, bits), "mix-cuts")
    edge = keep(_narrow_to_key(rows, cuts, left), "mix-edge")
    taken = F.col("size") * (F.col("whole") + F.coalesce((F.col("key") < F.col("stop")).cast("long"), F.lit(0)))
    return keyed.join(targets, "src").join(edge, "src", "left").select("carried", "size", "source_size", "target", taken.alias("taken"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    coarse: Sequence[int] = (12, 12),
) -> DataFrame:
    """How often a mix of the sources takes each document.

    Returns (doc_id, size, source_size, target, taken), one row per input row.
    ``size`` counts blank-separated words, ``taken`` is size times the number of
    copies. A source below its target is taken whole as often as fits, and the
    rest comes from the rows below the hash threshold; the row that the budget
    ends in is taken if that brings the source closer.

    Null texts have size 0 and are taken with 0 words; a null source is a source,
    the last; rows that repeat an id, or have none, are taken one by one by their
    texts, and rows that agree in id and text by their number; no rows give no
    rows. Other columns of ``docs`` play no part.
    """
    out = _mix(docs, weights, repeats, doc_id, text, source, coarse, F.col(doc_id))
    return out.withColumnRenamed("carried", "doc_id")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", coarse: Sequence[int] = (12, 12)) -> DataFrame:
    """The documents that :func:`mix_sources` takes, all columns kept, with ``copies``, ``taken`` and ``target``.

    Every row is judged by itself, so null and repeated ids make no difference.
    The three new columns have underscores after their names where ``docs`` has
    such columns already. No rows give no rows.
    """
    out = _mix(docs, weights, repeats, doc_id, text, source, coarse, F.struct("*")).where("taken > 0")
    copies = (F.col("taken") / F.col("size")).cast("long")
    new = {"copies": copies, "taken": F.col("taken"), "target": F.col("target")}
    return out.select("carried.*", *[column.alias(fresh(name, docs.columns)) for name, column in new.items()])


def _narrow_to_key(rows: DataFrame, cuts: DataFrame, bits: int) -> DataFrame:
    """The hash below which a source's documents are taken: (src, stop)."""
    inside = rows.join(cuts, "src").where((F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + F.lit(1 << bits)))
    sums = inside.groupBy("src", "key", "rest", "below").agg(F.sum("size").alias("size"))
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("src").orderBy("key"))
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    last = over.groupBy("src", "rest").agg(
        F.min("key").alias("key"), F.min("upto").alias("upto"), F.min_by(F.col("upto") - F.col("size"), "key").alias("without")
    )
    closer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("without"))
    return last.select("src", (F.col("key") + closer.cast("long")).alias("stop"))

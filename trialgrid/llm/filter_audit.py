"""How five quality filters act together: in every order, and as a game.

A document's failures are a mask of five bits, so the whole table folds into at
most 32 counts a part. The rest follows from these: what a set of filters removes
(the removal game), what a filter removes after others, and the game's potential.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

#: The filters; the k-th letter has bit k of a mask.
FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_REPEATS = 1 << FILTERS.index("E")
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Orders of the filters; whole multiples of a Shapley value are sums over all of them.
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the mask of filters A to D that the text fails; E takes the whole table.

    A: under 50 words; B: under 65% different words; C: over 5% capitals A-Z;
    D: one of ``#$%&*|``. A null or empty text fails A alone.
    """
    # words are made in a projection of their own, as two conditions read them
    split = docs.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__words", F.split(F.btrim("__text", F.lit(_SPACE)), r"[\x20\x09-\x0D]+"))
    empty = F.element_at("__words", 1) == ""
    n, kinds = (F.when(empty, 0).otherwise(F.size(words)) for words in (F.col("__words"), F.array_distinct("__words")))
    capitals = F.length("__text") - F.length(F.translate("__text", _UPPER, ""))
    fails = (n < 50, 100 * kinds < 65 * n, 100 * capitals.cast("long") > 5 * F.length("__text").cast("long"), F.col("__text").rlike(r"[#$%&*|]"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return split.withColumn(name, mask).drop("__words", "__text")


def failure_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Documents by part and failures: (part, mask, n, good, toxic).

    Equal rows are counted before anything is joined, and each join is on an id,
    so neither a text nor a part that most rows share meets in one task. A
    document repeats a text if its id is not the least of the text's; rows
    without id repeat nothing, are repeated by nothing and have no labels. An id
    counts as good or toxic if any of its labels says so.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    marked = text_failures(rows, "text", "mask").select("id", "part", "mask", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    same = keep(marked.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")), "filter-audit")
    least = same.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeats = F.when(F.col("id").isNotNull() & F.col("first").isNull(), _REPEATS).otherwise(0)
    judged = same.join(least, ["digest", "id"], "left").select("id", "part", (F.col("mask") + repeats).alias("mask"), "n")
    by_id = judged.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(doc_id).alias("id"), "quality", "toxic").groupBy("id").agg(flag("quality"), flag("toxic"))
    said = by_id.join(known, "id", "left")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return said.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def removal_game(counts: DataFrame) -> DataFrame:
    """One row a part: its documents ``n``, and arrays over the 32 coalitions of what each removes.

    ``removed``, ``good`` and ``toxic`` hold the documents that fail a filter of
    the coalition, at its mask + 1; ``alone`` those that fail one filter and no
    other, at the filter's mask + 1.
    """

    def over(column: str, hit) -> Column:
        return F.array(*[F.sum(F.when(hit(F.col("mask"), s), F.col(column)).otherwise(0)) for s in range(_ALL + 1)])

    meets = lambda mask, s: mask.bitwiseAND(s) != 0
    return counts.groupBy("part").agg(
        F.sum("n").alias("n"), over("n", meets).alias("removed"), over("good", meets).alias("good"), over("toxic", meets).alias("toxic"), over("n", lambda mask, s: mask == s).alias("alone")
    )


def potential(worth: Column, times: int = len(ORDERS)) -> Column:
    """The Hart-Mas-Colell potential of all coalitions, ``times`` over: an array, at mask + 1.

    P of no one is 0, and ``P(S) = (v(S) + sum of P(S without i) over i in S) / |S|``,
    so P is found coalition by coalition; those with a member less come before.
    120 times a potential of five players is a whole number.
    """
    members = [[1 << k for k in range(len(FILTERS)) if s >> k & 1] for s in range(_ALL + 1)]
    known = F.array(F.lit(0).cast("long"))
    each = F.array(*[F.array(*[F.lit(s - b) for b in m]) for s, m in enumerate(members) if s])

    def grown(found: Column, without: Column) -> Column:
        before = F.aggregate(without, F.lit(0).cast("long"), lambda total, s: total + F.element_at(found, s + 1))
        return F.concat(found, F.array((times * F.element_at(worth, F.size(found) + 1) + before).cast("long") / F.size(without)).cast("array<long>"))

    return F.aggregate(each, known, grown)


def audit_filters(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each of the five filters does at each step of each order, by part.

    Returns (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), 600 rows a part. A coalition's worth is
    what it removes, so a step removes what its filter adds to those before.
    ``shapley`` is the potential of all filters less that without the step's,
    both 120 times: the filter's removals summed over all orders.

    A null part is the empty string, a null text is empty; an empty table gives
    no rows; see :func:`failure_counts` for null and repeated ids.
    """
    game = removal_game(failure_counts(docs, labels, doc_id=doc_id, text=text, part=part)).withColumn("__p", potential(F.col("removed")))
    steps = game.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = [F.when(F.position(F.lit(f), F.col("filter_order")) < F.col("step"), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)]
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = sum((F.when(letter == f, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"__before": sum(bits, F.lit(0)), "__own": own})
    at = lambda c, s: F.element_at(c, s + 1)
    before, own, after = F.col("__before"), F.col("__own"), F.col("__before") + F.col("__own")
    added = lambda c: at(c, after) - at(c, before)
    return steps.select(
        "part", "filter_order", "step",
        (F.col("n") - at("removed", after)).alias("kept"), added("removed").alias("removed"), (at("removed", own) - added("removed")).alias("redundant"),
        at("alone", own).alias("unique_fails"), added("good").alias("good_lost"), added("toxic").alias("toxic_lost"),
        (at("__p", F.lit(_ALL)) - at("__p", _ALL - own)).alias("shapley"),
    )

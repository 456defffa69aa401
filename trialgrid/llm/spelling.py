"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a set of (letter, its how-manieth) pairs, a binary vector. One
edit changes at most two of its places: two for a replaced letter, when lengths are
equal, and one for an inserted or deleted letter, when they differ by one. The places
are dealt into parts; of vectors at distance k all parts but k agree at least, so the
words meet in one of the signatures that leave out k parts.

An edit leaves either the first three or the last four letters of a word of seven
letters or more as they are. A signature holds one or the other as well, without
which words of the same letters in other orders meet by the thousand.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import forget, keep

#: Letters that a word needs, and those at either end of which an edit leaves one side alone.
LETTERS, HEAD, TAIL = 7, 3, 4
#: Parts of the vector, for replaced letters (distance two) and for inserted ones (distance one).
PARTS = {2: 4, 1: 3}
_RUN = r"[A-Za-zÀ-ÿ]{%d,}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", deleted: int = 31, least: int = 2) -> DataFrame:
    """Words of at least seven letters and ``least`` occurrences with their numbers: (word, n).

    A run of letters loses one where the checksum of the id and the lower-cased
    run divides by ``deleted``. Runs that are too short are never made into rows;
    tasks count before they send anything. A null id counts as an empty string.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(_RUN % LETTERS), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    sums = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run"))
    counted = sums.select(word.alias("word")).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def _places(word: Column) -> Column:
    """Hashes of a word's (letter, how-manieth) pairs, which all differ."""
    times = lambda c: F.length(word) - F.length(F.replace(word, c, F.lit("")))
    return F.flatten(F.transform(F.array_distinct(F.split(word, "")), lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda k: F.xxhash64(c, k))))


def _signatures(distance: int) -> list[Column]:
    """One number for each way to leave out ``distance`` parts of ``__places``."""
    n = PARTS[distance]
    part = lambda p: F.aggregate("__places", F.lit(p).cast("long"), lambda s, x: F.when(F.pmod(x, F.lit(n)) == p, s.bitwiseXOR(x)).otherwise(s))
    parts = [part(p) for p in range(n)]
    return [F.xxhash64(*[parts[p] for p in range(n) if p not in out], F.lit(k)) for k, out in enumerate(combinations(range(n), distance))]


def _listed(vocabulary: DataFrame, distance: int, size: Column) -> DataFrame:
    """(sig, tail, word, n): each signature with the head, or with the tail, and a length."""
    placed = vocabulary.withColumn("__places", _places(F.col("word")))
    made = placed.select("word", "n", size.alias("size"), F.explode(F.array(*_signatures(distance))).alias("s"))
    ends = F.explode(F.array(F.struct(F.lit(False).alias("tail"), F.left("word", F.lit(HEAD)).alias("end")), F.struct(F.lit(True).alias("tail"), F.right("word", F.lit(TAIL)).alias("end"))))
    dealt = made.select("word", "n", "size", "s", ends.alias("e"))
    return dealt.select(F.xxhash64("s", "size", "e.tail", "e.end").alias("sig"), F.col("e.tail").alias("tail"), "word", "n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs of words one edit apart (word, n, other, m), each once, the smaller or the shorter word first.

    Signatures are exact: no pair is missed. Pairs that meet are verified, those
    that meet by both ends counted by their heads, and repeats of a pair, which
    meets in every signature that both share, removed.
    """
    size = F.length("word")

    def met(a: DataFrame, b: DataFrame, further: Column) -> DataFrame:
        heads = F.left("a.word", F.lit(HEAD)) == F.left("b.word", F.lit(HEAD))
        both = a.alias("a").join(b.alias("b"), F.col("a.sig") == F.col("b.sig")).where(further & (F.col("a.tail") == F.col("b.tail")) & (~F.col("a.tail") | ~heads))
        near = both.where(F.levenshtein("a.word", "b.word", 1) == 1)
        return near.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("m"))

    equal = _listed(vocabulary, 2, size)
    replaced = met(equal, equal, F.col("a.word") < F.col("b.word"))
    inserted = met(_listed(vocabulary, 1, size), _listed(vocabulary, 1, size - 1), F.length("a.word") < F.length("b.word"))
    return replaced.union(inserted).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) in which forms have ten times a word's number, so chains are short and end."""
    found = keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    onward = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        moved = keep(found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forget(found)
        found = moved.drop("moved")
        if not moved.where("moved").take(1):
            return found


def group_spellings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ratio: int = 10) -> DataFrame:
    """Words with their spelling groups: (word, form, root, n, n_near, form_n).

    ``form`` is the near word of most occurrences, of equals the first in
    code-point order, if it has at least ``ratio`` times as many as the word;
    ``root`` is where forms lead at last, the word itself if it has none.

    Null and empty texts have no words, and an empty table gives no rows;
    repeated rows count as often as they occur; a word of any length takes part.
    """
    vocabulary = keep(words(docs, doc_id=doc_id, text=text), "spelling-words")
    pairs = near_pairs(vocabulary)
    both = pairs.select("word", "n", F.col("other").alias("near"), "m").union(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("near"), F.col("n").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("near")))
    near = keep(both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("m")), "spelling-near")
    taken = near.where(F.col("m") >= ratio * F.col("n")).select("word", F.col("near").alias("form"), F.col("m").alias("form_n"))
    roots = _roots(taken)
    grouped = near.select("word", "n_near").join(taken, "word", "left").join(roots, "word", "left")
    out = vocabulary.join(grouped, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells in three sub-tables. Every paragraph digest goes to one cell
of each, which keeps the number of digests and the XOR of the digests and of
their check hashes. The cells of two versions subtract; a cell left with a
single digest gives it away, and taking that out of its other cells frees more.
If cells stay full, both versions are sketched again with more cells.

Everything is Spark SQL over the arrays of one row. Cells are kept sparse, as
entries (place, number, digests, checks); entries of one place add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_partitions

#: Paragraphs are lines. A longer one is cut between two characters wherever the last byte of each
#: in UTF-8 is one of some, by its low five bits: a hash of the two that holds in every script, in
#: lower and upper case, with and without spaces. So a cut depends on two characters alone and not on
#: what stands before. These bits cut about every 100 characters in the languages tried; after so many
#: bytes without a cut there is one in any case.
BEFORE, AFTER, MOST = (1, 5, 26, 30), (5, 7, 31), 2400
#: Cells of each sub-table of the fingerprint itself. The first retry has room for ROOM times all
#: digests, as empty cells cost nothing; any further one has GROWTH times as many.
WIDTH, ROOM, GROWTH, RETRIES, ROUNDS = 8, 16, 4, 4, 20
#: Entries folded in one go.
FOLD = 24

_CELL = "struct<p:int,n:int,k:bigint,c:bigint>"
_CELLS = f"array<{_CELL}>"
_NONE = "cast(array() as array<bigint>)"


def _bytes(bits: tuple[int, ...], low: int, high: int) -> str:
    return "[" + "".join(f"\\x{b:02X}" for b in range(low, high) if b & 31 in bits and b != 10) + "]"


def _cut() -> str:
    """A place between two characters, in a text whose characters are bytes; what it matches ends the first."""
    last, more = _bytes(AFTER, 0x80, 0xC0), r"[\x80-\xBF]"
    following = rf"{_bytes(AFTER, 0, 0x80)}|[\xC2-\xDF]{last}|[\xE0-\xEF]{more}{last}|[\xF0-\xF4]{more}{more}{last}"
    return f"{_bytes(BEFORE, 0, 0xC0)}(?={following})"


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    plain = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    every = F.regexp_extract_all(plain, F.lit(rf"([^\n]{{0,{MOST}}}?{_cut()}|[^\n]{{1,{MOST}}})"), F.lit(1))
    return F.array_distinct(F.transform(every, lambda p: F.xxhash64(p)))


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entries(items: str, key: str, number: str, width: str) -> str:
    """The entries of digests in their three cells; ``f`` is the item."""
    cell = f"named_struct('p', cast({{t}} * {width} + pmod(shiftright(u.h, 20 * {{t}}), {width}) as int), 'n', {number}, 'k', {key}, 'c', u.c)"
    cells = ", ".join(cell.format(t=t) for t in range(3))
    each = _let("u", f"named_struct('h', xxhash64({key}, {width}), 'c', xxhash64({key}, 1))", f"array({cells})")
    return f"flatten(transform({items}, f -> {each}))"


def _fold(entries: str) -> str:
    """Entries of one place added up; those that come to nothing go.

    Most have a place of their own; long lists of the others are dealt by place first.
    """
    state = f"struct<out:{_CELLS},cur:{_CELL}>"
    empty = "s.cur.n = 0 and s.cur.k = 0 and s.cur.c = 0"
    out = f"if({empty}, s.out, concat(s.out, array(s.cur)))"
    added = f"named_struct('p', e.p, 'n', s.cur.n + e.n, 'k', s.cur.k ^ e.k, 'c', s.cur.c ^ e.c)"
    step = f"if(s.cur.p = e.p, named_struct('out', s.out, 'cur', {added}), named_struct('out', {out}, 'cur', e))"
    start = f"cast(named_struct('out', cast(array() as {_CELLS}), 'cur', named_struct('p', -1, 'n', 0, 'k', 0L, 'c', 0L)) as {state})"

    def run(some: str) -> str:
        return f"aggregate({some}, {start}, (s, e) -> {step}, s -> {out})"

    beside = "coalesce(get(z, i - 1).p = x.p, false) or coalesce(get(z, i + 1).p = x.p, false)"
    dealt = f"flatten(transform(sequence(0, groups - 1), g -> {run('filter(es, x -> pmod(x.p, groups) = g)')}))"
    many = _let("groups", "cast(ceil(sqrt(size(es)) / 2) as int)", dealt)
    shared = _let("es", f"filter(z, (x, i) -> {beside})", f"if(size(es) <= {FOLD}, {run('es')}, {many})")
    return _let("z", f"sort_array({entries})", f"concat(filter(z, (x, i) -> not ({beside})), {shared})")


def _minus(a: str, b: str) -> str:
    negative = f"transform({b}, y -> named_struct('p', y.p, 'n', -y.n, 'k', y.k, 'c', y.c))"
    return _fold(f"concat({a}, {negative})")


def _sum(items: str, more: str, start: str = "named_struct('k', 0L, 'c', 0L)") -> str:
    return f"aggregate({items}, {start}, (s, x) -> {more})"


def _peel(cells: str, width: str) -> str:
    """Digests only in the first and only in the second version, and whether that is all.

    A round takes the digests of all cells that hold a single one. If they add
    up to the first sub-table they are all there is; or else they are taken out
    of the other cells, and the next round follows. A round that finds none ends it.
    """
    state = f"struct<cells:{_CELLS},a:array<bigint>,b:array<bigint>,end:int>"
    single = "array_distinct(transform(filter(q.cells, x -> x.n = {} and xxhash64(x.k, 1) = x.c), x -> x.k))"
    whole = _sum("q.cells", f"if(x.p < {width}, named_struct('k', s.k ^ x.k, 'c', s.c ^ x.c), s)")
    found = _sum("concat(g.a, g.b)", "named_struct('k', s.k ^ x, 'c', s.c ^ xxhash64(x, 1))")
    out = "'a', concat(q.a, g.a), 'b', concat(q.b, g.b)"
    gone = f"concat({_entries('g.a', 'f', '-1', width)}, {_entries('g.b', 'f', '1', width)})"
    after = _let("left", _fold(f"concat(q.cells, {gone})"), f"named_struct('cells', left, {out}, 'end', if(size(left) = 0, 1, 0))")
    all_ = f"named_struct('cells', q.cells, {out}, 'end', 1)"
    none = "named_struct('cells', q.cells, 'a', q.a, 'b', q.b, 'end', 2)"
    step = _let(
        "g", f"named_struct('a', {single.format(1)}, 'b', {single.format(-1)})",
        f"if(size(g.a) + size(g.b) = 0, {none}, if({whole} = {found}, {all_}, {after}))",
    )
    start = _let("cs", cells, f"named_struct('cells', cs, 'a', {_NONE}, 'b', {_NONE}, 'end', if(size(cs) = 0, 1, 0))")
    end = "q -> named_struct('a', q.a, 'b', q.b, 'done', q.end = 1)"
    return f"aggregate(sequence(1, {ROUNDS}), cast({start} as {state}), (q, r) -> if(q.end > 0, q, {step}), {end})"


def sketch(digests: str) -> Column:
    """The fingerprint's cells for a column of digests."""
    return F.expr(_fold(_entries(digests, "f", "1", str(WIDTH))))


def fingerprint_text(cells: str) -> Column:
    """Cells as text: place, number, digests and checks of each in hexadecimal."""
    return F.expr(f"array_join(transform({cells}, c -> concat(hex(cast(c.p as bigint)), ':', hex(cast(c.n as bigint)), '.', hex(c.k), '.', hex(c.c))), '-')")


def difference(digests_a: str, cells_a: str, digests_b: str, cells_b: str) -> Column:
    """What two versions' sketches tell apart: struct(a, b, done) of digests on one side only.

    The fingerprints are tried first, then larger sketches of both versions.
    ``done`` is false only if the largest failed too; the digests themselves are
    compared then, so ``a`` and ``b`` are exact in any case.
    """
    first = _peel(_minus(cells_a, cells_b), str(WIDTH))
    both = f"concat({_entries(digests_a, 'f', '1', 'w')}, {_entries(digests_b, 'f', '-1', 'w')})"
    larger = _let("w", f"cast((size({digests_a}) + size({digests_b})) * {ROOM} * power({GROWTH}, z - 1) as bigint)", _peel(_fold(both), "w"))
    tried = f"aggregate(sequence(1, {RETRIES}), {first}, (d, z) -> if(d.done, d, {larger}))"
    exact = f"named_struct('a', array_except({digests_a}, {digests_b}), 'b', array_except({digests_b}, {digests_a}), 'done', false)"
    return F.expr(_let("d", tried, f"if(d.done, d, {exact})"))


def likeness(found: str, size_a: str, size_b: str) -> Column:
    """Jaccard likeness of two digest sets from their difference; 1 for two empty ones."""
    apart = f"(size({found}.a) + size({found}.b))"
    return F.expr(f"coalesce(try_divide({size_a} + {size_b} - {apart}, cast({size_a} + {size_b} + {apart} as double)), 1D)")


def _sketched(df: DataFrame) -> DataFrame:
    out = df.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("digests", paragraph_digests(F.col("text")))
    return out.withColumn("cells", sketch("digests"))


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _following(docs: DataFrame) -> DataFrame:
    """Each row sketched, with ``next``, the row that follows in descending (doc_id, hash of text, text); after the last comes the first.

    Rows are dealt into ranges of ids, whose limits are quantiles. Ids that take
    up a whole range by themselves, and null ones, are cut into 64 ranges by the
    hash. A range's last row takes the first row of the next range that has any.
    """
    ranges = 4 * shuffle_partitions(docs.sparkSession)
    cuts = [int(x) for x in docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)]
    limits, hot = sorted(set(cuts)), sorted({x for x in cuts if cuts.count(x) > 1})
    above = F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x > F.col("doc_id"))) if limits else F.lit(0)
    spread = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    docs = docs.withColumn("hash", F.expr("shiftrightunsigned(xxhash64(text), 1)"))
    # rows of a spread id come after the greater ids of their range and before the smaller ones
    spot = F.when(F.col("doc_id").isNull(), F.lit(len(limits) + 1)).otherwise(above)
    side = F.lit(0)
    for x in hot:
        side = F.when(above == sum(y > x for y in limits), F.when(F.col("doc_id") > x, 0).when(F.col("doc_id") == x, 1).otherwise(2)).otherwise(side)
    slot = F.when(spread, 63 - F.shiftright("hash", 57)).otherwise(F.lit(0))
    docs = docs.withColumn("range", spot * 256 + side * 64 + slot)
    row = F.struct("text", "n_chars", "digests", "cells")
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc()]
    inside = _sketched(docs.repartition("range")).withColumn("next", F.lead(row).over(Window.partitionBy("range").orderBy(*order)))
    tops = docs.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("top"))
    # one row per range, whose number does not grow with the data
    heads = docs.join(F.broadcast(tops), "range").where(F.struct("doc_id", "hash").eqNullSafe(F.col("top")))
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*order))).where("nth = 1")
    heads = _sketched(heads.select("range", "text"))
    ring = Window.orderBy("range")  # one row per range
    first = F.first(row).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("range", F.coalesce(F.lead(row).over(ring), first).alias("head"))
    return inside.join(heads, "range").withColumn("next", F.coalesce("next", "head")).drop("head", "range", "hash")


def document_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text (doc_id, text, n_chars, digests, cells, fingerprint).

    Null and empty texts have no paragraphs and no cells. Equal texts have equal
    fingerprints. A paragraph that occurs twice counts once. Other columns play
    no part.
    """
    return _sketched(_plain(docs, doc_id, text)).withColumn("fingerprint", fingerprint_text("cells"))


def compare_with_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edited version and against the next document.

    The edited text is the text with its last half replaced by as many leading
    code points (or all) of the next document in descending id; the last is
    followed by the first, and a single document by itself. Returns (doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_apart, next_apart, peeled): the likenesses, the numbers of
    paragraph digests that were recovered, and whether peeling recovered all.

    Null texts count as empty; two versions without paragraphs are alike (1);
    rows that repeat an id follow each other in descending order of a hash of
    the text, and rows without an id come last; no rows give no rows.
    """
    rows = _following(_plain(docs, doc_id, text))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.left(F.col("next.text"), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", "digests", "cells",
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("edited")).alias("e_digests"),
        F.col("next.digests").alias("n_digests"), F.col("next.cells").alias("n_cells"),
    )
    rows = rows.withColumn("e_cells", sketch("e_digests"))
    rows = rows.withColumn("to_edited", difference("digests", "cells", "e_digests", "e_cells"))
    rows = rows.withColumn("to_next", difference("digests", "cells", "n_digests", "n_cells"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text("cells").alias("fingerprint"),
        fingerprint_text("e_cells").alias("edited_fingerprint"),
        likeness("to_edited", "size(digests)", "size(e_digests)").alias("near_edited"),
        likeness("to_next", "size(digests)", "size(n_digests)").alias("near_next"),
        F.expr("size(to_edited.a) + size(to_edited.b)").alias("edited_apart"),
        F.expr("size(to_next.a) + size(to_next.b)").alias("next_apart"),
        F.expr("to_edited.done and to_next.done").alias("peeled"),
    )

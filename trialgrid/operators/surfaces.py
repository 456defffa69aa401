"""Labelled surfaces of an arena, points on them, and distances between bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import bin_left_closed, mean_step, soft_range
from ..sources.io import remove, written
from .ordered import neighbour

SURFACE_SCHEMA = "surface_id int, kind string, obj int, side int, ex array<double>, ey array<double>, ez array<double>, normal array<float>"

# The default arena, as (x0, y0, x1, y1) and heights.
BOUNDS = (-12.5, -12.5, 12.5, 12.5)
ARENA = (-12.72, -12.37, 12.28, 12.63)
PILLARS = ((-7.5, 2.5, -2.5, 7.5), (2.5, 2.5, 7.5, 7.5), (-7.5, -7.5, -2.5, -2.5), (2.5, -7.5, 7.5, -2.5))
FLOOR = (
    (-12.72, -12.37, -7.55, 12.63), (-2.45, -12.37, 2.55, 12.63), (7.55, -12.37, 12.28, 12.63),
    (-7.55, -12.37, -2.45, -7.55), (-7.55, -2.45, -2.45, 2.45), (-7.55, 7.55, -2.45, 12.63),
    (2.45, -12.37, 7.55, -7.55), (2.45, -2.45, 7.55, 2.45), (2.45, 7.55, 7.55, 12.63),
)
WALL_HEIGHT, PILLAR_HEIGHT, CAMERA_HEIGHT, PILLAR_BOTTOM, THIN = 4.93, 3.11, 1.85, 0.05, 0.05
FLOOR_STEP, PILLAR_STEP = 25.0 / 39, 5.0 / 7

#: Of several surfaces that hold a point, the kind named first labels it.
PRIORITY = ("pillars", "walls", "ceiling", "floor")

Box = tuple[float, float, float, float]


def box_faces(box: Box, step: float, vertical_step: float, top: float, thin: float = THIN, bottom: float = 0.0, inward: bool = False) -> list[tuple]:
    """Four faces of an upright box as (ex, ey, ez, normal): front, back, left, right."""
    x0, y0, x1, y1 = box
    across, along, up = soft_range(x0, x1, step), soft_range(y0, y1, step), soft_range(bottom, top, vertical_step)
    flip = -1.0 if inward else 1.0
    return [
        (across, [y0 - thin, y0 + thin], up, [0.0, -flip, 0.0]),
        (across, [y1 - thin, y1 + thin], up, [0.0, flip, 0.0]),
        ([x0 - thin, x0 + thin], along, up, [-flip, 0.0, 0.0]),
        ([x1 - thin, x1 + thin], along, up, [flip, 0.0, 0.0]),
    ]


def arena_surfaces(
    spark: SparkSession,
    step: float = FLOOR_STEP,
    first_pillar_step: float = PILLAR_STEP,
    pillars: Sequence[Box] = PILLARS,
    arena: Box = ARENA,
    floor: Sequence[Box] = FLOOR,
    thin: float = THIN,
    pillar_layers: int = 4,
    wall_layers: int = 7,
) -> DataFrame:
    """The surfaces of an arena with pillars: a small table, one row per face.

    Only the first pillar has a bin width of its own; the others share the
    floor's. The floor is given as slabs, which leave out what pillars stand on.
    """
    rows: list[tuple] = []

    def add(kind: str, obj: int, faces: Sequence[tuple]) -> None:
        for side, face in enumerate(faces, 1):
            rows.append((len(rows) + 1, kind, obj, side, *face))

    for k, box in enumerate(pillars, 1):
        add("pillars", k, box_faces(box, first_pillar_step if k == 1 else step, PILLAR_HEIGHT / pillar_layers, PILLAR_HEIGHT, thin, PILLAR_BOTTOM))
    for k, face in enumerate(box_faces(arena, step, WALL_HEIGHT / wall_layers, WALL_HEIGHT, thin, inward=True), 1):
        add("walls", k, [face])
    flat = lambda b, z, up: (soft_range(b[0], b[2], step), soft_range(b[1], b[3], step), [z - thin, z + thin], [0.0, 0.0, up])
    for k, slab in enumerate(floor, 1):
        add("floor", k, [flat(slab, 0.0, 1.0)])
    add("ceiling", 1, [flat(arena, WALL_HEIGHT, -1.0)])
    return spark.createDataFrame(rows, SURFACE_SCHEMA)


def _bins_along(e: str) -> Column:
    """Bins of an axis: one for each edge, as one is appended, and a single one across a thin axis."""
    return F.when(F.size(e) > 2, F.size(e)).otherwise(F.lit(1))


def surface_bins(surfaces: DataFrame) -> DataFrame:
    """One row per bin of every surface: its numbers and its centre (cx, cy, cz)."""
    out = surfaces
    for c in "xyz":
        out = out.select("*", F.explode(F.sequence(F.lit(1), _bins_along(f"e{c}"))).alias(f"i{c}"))
    centre = lambda c: F.element_at(f"e{c}", F.col(f"i{c}")) + mean_step(F.col(f"e{c}")) / 2
    return out.select("surface_id", "kind", "obj", "side", "ix", "iy", "iz", *[centre(c).alias(f"c{c}") for c in "xyz"])


def bins_by_kind(surfaces: DataFrame) -> DataFrame:
    """Edges of all surfaces of a kind, in their order: (kind, bins array of (surface_id, ex, ey, ez))."""
    return surfaces.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("surface_id", "ex", "ey", "ez"))).alias("bins"))


def normals_by_kind(surfaces: DataFrame) -> DataFrame:
    """Normals of all surfaces of a kind, in their order: (kind, normals array of (surface_id, normal))."""
    return surfaces.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("surface_id", "normal"))).alias("normals"))


def surface_points(surfaces: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Edge points (surface_id, kind, obj, side, n, x, y, z) of each surface's inner face, numbered with x fastest.

    The inner face is the one its normal points to: at the first edge of the
    thin axis for a negative component, at the last one for a positive. Kinds
    in ``exclude`` are left out.
    """
    out = surfaces.where(~F.col("kind").isin(*exclude)) if exclude else surfaces
    axis = {"x": 1, "y": 2, "z": 3}
    for c, k in axis.items():
        n = F.element_at("normal", k)
        face = F.when(n < 0, F.slice(f"e{c}", 1, 1)).when(n > 0, F.slice(f"e{c}", F.size(f"e{c}"), F.lit(1))).otherwise(F.col(f"e{c}"))
        out = out.withColumn(f"f{c}", face)
    for c in "zyx":
        out = out.select("*", F.posexplode(f"f{c}").alias(f"k{c}", c))
    n = F.col("kx") + F.size("fx") * (F.col("ky") + F.size("fy") * F.col("kz")) + 1
    return out.select("surface_id", "kind", "obj", "side", n.alias("n"), "x", "y", "z")


def unique_points(points: DataFrame) -> DataFrame:
    """Different points (x, y, z) with the least surface that has each."""
    return points.groupBy("x", "y", "z").agg(F.min("surface_id").alias("surface_id"))


def bin_count(surfaces: DataFrame) -> DataFrame:
    return surfaces.agg(F.sum(_bins_along("ex") * _bins_along("ey") * _bins_along("ez")).cast("long").alias("n_bins"))


def physical_size(surfaces: DataFrame) -> DataFrame:
    """Extent of all surfaces along each axis, by the faces' in-plane edges."""
    long = lambda e: F.when(F.size(e) > 2, F.col(e))
    return surfaces.agg(*[(F.max(F.array_max(long(f"e{c}"))) - F.min(F.array_min(long(f"e{c}")))).alias(f"size_{c}") for c in "xyz"])


def _longer(surfaces: DataFrame) -> DataFrame:
    """Surfaces with one more bin on every axis, and the extent (x0, x1, ...) of all bins."""
    out = surfaces.withColumns({f"e{c}": F.concat(F.col(f"e{c}"), F.array(F.element_at(f"e{c}", -1) * 2 - F.element_at(f"e{c}", -2))) for c in "xyz"})
    return out.withColumns({f"{c}{k}": F.element_at(f"e{c}", at) for c in "xyz" for k, at in ((0, 1), (1, -1))})


class _Grid:
    """A grid of cells over the extent of all surfaces: about as many cells as there are surfaces."""

    def __init__(self, surfaces: DataFrame):
        self.surfaces = _longer(surfaces)
        told = self.surfaces.agg(F.count("*").alias("n"), *[f(f"{c}{k}").alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]).first()  # seven numbers
        each = math.ceil(max(told.n, 1) ** (1 / 3))
        self.lows = {c: told[f"{c}0"] or 0.0 for c in "xyz"}
        self.widths = {c: ((told[f"{c}1"] or 0.0) - self.lows[c]) / each or 1.0 for c in "xyz"}

    def cell(self, c: str, at: Column) -> Column:
        return F.floor((at - self.lows[c]) / self.widths[c])

    def listed(self) -> DataFrame:
        """Surfaces by each cell (gx, gy, gz) that their extent touches."""
        out = self.surfaces
        for c in "xyz":
            out = out.withColumn(f"g{c}", F.explode(F.sequence(self.cell(c, F.col(f"{c}0")), self.cell(c, F.col(f"{c}1")))))
        return out

    def placed(self, points: DataFrame) -> DataFrame:
        """Points as ``__p`` with their cell; those beyond all surfaces have cells that no surface touches."""
        return points.select(F.struct("*").alias("__p"), *[self.cell(c, F.col(c).cast("double")).alias(f"g{c}") for c in "xyz"])


_CELL = ["gx", "gy", "gz"]


def locate(points: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Points with every surface bin that holds them; a point can lie in several.

    One more bin is appended to every axis. Surfaces are listed by the cells of a
    grid that their extents touch and meet the points of these cells alone, by
    an equi-join, which Spark broadcasts if the list is small enough for it.
    """
    grid = _Grid(surfaces)
    inside = [(F.col(f"__p.{c}") >= F.col(f"{c}0")) & (F.col(f"__p.{c}") < F.col(f"{c}1")) for c in "xyz"]
    out = grid.placed(points).join(grid.listed(), _CELL).where(inside[0] & inside[1] & inside[2])
    number = {f"i{c}": bin_left_closed(F.col(f"__p.{c}"), F.col(f"e{c}")) for c in "xyz"}
    return out.select("__p.*", "surface_id", "kind", "obj", "side", *[v.alias(k) for k, v in number.items()])


def surface_histogram(points: DataFrame, surfaces: DataFrame, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted count by surface bin (by..., surface_id, ix, iy, iz, weight); a point counts in each surface it lies in."""
    amount = F.sum(weight) if weight else F.count("*")
    return locate(points, surfaces).groupBy(*by, "surface_id", "ix", "iy", "iz").agg(amount.alias("weight"))


def label_points(points: DataFrame, surfaces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One label per point (keys..., kind, surface_id, ix, iy, iz); points on no surface are left out.

    Each cell of a grid has its surfaces as one array, the kinds that come first
    in front, and a point meets its cell's alone: rows are neither paired nor
    multiplied, and those that repeat a key keep a row each.
    """
    grid = _Grid(surfaces)
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    fields = ["surface_id", "kind", "ex", "ey", "ez", *[f"{c}{k}" for c in "xyz" for k in (0, 1)]]
    cells = grid.listed().groupBy(*_CELL).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), *fields))).alias("__s"))

    def holds(s: Column) -> Column:
        held = [(F.col(f"__p.{c}") >= s[f"{c}0"]) & (F.col(f"__p.{c}") < s[f"{c}1"]) for c in "xyz"]
        return held[0] & held[1] & held[2]

    out = grid.placed(points).join(cells, _CELL).withColumn("__l", F.get(F.filter("__s", holds), F.lit(0))).where("__l is not null")
    bins = [bin_left_closed(F.col(f"__p.{c}"), F.col(f"__l.e{c}")).alias(f"i{c}") for c in "xyz"]
    return out.select(*[F.col(f"__p.`{k}`").alias(k) for k in keys], F.col("__l.kind").alias("kind"), F.col("__l.surface_id").alias("surface_id"), *bins)


def dwell_histogram(gaze: DataFrame, surfaces: DataFrame, keys: Sequence[str], time: str = "t", *, fixations_only: bool = False, by: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """:func:`surface_histogram` weighted by the time to the next sample; a key's last sample has none."""
    held = neighbour(gaze, keys, time, "__next", later=True, bucket=bucket)
    held = held.withColumn("__dt", F.col("__next") - F.col(time)).where("__dt is not null")
    if fixations_only:
        held = held.where("fixated")
    return surface_histogram(held, surfaces, "__dt", by).withColumnRenamed("weight", "occ")


def view_map(events: DataFrame, surfaces: DataFrame, occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event counts, time and their ratio by surface bin."""
    on = [*by, "surface_id", "ix", "iy", "iz"]
    out = surface_histogram(events, surfaces, by=by).join(occ, on, "full")
    out = out.withColumns({"weight": F.coalesce("weight", F.lit(0)), "occ": F.coalesce("occ", F.lit(0))})
    return out.withColumn("rate", F.try_divide(F.col("weight"), F.col("occ")))


def collapse_thin(hist: DataFrame, surfaces: DataFrame, value: str = "weight") -> DataFrame:
    """Sum over the axis of each surface's normal; the other two bin numbers are ``u`` and ``v``."""
    axis = F.array_position(F.transform(F.col("normal"), lambda v: v != 0), F.lit(True))
    u, v = F.when(axis == 1, F.col("iy")).otherwise(F.col("ix")), F.when(axis == 3, F.col("iy")).otherwise(F.col("iz"))
    joined = hist.join(F.broadcast(surfaces.select("surface_id", "normal")), "surface_id")
    finite = F.when(F.isnan(F.col(value).cast("double")) | F.abs(F.col(value).cast("double")).isin(float("inf")), F.lit(0)).otherwise(F.coalesce(F.col(value), F.lit(0)))
    return joined.groupBy("surface_id", u.alias("u"), v.alias("v")).agg(F.sum(finite).alias(value))


def nearest_wall(points: DataFrame, walls: DataFrame, key: str) -> DataFrame:
    """The wall whose centre (cx, cy) lies nearest to each point, by row; ``walls`` is a small table (wall_id, cx, cy)."""
    all_ = walls.agg(F.collect_list(F.struct("wall_id", "cx", "cy")).alias("__w"))

    def apart(w: Column) -> Column:
        return F.struct(((F.col("x") - w["cx"]) * (F.col("x") - w["cx"]) + (F.col("y") - w["cy"]) * (F.col("y") - w["cy"])).alias("d2"), w["wall_id"].alias("wall_id"))

    best = F.array_min(F.transform("__w", apart))
    return points.crossJoin(F.broadcast(all_)).select(key, best["wall_id"].alias("wall_id"))


def bin_distances(bins: DataFrame, cutoff: float, key: str = "bin_id") -> DataFrame:
    """Straight-line distances (i, j, d) of bins not farther apart than ``cutoff``, both ways and i = j.

    Bins are dealt into cells as wide as the cut-off; one meets its own and the 26 around it.
    """
    cell = {f"c{c}": F.floor(F.col(f"c{c}") / cutoff) for c in "xyz"}
    left = bins.select(F.col(key).alias("i"), *[F.col(f"c{c}").alias(f"a{c}") for c in "xyz"], *[v.alias(f"k{c[-1]}") for c, v in cell.items()])
    right = bins.select(F.col(key).alias("j"), *[F.col(f"c{c}").alias(f"b{c}") for c in "xyz"], *[v.alias(f"k{c[-1]}") for c, v in cell.items()])
    for c in "xyz":
        right = right.withColumn("__o", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"k{c}", F.col(f"k{c}") + F.col("__o")).drop("__o")
    d2 = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    return left.join(right, ["kx", "ky", "kz"]).select("i", "j", F.sqrt(d2).alias("d")).where(F.col("d") <= cutoff)


def bin_number(surface: Column, ix: Column, iy: Column, iz: Column) -> Column:
    """One number for a surface bin; an axis has fewer than 4,096 bins."""
    return ((surface.cast("long") * 4096 + ix) * 4096 + iy) * 4096 + iz


def adjacent_bins(surfaces: DataFrame) -> DataFrame:
    """Bins that touch, on one surface or across an edge that two share, both ways: (i, j, d), with d between their centres.

    Bins are dealt into cells twice as wide as the widest half bin, so those
    that touch lie in the same cell or in one beside it.
    """
    steps = surfaces.select("surface_id", *[(mean_step(F.col(f"e{c}")) / 2).alias(f"h{c}") for c in "xyz"])
    cell = steps.agg((F.max(F.greatest("hx", "hy", "hz")) * 2 + 1e-6).alias("w")).scalar()  # one number of a small table
    bins = surface_bins(surfaces).join(steps, "surface_id")
    named = bins.select(bin_number(F.col("surface_id"), F.col("ix"), F.col("iy"), F.col("iz")).alias("id"), *[f"{k}{c}" for k in "ch" for c in "xyz"], *[F.floor(F.col(f"c{c}") / cell).alias(f"k{c}") for c in "xyz"])
    left = named.select(F.col("id").alias("i"), *[F.col(f"{k}{c}").alias(f"a{k}{c}") for k in "ch" for c in "xyz"], "kx", "ky", "kz")
    right = named.select(F.col("id").alias("j"), *[F.col(f"{k}{c}").alias(f"b{k}{c}") for k in "ch" for c in "xyz"], "kx", "ky", "kz")
    for c in "xyz":
        right = right.withColumn("__o", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"k{c}", F.col(f"k{c}") + F.col("__o")).drop("__o")
    touch = [F.abs(F.col(f"ac{c}") - F.col(f"bc{c}")) <= F.col(f"ah{c}") + F.col(f"bh{c}") + 1e-6 for c in "xyz"]
    d2 = sum(((F.col(f"ac{c}") - F.col(f"bc{c}")) * (F.col(f"ac{c}") - F.col(f"bc{c}")) for c in "xyz"), F.lit(0.0))
    return left.join(right, ["kx", "ky", "kz"]).where((F.col("i") != F.col("j")) & touch[0] & touch[1] & touch[2]).select("i", "j", F.sqrt(d2).alias("d"))


def path_distances(edges: DataFrame, cutoff: float) -> DataFrame:
    """Lengths (i, j, d) of the shortest ways along edges (i, j, d), up to ``cutoff``, both ends of an edge and i = j included.

    All sources go forward together: each round lengthens the ways found last
    by one edge, keeps the least for each pair, and goes on with those that got
    shorter. Rounds are written to the shared folder; there are as many as a
    shortest way has edges, at most, and no more rows than pairs in reach.
    """
    spark = edges.sparkSession
    shape = "i long, j long, d double, fresh boolean"
    steps = written(edges.where(F.col("d") <= cutoff).select("i", F.col("j").alias("k"), F.col("d").alias("w")), "edges", "parquet")
    step = spark.read.schema("i long, k long, w double").parquet(steps)
    ends = step.select(F.col("i")).union(step.select(F.col("k"))).distinct()
    path = written(ends.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")), "paths", "parquet")
    while True:
        held = spark.read.schema(shape).parquet(path)
        if not held.where("fresh").take(1):
            return held.select("i", "j", "d")
        on = step.withColumnRenamed("i", "j")
        found = held.where("fresh").join(on, "j").select("i", F.col("k").alias("j"), (F.col("d") + F.col("w")).alias("n")).where(F.col("n") <= cutoff)
        least = found.groupBy("i", "j").agg(F.min("n").alias("n"))
        better = F.col("d").isNull() | (F.col("n") < F.col("d") - 1e-12)
        merged = held.drop("fresh").join(least, ["i", "j"], "full").select("i", "j", F.when(better, F.coalesce("n", "d")).otherwise(F.col("d")).alias("d"), F.coalesce(better & F.col("n").isNotNull(), F.lit(False)).alias("fresh"))
        before, path = path, written(merged, "paths", "parquet")
        remove(spark, before)


def surface_distances(surfaces: DataFrame, cutoff: float) -> DataFrame:
    """Distances (i, j, d) of bins along the surfaces, from centre to centre of bins that touch, up to ``cutoff``."""
    return path_distances(adjacent_bins(surfaces), cutoff)


def bin_weights(hist: DataFrame, surfaces: DataFrame, value: str = "weight") -> DataFrame:
    """A histogram by the bins of :func:`surface_bins` (bin_id, value): both layers of a thin axis count as its one bin."""
    thin = surfaces.select("surface_id", *[(F.size(f"e{c}") == 2).alias(f"t{c}") for c in "xyz"])
    at = [F.when(F.col(f"t{c}"), F.lit(1)).otherwise(F.col(f"i{c}")) for c in "xyz"]
    return hist.join(thin, "surface_id").groupBy(bin_number(F.col("surface_id"), *at).alias("bin_id")).agg(F.sum(value).alias(value))


def kernel_smooth(values: DataFrame, distances: DataFrame, sigma: float = 5.5, key: str = "bin_id", value: str = "weight") -> DataFrame:
    """``sum_j exp(-d_ij**2 / (2 sigma**2)) value_j`` for every bin i that a distance leads to."""
    weight = F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma))
    joined = distances.join(values.select(F.col(key).alias("j"), F.col(value).alias("__v")), "j")
    return joined.groupBy(F.col("i").alias(key)).agg(F.sum(weight * F.col("__v")).alias("smooth"))


def busier_side(hist: DataFrame, surface: Sequence[str], side: str = "iz", value: str = "weight") -> DataFrame:
    """Of a thin surface's two layers the rows of the one with more weight, the first of equals."""
    totals = hist.groupBy(*surface, side).agg(F.sum(value).alias("__sum"))
    best = totals.groupBy(*surface).agg(F.max_by(side, F.struct("__sum", -F.col(side))).alias(side))
    return hist.join(best, [*surface, side], "left_semi")

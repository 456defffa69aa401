"""Operators against known results and against slow statements of their rules."""

import bisect
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.functions import bins, columns
from trialgrid.operators import asof, gaze, intervals, maps, ordered, signals, surfaces, trials, units
from trialgrid.plans.queries import QUERIES
from trialgrid.sources import io, levels


def _markers(spark, values):
    return spark.createDataFrame([(1, k, m, float(k)) for k, m in enumerate(values)], "session int, seq int, marker int, t double")


def test_reshape_triggers(spark):
    out = trials.reshape_triggers(_markers(spark, [84, 11, 21, 31, 12, 22, 42, 13, 23, 33]), ["session"]).orderBy("trial").collect()
    assert [(r.trig1, r.trig2, r.trig3) for r in out] == [(11, 21, 31), (12, 22, 42), (13, 23, 33)]
    assert [(r.t1, r.t2, r.t3) for r in out] == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]


@pytest.mark.parametrize(("values", "said"), [([11, 22, 31], "Inconsistent cue markers"), ([23, 23, 33], "Inconsistent main markers")])
def test_reshape_triggers_fails(spark, values, said):
    with pytest.raises(Exception, match=said):
        trials.reshape_triggers(_markers(spark, values), ["session"]).collect()


def test_messages_and_clock(spark):
    df = spark.createDataFrame([("Start Trial 11",), ("Cue Offset 21",), ("End Trial 31",), ("other 5",), (None,)], "m string")
    assert [r[0] for r in df.select(columns.message_marker(F.col("m"))).collect()] == [11, 21, 31, None, None]


def test_soft_range():
    edges = bins.soft_range(0.0, 3.1, 1.1)
    assert len(edges) == 4 and edges[1] == pytest.approx(1.03333, abs=1e-5)


def test_box_and_maze(spark):
    faces = surfaces.box_faces((-7.5, 2.5, -2.5, 7.5), 0.1, 0.1, 3.0, 0.1)
    assert len(faces[0][0]) == 51 and faces[0][1] == [2.4, 2.6]
    arena = surfaces.arena_surfaces(spark)
    assert arena.count() == 30
    size = surfaces.physical_size(arena).first()
    assert (size.size_x, size.size_y, size.size_z) == pytest.approx((25.0, 25.0, 4.93))
    assert surfaces.surface_bins(arena).count() == surfaces.bin_count(arena).first().n_bins == 5186


def test_point_labels(spark):
    points = [(2.5, 7.51, 1.5), (7.51, -2.5, 1.5), (-2.5, -7.51, 1.5), (-7.51, 2.5, 1.5), (-2.5, -2.49, 1.5), (2.5, 2.49, 1.5), (0.0, 0.0, 4.93), (-2.72, 12.63, 1.5), (-2.72, -12.37, 1.5), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, x double, y double, z double")
    out = surfaces.label_points(df, surfaces.arena_surfaces(spark), ["k"]).orderBy("k").collect()
    assert [r.kind for r in out] == ["pillars"] * 6 + ["ceiling", "walls", "walls", "floor"]


def test_known_ray(spark):
    vx, vy = (float((np.float32(v) - np.float32(n / 2)) / np.float32(n)) for v, n in ((950.4, 1919.0), (1069.1, 1079.0)))
    df = spark.createDataFrame([(vx, vy, 0.0, 0.0, -10.0, surfaces.CAMERA_HEIGHT)], "vx double, vy double, dir double, px double, py double, pz double")
    dx, dy, dz = gaze.gaze_direction(F.col("vx"), F.col("vy"), F.col("dir"))
    r = gaze.ray_hit(df.withColumns({"dx": dx, "dy": dy, "dz": dz})).first()
    assert (r.gx, r.gy, r.gz) == pytest.approx((-0.0608161026648, -3.7602963690846, 4.9267642104094), abs=1e-6)


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_against_index_rule(spark, direction, bucket):
    rng = random.Random(3)
    events = [(k % 3, rng.randrange(100)) for k in range(60)]
    samples = sorted({(rng.randrange(3), rng.randrange(100)) for _ in range(40)})
    out = asof.asof_join(
        spark.createDataFrame(events, "k int, t int"),
        spark.createDataFrame([(k, t, t * 1.5) for k, t in samples], "k int, t int, x double"),
        ["k"], values=["x"], direction=direction, bucket=bucket,
    )
    expected = []
    for k, t in events:
        own = [s for q, s in samples if q == k]
        at = bisect.bisect_left(own, t) if direction == "forward" else bisect.bisect_right(own, t) - 1
        if 0 <= at < len(own):
            expected.append((k, t, own[at]))
    assert sorted((r.k, r.t, r.t_match) for r in out.collect()) == sorted(expected)


def test_asof_without_match(spark):
    """Null times and null keys: nothing is lost, and a null time matches nothing."""
    events = spark.createDataFrame([(1, 5), (1, None), (1, 99), (None, 3)], "k int, t int")
    samples = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, None, 3), (None, 60, 4), (2, 5, 5)], "k int, t int, x int")
    for direction, found in [("forward", [(None, 3, 60), (1, None, None), (1, 5, 7), (1, 99, None)]), ("backward", [(None, 3, None), (1, None, None), (1, 5, None), (1, 99, 7)])]:
        for bucket in (None, 10):
            out = asof.asof_join(events, samples, ["k"], values=["x"], direction=direction, bucket=bucket, drop_unmatched=False).collect()
            assert sorted(map(str, [(r.k, r.t, r.t_match) for r in out])) == sorted(map(str, found))
            assert {r.x for r in out if r.t_match == 7} == {1 if direction == "forward" else 2}


@pytest.mark.parametrize("bucket", [None, 9])
def test_slices_against_rule(spark, bucket):
    rng = random.Random(8)
    samples = sorted(rng.sample(range(300), 40))
    bounds = [(n, a, a + rng.randrange(40)) for n, a in enumerate(range(-20, 320, 17))]
    df = spark.createDataFrame([(1, t, "v") for t in samples] + [(2, 1, "v"), (2, None, "v")], "k int, t int, __row string")
    spans = spark.createDataFrame([(1, *b) for b in bounds] + [(1, 99, None, 5), (3, 1, 1, 2)], "k int, trial int, t1 int, t3 int")
    cut = trials.trial_slice(df, spans, ["k"], bucket=bucket)
    assert sorted(cut.columns) == ["__row", "k", "t", "trial"]
    expected = [(n, t) for n, a, b in bounds for k, t in enumerate(samples) if t >= a and (k == 0 or samples[k - 1] < b)]
    assert sorted((r.trial, r.t) for r in cut.collect()) == sorted(expected)
    around = trials.trial_window(df, spans, ["k"], pre=3, post=4, bucket=bucket)
    assert sorted((r.trial, r.t) for r in around.collect()) == sorted((n, t - a) for n, a, b in bounds for t in samples if a - 3 <= t <= b + 4)
    clock = trials.cumulative_clock(df.withColumn("dt", F.col("t") * 2), ["k"], order="t", name="clock", bucket=bucket).where("k = 1")
    assert {r.t: r.clock for r in clock.collect()} == {t: 2 * sum(samples[: k + 1]) for k, t in enumerate(samples)}
    for later in (False, True):
        beside = ordered.neighbour(df, ["k"], "t", "other", later=later, bucket=bucket).where("k = 1").collect()
        step = 1 if later else -1
        assert {r.t: r.other for r in beside} == {t: samples[k + step] if 0 <= k + step < len(samples) else None for k, t in enumerate(samples)}


@pytest.mark.parametrize("bucket", [None, 9])
def test_interval_mask_ties_and_nulls(spark, bucket):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (1, 40, "d"), (1, 40, "e"), (2, 5, "f")], "k int, t int, fixated string")
    spans = spark.createDataFrame([(1, 3, 6), (1, None, 80), (2, 9, 4)], "k int, t_start int, t_end int")
    out = intervals.interval_mask(df, spans, ["k"], bucket=bucket)
    assert sorted(map(str, [(r.k, r.t, r.fixated) for r in out.collect()])) == sorted(map(str, [(1, 5, True), (1, 5, True), (1, None, False), (1, 40, True), (1, 40, True), (2, 5, False)]))


@pytest.mark.parametrize("bucket", [None, 9])
@pytest.mark.parametrize("strict", [False, True])
def test_interval_mask_against_rule(spark, strict, bucket):
    rng = random.Random(5)
    samples = sorted(rng.sample(range(200), 40))
    spans = [(a, a + rng.randrange(15)) for a in range(0, 200, 20)]
    out = intervals.interval_mask(spark.createDataFrame([(1, t) for t in samples], "k int, t int"), spark.createDataFrame([(1, a, b) for a, b in spans], "k int, t_start int, t_end int"), ["k"], strict=strict, bucket=bucket)
    for r in out.collect():
        at = samples.index(r.t)
        rule = any(a <= r.t and ((at == 0 and not strict) or (at > 0 and samples[at - 1] < b)) for a, b in spans)
        assert r.fixated == rule


def test_band_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 9.0)], "k int, t double")
    out = intervals.band_self_join(df, ["k"], 5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [(r.t, r.t_later) for r in out.collect()] == [(1.0, 2.0)]


@pytest.mark.parametrize("bucket", [None, 9.0])
def test_lag_counts_without_pairs(spark, bucket):
    """Ties, lags on an edge, an edge above 0, null times and keys, a single point."""
    rng = random.Random(4)
    times = [rng.randrange(60) for _ in range(50)] + [7, 7, 7]
    rows = [("a", float(t)) for t in times] + [(None, float(t)) for t in times[:9]] + [("b", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t double")
    for edges in ([0.0, 1.0, 3.0, 10.0], [2.0, 4.0, 40.0]):
        want = {}
        for key, own in (("a", times), (None, times[:9])):
            for a in own:
                for b in own:
                    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False), 1):
                        if b > a and lo < b - a <= hi:
                            want[key, k] = want.get((key, k), 0) + 1
        out = intervals.lag_counts(df, ["k"], edges, bucket=bucket)
        assert {(r.k, r.bin): r.n for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket", [None, 4, F])
def test_ranked(spark, bucket):
    """Numbers and totals by key, null orders first, null keys, a sort by two columns; no window sorts a key alone."""
    rng = random.Random(9)
    rows = [(rng.choice((1, 2, None)), rng.choice((None, *range(40))), k) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, t int, n int")
    bucket = F.floor(F.col("t") / 7) if bucket is F else bucket
    out = ordered.ranked(df, ["k"], ["t", "n"], "place", total="of", bucket=bucket)
    assert out.columns == ["k", "t", "n", "place", "of"]
    for key in (1, 2, None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert sorted((r.place, r.t, r.n, r.of) for r in out.collect() if r.k == key) == [(i, t, n, len(own)) for i, (_, t, n) in enumerate(own, 1)]
    assert ordered.ranked(df.where("false"), ["k"], "t").count() == 0
    window = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line and "windowspec" in line]
    assert window and all("__bucket" in line for line in window)


def test_cover_is_small_and_exact(spark):
    rng = random.Random(2)
    spans = [(0, 9999), (1, 10000), (-37, -37), (-5, 900), (5, 4)] + [(a, a + rng.randrange(3000)) for a in (rng.randrange(-500, 500) for _ in range(40))]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", ordered.cover(F.col("a"), F.col("b")).alias("c"))
    for r in df.collect():
        held = [b for c in r.c for b in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(held) == list(range(r.a, r.b + 1)) and len(r.c) < 40


def test_disk_and_border(spark):
    kernel = maps.disk_kernel(1)
    assert len(kernel) == 5 and all(w == 0.2 for _, _, w in kernel)
    out = {(r.ix, r.iy): r.smooth for r in maps.smooth_map(spark.createDataFrame([(1, 1, 1.0)], "ix int, iy int, weight double"), 3, 3, kernel).collect()}
    assert out[(1, 1)] == pytest.approx(0.6) and out[(2, 1)] == pytest.approx(0.2)


def test_ray_against_steps(spark):
    import math

    rng = random.Random(8)
    rays = []
    while len(rays) < 60:
        p = (rng.uniform(-12, 12), rng.uniform(-12, 12), 1.7)
        if not any(b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3] for b in surfaces.PILLARS):
            a, up = rng.uniform(0, 2 * math.pi), rng.uniform(-0.3, 0.3)
            rays.append((*p, math.sin(a), math.cos(a), up))
    out = gaze.ray_hit(spark.createDataFrame(rays, "px double, py double, pz double, dx double, dy double, dz double"))
    for r in out.collect():
        n = 0
        while True:
            x, y, z = r.px + n * 0.01 * r.dx, r.py + n * 0.01 * r.dy, r.pz + n * 0.01 * r.dz
            inside = -12.5 <= x <= 12.5 and -12.5 <= y <= 12.5 and 0 <= z <= 4.93
            if not inside or any(b[0] <= x <= b[2] and b[1] <= y <= b[3] and z <= 3.11 for b in surfaces.PILLARS):
                break
            n += 1
        last = max(n - 1, 0) * 0.01
        assert (r.gx, r.gy) == pytest.approx((r.px + last * r.dx, r.py + last * r.dy), abs=1e-9)


def test_units(spark):
    templates = spark.createDataFrame([(u, 1, p, float(u * p)) for u in (1, 2, 5) for p in (1, 2)], "unit int, channel int, pt int, v double")
    firings = spark.createDataFrame([(1,), (1,), (1,), (2,), (5,)], "unit int")
    merged, relabelled = units.merge_units(templates, firings, [1, 2])
    assert {(r.unit, r.pt): r.v for r in merged.collect()}[(1, 2)] == pytest.approx((3 * 2 + 1 * 4) / 4)
    assert sorted(r.unit for r in relabelled.collect()) == [1, 1, 1, 1, 5]
    kept = units.keep_units(firings, spark.createDataFrame([(2,), (5,)], "unit int"))
    assert sorted(r.unit for r in kept.collect()) == [1, 2]


def test_session_logs(spark, tmp_path):
    lines = ["name: a maze DTL Donk", "", "posters: P1(-5,1.5,-7.55)", "16 0.5 0.0 -10.0 0.0", "0 0.25 1.0 -9.5 1.5", "26 0.25 1.5 -9.0 2.5"]
    (tmp_path / "session_1.txt").write_text("\n".join(lines))
    rows = io.read_positions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.marker, r.x) for r in rows] == [(16, 0.0), (0, 1.0), (26, 1.5)]
    header = io.read_headers(spark, str(tmp_path)).select("header", io.posters(F.col("header")["posters"]).alias("p")).first()
    assert header.header["name"] == " a maze DTL Donk"
    assert [(p.poster, p.x, p.y, p.z) for p in header.p] == [(1, -5.0, 1.5, -7.55)]
    assert io.read_spikes(spark, str(tmp_path / "none")).count() == 0


def test_logs_of_many_sessions_share_files(spark):
    """Bundled logs read like logs of their own, and files do not grow with the sessions."""
    lines = [(s, k, text) for s in range(300) for k, text in enumerate([f"MazeName: m {s}", "PosterLocations: P1(-5,1.5,-7.55)", "16 0.5 0.0 -10.0 0.0", f"26 0.25\t{s}.5 -9.0 2.5"])]
    path = io.write_logs(spark.createDataFrame(lines, "s long, k int, line string"), "s", "k", "line")
    assert len(spark.read.text(path).inputFiles()) <= 4
    rows = {(r.file, r.seq): (r.marker, r.x) for r in io.read_positions(spark, path, bundled=True).collect()}
    assert rows == {(str(s), q): (16, 0.0) if q == 1 else (26, s + 0.5) for s in range(300) for q in (1, 2)}
    assert {r.file: r.header["MazeName"] for r in io.read_headers(spark, path, bundled=True).collect()} == {str(s): f" m {s}" for s in range(300)}
    assert {(r.file, r.maze, r.poster, r.x) for r in io.read_posters(spark, path, bundled=True).collect()} == {(str(s), f"m {s}", 1, -5.0) for s in range(300)}
    assert io.read_spikes(spark, path + "-none", "s long").columns == ["s", "t_ms"]


@pytest.mark.parametrize("name", ["session_logs", "spike_files"])
def test_files_do_not_grow_with_users(spark, tmp_path, monkeypatch, name):
    rows = spark.range(400).selectExpr("id AS event_id", "id AS user_id", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "IF(id % 2 = 0, 'view', 'purchase') AS event_type", "1D AS value", "'1' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    paths, write = [], io.written
    monkeypatch.setattr(io, "written", lambda *a, **k: paths.append(write(*a, **k)) or paths[-1])
    assert QUERIES[name](spark, str(tmp_path)).count() == 200
    assert [p for p in paths if len(list(Path(p.removeprefix("file://")).rglob("part-*"))) > 8] == []


def test_levels_of_many_values_are_no_folders(spark, tmp_path):
    df = spark.range(3000).selectExpr("id % 2 AS array", "id % 300 AS session", "id AS v")
    io.write_levels(df.repartition(3), f"{tmp_path}/k", ("array", "session"), within=("session",))
    assert sorted(p.name for p in Path(f"{tmp_path}/k").rglob("*=*")) == ["array=0", "array=1"]
    assert sorted(r.v for r in io.load(spark, str(tmp_path), "k", array=1, session=7).collect()) == list(range(7, 3000, 300))


def test_spectra_of_many_short_series(spark):
    """Short series share batches; frequencies within bounds are those of the whole spectrum."""
    rng = np.random.default_rng(2)
    series = {s: rng.normal(size=int(rng.integers(1, 30))) for s in range(40)}
    df = spark.createDataFrame([(s, k, float(x)) for s, v in series.items() for k, x in enumerate(v)], "s int, t long, v double")
    out = signals.spectrum(df, ["s"], 32.0, block=16, within=(4.0, 12.0))
    assert "Pandas" not in out._jdf.queryExecution().toString()
    got = {(r.s, r.t, r.freq): complex(r.re, r.im) for r in out.collect()}
    reach, told = signals._margin(32.0, 1.5, 1.0), {}
    for s, v in series.items():
        freqs, c = signals.morlet(np.pad(v, reach), 32.0)
        told |= {(s, t, f): c[reach + t, k] for t in range(len(v)) for k, f in enumerate(freqs) if 4 <= f <= 12}
    assert got.keys() == told.keys()
    assert max(abs(got[k] - told[k]) for k in told) < 1e-6


def test_cell_names(spark):
    out = spark.createDataFrame([("20180706ch12c1",)], "n string").select(io.parse_cell(F.col("n")).alias("c")).first().c
    assert (out.day, out.channel, out.cell) == ("20180706", "012", "01")


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "t")
    assert io.materialize(spark, spark.range(3), path).count() == 3
    assert io.materialize(spark, spark.range(5), path).count() == 3
    assert io.materialize(spark, spark.range(5), path, redo=True).count() == 5


def _matrix(n=40, d=6, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ np.diag(np.arange(d, 0, -1)) + rng.normal(size=d)


def test_features_follow_numpy(spark):
    """Principal components, singular vectors and both by channel, up to signs."""
    x = _matrix()
    rows = [(k, k % 2, w.tolist()) for k, w in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, channel int, wave array<double>")

    def told(found):
        return np.array([r.features for r in sorted(found.collect(), key=lambda r: r.id)])

    def pca(m):
        c = m - m.mean(0)
        return c @ np.linalg.svd(c, full_matrices=False)[2][:3].T

    assert np.allclose(np.abs(told(units.pca_features(df, "id"))), np.abs(pca(x)), atol=1e-6)
    assert np.allclose(np.abs(told(units.svd_features(df, "id"))), np.abs(np.linalg.svd(x, full_matrices=False)[0][:, :3]), atol=1e-6)
    each = units.features_by_channel(df, "id")
    for channel in (0, 1):
        assert np.allclose(np.abs(told(each.where(f"channel = {channel}"))), np.abs(pca(x[channel::2])), atol=1e-6)
    assert units.features_by_channel(df.where("false"), "id").count() == 0


def test_spectrum_in_blocks(spark):
    """Blocks give what the whole series gives, and both what the direct sum of a wavelet gives."""
    n, fs, beta = 700, 16.0, 1.5
    v = np.random.default_rng(5).normal(size=n)
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(v)] + [("b", 0, 1.0)], "s string, t long, v double")
    whole = {(r.s, r.t, r.freq): complex(r.re, r.im) for r in signals.spectrum(df, ["s"], fs).collect()}
    parts = {(r.s, r.t, r.freq): complex(r.re, r.im) for r in signals.spectrum(df, ["s"], fs, block=128).collect()}
    assert whole.keys() == parts.keys() and max(abs(whole[k] - parts[k]) for k in whole if k[2] <= fs / 4) < 1e-5
    f = max(freq for s, _, freq in whole if s == "a" and freq <= 4)
    at = (np.arange(n) - 350) / fs
    # the wavelet in time is the transform of its spectrum: a Gaussian of width beta / f under a carrier
    wavelet = 2 * f / (beta * np.sqrt(2 * np.pi)) * np.exp(-0.5 * (at * f / beta) ** 2) * np.exp(-2j * np.pi * f * at) / fs
    assert abs((v * wavelet).sum() - whole["a", 350, f]) < 1e-3


def test_aligned_spectrum(spark):
    rng = np.random.default_rng(6)
    waves = rng.normal(size=(9, 16))
    rows = [(e, o - 8, float(waves[e, o])) for e in range(9) for o in range(16)]
    df = spark.createDataFrame(rows, "trial int, offset int, v double")
    reach = signals._margin(16.0, 1.5, 1.0)
    logs = []
    for w in waves:
        freqs, c = signals.morlet(np.pad(w, reach), 16.0)
        logs.append(np.log(np.abs(c[reach : reach + 16])))
    mean, deviation = np.mean(logs, 0), np.std(logs, 0)
    out = signals.aligned_spectrum(df, ["trial"], 16.0).collect()
    assert len(out) == 16 * len(freqs)
    for r in out:
        k = int(np.argmin(np.abs(freqs - r.freq)))
        assert abs(r["mean"] - mean[r.offset + 8, k]) < 1e-6 and abs(r.deviation - deviation[r.offset + 8, k]) < 1e-6
    turned = signals.aligned_spectrum(df, ["trial"], 16.0, seed=2).collect()
    assert len(turned) == len(out) and any(abs(a["mean"] - b["mean"]) > 1e-3 for a, b in zip(sorted(out), sorted(turned), strict=True))


def test_surface_points(spark):
    arena = surfaces.arena_surfaces(spark)
    points = surfaces.surface_points(arena)
    sizes = {r.surface_id: (len(r.ex), len(r.ey), len(r.ez), r.normal) for r in arena.collect()}
    counts = {r.surface_id: r["count"] for r in points.groupBy("surface_id").count().collect()}
    for k, (nx, ny, nz, normal) in sizes.items():
        free = [n for n, v in zip((nx, ny, nz), normal, strict=True) if v == 0]
        assert counts[k] == free[0] * free[1]
    ceiling = arena.where("kind = 'ceiling'").first()
    assert {r.z for r in points.where("kind = 'ceiling'").select("z").distinct().collect()} == {ceiling.ez[0]}
    assert points.where("surface_id = 1").agg({"n": "max"}).first()[0] == counts[1]
    assert surfaces.surface_points(arena, ["pillars", "walls"]).select("kind").distinct().count() == 2
    assert surfaces.unique_points(points.unionByName(points)).count() == points.select("x", "y", "z").distinct().count()


def test_short_trio_fails(spark):
    df = spark.createDataFrame([(1, k, m, float(k)) for k, m in enumerate([84, 11, 21, 31, 12])], "s int, seq int, marker int, t double")
    with pytest.raises(Exception, match="Inconsistent number of markers"):
        trials.reshape_triggers(df, ["s"]).collect()


def test_eye_recording(spark):
    """Screen, eyes, fixations, saccades, trials and samples of a recording."""
    said = [("GAZE_COORDS 0.00 0.00 1919.00 1079.00", 0), ("Start Trial 11", 10), ("GAZE_COORDS 1 1 1 1", 20), ("Cue Offset 21", 1000), ("End Trial 31", 50000)]
    events = [(1, k, "messageevent", m, t, None, None, None, None, None) for k, (m, t) in enumerate(said)]
    events += [(1, 9, "endfix", None, 100, 200, None, None, None, None), (1, 10, "endsacc", None, 200, 220, 5.0, 79.0, 6.0, 1000.0)]
    shape = "s int, seq int, eventtype string, message string, sttime long, entime long, gstx double, gsty double, genx double, geny double"
    samples = [(1, eye, t, 10.0 if eye == 1 else -32768.0, 9.0) for eye in (1, 2) for t in range(3)]
    got = io.extract_eye(spark.createDataFrame(events, shape), spark.createDataFrame(samples, "s int, eye int, t long, gx double, gy double"), ["s"])
    assert got["screen"].first()[1:] == (0.0, 0.0, 1919.0, 1079.0) and [r.eye for r in got["eyes"].collect()] == [1]
    assert got["fixations"].first()[1:] == (100, 200) and got["saccades"].first()[3:] == (5.0, 1000.0, 6.0, 79.0)
    trial = got["triggers"].first()
    assert (trial.trig1, trial.trig2, trial.trig3, trial.t1, trial.t2, trial.t3) == (11, 21, 31, 10, 1000, 50000)
    assert {r.gy for r in got["gaze"].collect()} == {1070.0}


def test_log_folders(spark, tmp_path):
    (tmp_path / "a" / "RawData_T1").mkdir(parents=True)
    log = "Date: now\nMazeName: Maze Donk\nPosterLocations: \nname: Poster-hippo\nposterPosition: (1.0, 1.2, 3.0)\n16 0.1 1 2 3\n26 0.2 1.5 2 3\n"
    (tmp_path / "a" / "RawData_T1" / "session_1.txt").write_text(log)
    (tmp_path / "a" / "other.txt").write_text("x")
    found = io.discover(spark, str(tmp_path), "session_*.txt").collect()
    assert len(found) == 1 and found[0].path.endswith("a/RawData_T1/session_1.txt")
    poster = io.read_posters(spark, found[0].path).collect()
    assert [(r.maze, r.name, r.x, r.y, r.z) for r in poster] == [("Maze Donk", "Poster-hippo", 1.0, 1.2, 3.0)]
    assert [(r.seq, r.marker, r.x) for r in io.read_positions(spark, found[0].path).orderBy("seq").collect()] == [(1, 16.0, 1.0), (2, 26.0, 1.5)]


def test_zip_trials(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 1, 2.0), (1, 2, 1.0)], "s int, trial int, t double")
    b = spark.createDataFrame([(1, 1, 31), (2, 1, 32)], "s int, trial int, marker int")
    out = trials.zip_trials(["s"], spikes=a, markers=b).collect()
    assert len(out) == 1 and [r.t for r in out[0].spikes] == [2.0, 5.0] and out[0].markers[0].marker == 31
    assert trials.trial_of(a, 2).count() == 1


def test_points_that_repeat_a_key_keep_their_rows(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 4.93), (2, 99.0, 0.0, 0.0)], "k int, x double, y double, z double")
    assert sorted(r.kind for r in surfaces.label_points(points, surfaces.arena_surfaces(spark), ["k"]).collect()) == ["ceiling", "floor"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_surfaces_by_a_grid(spark):
    """10,000 surfaces: an equi-join, and the bins and labels that the extents say."""
    rng = random.Random(7)
    rows, kinds = [], ["pillars", "walls", "ceiling", "floor"]
    for k in range(10_000):
        x, y, z = (rng.uniform(0, 100) for _ in range(3))
        thin = k % 3
        axes = [[v, v + 0.5, v + 1.0] if a != thin else [v, v + 0.1] for a, v in enumerate((x, y, z))]
        rows.append((k, kinds[k % 4], 1, 1, *axes, [0.0, 0.0, 1.0]))
    points = [(k, *(rng.uniform(-5, 105) for _ in range(3))) for k in range(300)] + [(k + 300, *(a[0] for a in rows[k][4:7])) for k in range(50)] + [(999, None, 1.0, 1.0)]
    arena = spark.createDataFrame(rows, surfaces.SURFACE_SCHEMA)
    df = spark.createDataFrame(points, "k int, x double, y double, z double")
    want, label = set(), {}
    for k, *p in points:
        if None in p:
            continue
        for sid, kind, _, _, *axes, _ in rows:
            longer = [[*e, 2 * e[-1] - e[-2]] for e in axes]
            if all(e[0] <= v < e[-1] for v, e in zip(p, longer, strict=True)):
                want.add((k, sid, *(sum(c <= v for c in e[:]) for v, e in zip(p, axes, strict=True))))
                label[k] = min(label.get(k, (9, 0)), (kinds.index(kind), sid))
    out = surfaces.locate(df, arena)
    assert {(r.k, r.surface_id, r.ix, r.iy, r.iz) for r in out.collect()} == want and len(want) > 50
    assert {r.k: (kinds.index(r.kind), r.surface_id) for r in surfaces.label_points(df, arena, ["k"]).collect()} == label
    for plan in (_plan(out), _plan(surfaces.label_points(df, arena, ["k"])), _plan(surfaces.surface_histogram(df, arena))):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distances_along_surfaces(spark):
    """The default arena's bins: shortest ways by Dijkstra from some of them, and farther than straight lines."""
    import heapq
    import math

    arena = surfaces.arena_surfaces(spark, 2.6, 2.6)
    bins = {r.id: r for r in surfaces.surface_bins(arena).select(surfaces.bin_number(F.col("surface_id"), F.col("ix"), F.col("iy"), F.col("iz")).alias("id"), "surface_id", "cx", "cy", "cz").collect()}
    half = {r.surface_id: [(e[-1] - e[0]) / (len(e) - 1) / 2 for e in (r.ex, r.ey, r.ez)] for r in arena.collect()}
    near = {}
    for a in bins.values():
        for b in bins.values():
            gap = [abs(p - q) for p, q in zip((a.cx, a.cy, a.cz), (b.cx, b.cy, b.cz), strict=True)]
            if a.id != b.id and all(g <= p + q + 1e-6 for g, p, q in zip(gap, half[a.surface_id], half[b.surface_id], strict=True)):
                near.setdefault(a.id, []).append((b.id, math.sqrt(sum(g * g for g in gap))))
    assert {(r.i, r.j) for r in surfaces.adjacent_bins(arena).collect()} == {(a, b) for a, own in near.items() for b, _ in own}
    found = {}
    for r in surfaces.surface_distances(arena, 9.0).collect():
        found.setdefault(r.i, {})[r.j] = r.d
    assert len(found) == len(near)
    for start in list(near)[::29]:
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, at = heapq.heappop(heap)
            for b, w in near[at]:
                if d <= best[at] and d + w < best.get(b, 9.0 + 1e-9):
                    best[b] = d + w
                    heapq.heappush(heap, (d + w, b))
        assert found[start].keys() == best.keys() and all(abs(found[start][b] - d) < 1e-9 for b, d in best.items())


def test_band_is_that_of_the_spectrum(spark):
    """One band by blocks against the whole transform, with what is carried along and a series that starts elsewhere."""
    v = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([("a", k + 1000, float(x), -k) for k, x in enumerate(v)] + [("b", 3, 2.0, 7)], "s string, idx long, v double, t int")
    whole = signals.band(signals.spectrum(df.where("s = 'a'"), ["s"], 64.0, "idx"), 5.0, ["s"], "idx")
    want = {r.idx: r.v for r in whole.collect()}
    got = signals.band_signal(df, ["s"], 64.0, 5.0, carried=["t"], block=64).collect()
    assert {r.idx for r in got if r.s == "a"} == want.keys() and max(abs(want[r.idx] - r.v) for r in got if r.s == "a") < 1e-5
    assert all(r.t == 1000 - r.idx for r in got if r.s == "a") and len(got) == 501


def test_windows_are_slices(spark):
    """Blocks with margins give every window, also where numbers are missing or repeated; one shuffle of the samples, no pairs by sample."""
    rng = random.Random(3)
    numbers = {"whole": list(range(200)), "gaps": sorted(rng.sample(range(200), 120)), "twice": sorted([*range(200), 50, 51])}
    df = spark.createDataFrame([(s, i, i * 10) for s, own in numbers.items() for i in own], "s string, idx long, v int")
    ends = spark.createDataFrame([(s, k, k, 35) for s in numbers for k in range(-3, 205, 4)] + [("none", 1, 1, 35), ("whole", 1, None, 35), ("whole", 2, 2, 41)], "s string, trial int, i3 long, trig3 int")
    out = trials.event_windows(df, ends, ["s"], 4, 5, block=16)
    assert _plan(out).count("Exchange") == 2  # the samples' and the events'
    want = sorted((s, k, i, i - k, i * 10) for s, own in numbers.items() for k in range(-3, 205, 4) for i in own if k - 4 <= i < k + 5)
    assert sorted((r.s, r.trial, r.idx, r.offset, r.v) for r in out.collect()) == want
    waves = trials.event_waves(df, ends, ["s"], 4, 5, block=16).where("s = 'whole'").collect()
    assert {r.trial: r.wave for r in waves} == {k: [10.0 * i for i in range(k - 4, k + 5)] for k in range(-3, 205, 4) if k >= 4 and k + 5 <= 200}


def test_streams_of_a_trial(spark):
    """Each stream is cut on its own numbering and margin, and zeroed at its own first row."""
    fast = spark.createDataFrame([(1, k, 1000 + 2 * k, k) for k in range(100)], "s int, idx long, t long, v int")
    slow = spark.createDataFrame([(1, k, 50 * k, k) for k in range(10)], "s int, idx long, t long, x int")
    cut = trials.cut_streams(["s"], {
        "fast": trials.Stream(fast, spark.createDataFrame([(1, 1, 10, 20), (1, 2, 95, 99), (1, 3, 200, 300)], "s int, trial int, i1 long, i3 long"), margin=3),
        "slow": trials.Stream(slow, spark.createDataFrame([(1, 1, 0, 2)], "s int, trial int, i1 long, i3 long"), margin=1),
    })
    assert sorted((r.trial, r.idx, r.t) for r in cut["fast"].collect()) == [(1, k, 2 * (k - 10)) for k in range(7, 24)] + [(2, k, 2 * (k - 95)) for k in range(92, 100)]
    assert sorted((r.trial, r.idx, r.t) for r in cut["slow"].collect()) == [(1, k, 50 * k) for k in range(4)]


def test_wide_features(spark):
    """4,000 values a row, more than one pass: equal to numpy, by group, with nothing joined."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 20)) @ np.diag(np.linspace(9, 1, 20)) @ rng.normal(size=(20, 4000)) + rng.normal(size=(90, 4000)) + rng.normal(size=4000)
    df = spark.createDataFrame([(k, k % 2, w.tolist()) for k, w in enumerate(x)] + [(99, 0, None)], "id int, channel int, wave array<double>").repartition(3).cache()

    def told(found):
        return np.abs(np.array([r.features for r in sorted(found.collect(), key=lambda r: r.id)]))

    c = x - x.mean(0)
    found = units.pca_features(df, "id")
    assert np.allclose(told(found), np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][:3].T), rtol=0, atol=1e-6)
    assert np.allclose(told(units.svd_features(df, "id")), np.abs(np.linalg.svd(x, full_matrices=False)[0][:, :3]), rtol=0, atol=1e-6)
    assert "Join" not in _plan(found) and "Exchange" not in _plan(found).replace("Exchange RoundRobin", "").split("InMemory")[0]
    each = units.features_by_channel(df, "id", method="svd")
    for channel in (0, 1):
        own = x[channel::2]
        assert np.allclose(told(each.where(f"channel = {channel}")), np.abs(np.linalg.svd(own, full_matrices=False)[0][:, :3]), rtol=0, atol=1e-6)


def test_products_grow_by_level(spark, tmp_path):
    """Only levels that are not done are made; products of products; a broken run is made again; redo makes all."""
    root, made = str(tmp_path), []

    def sums(own):
        made.append(sorted(r.session for r in own.select("session").distinct().collect()))
        return own.groupBy("session").agg(F.sum("v").alias("v"))

    total = levels.Product("sums", ("rows",), sums)
    twice = levels.Product("twice", (total, "rows"), lambda s, rows: s.join(rows.select("session").distinct(), "session").withColumn("v", F.col("v") * 2))

    def add(rows):
        io.write_levels(spark.createDataFrame(rows, "session int, v long"), f"{root}/rows", mode="append")

    add([(1, 5), (1, 6), (2, 7)])
    assert {r.session: r.v for r in levels.produce(spark, root, total).collect()} == {1: 11, 2: 7} and made == [[1, 2]]
    assert levels.produce(spark, root, total).count() == 2 and made == [[1, 2]]
    add([(3, 1)])
    assert [tuple(r) for r in levels.produce(spark, root, twice, session=3).select("session", "v").collect()] == [(3, 2)] and made[1:] == [[3]]
    assert {r.session: r.v for r in levels.produce(spark, root, twice).collect()} == {1: 22, 2: 14, 3: 2} and made[1:] == [[3]]
    # a level that was written but not noted as done is written again, not added to
    spark.createDataFrame([(9, 9)], "session int, v long").write.mode("overwrite").parquet(f"{root}/sums.done")
    assert {r.session: r.v for r in levels.produce(spark, root, total).collect()} == {1: 11, 2: 7, 3: 1}
    add([(1, 100)])
    assert {r.session: r.v for r in levels.produce(spark, root, total, redo=True).collect()} == {1: 111, 2: 7, 3: 1}
    assert levels.merged(levels.produce(spark, root, total), [], ["v"]).first().v == 119


def test_markers_of_other_numbers_fail(spark):
    """Starts, cues and ends that differ in number are an error, unless told otherwise."""
    df = _markers(spark, [11, 21, 31, 12, 22])
    with pytest.raises(Exception, match="differ in number"):
        trials.pair_markers(df, ["session"]).collect()
    assert trials.pair_markers(df, ["session"], check=False).count() == 2
    assert trials.pair_markers(_markers(spark, [11, 21, 31, 12, 22, 42]), ["session"], bucket=2).count() == 2


def test_posters_bins_and_cones(spark):
    mazes = spark.createDataFrame([("Maze one CAT",), ("two dog ",), ("bird",), (None,)], "maze string")
    images = spark.createDataFrame([("z/cat.png",), ("a/Cat2.png",), ("hotdog.png",)], "image string")
    assert {r.maze: r.image for r in io.poster_image(mazes, images).collect()} == {"Maze one CAT": "a/Cat2.png", "two dog ": "hotdog.png", "bird": None, None: None}
    assert bins.uniform_edges(0.0, 1.0, 5) == [0.0, 0.25, 0.5, 0.75, 1.0]
    arena = surfaces.arena_surfaces(spark)
    own = {r.kind: r.bins for r in surfaces.bins_by_kind(arena).collect()}
    normals = {r.kind: [list(s.normal) for s in r.normals] for r in surfaces.normals_by_kind(arena).collect()}
    assert {k: len(v) for k, v in own.items()} == {"pillars": 16, "walls": 4, "floor": 9, "ceiling": 1} == {k: len(v) for k, v in normals.items()}
    assert normals["ceiling"] == [[0.0, 0.0, -1.0]] and normals["walls"][0] == [0.0, 1.0, 0.0]
    cone = gaze.view_cone(spark.createDataFrame([(0.0, -10.0, 0.0)], "px double, py double, dir double")).first()
    assert cone.left_x < 0 < cone.right_x and abs(cone.left_x + cone.right_x) < 0.02


def test_traced_gaze_by_trial(spark):
    traced = spark.createDataFrame([(1, 100.0 + 10 * k, None if k == 3 else float(k)) for k in range(12)], "s int, t double, gx double").withColumns({"gy": F.col("gx"), "gz": F.col("gx")})
    found = spark.createDataFrame([(1, 1, 5000.0, 5030.0), (1, 2, 5055.0, 5100.0)], "s int, trial int, t1 double, t3 double")
    out = sorted((r.trial, round(r.t, 3), r.gx) for r in io.gaze_by_trial(traced, found, ["s"]).collect())
    assert out == [(1, 0.0, 0.0), (1, 0.01, 1.0), (1, 0.02, 2.0), (1, 0.03, None), (2, 0.0, 6.0), (2, 0.01, 7.0), (2, 0.02, 8.0), (2, 0.03, 9.0), (2, 0.04, 10.0)]

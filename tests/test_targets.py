"""Target formulas against direct numpy versions of their definitions, short tracks and failures included."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import targets as T
from strata.plans.session import ship


def _frames(spark, tracks):
    return spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track_id string, frame int, x double")


def _chroma(spark, tracks):
    rows = [(t, i, pc, float(v)) for t, c in tracks.items() for i, col in enumerate(c.T) for pc, v in enumerate(col)]
    return spark.createDataFrame(rows, "track_id string, frame int, pc int, energy double")


def _series(df, key="x"):
    out = {}
    for r in df.orderBy("frame").collect():
        out.setdefault(r.track_id, []).append(r[key])
    return out


def _pool(x, n):
    if len(x) <= n:
        return np.concatenate([x, np.zeros(n - len(x))])
    at = np.minimum(np.arange(len(x)) * n // len(x), n - 1)
    return np.bincount(at, weights=x, minlength=n) / np.bincount(at, minlength=n)


def _pool_equal(x, n):
    if len(x) < n:
        return np.concatenate([x, np.zeros(n - len(x))])
    w = len(x) // n
    return x[: w * n].reshape(n, w).mean(axis=1)


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(8)


def test_equal_buckets_of_short_tracks(spark, rng):
    tracks = {"long": rng.random(47), "even": rng.random(10), "short": rng.random(4), "one": rng.random(1)}
    found = _series(T.bucket_mean_equal(_frames(spark, tracks), 10))
    assert found == {t: pytest.approx(_pool_equal(x, 10).tolist()) for t, x in tracks.items()}
    arcs = {r.track_id: r.curve for r in T.dynamic_arc(_frames(spark, tracks), 10).collect()}
    assert set(arcs) == set(tracks) and all(len(c) == 10 and min(c) >= 0 and max(c) <= 1 for c in arcs.values())


def test_centroid_curve_pools_hertz(spark, rng):
    tracks = {"a": rng.uniform(50, 8000, 130), "b": rng.uniform(50, 8000, 7), "flat": np.full(60, 440.0), "two": np.array([100.0, 4000.0] * 60)}
    found = {r.track_id: r.curve for r in T.centroid_curve(_frames(spark, tracks)).collect()}
    for t, x in tracks.items():
        level = np.log2(_pool(x, 60) + 1)
        want = np.zeros(60) if level.std() < 1e-6 else (level - level.mean()) / (level.std() + 1e-6)
        assert found[t] == pytest.approx(want.tolist(), abs=1e-9)


def test_tension_pools_before_it_projects(spark, rng):
    tracks = {"a": rng.random((12, 100)), "short": rng.random((12, 5)), "silent": np.zeros((12, 20)), "peaky": rng.random((12, 64)) ** 8}
    found = _series(T.tension_curve(_chroma(spark, tracks), 16))
    for t, c in tracks.items():
        pooled = np.stack([_pool(row, 16) for row in c])
        total = pooled.sum(axis=0)
        size = np.abs(np.fft.fft(pooled / np.where(total > 0, total, 1), axis=0)[1:7]) * np.array(T.TENSION_RADII)[:, None]
        x = np.linalg.norm(size, axis=0)
        want = (x - x.min()) / (x.max() - x.min()) if x.max() - x.min() > 1e-9 else np.zeros(16)
        assert found[t] == pytest.approx(want.tolist(), abs=1e-9)


def _novelty(c, radius):
    n = c.shape[1]
    out = np.zeros(n)
    unit = c / np.maximum(np.linalg.norm(c, axis=0), 1e-12)
    sim = unit.T @ unit
    axis = np.array([d for d in range(-radius, radius + 1) if d], dtype=float)
    kernel = np.exp(-(axis[:, None] ** 2 + axis[None] ** 2) / radius**2) * np.sign(axis)[:, None] * np.sign(axis)[None]
    for k in range(n - 2 * radius + 1):
        out[k + radius] = (kernel * sim[k : k + 2 * radius, k : k + 2 * radius]).sum()
    return out


def test_novelty_has_the_wide_taper(spark, rng):
    change = np.concatenate([np.outer(np.eye(12)[0], np.ones(20)), np.outer(np.eye(12)[5], np.ones(21))], axis=1) + 0.01 * rng.random((12, 41))
    tracks = {"noise": rng.standard_normal((12, 50)), "change": change, "short": rng.random((12, 9))}
    for radius in (3, 8):
        found = _series(T.novelty(_chroma(spark, tracks), radius))
        for t, c in tracks.items():
            assert found[t] == pytest.approx(_novelty(c, radius).tolist(), abs=1e-9)
    other = {t: rng.random((12, c.shape[1] - 2)) for t, c in tracks.items()}
    curve = _series(T.novelty_curve(_chroma(spark, tracks), _chroma(spark, other), 10))
    for t, c in tracks.items():
        a, b = _novelty(c[:, :-2], 8), _novelty(other[t], 8)
        peak = lambda x: x / x.max() if x.max() > 0 else 0 * x
        assert curve[t] == pytest.approx(_pool_equal((peak(a) + peak(b)) / 2, 10).tolist(), abs=1e-9)


def test_performance_tempo_looks_around_frame_centres(spark, rng):
    onsets = {f"t{k}": np.sort(rng.uniform(0, 30, n)) for k, n in enumerate((70, 25, 4, 3))}
    notes = spark.createDataFrame([(t, i, float(o), float(o) + 0.1, 64) for t, x in onsets.items() for i, o in enumerate(x)], "track_id string, seq long, onset double, offset double, velocity int")
    found = _series(T.performance_tempo(notes))
    assert set(found) == {"t0", "t1", "t2"}
    for t, x in list(onsets.items())[:3]:
        want, last = [], 1.0
        for i in range(60):
            c = (i + 0.5) / 2
            w = x[(x >= c - 1) & (x <= c + 1)]
            if len(w) >= 3 and np.median(np.diff(w)) > 0:
                last = float(np.log2(np.clip(60 / np.median(np.diff(w)), 40, 240) / 60))
            want.append(last)
        assert found[t] == pytest.approx(want, abs=1e-9)


def test_pedal_is_sampled_at_centres(spark, rng):
    events = [("a", 0, i, float(t), 64, int(v)) for i, (t, v) in enumerate(zip(np.sort(rng.uniform(0, 30, 40)), rng.integers(0, 128, 40)))]
    events += [("a", 1, 100 + i, t, 64, v) for i, (t, v) in enumerate([(10.005, 100), (10.5, 0)])]
    controls = spark.createDataFrame(events, "track_id string, instrument int, event_id long, t double, cc int, value int")
    tracks = spark.createDataFrame([("a", 26.3)], "track_id string, duration double")
    found = _series(T.pedal_curve(controls, tracks))["a"]
    times = (np.arange(60 * 50) + 0.5) * 0.01
    on = np.zeros(len(times), bool)
    for k in (0, 1):
        own = [(t, v) for _, i, _, t, _, v in events if i == k]
        at = np.searchsorted([t for t, _ in own], times, side="right") - 1
        on |= (at >= 0) & np.array([own[max(i, 0)][1] >= 64 for i in at])
    on[times >= 26.3] = False
    assert found == pytest.approx(on.reshape(60, 50).mean(axis=1).tolist(), abs=1e-9)


def _runs(x):
    out = []
    for up in (True, False):
        steps, best, start, length = np.diff(x), (0, 0), 0, 0
        for i, d in enumerate(steps):
            if (d > 0) if up else (d < 0):
                start, length = (i, 1) if not length else (start, length + 1)
                if length > best[0]:
                    best = (length, start)
            else:
                length = 0
        out.append(abs(x[best[1] + best[0]] - x[best[1]]) * best[0])
    return out


def test_monotonic_runs_count_steps(spark, rng):
    tracks = {"up": np.arange(4.0), "ties": np.array([0, 1, 2, 2, 3, 4, 1, 0.0]), "one": np.array([5.0]), "flat": np.ones(6), **{f"r{k}": rng.integers(0, 6, 40).astype(float) for k in range(8)}}
    found = {r.track_id: (r.rise, r.fall) for r in T.monotonic_runs(_frames(spark, tracks)).collect()}
    assert found["up"] == (9.0, 0.0)
    assert found == {t: pytest.approx(tuple(_runs(x))) for t, x in tracks.items()}


def test_harmony_fields(spark, rng):
    tracks = {"a": rng.random((12, 30)), "one": rng.random((12, 1))}
    c = _chroma(spark, tracks)
    assert _series(T.harmonic_change(c)) == {"a": pytest.approx(np.abs(np.diff(tracks["a"], axis=1)).mean(axis=0).tolist())}
    stable = {(r.track_id, r.pc): r.x for r in T.tonal_stability(c).collect()}
    assert stable == {(t, pc): pytest.approx(1 / (1 + x[pc].var())) for t, x in tracks.items() for pc in range(12)}
    for r in T.harmonic_complexity(c).collect():
        p = tracks[r.track_id].mean(axis=1)
        p = p / (p.sum() + 1e-8)
        assert r.x == pytest.approx(-(p * np.log(p + 1e-8)).sum())


def test_attacks_step_forward_and_fit_inside(spark, rng):
    x = {"a": np.abs(rng.standard_normal(40)), "quiet": np.concatenate([[1.0], np.full(30, 1e-7)]), "none": rng.random(10)}
    onsets = {"a": [0, 5, 33, 34, 35, 39], "quiet": [0, 3, 30]}
    asked = spark.createDataFrame([(t, o) for t, os in onsets.items() for o in os], "track_id string, onset int")
    found = {r.track_id: (r.attack_slopes, r.attack_sharpness) for r in T.attack_fields(_frames(spark, x), asked, 6).collect()}
    assert found["none"] == ([0.0], [0.0])
    for t, os in onsets.items():
        power = np.maximum(x[t] ** 2, 1e-10)
        db = 10 * np.log10(power / power.max())
        db = np.maximum(db, db.max() - 80)
        slopes = [max(0.0, np.polyfit(range(6), db[o : o + 6], 1)[0]) for o in os if o + 6 <= len(db)]
        sharp = [abs(db[o + 1] - db[o]) for o in os if o < len(db) - 1]
        assert found[t][0] == pytest.approx(slopes, abs=1e-9) and found[t][1] == pytest.approx(sharp, abs=1e-9)


def test_a_bad_track_in_the_middle_is_one_error_row(spark, rng):
    ship(spark)
    frames = _frames(spark, {f"t{k}": rng.random(20) for k in range(9)}).withColumn("x", F.when((F.col("track_id") == "t4") & (F.col("frame") == 10), None).otherwise(F.col("x")))

    def strict(pdf):
        if pdf.x.isna().any():
            raise ValueError("a frame is missing")
        return {"mean": pdf.x.mean(), "curve": pdf.x.to_numpy()}

    out = T.targets_of_tracks(frames, {"size": lambda pdf: {"frames": len(pdf)}, "level": strict, "text": lambda pdf: {"name": "no number"}}).collect()
    bad = [r for r in out if r.error]
    assert len(out) == 9 + 2 * 8 + 1 + 9 and [(r.track_id, r.error) for r in bad if r.category == "level"] == [("t4", "ValueError: a frame is missing")]
    assert {r.track_id for r in bad if r.category == "text"} == {f"t{k}" for k in range(9)} and {r.track_id for r in out if r.field == "frames"} == {f"t{k}" for k in range(9)}


def test_spaced_peaks_of_a_long_track(spark, rng):
    ship(spark)
    n = 400_000
    x = np.round(rng.random(n) * 100)
    x[1::2] = -1  # 200 000 peaks of few different heights
    rows = spark.range(n).select(F.lit("a").alias("track_id"), F.col("id").cast("int").alias("frame"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("h"))
    rows = rows.select("track_id", "frame", F.when(F.col("frame") % 2 == 1, -1.0).otherwise(F.col("h")).alias("x"))
    got = sorted((r.frame, r.x) for r in T.onset_peaks(rows, 7).collect())
    assert len(got) > n / 20 and min(b[0] - a[0] for a, b in zip(got, got[1:])) >= 7
    small = _frames(spark, {"s": x[:300] + 0.5, "t": np.sin(np.arange(200) / 3) + 1})
    top = {(r.track_id, r.frame): r.x for r in T.onset_peaks(small).collect()}
    kept = []
    for (t, f), v in sorted(top.items(), key=lambda e: (e[0][0], -e[1], e[0][1])):
        if all(t != u or abs(f - g) >= 7 for u, g in kept):
            kept.append((t, f))
    assert {(r.track_id, r.frame) for r in T.onset_peaks(small, 7).collect()} == set(kept)


def test_pedal_state_is_found_without_a_join(spark, rng):
    """A grid has hundreds of rows a track, which Spark takes for as many as tracks and broadcast from the driver's memory."""
    rows = [(int(rng.integers(3)), int(rng.integers(2)), i, float(rng.integers(40)) / 4, 64, int(rng.choice([0, 63, 64, 127]))) for i in range(120)]
    rows += [(None, 0, 998, 1.0, 64, 127), (0, 0, 999, None, 64, 127)]
    controls = spark.createDataFrame(rows, "track_id int, instrument int, event_id long, t double, cc int, value int")
    grid = spark.range(200).selectExpr("cast(id div 50 as int) as track_id", "(id % 50) * 0.25d as t")
    found = T.pedal_state(controls, grid)
    for df in (found, T.pedal_curve(controls, spark.createDataFrame([(0, 9.0), (3, 5.0)], "track_id int, duration double"))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.track_id, r.t): r.on for r in found.collect()}
    for track in range(4):
        for k in range(50):
            last = [max(((t, i, v) for a, b, i, t, _, v in rows if a == track and b == own and t is not None and t <= k / 4), default=(0, 0, 0)) for own in (0, 1)]
            assert got[track, k / 4] == int(any(v >= 64 for _, _, v in last))
    assert len(got) == 200


def test_pedal_curve_counts_the_points_of_the_grid_without_making_them(spark, rng):
    """Events at, just before and just after points, before the grid and past it, at one time, without a track; ends in all places."""
    centres = (np.arange(3000) + 0.5) * 0.01
    at = [float(v) for c in rng.choice(centres, 60) for v in (c, np.nextafter(c, 0), np.nextafter(c, 99))] + [-3.0, 0.0, 0.005, 29.995, 30.0, 44.0, float("nan")] + [7.5] * 6
    rows = [(int(rng.integers(5)), int(rng.integers(2)), i, t, 64, int(rng.choice([0, 63, 64, 127]))) for i, t in enumerate(at * 4)]
    controls = spark.createDataFrame(rows, "track_id int, instrument int, event_id long, t double, cc int, value int")
    ends = {0: 26.305, 1: float("inf"), 2: 0.005, 3: None, 7: float("nan")}  # track 4 has events only, 7 has none
    curve = T.pedal_curve(controls, spark.createDataFrame(list(ends.items()), "track_id int, duration double"))
    assert "Join" not in curve._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.track_id, r.frame): r.x for r in curve.collect()}
    assert got.keys() == {(t, f) for t in ends for f in range(60)}
    for track, end in ends.items():
        on = np.zeros(3000, bool)
        for k in (0, 1):
            own = sorted((t, i, v) for a, b, i, t, _, v in rows if (a, b) == (track, k) and t == t)
            place = np.searchsorted([t for t, _, _ in own], centres, side="right") - 1
            on |= np.array([p >= 0 and own[p][2] >= 64 for p in place])
        on &= np.array([end is not None and (end != end or c < end) for c in centres])
        assert [got[track, f] for f in range(60)] == (on.reshape(60, 50).sum(axis=1) / 50).tolist()
    held = spark.createDataFrame([(0, 0, 0, 5.1, 64, 127), (0, 0, 1, 15.3, 64, 0)], controls.schema)
    fine = T.pedal_curve(held, spark.createDataFrame([(0, 30.0)], "track_id int, duration double"), sub=10**7)  # 6e8 points
    assert _series(fine)[0] == pytest.approx([0] * 10 + [0.8] + [1] * 19 + [0.6] + [0] * 29, abs=1e-6)


def test_pedal_query_samples_every_ten_milliseconds(spark, sf):
    """Half a second is 50 points, not five; held against the events of each track."""
    from strata.operators import target_queries as Q
    from strata.plans import views

    ship(spark)
    events, ends = {}, {}
    for r in views.controls(spark, sf).orderBy("t", "event_id").collect():
        events.setdefault(r.track_id, []).append((r.t, r.value))
    for r in views.notes(spark, sf).selectExpr("track_id", "onset + dur as z").collect():
        ends[r.track_id] = max(ends.get(r.track_id, 0.0), r.z)
    got = _series(Q.t15(spark, sf))
    assert got.keys() == ends.keys()
    centres = (np.arange(3000) + 0.5) * (0.5 / 50)
    for track, end in ends.items():
        own = events.get(track, [])
        place = np.searchsorted([t for t, _ in own], centres, side="right") - 1
        on = np.array([p >= 0 and own[p][1] >= 64 for p in place]) & (centres < end)
        assert got[track] == pytest.approx(on.reshape(60, 50).mean(axis=1).tolist(), abs=1e-9)


def test_autocorrelation_of_long_tracks_gaps_and_nulls_sends_a_frame_twice_at_most(spark, rng):
    ship(spark)
    tracks = {"long": rng.normal(size=2300), "short": rng.normal(size=5), "gap": rng.normal(size=40)}
    rows = [(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x) if not (t == "gap" and 3 <= i < 30)]
    rows += [("null", 0, 1.0), ("null", 1, None), ("bad", 0, float("nan")), ("bad", 1, 2.0), ("bad", 2, 3.0)]
    frames = spark.createDataFrame(rows, "track_id string, frame int, x double")
    found = T.autocorrelation(frames, 50)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.track_id, r.lag): r.r for r in found.collect()}
    want: dict = {}
    at = {(t, i): v for t, i, v in rows}
    for (t, i), v in at.items():
        for lag in range(50):
            if (t, i + lag) in at:
                own = want.setdefault((t, lag), [])
                own += [v * at[t, i + lag]] if v is not None and at[t, i + lag] is not None else []
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(sum(v), abs=1e-9, nan_ok=True) if v else got[k] is None

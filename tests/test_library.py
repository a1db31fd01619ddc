"""Closed forms, contracts and round trips of the library's operators."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions import registry
from strata.functions import vectors as V
from strata.operators import clips as C
from strata.operators import index as X
from strata.operators import probing as R
from strata.operators import search as S
from strata.operators import targets as T
from strata.sources import artifacts as A
from strata.sources import feature_store, files, tables
from strata.streaming.incremental import ingest_new_files

#: Four-dimensional vectors; a is nearest to b, then c, then d.
TINY = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0, 0.0]), (2, [0.5, 0.5, 0.0, 0.0]), (3, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0, 0.0])]


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame(TINY, "id long, vec array<double>")


def test_ranking_order_bounds_and_ties(tiny):
    rows = S.find_similar(tiny, 0, k=10).collect()
    assert [r.id for r in rows] == [1, 2, 3, 4]
    assert all(-1 <= r.similarity <= 1 + 1e-9 for r in rows)
    assert rows[-1].similarity == 0.0


def test_search_errors(tiny):
    with pytest.raises(KeyError):
        S.find_similar(tiny, 99)
    with pytest.raises(ValueError):
        S.similar_to(tiny, [1.0, 0, 0, 0], k=0)


def test_batch_search_equals_single_over_partitions(tiny):
    for n in (1, 3):
        got = {r.id: r.rank for r in S.similar_to_all(tiny.repartition(n), tiny.where("id = 0"), k=4).collect()}
        assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_batch_search_over_blocks(spark, sf):
    from strata.plans import views

    v = views.vectors(spark, sf)
    x = {r.id: np.array(r.vec, dtype=float) for r in v.collect()}
    ids = sorted(x)
    m = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
    scores = np.round(m @ m.T, 9)
    for sizes in ((7, 100), (2048, 65536)):
        got = {}
        for r in S.similar_to_all(v, v.where("id % 50 = 0"), 4, query_block=sizes[0], corpus_block=sizes[1]).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: [ids[j] for j in np.lexsort((ids, -scores[ids.index(q)])) if ids[j] != q][:4] for q in ids if q % 50 == 0}
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, vec array<double>")
    assert [r.id for r in S.similar_to_all(ties, ties.where("id = 5"), 3, corpus_block=4).orderBy("rank").collect()] == [0, 1, 2]
    assert S.similar_to_all(ties.limit(0), ties, 3).count() == 0 and S.similar_to_all(ties, ties.limit(0), 3).count() == 0


def test_clip_queries(spark):
    rows = [(f"c{i}", "t" if i < 4 else "u", 2.5 * (i % 4), [1.0, i / 10], i % 2) for i in range(8)]
    index = spark.createDataFrame(rows, "clip_id string, track_id string, start_sec double, vec array<double>, list_id int")
    by_id = [r.clip_id for r in S.search_by_clip(index, "c1", k=3, dedupe_window=0).collect()]
    near = sorted((abs(math.atan(i / 10) - math.atan(0.1)), f"c{i}") for i in range(8) if i != 1)
    assert by_id == [c for _, c in near[:3]]
    assert [r.clip_id for r in S.search_by_clip(index, track_id="t", start_sec=2.9, k=3, dedupe_window=0).collect()] == by_id
    assert S.query_clip(index, track_id="t", start_sec=1.25) == "c0"
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.3])], "list_id int, centre array<double>")
    assert {r.clip_id for r in S.search_by_clip(index, "c4", 10, 0, centres=centres, nprobe=2).collect()} == {f"c{i}" for i in range(8)} - {"c4"}
    assert S.search_by_clip(index, "c4", 10, 0, centres=centres, nprobe=1).count() < 7
    assert S.search_by_clip(index, "c1", 10, 0, fetch=2).count() <= 2
    for wrong in ({"clip_id": "c1", "track_id": "t"}, {"track_id": "t"}, {"track_id": "t", "start_sec": -1.0}, {"clip_id": "c1", "nprobe": 2}):
        with pytest.raises(ValueError):
            S.search_by_clip(index, **wrong)
    with pytest.raises(KeyError):
        S.search_by_clip(index, track_id="none", start_sec=0.0)


def test_dedupe_walks_down_the_ranking(spark):
    hits = [("t", "c0", 0.0, 0.9), ("t", "c1", 2.5, 0.8), ("t", "c2", 5.0, 0.7), ("u", "c3", 2.5, 0.6), ("t", "c4", 7.5, 0.5), ("t", "c5", 10.0, 0.4)]
    df = spark.createDataFrame(hits, "track_id string, clip_id string, start_sec double, similarity double")
    kept = {r.clip_id for r in S.dedupe_in_time(df, 5.0).collect()}
    assert kept == {"c0", "c2", "c3", "c5"}
    assert S.dedupe_in_time(df, 0).count() == 6


def test_weights(spark):
    assert S.parse_weights("a=0.7, b=0.3,a=0.1") == {"a": pytest.approx(0.8), "b": 0.3}
    for bad in ("a", "a=-1", "a=0", "", "a=x"):
        with pytest.raises(ValueError):
            S.parse_weights(bad)


def test_fuse_needs_positive_weights():
    with pytest.raises(ValueError):
        V.fuse(None, [0.0, 0.0])


def test_clip_contracts(spark, tmp_path):
    seg = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "track_id string, segment_idx int")
    clips = C.build_clips(seg, "smd")
    rows = {r.clip_id: (r.start_sec, r.end_sec, r.recording_id, r.work_id) for r in clips.collect()}
    assert rows["smd:a:00001"] == (2.5, 7.5, "a", "")
    path = str(tmp_path / "clips.csv")
    tables.write_clip_index(clips, path)
    back = tables.read_clip_index(spark, path)
    assert [r.clip_id for r in back.collect()] == sorted(rows)
    with pytest.raises(ValueError):
        tables.read_clip_index(spark, str(tmp_path / "clips.txt"))
    with pytest.raises(ValueError):
        C.require_unique(clips.union(clips), "clip_id")
    assert C.filter_clips(clips, track_id=set()).count() == 0
    assert C.filter_clips(clips, track_id=None).count() == 3
    with pytest.raises(ValueError):
        C.hop_seconds(5.0, 1.0)


def test_split_keeps_recordings_together(spark):
    seg = spark.range(200).select(F.format_string("t%03d", "id").alias("track_id"), F.lit(0).alias("segment_idx"))
    meta = seg.select("track_id", F.format_string("r%02d", F.crc32(F.col("track_id").cast("binary")) % 20).alias("recording_id"), F.lit("w").alias("work_id"))
    out = C.split_by_recording(C.build_clips(seg, "d", metadata=meta))
    assert out.groupBy("recording_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    n = out.select("recording_id", "split").distinct().groupBy("split").count().collect()
    total = sum(r["count"] for r in n)
    assert {r.split: r["count"] for r in n}["train"] == int(total * 0.8)


def test_metadata_contract(spark):
    rows = spark.createDataFrame([("t1", " r1 ", "w1", None)], "track_id string, recording_id string, work_id string, composer string")
    assert tables.normalise_metadata(rows).first().recording_id == "r1"
    with pytest.raises(ValueError):
        tables.normalise_metadata(rows.withColumn("work_id", F.lit(" ")))
    with pytest.raises(ValueError):
        tables.normalise_metadata(rows.drop("work_id"))


def _ridge(x, y, folds, alpha=1.0):
    out = np.zeros(len(y))
    for f in np.unique(folds):
        a, b = folds != f, folds == f
        m, s = x[a].mean(0), x[a].std(0)
        s[s < 1e-12] = 1
        z = (x[a] - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y[a] - y[a].mean()))
        out[b] = (x[b] - m) / s @ w + y[a].mean()
    return 1 - ((y - out) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.fixture(scope="module")
def probe_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3, 4))
    y = x[:, 1] @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.05 * rng.standard_normal(60)
    feats = spark.createDataFrame([(i, k, x[i, k].tolist()) for i in range(60) for k in range(3)], "id long, layer int, vec array<double>")
    ys = spark.createDataFrame([(i, t, v) for i in range(60) for t, v in (("lin", float(y[i])), ("noise", float(rng.standard_normal())), ("half", float(y[i]) if i % 2 else None))], "id long, target string, y double")
    return x, y, feats, ys


def test_ridge_equals_numpy(spark, probe_tables):
    x, y, feats, ys = probe_tables
    folds = R.kfold(feats.select("id"))
    f = {r.id: r.fold for r in folds.collect()}
    fold = np.array([f[i] for i in range(60)])
    got = {(r.layer, r.target): r for r in R.probe_layers(feats, ys, folds).collect()}
    for layer in range(3):
        assert got[layer, "lin"].r2_score == pytest.approx(_ridge(x[:, layer], y, fold), abs=1e-9)
    assert got[1, "lin"].r2_score > 0.95 and got[1, "noise"].r2_score < 0.5 and got[1, "half"].n_valid == 30


def test_mixes_and_aspects(spark, probe_tables):
    _, _, feats, ys = probe_tables
    results = R.discover(feats, ys, 3).cache()
    assert {r.target: r.layer for r in R.best_layers(results).collect()}["lin"] == 1
    mix = results.where("mode = 'weighted_sum' and target = 'lin'").first()
    assert int(np.argmax(mix.layer_weights)) == 1 and sum(mix.layer_weights) == pytest.approx(1)
    aspects = spark.createDataFrame([("clear", "lin", 0), ("dull", "noise", 0)], "aspect string, target string, ord int")
    found = R.resolve_aspects(results, aspects).collect()
    assert [r.aspect for r in found] == ["clear"]
    assert R.resolve_aspects(results, aspects, mode="weighted_sum").first().layer is None
    with pytest.raises(ValueError):
        R.resolve_aspects(results, aspects, mode="other")


def test_curve_probe(spark, probe_tables):
    x, y, feats, _ = probe_tables
    rows = [(i, "c", [float(y[i]), float(-y[i]), float(2 * y[i])]) for i in range(60)]
    out = R.probe_curves(feats, spark.createDataFrame(rows, "id long, target string, curve array<double>"), R.kfold(feats.select("id")))
    best = {r.layer: r for r in out.collect()}
    assert best[1].r2_mean > 0.95 and best[1].r2_pc1 > 0.95 and best[0].r2_mean < 0.5


def test_probes_of_all_targets_equal_numpy(spark, sf):
    """Every layer, target, fold and mix of the given tables, with missing targets, against direct solutions."""
    from strata.plans import views

    feats, ys = views.layer_vectors(spark, sf), views.targets(spark, sf)
    folds = R.kfold(views.vectors(spark, sf))
    x = {}
    for r in feats.collect():
        x.setdefault(r.id, {})[r.layer] = np.array(r.vec, dtype=float)
    fold = {r.id: r.fold for r in folds.collect()}
    y = {}
    for r in ys.where("y is not null").collect():
        y.setdefault(r.target, {})[r.id] = r.y
    single = {}
    layers = R.probe_layers(feats, ys, folds).cache()
    for r in layers.collect():
        ids = sorted(y[r.target])
        own = np.array([fold[i] for i in ids])
        single[r.target, r.layer] = _ridge(np.array([x[i][r.layer] for i in ids]), np.array([y[r.target][i] for i in ids]), own)
        assert r.r2_score == pytest.approx(single[r.target, r.layer], abs=1e-8) and r.n_valid == len(ids)
    for r in R.probe_mixes(feats, ys, folds, layers, 4).collect():
        ids = sorted(y[r.target])
        r2 = [single[r.target, k] for k in range(4)]
        bases = [np.zeros(4), np.maximum(r2, 0), (np.arange(4) == int(np.argmax(r2))).astype(float)]
        scores = []
        for base in bases:
            for tau in R.TAUS:
                w = np.exp((base - base.max()) / tau)
                w /= w.sum()
                scores.append(_ridge(np.array([sum(w[k] * x[i][k] for k in range(4)) for i in ids]), np.array([y[r.target][i] for i in ids]), np.array([fold[i] for i in ids])))
        assert r.r2_score == pytest.approx(max(scores), abs=1e-8) and r.r2_gain == pytest.approx(max(scores) - max(r2), abs=1e-8)


def test_curves_in_discovery(spark, probe_tables, tmp_path):
    x, y, feats, ys = probe_tables
    rows = [(i, "c", [float(y[i]), float(-y[i]), float(2 * y[i])] if i % 10 else None) for i in range(60)]
    curves = spark.createDataFrame(rows, "id long, target string, curve array<double>")
    out = R.discover_and_save(feats, ys, 3, str(tmp_path / "results"), curves=curves)
    found = {(r["mode"], r.layer, r.target): r for r in out.collect()}
    assert found["best_layer", 1, "c"].r2_mean > 0.95 and found["best_layer", 1, "c"].n_valid == 54 and found["best_layer", 1, "c"].coverage == pytest.approx(0.9)
    assert int(np.argmax(found["weighted_sum", None, "c"].layer_weights)) == 1 and found["best_layer", 1, "lin"].r2_mean is None
    aspects = spark.createDataFrame([("shape", "c", 0)], "aspect string, target string, ord int")
    assert R.resolve_aspects(out, aspects).first().aspect == "shape" and R.resolve_aspects(out, aspects, curves=False).count() == 0
    assert R.discover(feats, ys, 3, n_samples=30, mixes=False).agg(F.max("n_valid")).first()[0] == 30
    assert R.discover(feats.limit(0), ys, 3, mixes=False).count() == 0


def test_few_rows_give_the_sentinel(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0)], "k string, y double, p double")
    r = R.fit_metrics(p, ["k"]).first()
    assert (r.r2_score, r.correlation, r.rmse) == (-999.0, 0.0, 999.0)


def _notes(spark, onsets, length=0.5, velocity=None):
    rows = [("t", i, float(o), float(o) + length, velocity[i] if velocity else 64) for i, o in enumerate(onsets)]
    return spark.createDataFrame(rows, "track_id string, seq long, onset double, offset double, velocity int")


def test_steady_tempo_is_flat(spark):
    curve = T.performance_tempo_curve(_notes(spark, np.arange(0, 30, 0.5))).first().curve
    assert len(curve) == 60 and all(v == pytest.approx(1.0) for v in curve)
    assert T.performance_tempo(_notes(spark, [0, 1, 2])).count() == 0


def test_articulation_bins(spark):
    rows = {r.bin: r.p for r in T.articulation(_notes(spark, np.arange(0, 10, 0.5), 0.5 * 0.98)).collect()}
    assert max(rows, key=rows.get) == 11 and sum(rows.values()) == pytest.approx(1)
    assert all(r.p == 1 / 16 for r in T.articulation(_notes(spark, [0.0])).collect())


def test_expressivity_equals_numpy(spark):
    v = [10, 50, 90, 70]
    r = T.expressivity(_notes(spark, [0, 1, 3, 3.5], velocity=v)).first()
    assert r.velocity_std == pytest.approx(np.std(v)) and r.log_ioi_std == pytest.approx(np.std(np.log(np.array([1, 2, 0.5]) + 1e-6)))


def test_pedal_share(spark):
    c = spark.createDataFrame([("t", 1, 5.0, 64, 100), ("t", 2, 15.0, 64, 0), ("t", 3, 20.0, 64, 64), ("t", 4, 30.0, 64, 0)], "track_id string, event_id long, t double, cc int, value int")
    tracks = spark.createDataFrame([("t", 30.0)], "track_id string, duration double")
    assert T.pedal_curve(c, tracks, sub=10).agg(F.avg("x")).first()[0] == pytest.approx(20 / 30)


def test_monotonic_runs(spark):
    env = [0.1, 0.2, 0.3, 0.4, 0.5, 0.4, 0.3, 0.2, 0.1]
    r = T.monotonic_runs(spark.createDataFrame([("t", i, v) for i, v in enumerate(env)], "track_id string, frame int, x double")).first()
    assert r.rise == pytest.approx(0.4 * 4) and r.fall == pytest.approx(0.4 * 4)


def test_smoothing_keeps_polynomials(spark):
    x = [0.01 * i**3 - i for i in range(101)]
    rows = [("long", i, v) for i, v in enumerate(x)] + [("short", i, v) for i, v in enumerate(x[:8])] + [("tiny", i, float(i % 2)) for i in range(4)]
    got = {(r.track_id, r.frame): r.x for r in T.smoothed(spark.createDataFrame(rows, "track_id string, frame int, x double")).collect()}
    assert all(got[t, i] == pytest.approx(v, abs=1e-6) for t, i, v in rows)
    flat = spark.createDataFrame([([2.0] * 9,)], "v array<double>")
    assert flat.select(V.gaussian_smooth(F.col("v"))).first()[0] == pytest.approx([2.0] * 9)
    assert spark.createDataFrame([([1.0, 9.0, 2.0],)], "v array<double>").select(V.median_of_window(F.col("v"), 3)).first()[0] == [1.0, 2.0, 2.0]


def test_sliding_segments(spark):
    df = spark.createDataFrame([("a", [float(i) for i in range(25)]), ("b", [1.0])], "track_id string, samples array<double>")
    rows = T.sliding_segments(df, 10, 5).collect()
    assert [r.start for r in rows if r.track_id == "a"] == [0, 5, 10, 15]
    assert [r.samples for r in rows if r.track_id == "b"] == [[1.0] + [0.0] * 9]


def _wav(path, seconds, rate=8000, channels=1):
    x = (np.sin(2 * math.pi * 440 * np.arange(int(seconds * rate)) / rate) * 20000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())


def test_audio_jobs(spark, tmp_path):
    _wav(tmp_path / "long.WAV", 2, channels=2)
    _wav(tmp_path / "short.wav", 0.2)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    assert [r.track_id for r in files.list_audio(spark, str(tmp_path)).collect()] == ["bad", "long", "short"]
    raw = files.binary_files(spark, str(tmp_path), ".wav")
    ok = {r.path.rsplit("/", 1)[-1]: (r.valid, list(r.errors)) for r in files.validate_audio(raw).collect()}
    assert ok == {"long.WAV": (True, []), "short.wav": (False, ["too short"]), "bad.wav": (False, ["unreadable header"])}
    decoded = {r.track_id: r for r in files.decode_wav(raw).collect()}
    assert len(decoded["long"].samples) == 16000 and decoded["bad"].error
    seg = T.sliding_segments(files.decode_wav(raw).where("error is null").select("track_id", V.doubles(F.col("samples")).alias("samples")), 4000, 2000)
    layers = files.encode_batches(seg, files.random_projection(4000, 3, 5), 4000, 3).where("track_id = 'long'")
    assert {(len(r.layers), len(r.layers[0])) for r in layers.collect()} == {(3, 5)}
    peak = files.spectra(seg.where("track_id = 'long'"), 8000.0).groupBy("frame").agg(F.max_by("freq", "mag").alias("f")).first().f
    assert peak == pytest.approx(440, abs=2)


def test_spectra_of_a_batch_are_transformed_together(spark, monkeypatch):
    """One batch of rows for each length of segments, in stretches of bounded size; the bins are those of each segment alone."""
    rng = np.random.default_rng(6)
    rows = [(f"t{i}", i % 3, rng.standard_normal(20 if i % 4 else 9).tolist()) for i in range(200)]
    expected = sorted((t, s, f, m) for t, s, x in rows for f, m in zip(np.fft.rfftfreq(len(x), 1 / 64.0), np.abs(np.fft.rfft(x))))
    batch = pa.RecordBatch.from_pydict({"track_id": [r[0] for r in rows], "segment_idx": [r[1] for r in rows], "samples": [r[2] for r in rows]})
    made = list(files._spectra(64.0)(iter([batch])))
    assert [b.num_rows for b in made] == [50 * 5, 150 * 11]
    monkeypatch.setattr(files, "TRANSFORMED", 200)
    assert max(b.num_rows for b in files._spectra(64.0)(iter([batch]))) == 22 * 5
    found = files.spectra(spark.createDataFrame(rows, "track_id string, segment_idx int, samples array<double>"), 64.0).collect()
    assert np.allclose([r[2:] for r in sorted(map(tuple, found))], [e[2:] for e in expected]) and [r[:2] for r in sorted(map(tuple, found))] == [e[:2] for e in expected]


def test_array_and_target_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    np.save(tmp_path / "one.npy", x)
    rows = files.ingest_npy(files.binary_files(spark, str(tmp_path), ".npy"))
    assert rows.where("segment_idx = 1 and layer = 2").first().vec == [20, 21, 22, 23]
    buffer = io.BytesIO()
    np.savez(buffer, **{"timbre.centroid": np.array([10.0, 20.0]), "dynamics.range": np.array(3.0)})
    (tmp_path / "one_segment_targets.npz").write_bytes(buffer.getvalue())
    long = files.ingest_targets(files.binary_files(spark, str(tmp_path), ".npz"))
    assert {(r.track_id, r.category, r.field): list(r["values"]) for r in long.collect()} == {("one", "timbre", "centroid"): [10.0, 20.0], ("one", "dynamics", "range"): [3.0]}
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    for n in (1, 2):
        folder = tmp_path / "stream"
        folder.mkdir(exist_ok=True)
        np.save(folder / f"f{n}.npy", x)
        ingest_new_files(spark, str(folder), out, seen, files.ingest_npy)
        assert spark.read.parquet(out).select("track_id").distinct().count() == n


def test_feature_store(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = [("a", "aggregated", 0, [1.0, 3.0]), ("a", "segments", 0, [2.0, 2.0]), ("b", "aggregated", 1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "track_id string, feature_type string, layer int, vec array<double>")
    tables.write_features(df, path)
    tables.write_features(df.where("layer = 1"), path)
    assert [(r.track_id, r.vec) for r in tables.read_layer(spark, path, 0, 2).collect()] == [("a", [1.0, 3.0])]
    assert tables.read_features(spark, path, ["aggregated", "segments"]).select("track_id").distinct().collect()[0][0] == "a"
    with pytest.raises(ValueError):
        tables.read_layer(spark, path, 2, 2)
    plan = feature_store.read_feature_rows(spark, path).where("layer = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan


def test_index_save_load_publish(spark, tiny, tmp_path):
    root = str(tmp_path / "root")
    flat = X.flat_index(tiny)
    first = A.save_index(flat, root, "clips", "20240101T000000Z")
    second = A.save_index(flat, root, "clips", "20240102T000000Z")
    with pytest.raises(Exception, match="(?i)exist"):
        A.save_index(flat, root, "clips", "20240101T000000Z")
    vectors, manifest = A.load_index(spark, first)
    assert vectors.count() == 5 and manifest["dimension"] == 4
    assert A.latest_index(spark, root, "clips").endswith(second.rsplit("/", 1)[-1])
    with pytest.raises(FileNotFoundError):
        A.latest_index(spark, root, "none")
    A.publish_index(spark, second, str(tmp_path / "remote"))
    pulled, _ = A.load_latest(spark, str(tmp_path / "remote"), "clips")
    assert pulled.exceptAll(flat).count() == 0
    with pytest.raises(ValueError):
        A.validate_manifest({**manifest, "schema_version": 1})
    with pytest.raises(ValueError):
        A.validate_manifest({k: v for k, v in manifest.items() if k != "metric"})


def test_inverted_lists(spark, sf, tmp_path):
    from strata.plans import views

    v = views.vectors(spark, sf)
    lists, centres = X.ivf_index(v, 4)
    q = v.where("id < 20").select(F.col("id").alias("query_id"), "vec")
    exact = S.similar_to_all(v, v.where("id < 20"), 10, exclude_self=False).select("query_id", "id")
    full = X.probe_ivf(lists, centres, q, 10, 4).select("query_id", "id")
    assert exact.exceptAll(full).count() == 0
    some = X.probe_ivf(lists, centres, q, 10, 2).select("query_id", "id")
    assert some.intersect(exact).count() / exact.count() > 0.5  # test_recall_of_indexes has the settings that reach 0.9
    X.write_lists(lists, centres, str(tmp_path / "ivf"), 2)
    stored, middle, nprobe = X.read_lists(spark, str(tmp_path / "ivf"))
    assert nprobe == 2 and X.probe_ivf(stored, middle, q, 10, nprobe).select("query_id", "id").exceptAll(some).count() == 0
    with pytest.raises(ValueError):
        X.probe_ivf(lists, centres, q, 10, 0)
    with pytest.raises(ValueError):
        X.parse_factory("HNSW32,Flat")


@pytest.mark.parametrize("name", ["x2_ivf_four_probes", "x3_product_codes"])
def test_recall_of_indexes(spark, sf, name):
    from strata import catalog
    from strata.plans import views

    v = views.vectors(spark, sf)
    exact = {(r.query_id, r.id) for r in S.similar_to_all(v, v.where("id % 50 = 0"), 9).collect()}
    rows = catalog.queries()[name](spark, sf).collect()
    assert len({(r.query_id, r.id) for r in rows}) == len(rows) == 10 * len({q for q, _ in exact})
    recall = len(exact & {(r.query_id, r.id) for r in rows}) / len(exact)
    print(name, recall)
    assert recall >= 0.9


def test_probe_results_json(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"0": {"tempo": {"r2_score": 0.5, "correlation": 0.7, "rmse": 1.0}}, "weighted_sum": {"tempo": {"r2_score": 0.6, "layer_weights": [0.5, 0.5], "gain": 0.1}}, "note": {}}')
    rows = {r["mode"]: r for r in tables.read_probe_results(spark, str(path)).collect()}
    assert rows["best_layer"].layer == 0 and list(rows["weighted_sum"].layer_weights) == [0.5, 0.5]


def test_registry():
    registry.register("dynamics", T.dynamics)
    registry.register("dynamics", T.phrases)
    assert registry.get_generator("dynamics") is T.phrases and "dynamics" in registry.all_names()
    with pytest.raises(KeyError):
        registry.get_generator("none")


def test_audio_resolution(spark):
    tracks = spark.createDataFrame([("a",)], "track_id string")
    paths = spark.createDataFrame([("/x/a.wav",), ("/x/b.wav",)], "path string")
    assert C.resolve_audio(tracks, paths).first().path == "/x/a.wav"
    with pytest.raises(Exception, match="2 audio files"):
        C.resolve_audio(tracks, paths.union(spark.createDataFrame([("/y/a.mp3",)], "path string"))).collect()
    with pytest.raises(Exception, match="0 audio files"):
        C.resolve_audio(spark.createDataFrame([("z",)], "track_id string"), paths).collect()


def test_readers_of_features(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = [(t, kind, k, s, [float(k), float(s)]) for t in ("a", "b") for kind in ("aggregated", "segments") for k in range(3) for s in range(2 if kind == "segments" else 1)]
    tables.write_features(spark.createDataFrame(rows, "track_id string, feature_type string, layer int, segment_idx int, vec array<double>"), path)
    flat = {r.track_id: r.vec for r in tables.read_track_vectors(spark, path, 3, 2).collect()}
    assert flat == {"a": [0.0, 0.0, 1.0, 0.0, 2.0, 0.0], "b": [0.0, 0.0, 1.0, 0.0, 2.0, 0.0]}
    assert tables.read_track_vectors(spark, path, 3, 2, layer=1).first().vec == [1.0, 0.0]
    assert [r.layers for r in tables.read_layer_matrix(spark, path, 3, 2).collect()] == [[[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]] * 2
    clips = tables.read_clip_vectors(spark, path, 2, 3).collect()
    assert [(r.track_id, r.start_sec, r.end_sec, r.vec) for r in clips[:2]] == [("a", 0.0, 5.0, [2.0, 0.0]), ("a", 2.5, 7.5, [2.0, 1.0])]
    with pytest.raises(Exception, match="wrong embedding shape"):
        tables.read_layer_matrix(spark, path, 4, 2).collect()
    with pytest.raises(ValueError):
        tables.read_clip_vectors(spark, path, 3, 3)
    with pytest.raises(FileNotFoundError):
        tables.read_layer_matrix(spark, path, 3, 2, "raw")


def test_an_encoder_error_is_a_column(spark):
    def make():
        def encode(x):
            if (x < 0).any():
                raise ValueError("negative sample")
            return np.stack([x, 2 * x], axis=1)

        return encode

    rows = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [-1.0, 2.0]), ("b", 0, [3.0, 4.0])], "track_id string, segment_idx int, samples array<double>").coalesce(1)
    got = {(r.track_id, r.segment_idx): (r.layers, r.error) for r in files.encode_safely(rows, make).collect()}
    assert got == {("a", 0): ([[1.0, 2.0], [2.0, 4.0]], None), ("a", 1): (None, "ValueError: negative sample"), ("b", 0): ([[3.0, 4.0], [6.0, 8.0]], None)}


def test_descriptors_and_aspects(spark):
    from strata.functions import descriptors as D

    assert D.target_specs(spark).count() == 22 and len(D.SEGMENT_TARGETS) == 11 and set(D.SEGMENT_TARGETS) <= {t[0] for t in D.SCALAR_TARGETS}
    aspects = D.aspect_registry(spark)
    assert aspects.select("aspect").distinct().count() == 16
    known = {t[0] for t in D.SCALAR_TARGETS} | {t[0] for t in D.REGISTERED_TARGETS}
    assert {r.target for r in aspects.collect()} <= known
    results = spark.createDataFrame([("best_layer", 2, "spectral_centroid", 0.9, 10, None, None, 1.0)], "mode string, layer int, target string, r2_score double, n_valid long, layer_weights array<double>, r2_gain double, coverage double")
    found = R.resolve_aspects(results, aspects)
    assert {r.aspect: r.layer for r in found.collect()} == {"brightness": 2, "warmth": 2}
    stacks = spark.createDataFrame([(i, [[0.0, 1.0], [0.0, 1.0], [1.0, float(i)]]) for i in range(4)], "id long, layers array<array<double>>")
    assert S.search_by_aspect(stacks, 0, "brightness", found, 3, k=1).first().id == 1


def test_target_jobs_fail_alone(spark):
    good = lambda: {("a", "x"): spark.createDataFrame([(1, 2.0)], "track_id long, v double")}
    bad = lambda: {("b", "y"): spark.createDataFrame([(1, "z")], "track_id long, v string").select("track_id", F.raise_error(F.lit("broken")).cast("double").alias("v"))}
    long, errors = T.all_targets({"good": good, "bad": bad})
    assert [tuple(r) for r in long.collect()] == [(1, "a", "x", [2.0])] and list(errors) == ["bad"]
    assert T.all_targets({"bad": bad})[0] is None


def test_dynamics_curves_and_midi_gate(spark):
    x = [0.1 + 0.01 * i for i in range(60)] + [0.7 - 0.01 * i for i in range(60)]
    frames = spark.createDataFrame([("t", i, v) for i, v in enumerate(x)] + [("flat", i, 0.5) for i in range(120)], "track_id string, frame int, x double")
    arc = {r.track_id: r.curve for r in T.dynamic_arc(frames).collect()}
    assert len(arc["t"]) == 60 and min(arc["t"]) == 0 and max(arc["t"]) == 1 and 25 < int(np.argmax(arc["t"])) < 35 and arc["flat"] == [0.0] * 60
    fields = {r.track_id: r for r in T.dynamics_fields(frames).collect()}
    assert fields["t"].crescendo_strength > 10 and fields["t"].dynamic_range == pytest.approx(0.6, abs=0.02) and fields["flat"].dynamic_variance == pytest.approx(0)
    long = spark.createDataFrame([("t", "curves", "arc", [1.0] * 3), ("u", "curves", "arc", [1.0] * 2), ("v", "curves", "arc", [float("nan")] * 3)], "track_id string, category string, field string, values array<double>")
    assert {r.track_id: r.curve for r in tables.read_curves(long, "curves", 3).collect()} == {"t": [1.0] * 3, "u": None, "v": None}
    ys = spark.createDataFrame([("t", "m", 1.0), ("u", "m", 1.0), ("u", "n", 2.0)], "track_id string, target string, y double")
    flags = spark.createDataFrame([("u", False)], "track_id string, midi_available boolean")
    assert sorted((r.track_id, r.target, r.y) for r in tables.gate_midi(ys, flags, ["m"]).collect()) == [("t", "m", 1.0), ("u", "m", None), ("u", "n", 2.0)]


def test_blobs_extra_tables_and_run_all(spark):
    meta = spark.createDataFrame([("t", " Bach ", None), ("u", "", " ")], "track_id string, composer string, work string")
    tracks = spark.createDataFrame([("t",), ("u",), ("x",)], "track_id string")
    assert {r.track_id: r.blob for r in C.blob_of(tracks, meta).collect()} == {"t": "Bach", "u": "", "x": None}
    clips = spark.createDataFrame([("c1",), ("c2",)], "clip_id string")
    feats = spark.createDataFrame([("c1", [1.0])], "clip_id string, vec array<double>")
    notes = spark.createDataFrame([("c2", "loud")], "clip_id string, note string")
    ys = spark.createDataFrame([("c1", {"q": 1.0})], "clip_id string, targets map<string,double>")
    got = {r.clip_id: (r.note, r.target_values, r.target_mask, r.has_targets) for r in C.training_view(clips, feats, ys, ["q", "z"], [notes]).collect()}
    assert got["c1"] == (None, [1.0, None], [True, False], True) and got["c2"][0] == "loud" and not got["c2"][3]
    registry.register("phrases_of", T.phrases)
    made = registry.run_all({"phrases_of": spark.createDataFrame([("t", 0.0), ("t", 1.0)], "track_id string, t double"), "unknown": meta})
    assert set(made) == {"phrases_of"} and made["phrases_of"].first().n == 1


def test_results_of_indented_json(spark, tmp_path):
    import json

    path = tmp_path / "indented.json"
    path.write_text(json.dumps({"3": {"tempo": {"r2_score": 0.5}}, "weighted_sum": {"tempo": {"r2_score": 0.6, "layer_weights": [0.5, 0.5]}}}, indent=2))
    rows = {(r.mode, r.layer, r.target, r.r2_score) for r in tables.read_probe_results(spark, str(path)).collect()}
    assert rows == {("best_layer", 3, "tempo", 0.5), ("weighted_sum", None, "tempo", 0.6)}

"""Probes with gaps, mixes, folds by groups: against direct solutions, and the size of what is shuffled."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import grams as G
from strata.operators import probing as R
from strata.plans.session import ship
from tests.test_library import _ridge


def _predictions(x, y, fold):
    p = np.full(len(y), np.nan)
    for f in set(fold.tolist()):
        train, test = fold != f, fold == f
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        sd = np.where(sd < 1e-12, 1, sd)
        z = (x[train] - mean) / sd
        w = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y[train] - y[train].mean()))
        p[test] = (x[test] - mean) / sd @ w + y[train].mean()
    return p


@pytest.fixture(scope="module")
def gappy(spark):
    """22 targets, each with gaps of its own but for two; a constant column; layers of 5 entries."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 3, 5))
    x[:, :, 4] = 2.5
    y = np.einsum("nld,ldt->nt", x, rng.standard_normal((3, 5, 22))) + 3 * rng.standard_normal((120, 22))
    y[rng.random(y.shape) < rng.uniform(0.02, 0.6, 22)] = np.nan
    y[:, :2] = rng.standard_normal((120, 2)) + x[:, 1, :2]
    feats = spark.createDataFrame([(i, k, x[i, k].tolist()) for i in range(120) for k in range(3)], "id long, layer int, vec array<double>")
    ys = spark.createDataFrame([(i, f"t{t:02d}", None if np.isnan(y[i, t]) else float(y[i, t])) for i in range(120) for t in range(22)], "id long, target string, y double")
    return x, y, feats, ys


def test_independent_gaps_equal_numpy(spark, gappy):
    ship(spark)
    x, y, feats, ys = gappy
    folds = R.kfold(feats.select("id"))
    fold = np.array([r.fold for r in folds.orderBy("id").collect()])
    layers = R.probe_layers(feats, ys, folds)
    found = {(r.layer, r.target): r for r in layers.collect()}
    assert len(found) == 66
    for t in range(22):
        own = ~np.isnan(y[:, t])
        for k in range(3):
            r, p = found[k, f"t{t:02d}"], _predictions(x[own, k], y[own, t], fold[own])
            assert r.n_valid == own.sum() and r.r2_score == pytest.approx(_ridge(x[own, k], y[own, t], fold[own]), abs=1e-8)
            assert r.correlation == pytest.approx(np.corrcoef(y[own, t], p)[0, 1], abs=1e-8) and r.rmse == pytest.approx(np.sqrt(((y[own, t] - p) ** 2).mean()), abs=1e-8)
    for r in R.probe_mixes(feats, ys, folds, layers, 3).collect():
        own = ~np.isnan(y[:, int(r.target[1:])])
        mixed = np.einsum("nld,l->nd", x[own], np.array(r.layer_weights))
        assert r.r2_score == pytest.approx(_ridge(mixed, y[own, int(r.target[1:])], fold[own]), abs=1e-8)


def test_matrices_do_not_grow_with_patterns(spark, gappy):
    ship(spark)
    x, y, feats, ys = gappy
    plan = R._Plan(R._layer_maps(feats), ys, R.kfold(feats.select("id")), None, False)
    sums = G.sums_of_products(plan.rows, plan.n)
    keys = sums.select("model", "a", "b", "fold", "gap").distinct().count()
    patterns = len({tuple(np.isnan(r)) for r in y})
    assert patterns > 100 and keys <= 3 * 5 * (1 + 20)
    cross = G.sums_of_products(plan.rows, plan.n, cross=True).where("gap < 0").select("a", "b", "fold").distinct().count()
    assert cross == 6 * 5


def test_blocks_of_targets_and_parts_of_rows(spark, gappy, monkeypatch):
    ship(spark)
    _, _, feats, ys = gappy
    folds = R.kfold(feats.select("id"))
    wanted = {(r.layer, r.target): r.r2_score for r in R.probe_layers(feats, ys, folds).collect()}
    monkeypatch.setattr(R, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(G, "PART_ROWS", 50)
    assert {(r.layer, r.target): r.r2_score for r in R.probe_layers(feats, ys, folds).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in wanted.items()}


def test_curves_with_gaps_equal_numpy(spark, gappy):
    ship(spark)
    x, _, feats, _ = gappy
    rng = np.random.default_rng(2)
    curves = {"c": x[:, 1] @ rng.standard_normal((5, 4)) + rng.standard_normal((120, 4)), "d": rng.standard_normal((120, 3))}
    gone = rng.random(120) < 0.3
    rows = [(i, n, None if n == "c" and gone[i] else c[i].tolist()) for n, c in curves.items() for i in range(120)] + [(500, "c", [1.0])]
    folds = R.kfold(feats.select("id"))
    fold = np.array([r.fold for r in folds.orderBy("id").collect()])
    for r in R.probe_curves(feats, spark.createDataFrame(rows, "id long, target string, curve array<double>"), folds).collect():
        own = ~gone if r.target == "c" else np.ones(120, bool)
        y, f, z = curves[r.target][own], fold[own], x[own, r.layer]
        p = np.stack([_predictions(z, y[:, t], f) for t in range(y.shape[1])], axis=1)
        r2 = 1 - ((y - p) ** 2).sum(axis=0) / ((y - y.mean(axis=0)) ** 2).sum(axis=0)
        assert r.n_valid == own.sum() and r.r2_mean == pytest.approx(r2.mean(), abs=1e-8) and r.rmse_mean == pytest.approx(np.sqrt(((y - p) ** 2).mean()), abs=1e-8)
        score, guess = np.zeros(len(y)), np.zeros(len(y))
        for k in set(f.tolist()):
            train = f != k
            mean = y[train].mean(axis=0)
            axis = np.linalg.eigh(np.cov(y[train].T, bias=True))[1][:, -1]
            axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
            score[~train] = ((y - mean) @ axis)[~train]
            guess[~train] = _predictions(z, (y - mean) @ axis, f)[~train]
        assert r.r2_pc1 == pytest.approx(1 - ((score - guess) ** 2).sum() / ((score - score.mean()) ** 2).sum(), abs=1e-7)


def test_grouped_folds_are_balanced(spark):
    rng = np.random.default_rng(3)
    sizes = [200, 90, 90, 40, *rng.integers(1, 12, 60).tolist()]
    group = np.repeat(np.arange(len(sizes)), sizes)
    rows = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "id long, g long")
    fold = {r.id: r.fold for r in R.grouped_kfold(rows, "id", "g").collect()}
    assert len(fold) == len(group) and len({(g, fold[i]) for i, g in enumerate(group)}) == len(sizes)
    loads, greedy = collections.Counter(fold.values()), [0] * 5
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert sorted(loads.values()) == sorted(greedy)
    assert set(R.grouped_kfold(rows.withColumn("g", F.lit(1)), "id", "g").select("fold").distinct().toPandas().fold) == set(range(5))
    two = R.grouped_kfold(rows.where("g < 2"), "id", "g")
    assert two.select("fold").distinct().count() == 2


def test_a_target_of_one_track_is_probed_with_ungrouped_folds(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((10, 8, 2, 3))
    feats = spark.createDataFrame([(f"t{t}", s, k, x[t, s, k].tolist()) for t in range(10) for s in range(8) for k in range(2)], "track_id string, segment_idx int, layer int, vec array<double>")
    value = lambda t, s: float(x[t, s, 0].sum())
    ys = spark.createDataFrame([(f"t{t}", s, n, value(t, s) if n == "all" or t == 4 else None) for t in range(10) for s in range(8) for n in ("all", "one")], "track_id string, segment_idx int, target string, y double")
    out = {(r["mode"], r.layer, r.target): r for r in R.discover_segments(feats, ys, 2).collect()}
    assert {k[2] for k in out} == {"all", "one"} and len(out) == 6
    r = out["best_layer", 0, "one"]
    assert (r.n_valid, r.n_groups, r.n_tracks) == (8, 1, 10) and r.coverage == pytest.approx(0.1)
    order = sorted(range(8), key=lambda s: __import__("hashlib").md5(f"42:t4:{s}".encode()).hexdigest())
    fold = np.array([order.index(s) % 5 for s in range(8)])
    assert r.r2_score == pytest.approx(_ridge(x[4, :, 0], np.array([value(4, s) for s in range(8)]), fold), abs=1e-8)


def test_segments_are_read_once_and_are_those_of_align_segments(spark):
    """Tracks whose numbers of segments differ are left out, segments that one side lacks too, and rows given twice count once."""
    ship(spark)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((12, 6, 2, 3))
    vecs = [(f"t{t}", s, k, x[t, s, k].tolist()) for t in range(12) for s in range(6) for k in range(2) if (t, s) not in ((1, 5), (2, 0))]
    values = [(f"t{t}", s, n, None if n == "gaps" and s == t % 6 else float(x[t, s, 0].sum())) for t in range(12) for s in range(6) for n in ("all", "gaps") if (t, s) != (2, 5)]
    read = {n: spark.sparkContext.accumulator(0) for n in ("vecs", "values")}

    def counted(rows, name, schema):
        def run(batches):
            for b in batches:
                read[name].add(b.num_rows)
                yield b

        return spark.createDataFrame(rows, schema).mapInArrow(run, schema)

    feats = counted(vecs + vecs[:8], "vecs", "track_id string, segment_idx int, layer int, vec array<double>")
    ys = counted(values + values[:8], "values", "track_id string, segment_idx int, target string, y double")
    out = {(r["mode"], r.layer, r.target): r for r in R.discover_segments(feats, ys, 2).collect()}
    assert {n: a.value for n, a in read.items()} == {"vecs": len(vecs) + 8, "values": len(values) + 8}
    rows = R.align_segments(feats, ys).toPandas()
    assert set(rows.track_id) == {f"t{t}" for t in range(12) if t != 1} and set(rows.segment_idx[rows.track_id == "t2"]) == {1, 2, 3, 4}
    assert {k[2]: (r.n_valid, r.n_groups, r.n_tracks) for k, r in out.items()} == {n: (rows[(rows.target == n) & rows.y.notna()].id.nunique(), 11, 11) for n in ("all", "gaps")}
    ids = spark.createDataFrame(rows[["id", "track_id"]].drop_duplicates())
    long = spark.createDataFrame(rows[["id", "target", "y"]].drop_duplicates()).withColumn("y", F.nanvl("y", F.lit(None)))
    plain = R.probe_layers(spark.createDataFrame(rows.drop_duplicates(["id", "layer"])[["id", "layer", "vec"]]), long, R.grouped_kfold(ids, "id", "track_id"))
    for r in plain.collect():
        assert out["best_layer", r.layer, r.target].r2_score == pytest.approx(r.r2_score, abs=1e-9)


def test_groups_are_dealt_in_checksum_order_whatever_their_sizes(spark):
    """As row_number() over (order by md5('42:' || group)) - 1, modulo 5."""
    ids = list(range(0, 57)) + [91, 92, 93]
    rows = spark.createDataFrame([(i, i // 10) for i in ids], "id long, g long")
    order = sorted({i // 10 for i in ids}, key=lambda g: hashlib.md5(f"42:{g}".encode()).hexdigest())
    assert {r.id: r.fold for r in R.grouped_kfold(rows, "id", "g", by_size=False).collect()} == {i: order.index(i // 10) % 5 for i in ids}
    assert {r.fold for r in R.grouped_kfold(rows.where("g = 0"), "id", "g", by_size=False).collect()} == {0}

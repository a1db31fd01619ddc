"""Writes of single tracks, dead and competing writers, new columns, old versions and compaction of feature tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from strata.sources import feature_store as S
from strata.sources import tables

SCHEMA = "track_id string, feature_type string, layer int, vec array<double>"


def _rows(spark, *rows):
    return spark.createDataFrame([(t, k, n, [v]) for t, k, n, v in rows], SCHEMA)


def _state(spark, path, version=None):
    return sorted((r.track_id, r.feature_type, r.layer, r.vec[0]) for r in S.read_feature_rows(spark, path, version).collect())


def test_a_write_replaces_its_own_tracks_only(spark, tmp_path):
    path = str(tmp_path / "f")
    with pytest.raises(FileNotFoundError):
        S.read_feature_rows(spark, path)
    assert [S.write_features(_rows(spark, x), path) for x in (("a", "k", 0, 1.0), ("b", "k", 0, 2.0), ("a", "k", 0, 3.0), ("a", "k", 1, 4.0), ("a", "j", 0, 5.0))] == [1, 2, 3, 4, 5]
    now = [("a", "j", 0, 5.0), ("a", "k", 0, 3.0), ("a", "k", 1, 4.0), ("b", "k", 0, 2.0)]
    assert _state(spark, path) == now
    assert _state(spark, path, 2) == [("a", "k", 0, 1.0), ("b", "k", 0, 2.0)]
    S.write_features(_rows(spark, ("a", "k", 0, 6.0), ("a", "k", 0, 7.0)), path)  # two rows of one key, as segments have
    now = sorted([x for x in now if x[:3] != ("a", "k", 0)] + [("a", "k", 0, 6.0), ("a", "k", 0, 7.0)])
    assert _state(spark, path) == now
    assert tables.missing_tracks(spark.createDataFrame([("a",), ("b",), ("c",)], "track_id string"), S.read_feature_rows(spark, path), ["k", "j"]).orderBy("track_id").collect() == [("b",), ("c",)]
    assert S.compact_features(spark, path) == 7 and S.compact_features(spark, path) == 7
    assert _state(spark, path) == now and _state(spark, path, 1) == [("a", "k", 0, 1.0)]
    S.write_features(_rows(spark, ("b", "k", 0, 8.0)), path)
    now = sorted([x for x in now if x[0] != "b"] + [("b", "k", 0, 8.0)])
    assert _state(spark, path) == now
    assert len(S.remove_old_batches(spark, path, keep=1)) == 6 and _state(spark, path) == now
    with pytest.raises(FileNotFoundError):
        S.read_feature_rows(spark, path, 1)


def test_a_dead_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    S.write_features(_rows(spark, ("a", "k", 0, 1.0)), path)
    with pytest.raises(Exception, match="a row fails"):
        S.write_features(_rows(spark, ("a", "k", 0, 2.0), ("b", "k", 0, 2.0)).withColumn("vec", F.when(F.col("track_id") == "b", F.raise_error(F.lit("a row fails"))).otherwise(F.col("vec"))), path)
    assert _state(spark, path) == [("a", "k", 0, 1.0)]
    monkeypatch.setattr(S._Folder, "put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))  # killed before the rename
    with pytest.raises(KeyboardInterrupt):
        S.write_features(_rows(spark, ("a", "k", 0, 2.0)), path)
    monkeypatch.undo()
    assert _state(spark, path) == [("a", "k", 0, 1.0)]
    assert S.write_features(_rows(spark, ("a", "k", 0, 3.0)), path) == 2 and _state(spark, path) == [("a", "k", 0, 3.0)]
    assert len(S.remove_old_batches(spark, path)) == 2 and _state(spark, path, 1) == [("a", "k", 0, 1.0)]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another write commits between a write's files and its rename: both stay, and the later rename wins what they share."""
    path, put, other = str(tmp_path / "f"), S._Folder.put, []
    S.write_features(_rows(spark, ("a", "k", 0, 1.0), ("c", "k", 0, 1.0)), path)

    def late(folder, name, value):
        if not other:
            other.append(True)
            S.write_features(_rows(spark, ("a", "k", 0, 2.0), ("b", "k", 0, 2.0)), path)
        return put(folder, name, value)

    monkeypatch.setattr(S._Folder, "put", late)
    assert S.write_features(_rows(spark, ("a", "k", 0, 3.0), ("d", "k", 0, 3.0)), path) == 3
    assert _state(spark, path) == [("a", "k", 0, 3.0), ("b", "k", 0, 2.0), ("c", "k", 0, 1.0), ("d", "k", 0, 3.0)]


def test_columns_keys_and_empty_writes(spark, tmp_path):
    path = str(tmp_path / "f")
    S.write_features(_rows(spark, ("a", "k", 0, 1.0)), path)
    S.write_features(_rows(spark, ("b", "k", 0, 2.0)).withColumn("t", F.lit(7)), path)
    assert {(r.track_id, r.t) for r in S.read_feature_rows(spark, path).collect()} == {("a", None), ("b", 7)}
    with pytest.raises(ValueError, match="column t is int"):
        S.write_features(_rows(spark, ("c", "k", 0, 2.0)).withColumn("t", F.lit("x")), path)
    with pytest.raises(ValueError, match="lack layer"):
        S.write_features(_rows(spark, ("c", "k", 0, 2.0)).drop("layer"), path)
    with pytest.raises(Exception, match="without track_id"):
        S.write_features(_rows(spark, (None, "k", 0, 2.0)), path)
    assert S.write_features(_rows(spark, ("c", "k", 0, 2.0)).where("false"), path) == 2
    assert S.write_features(_rows(spark, ("é/ =%", "k k/", -1, 2.0)), path) == 3
    assert ("é/ =%", "k k/", -1, 2.0) in _state(spark, path)


def test_readers_open_their_layer_only_and_do_not_shuffle_vectors(spark, tmp_path):
    path = str(tmp_path / "f")
    S.write_features(_rows(spark, *[(f"t{i}", "k", n, float(i)) for i in range(20) for n in range(3)]), path)
    S.write_features(_rows(spark, ("t3", "k", 1, -1.0)), path)
    rows = S.read_feature_rows(spark, path).where("feature_type = 'k' and layer = 1")
    assert sorted(r.vec[0] for r in rows.collect()) == sorted([-1.0, *(float(i) for i in range(20) if i != 3)])
    assert {os.path.basename(os.path.dirname(f)) for f in rows.inputFiles()} >= {"layer=1"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("PartitionFilters: [isnotnull(feature_type") == 2

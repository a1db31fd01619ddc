"""Lists of bounded size and exact search through them, against brute force: clusters, ties, zero vectors, few rows, several blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import index as X
from strata.operators import lists as L
from strata.plans.session import ship


def _table(spark, x, key="id"):
    return spark.createDataFrame([(i, v.tolist() if v is not None else None) for i, v in enumerate(x)], f"{key} long, vec array<double>")


def _brute(x, asked, k, own=True):
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    out = {}
    for q in asked:
        s = np.round(unit @ unit[q], 9)
        if own:
            s[q] = -np.inf
        top = [i for i in np.lexsort((np.arange(len(x)), -s))[:k] if s[i] > -np.inf]
        out[q] = [(int(i), pytest.approx(float(s[i]), abs=1e-8)) for i in top]
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.similarity))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def clustered():
    """80 % of the vectors around one direction, the rest around twelve; equal vectors, zeros."""
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(13, 16))
    own = np.where(rnd.random(3000) < 0.8, 0, rnd.integers(1, 13, 3000))
    x = middle[own] + 0.15 * rnd.normal(size=(3000, 16))
    x[100:400] = x[100]  # equal vectors
    x[500:505] = 0.0
    return x


def test_lists_have_bounded_parts_and_all_rows(spark, clustered):
    ship(spark)
    lists, centres = L.balanced_lists(_table(spark, clustered), 100)
    assert sorted(r.id for r in lists.select("id").collect()) == list(range(3000))
    sizes = sorted(r["count"] for r in lists.groupBy("list_id", "part").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert {(r.list_id, r.n) for r in centres.collect()} == {(r.list_id, r["count"]) for r in lists.groupBy("list_id").count().collect()}
    few, _ = L.balanced_lists(_table(spark, clustered), 100, max_centres=2)
    assert few.count() == 3000 and few.select("list_id").distinct().count() <= 4 and few.groupBy("list_id", "part").count().agg(F.max("count")).first()[0] < 250


@pytest.mark.parametrize("rounds,block,own", [((2, 8), 2048, True), ((1,), 64, False), ((), 300, True)])
def test_exact_search_equals_brute_force(spark, clustered, rounds, block, own):
    ship(spark)
    lists, centres = L.balanced_lists(_table(spark, clustered), 100)
    asked = [*range(0, 3000, 7), 100, 101, 399, 500, 501]
    queries = _table(spark, clustered).where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), "vec")
    found, compared = L.similar_through_lists(lists, centres, queries, 10, own, rounds, block)
    assert _found(found) == _brute(clustered, set(asked), 10, own)
    pairs = sum(r.pairs for r in compared.collect())
    assert pairs <= len(set(asked)) * 3000 and (not rounds or pairs < 0.9 * len(set(asked)) * 3000)


def test_few_rows_nulls_and_none(spark):
    ship(spark)
    x = np.eye(4)
    lists, centres = L.balanced_lists(_table(spark, [*x, None]), 2)
    queries = _table(spark, [*x, None], "query_id")
    assert _found(L.similar_through_lists(lists, centres, queries, 10)[0]) == _brute(x, range(4), 10)
    lists, centres = L.balanced_lists(_table(spark, x).where("false"), 2)
    found, compared = L.similar_through_lists(lists, centres, queries, 10)
    assert found.count() == 0 and compared.count() == 0
    with pytest.raises(ValueError):
        L.balanced_lists(queries, 0)
    with pytest.raises(ValueError):
        L.similar_through_lists(lists, centres, queries, 0)


def test_hot_list_is_dealt_to_parts(spark, clustered):
    """The approximate index: a list with most of the rows has parts of bounded size, and all of them are probed."""
    from strata.operators import index as X

    ship(spark)
    v = _table(spark, clustered)
    lists, centres = X.ivf_index(v, 4, list_rows=100)
    sizes = [r["count"] for r in lists.groupBy("list_id", "part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 160 and len(sizes) >= 30
    queries = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")
    found = X.probe_ivf(lists, centres, queries, 5, 4)
    assert _found(found) == _brute(clustered, range(0, 3000, 100), 5, own=False)


def _greedy(rows, k, window, skip=None):
    kept = []
    for c, t, s, x in sorted(rows, key=lambda r: (-r[3], r[0])):
        if c != skip and len(kept) < k and all(t != u or abs(s - v) >= window for _, u, v, _ in kept):
            kept.append((c, t, s, x))
    return kept


def test_clip_search_returns_k_clips_whenever_there_are(spark):
    from strata.operators import search as S

    rnd = np.random.default_rng(4)
    near = [(f"n{i:04d}", "t", 2.5 * (i % 8), [1.0, 0.001 * i]) for i in range(1000)]  # 1000 near clips of one track within 20 s
    far = [(f"f{i:02d}", f"u{i % 6}", 5.0 * i, [0.5, 1.0 + i]) for i in range(12)]
    index = spark.createDataFrame([*near, *far], "clip_id string, track_id string, start_sec double, vec array<double>")
    x = np.array([r[3] for r in (*near, *far)])
    s = x @ x[0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[0])
    rows = [(*r[:3], v) for r, v in zip((*near, *far), s)]
    for k in (3, 10, 16, 50):
        found = [r.clip_id for r in S.search_by_clip(index, "n0000", k, 5.0).orderBy(F.col("similarity").desc(), "clip_id").collect()]
        assert found == [r[0] for r in _greedy(rows, k, 5.0, "n0000")] and len(found) == min(k, 16)
    assert S.search_by_clip(index, "n0000", 10, 5.0, fetch=250).count() < 10
    many = [(f"c{i}", f"t{rnd.integers(5)}", float(rnd.integers(0, 300)), float(rnd.random())) for i in range(3000)]
    scored = spark.createDataFrame(many, "clip_id string, track_id string, start_sec double, similarity double")
    for page in (1, 7, 100):
        got = [r.clip_id for r in S._walk_pages(scored, 9, 40.0, page).collect()]
        assert got == [r[0] for r in _greedy(many, 9, 40.0)]


def test_residual_codes_find_what_they_stand_for(spark, clustered):
    """A query by codes: near the exact search in the probed lists, and nearer with the centres' share than the codes alone."""
    from strata.operators import index as X
    from strata.operators import search as S

    ship(spark)
    v = _table(spark, clustered).where("id < 1500 and (id < 100 or id > 405) and (id < 500 or id > 505)")
    codes, centres, books = X.pq_index(v, "IVF6,PQ8x4", seed=3)
    own = {i for i in range(1500) if i < 100 or i > 505 or 405 < i < 500}
    for q in (7, 600):
        vector = [float(x) for x in clustered[q]]
        by_code = {r.id: r.similarity for r in X.search_pq(codes, centres, books, vector, 2000, 6).collect()}
        exact = {r.id: r.similarity for r in S.similar_to(v, vector, 2000).collect()}
        assert set(by_code) == set(exact) == own
        gap = np.array([by_code[i] - exact[i] for i in exact])
        assert np.abs(gap).mean() < 0.05 and np.corrcoef([by_code[i] for i in exact], list(exact.values()))[0, 1] > 0.99
    with pytest.raises(ValueError):
        X.search_pq(codes, centres, books, vector, 5, 0)


def test_queries_and_rows_of_lists_meet_in_blocks_and_spilled_rows_count_once(spark):
    ship(spark)
    x = np.random.default_rng(5).normal(size=(400, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    lists, centres = X.ivf_index(v, 6, spill=2, list_rows=60)
    found = X.probe_ivf(lists, centres, v.select(F.col("id").alias("query_id"), "vec"), 12, 3)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("strategy=broadcast" in line for line in joins)  # with the sizes of lists only
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    middle = np.array([r.centre for r in centres.orderBy("list_id").collect()])
    near = lambda n: (-2 * unit @ middle.T + (middle**2).sum(axis=1)).argsort(axis=1, kind="stable")[:, :n]
    own, probed = near(2), near(3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in range(400):
        rows = np.flatnonzero(np.isin(own, probed[q]).any(axis=1))
        assert got[q] == rows[np.lexsort((rows, -np.round(unit[rows] @ unit[q], 9)))][:12].tolist()


def test_queries_with_many_lists_left_are_compared_in_few_large_blocks(spark, monkeypatch):
    """Vectors without clusters: probes hold a query's vector for ten lists at most, not for all of them."""
    ship(spark)
    x = np.random.default_rng(6).normal(size=(600, 32))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    lists, centres = L.balanced_lists(v, 8)
    rows, stored = [], L._stored

    def counted(df, label):
        out = stored(df, label)
        if label == "probes":
            rows.append(out.count())
        return out

    monkeypatch.setattr(L, "_stored", counted)
    found, _ = L.similar_through_lists(lists, centres, v.select(F.col("id").alias("query_id"), "vec"), 5)
    assert centres.count() > 43 and sum(rows) <= 600 * (10 + L.WIDE_LISTS)
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -2)
    best = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert got == {(q, r + 1): int(best[q, r]) for q in range(600) for r in range(5)}


def test_queries_without_near_lists_leave_after_the_first_round(spark, monkeypatch):
    """vectors without clusters were probed in both rounds before all rows were compared with them, and pairs of blocks shared tasks."""
    ship(spark)
    x = np.random.default_rng(8).normal(size=(700, 32))
    x[690:] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    lists, centres = L.balanced_lists(v, 8)
    probes, tasks, stored, all_ = [], [], L._stored, L.best_of_all

    def counted(df, label):
        out = stored(df, label)
        if label == "probes":
            probes.append(out.count())
        return out

    def every(corpus, queries, *more):
        assert "reach" in queries.columns and queries.where("reach > 0").count() > 600
        tasks.append(all_(corpus, queries, *more))
        return tasks[-1]

    monkeypatch.setattr(L, "_stored", counted)
    monkeypatch.setattr(L, "best_of_all", every)
    monkeypatch.setattr(L, "QUERY_BLOCK", 128)
    found, compared = L.similar_through_lists(lists, centres, v.select(F.col("id").alias("query_id"), "vec"), 5)
    assert probes[0] == 2 * 700 and sum(probes[1:]) < 700  # the copies stay in their list
    assert [df.rdd.getNumPartitions() for df in tasks] == [36]
    assert _found(found) == _brute(x, range(700), 5)
    assert sum(r.pairs for r in compared.collect()) < 1.2 * 700 * 700


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """F1: each pair was rounded and ranked in double precision; now those that single precision, with a slack, leaves."""
    from strata.operators import search as S

    rnd = np.random.default_rng(9)
    scored, merge = [], S._Best._merge

    def counted(self, row, *more):
        scored.append(len(row))
        merge(self, row, *more)

    monkeypatch.setattr(S._Best, "_merge", counted)
    for case, n, dim, k in (("plain", 3000, 48, 10), ("ties", 1500, 3, 7), ("equal", 700, 8, 5), ("many", 900, 16, 300), ("near", 2500, 24, 10)):
        x = rnd.integers(-1, 2, (n, dim)).astype(float) if case == "ties" else rnd.normal(size=(n, dim))
        if case == "equal":
            x[100:] = x[100]
        if case == "near":
            x[:1200] = x[0] + 1e-9 * x[:1200]  # closer than single precision tells
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        ids, score = rnd.permutation(n), np.round(np.einsum("id,jd->ij", x, x), 9)
        np.fill_diagonal(score, -np.inf)
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        want = np.take_along_axis(score, order, axis=1)
        for reach in (None, want[:, -1].copy(), np.where(ids % 3 > 0, want[:, -1], -2.0)):
            scored.clear()
            best = S._Best(k, True, ids, x, reach)
            for lo in range(0, n, S.CORPUS_SLICE):
                best.add(ids[lo : lo + S.CORPUS_SLICE], x[lo : lo + S.CORPUS_SLICE])
            assert np.abs(best.place - want).max() < 2e-9
            if case == "plain":
                assert (best.ids == ids[order]).all() and best.rows().num_rows == n * k
                assert sum(scored) < 0.04 * n * n
            if case == "ties":
                assert (best.ids == ids[order]).all()

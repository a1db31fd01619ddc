"""Near-duplicates against brute force on a large group of near copies and a frequent passage, and edge rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strata.llm import near_dedup
from strata.plans.session import ship


def _texts(copies: int, sharing: int) -> list[str | None]:
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(120)]
    out: list[str | None] = []
    for _ in range(copies):
        text = list(base)
        for at in rnd.sample(range(200), rnd.choice((1, 2, 3, 4, 5, 6, 9))):
            text[at] = word()
        out.append(" ".join(text))
    for _ in range(sharing):
        out.append(" ".join([*(word() for _ in range(rnd.randint(20, 120))), *passage]))
    out += [" ".join(word() for _ in range(150)) for _ in range(40)]
    return out


def _brute(texts, size: int, percent: int) -> list[int]:
    column: dict[tuple, int] = {}
    rows = []
    for t in texts:
        w = (t or "").lower().split()
        rows.append({column.setdefault(tuple(w[k : k + size]), len(column)) for k in range(len(w) - size + 1)})
    x = np.zeros((len(texts), len(column)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, list(r)] = 1
    both, n = x @ x.T, x.sum(axis=1)
    alike = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (n[:, None] > 0) & (n[None, :] > 0)
    label = np.arange(len(texts))
    while True:
        least = np.minimum(label, np.where(alike, label[None, :], len(texts)).min(axis=1))
        if (least == label).all():
            return label.tolist()
        label = least


@pytest.mark.parametrize("defaults", [(16, 512), (2, 64)])
def test_large_group_of_near_copies(spark, defaults):
    ship(spark)
    texts = _texts(2000, 400) if defaults[1] == 512 else _texts(300, 200)
    rnd = random.Random(1)
    ids = rnd.sample(range(10**6), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(6)
    before = near_dedup.near_duplicate_links.__defaults__
    near_dedup.near_duplicate_links.__defaults__ = defaults
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, size=3, percent=85).collect()}
    finally:
        near_dedup.near_duplicate_links.__defaults__ = before
    groups: dict[int, list[int]] = {}
    for i, label in zip(ids, _brute(texts, 3, 85)):
        groups.setdefault(label, []).append(i)
    assert got == {i: min(g) for g in groups.values() for i in g}


def test_odd_ids_empty_tables_and_clashing_names(spark):
    ship(spark)
    rows = [(None, "a b c d e f", 1), ("7", "a b c d e f", 2), ("9", "A B c d e f", 3), (None, "a b c d e f", 4), ("11", None, 5), ("12", "", 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, key int").withColumnRenamed("key", "a.b")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(docs).collect()}
    assert got == {(None, None, True), (7, 7, True), (9, 7, False), (11, 11, True), (12, 12, True)}
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0 and near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_rarest_values_are_few_and_shared_and_frequent_ones_are_no_keys(spark):
    ship(spark)
    bound, rng = near_dedup.distance_bound(0.85), np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (300, near_dedup.SYMBOLS)).astype(np.uint16)
    sig[:200, :20] = sig[0, :20]  # a passage that many have
    for i in range(200, 300, 2):
        sig[i + 1] = sig[i]
        sig[i + 1, rng.permutation(near_dedup.SYMBOLS)[:bound]] += 1
    reps = spark.createDataFrame([(i, 50, bytearray(x.tobytes())) for i, x in enumerate(sig)], "doc_id long, n_shingles long, signature binary")
    hot = spark.createDataFrame([(i, i) for i in range(300)], "doc_id long, component long")
    rows = near_dedup._rarest_values(hot, 300, reps, bound).collect()
    assert len(rows) == 300 * (bound + 1) and all(r.component == r.doc_id for r in rows)
    keys: dict[int, set] = {}
    for r in rows:
        keys.setdefault(r.doc_id, set()).add(r.key)
    assert all(keys[i] & keys[i + 1] for i in range(200, 300, 2))
    assert not set.intersection(*(keys[i] for i in range(200)))
    common = near_dedup._values(near_dedup.pa.array([sig[0].tobytes()]))[0, :20].view(np.int64).tolist()
    assert not any(set(common) & keys[i] for i in range(200))


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    ship(spark)
    labels, stored = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: labels.append(label) or stored(df, label))
    links = spark.createDataFrame([(1, 5), (7, 1), (2, 9), (3, 3)], "a long, b long")
    assert {tuple(r) for r in near_dedup.components(links).collect()} == {(5, 1), (7, 1), (9, 2)} and labels == ["links"]
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 41), (50, 42)], "a long, b long")
    assert {tuple(r) for r in near_dedup.components(links).collect()} == {(i, 1) for i in range(2, 41)} | {(42, 41), (50, 41)}

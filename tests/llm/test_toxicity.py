"""Toxicity: voters by hand, the label model against planted votes, and held-out scores; nulls, empty tables, long texts, clashing columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import toxicity as T
from strata.plans.session import ship


def _votes(voters, texts):
    out = [None] * len(texts)
    for row, votes, _, _ in voters.votes(pa.array(texts, pa.string())):
        for i, v in enumerate(voters.matrix(votes)):
            out[row + i] = {n for n, x in zip(voters.names, v) if x}
    return out


def test_voters():
    voters = T.Voters(["zork", "blar*", "ñam*"])
    texts = [
        "You IDIOT, idiot!", "zork blarney ZORK", "blar blar", "ñamba zorks", "f#&k this", "sooooo nice", "STOP SHOUTING AT ALL OF US NOW PLEASE", "Wow!! No!! Go!!", None, "", "a plain text", "xx#$", "%%yy aaa", "aa", "x" * 300_000 + " idiot",
    ]
    got = _votes(voters, texts)
    base = {"no_word_of_any_list"}
    assert got[0] == {"en_mind", "de", "fr", "lexicon_twice", "second_person"} | {"exclaiming"}
    assert got[1] == {"zork", "blar*", "mined_twice"} and got[2] == base and got[3] == {"ñam*"}
    assert got[4] == {"masked_word"} | base and got[5] == {"stretched_word"} | base and "shouting" in got[6] and "exclaiming" in got[7]
    assert got[8:13] == [base] * 5 and got[13] == base  # patterns don't run from one text into the next
    assert got[14] == {"en_mind", "de", "fr", "stretched_word"}
    with pytest.raises(ValueError):
        T.Voters([f"w{i}" for i in range(64)])


def _planted(n, seed=1):
    """(votes, class): independent voters of known accuracy, a copy of the first, and one that fires at random."""
    rnd = np.random.default_rng(seed)
    y = (rnd.random(n) < 0.2).astype(int)
    p = np.array([[0.02, 0.8], [0.1, 0.6], [0.05, 0.5], [0.3, 0.3]])
    x = (rnd.random((n, 4)) < p[:, y].T).astype(int)
    copy = np.where(rnd.random(n) < 0.97, x[:, 0], 1 - x[:, 0])
    return np.column_stack([x, copy]), y


def test_label_model_finds_accuracies_and_correlations(spark):
    ship(spark)
    x, y = _planted(20_000)
    rows = [(int(v @ (1 << np.arange(5))), int(c) if i % 10 == 0 else None, 1) for i, (v, c) in enumerate(zip(x, y))]
    patterns = spark.createDataFrame(rows, "votes long, label int, n long").groupBy("votes", "label").agg(F.sum("n").alias("n"))
    model = T.fit_label_model(patterns.repartition(5), 5)
    assert model.prior[1] == pytest.approx(0.2, abs=0.02)
    for j in range(5):
        assert model.accuracy[j] == pytest.approx(y[x[:, j] == 1].mean(), abs=0.04)
    want = np.stack([np.corrcoef(x[y == c].T) for c in (0, 1)])
    assert np.abs(model.correlation - want).max() < 0.12 and model.correlation[0, 0, 4] > 0.4
    assert 4 in (model.parent[0], *np.flatnonzero(model.parent == 0)) or model.parent[4] == 0
    p = model.posterior(x.astype(float), np.full(len(x), -1))
    independent = T.LabelModel(model.prior, model.label, np.full(5, -1), np.repeat(((np.einsum("yii->yi", model.both) + 1) / (model.total[:, None] + 2))[:, :, None], 2, axis=2), model.both, model.total)
    naive = independent.posterior(x.astype(float), np.full(len(x), -1))
    loss = lambda q: -np.mean(np.log(np.where(y == 1, q, 1 - q).clip(1e-9)))
    assert loss(p) < loss(naive)  # a copied voter counts once
    whole = T.fit_label_model(patterns.coalesce(1), 5)
    assert whole.prior == pytest.approx(model.prior) and whole.fire == pytest.approx(model.fire)


def test_posterior_is_the_joint_distribution():
    x, y = _planted(500)
    both = np.stack([x[y == c].T @ x[y == c] for c in (0, 1)]).astype(float)
    total = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
    model = T.LabelModel.of_sums(total, both, np.array([[400.0, 4.0], [2.0, 90.0]]))
    for votes in ([0, 0, 0, 0, 0], [1, 0, 1, 0, 1], [1, 1, 1, 1, 0]):
        for label in (-1, 0, 1):
            joint = []
            for c in (0, 1):
                q = model.prior[c]
                for j, v in enumerate(votes):
                    fire = model.fire[c, j, votes[model.parent[j]] if model.parent[j] >= 0 else 0]
                    q *= fire if v else 1 - fire
                q *= 1 if label < 0 else model.label[c] if label else 1 - model.label[c]
                joint.append(q)
            assert model.posterior(np.array([votes], float), np.array([label]))[0] == pytest.approx(joint[1] / sum(joint))


@pytest.fixture(scope="module")
def corpus():
    """Texts of invented words; toxic ones have words of a list, or words that begin like no clean one, and some labels are wrong."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["an", "re", "ti", "on", "es", "lo", "mi"]) for _ in range(rnd.randint(1, 4)))
    docs, labels, truth = [], [], {}
    for i in range(900):
        words = [word() for _ in range(rnd.choice([20, 60, 400]))]
        toxic = int(rnd.random() < 0.15)
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron"]) if i % 2 else "vluk" + word()
        docs.append((i, " ".join(words)))
        truth[i] = toxic
        if rnd.random() < 0.6:
            labels.append((i, toxic if rnd.random() > 0.02 else 1 - toxic))
    return docs, labels, truth


def _auc(scores, truth):
    pos, neg = ([s for s, t in zip(scores, truth) if t == v] for v in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_scores(spark, corpus):
    ship(spark)
    docs, labels, truth = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("held", T.held_out(F.col("doc_id")))
    model = T.fit_toxicity(table.where("not held"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(m.startswith("vluk") for m in model.voters.mined)
    found = model.score(table).collect()
    assert {r.doc_id for r in found if r.held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    own = [r for r in found if r.held]
    assert _auc([r.score for r in own], [truth[r.doc_id] for r in own]) > 0.97
    wrong = sum((r.score >= T.THRESHOLD) != truth[r.doc_id] for r in own)
    assert wrong <= 0.05 * len(own) and all(0 <= r.score <= 1 for r in found)


def test_scores_keep_rows_and_columns(spark, corpus):
    ship(spark)
    docs, labels, _ = corpus
    table = spark.createDataFrame(docs[:300], "doc_id long, text string")
    odd = spark.createDataFrame([(None, "you idiot moron"), (None, None), (5, "you idiot moron"), (5, "you idiot moron"), (6, ""), (7, "so " * 200_000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, 0), (0, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = T.fit_toxicity(table.union(odd), marks)
    wide = odd.select(F.col("doc_id").alias("a.id"), "text", F.lit(9).alias("score"), F.lit(2).alias("row"), F.lit(3).alias("label"))
    out = model.score(wide)
    assert out.columns == ["a.id", "text", "row", "label", "score"]
    rows = out.collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.text == "you idiot moron"}) == 1 and {r.row for r in rows} == {2}
    assert len({r.score for r in rows if not r.text}) == 1 and min(r.score for r in rows if r.text == "you idiot moron") > max(r.score for r in rows if not r.text)


def test_nothing_to_learn_from(spark, corpus):
    ship(spark)
    docs, _, _ = corpus
    table = spark.createDataFrame(docs[:80], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit_toxicity(table.where("false"), none).score(table).select("score").distinct().collect() == [(0.5,)]
    unlabelled = T.fit_toxicity(table, none)
    assert unlabelled.voters.mined == [] and unlabelled.score(table).count() == 80 and unlabelled.score(table.where("false")).count() == 0

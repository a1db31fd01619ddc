"""Spelling variants against brute force, with nulls, long words, ties, several passes of the filters and chains of forms."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from strata.llm import spelling as S
from strata.plans.session import ship

ALPHABET = "abcéÀ÷ÿ"


def _edits(w):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    return out | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ALPHABET} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in ALPHABET}


def _brute(words):
    out = {}
    for w, n in words.items():
        near = sorted((-words[e], e) for e in _edits(w) - {w} if e in words)
        ok = near and -near[0][0] >= 2 * n
        out[w] = (near[0][1] if ok else None, n, len(near), -near[0][0] if ok else None)
    root = {w: w for w in words}
    for w in words:
        while out[root[w]][0]:
            root[w] = out[root[w]][0]
    return {w: (v[0], root[w], *v[1:]) for w, v in out.items()}


def _found(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(5)
    out = {"".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(5, 7))): rnd.choice([3, 5, 6, 10, 12, 40, 80]) for _ in range(400)}
    out |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "aaaaaaaaa": 48, "aaaaaaaaaa": 96, "aaaaaaaaaaa": 192, "aaaaaaaaaaaa": 400}
    return out | {"ab" * 70: 9, "ab" * 69 + "a": 20, "c" * 3000: 4, "c" * 3001: 8, "c" * 1500 + "a" + "c" * 1499: 3}


@pytest.mark.parametrize("filter_bytes", [S.FILTER_BYTES, 600])
def test_variants_equal_brute_force(spark, words, filter_bytes):
    ship(spark)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert _found(S.spelling_variants(table, filter_bytes=filter_bytes)) == _brute(words)
    assert S.Filters(Counter(map(len, words)), 600).passes > 1


def test_false_positives_are_removed(spark, words, monkeypatch):
    ship(spark)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(S.Filters.__init__, "__defaults__", (1,))  # one bit a word: most edits pass the filters
    assert _found(S.spelling_variants(table)) == _brute(words)


def _mistyped(i, w):
    h = zlib.crc32(f"{i}:{w}".encode())
    k = h % len(w)
    return w[:k] + w[k + 1 :] if i is not None and h % 7 == 0 else w


@pytest.mark.parametrize("mistype", [0, 7])
def test_vocabulary(spark, mistype):
    ship(spark)
    rnd = random.Random(6)
    pool = ["".join(rnd.choice("abCÉéÿ") for _ in range(rnd.randint(3, 9))) for _ in range(60)] + ["L" * 90 + "é", "naïve", "ĀbcdeĀ", "x×÷yz", "Étude"]
    texts = [rnd.choice([" ", "-", "1", "\n", "œ", "Ā"]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(60)] + [None, "", "12", "z" * 200_000]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, texts[0], 5), (1, texts[1], 5), (1, texts[2], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    wanted = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            w = _mistyped(i, w) if mistype else w
            wanted[w] += len(w) >= 5
    assert {r.word: r.n for r in S.vocabulary(docs, mistype=mistype).collect()} == {w: n for w, n in wanted.items() if n >= 3}


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    table = [b"apple pears apple grape", b"grape"]
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(S.ws, "span_hashes", lambda low, start, end, value: np.zeros(len(start), np.uint64) if value[0] == S.ws.keyed(256, 7)[0] else start.astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([x.decode() for x in table])], names=["text"])
    got = Counter()
    for b in S._count(0, 5)([batch]):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == {"apple": 2, "pears": 1, "grape": 2}


def test_empty_tables(spark):
    ship(spark)
    assert S.spelling_variants(S.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=1)

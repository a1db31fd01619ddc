"""Each stage of the pipeline after language ID, and run(), against brute force on whole tables."""

from __future__ import annotations

import re

import pytest

from strata.llm.shared import table
from strata.plans.session import ship


def _near(docs):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if top(i) == i}


def _substring(docs):
    first = {}
    for i in sorted(docs):
        w = (docs[i] or "").encode().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, t in docs.items():
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t
    return out


def _clean(docs, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    known = {}
    for t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(n, set()).add(tuple(w[k : k + n]))
    hit = lambda w: any(tuple(w[k : k + n]) in own for n, own in known.items() for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not hit(words(t))}


def test_stages_and_run_equal_brute_force(spark, sf):
    import corpus_pipeline

    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ship(spark)
    docs = corpus_pipeline.language_stage(spark, table(spark, sf, "documents"), sf)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    now = read(docs)
    wants = [_near, _substring, lambda d: _clean(d, [r.text for r in table(spark, sf, "benchmark").collect()])]
    for (name, _), want in zip(corpus_pipeline.STAGES[1:4], wants):
        now = want(now)
        docs = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
        assert read(docs) == now, name
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, list(r.ids), r.text) for r in rows} == {i: (len(ids), ids, t or "") for i, t in now.items() for ids in [sp.encode(t or "")]}

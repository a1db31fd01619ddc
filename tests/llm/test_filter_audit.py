"""The filter audit against brute force over all orders, with nulls, ties, shared ids, long texts and clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def _fails(rows):
    out = []
    for i, _, text in rows:
        t = text or ""
        w = _words(t)
        smaller = any(i is not None and j is not None and j < i and (u or "") == t for j, _, u in rows)
        out.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller})
    return out


def _brute(rows, labels):
    fails, good, toxic = _fails(rows), {}, {}
    for i, q, t in labels:
        good[i], toxic[i] = max(good.get(i, 0), int(q == 1)), max(toxic.get(i, 0), int(t == 1))
    out = {}
    for part in {r[1] or "" for r in rows}:
        own = [(f, good.get(r[0], 0), toxic.get(r[0], 0)) for f, r in zip(fails, rows) if (r[1] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [o for o in left if o[0][x]]
                left = [o for o in left if not o[0][x]]
                share[x] += len(gone)
                alone = sum(o[0][x] and sum(o[0].values()) == 1 for o in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(o[0][x] for o in own) - len(gone), alone, sum(o[1] for o in gone), sum(o[2] for o in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = lambda n, pool: " ".join(rnd.choice(pool) for _ in range(n))
    many = [f"w{i}" for i in range(900)]
    texts = [words(300, many), words(300, ["a", "b"]), words(10, many), words(250, ["X", "Yé", *many]).upper(), "#" + words(220, many), "", None, " \t\r\n", "é" * 300, words(30_000, many), "|", words(199, many), words(200, many)]
    out = [(i, rnd.choice(["s", "t", None, ""]), rnd.choice(texts)) for i in range(60)]
    return [*out, (None, "s", texts[0]), (None, "u", texts[0]), (3, "t", texts[2]), (3, "t", texts[2]), (7, "s", texts[0])]


def test_audit_equals_brute_force(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 1, 1), (6, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(i, p, t, 9, 1) for i, p, t in rows], "doc_id long, source string, text string, n int, fails int").repartition(3)
    found = A.audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found} == _brute(rows, labels)
    assert len(found) == 600 * len({p or "" for _, p, _ in rows})


def test_a_hot_text_and_no_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    first = A.audit_filters(docs, labels).where("step = 1 and filter_order like 'E%'").first()
    assert (first.removed, first.kept, first.unique_fails, first.shapley) == (1333, 2667, 0, 120 * 1333 // 2)
    assert A.audit_filters(docs.where("false"), labels).count() == 0


def test_lattice_counts_paths(spark):
    for k in (1, 3, 5):
        edges = A.lattice(k)
        assert len(edges) == k << (k - 1) and all(a * b == math.factorial(bin(s).count("1")) * math.factorial(k - 1 - bin(s).count("1")) for s, _, a, b in edges)
        assert sum(a * b for s, f, a, b in edges if f == 0) == math.factorial(k)
    masks = spark.createDataFrame([("p", 0b11, 6, 1, 0), ("p", 0b01, 2, 0, 0), ("p", 0, 5, 0, 0), ("p", 0b110, 4, 0, 2)], "part string, fails int, n long, good long, toxic long")
    shares = {r["filter"]: r.removed for r in A.shapley_sums(A.edge_counts(masks, 3), "xyz").collect()}
    assert shares == {"x": 3 * 6 + 6 * 2, "y": 3 * 6 + 3 * 4, "z": 3 * 4}
    with pytest.raises(ValueError):
        A.order_steps(A.edge_counts(masks, 3), "abcdefgh")

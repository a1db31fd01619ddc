"""Streaming piece search for scored pieces, refused models, span pools, and what token files keep for readers."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strata.llm import piece_coding, token_files
from strata.llm.idpool import IdPool
from strata.llm.shared import new_path
from strata.plans.session import ship


def _best(model, text):
    """The best segmentation over all of them, position by position, from the whole text at once."""
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = model.ids.get(text[start:end])
            if piece is None and end - start > 1:
                continue
            own = [piece] if piece is not None else [model.byte_ids[x] for x in text[start].encode()]
            total = best[start][0] + (model.scores[piece] if piece is not None else model.byte_score)
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + own)
    return best[-1][1]


def test_scored_pieces_equal_the_best_of_all_paths():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abc▁") for _ in range(rnd.randint(1, 5))) for _ in range(90)} | set("abc▁"))
    pieces = words + [f"<0x{k:02X}>" for k in range(256)]
    scores = {i: -len(words) / 7 - rnd.random() * 9 for i in range(len(words))}
    model = piece_coding.PieceModel.unigram(pieces, scores, [len(words) + k for k in range(256)])
    encoder = piece_coding.StreamingEncoder(model)
    for _ in range(200):
        text = "".join(rnd.choice("aabbcc▁▁é😀") for _ in range(rnd.randint(0, 120)))
        want = _best(model, text)
        assert encoder.encode(text) == want
        out: list[int] = []
        for k in range(0, len(text), 11):
            out += encoder.feed(text[k : k + 11])
        assert out + encoder.finish() == want
    early = encoder.feed("abcab▁" * 3000)
    assert len(early) > 5000 and len(encoder.back) < 200 and len(encoder.total) < 200


def _message(*fields):
    out = b""
    for number, value in fields:
        out += _tag(number, 2) + _varint(len(value)) + value if isinstance(value, bytes) else _tag(number, 0) + _varint(value)
    return out


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _tag(number, kind):
    return _varint(number * 8 + kind)


@pytest.mark.parametrize(
    "trainer, normal, piece, message",
    [(((3, 2),), ((4, 0),), 1, "no bytes"), (((3, 3), (35, 1)), ((4, 0),), 1, "only unigram"), (((3, 1), (35, 1)), ((4, 1),), 1, "identity"), (((3, 2), (35, 1)), ((2, b"x"), (4, 0)), 1, "identity"), (((3, 2), (35, 1), (24, 1)), ((4, 0),), 1, "after a word"), (((3, 2), (35, 1)), ((4, 0),), 4, "user-defined")],
)
def test_models_that_the_search_does_not_follow_are_refused(trainer, normal, piece, message):
    proto = lambda t, n, p: _message((1, _message((1, b"a"), (3, p))), (2, _message(*t)), (3, _message(*n)))
    with pytest.raises(ValueError, match=message):
        piece_coding.model_kind(proto(trainer, normal, piece))
    assert piece_coding.model_kind(proto(((3, 1), (35, 1)), ((1, b"identity"), (4, 0)), 1)) == "unigram"


def test_pool_checks_its_hits():
    pool = IdPool(lambda spans: [[len(s), s[0]] for s in spans])
    data = np.frombuffer(b"aabbbc", dtype=np.uint8)
    start, end = np.array([0, 2, 5]), np.array([2, 5, 6])
    same = np.array([9, 9, 9], dtype=np.uint64)
    ids, count = pool.ids_of(same, np.array([1, 2, 3], dtype=np.uint64), start, end, data)
    assert ids.tolist() == [2, 97, 3, 98, 1, 99] and count.tolist() == [2, 2, 2]


def test_token_files_prune_and_split(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    orc = pytest.importorskip("pyarrow.orc")
    import glob

    ship(spark)
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('word ', id) as text")
    path = new_path(spark, "orc")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), partitions=3)
    found = sorted(glob.glob(path.removeprefix("file:") + "/*.orc"))
    parts = [orc.ORCFile(f) for f in found]
    assert len(parts) == 3 and sum(p.nrows for p in parts) == 20_000 and all(p.row_index_stride == 1000 for p in parts)
    assert all(b"doc_id" in open(f, "rb").read() for f in found)
    ranges = [(ids[0].as_py(), ids[-1].as_py()) for ids in (p.read(columns=["doc_id"]).column(0) for p in parts)]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # files in ascending id order
    few = token_files.look_up(spark, path, [5, 19_999, 10**9])
    assert "In(doc_id" in few._jdf.queryExecution().toString() and sorted(r.doc_id for r in few.collect()) == [5, 19_999]
    # Row groups that cannot hold the ids are not read: the scan gives some groups of 1000 rows, not all rows.
    plan = few._jdf.queryExecution().executedPlan()
    few._jdf.queryExecution().toRdd().count()
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 4_000


def test_token_files_of_edge_rows(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ship(spark)
    rows = [(None, "a"), (None, None), (3, "b c"), (3, "b c"), (2, ""), (1, "é" * 200_000)]
    path = new_path(spark, "orc")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as `d.id`", "text", "1 as ids")
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), id_col="d.id")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens) for r in token_files.token_file_index(spark, path).collect())
    assert [g[0] for g in got] == [-1, -1, 1, 2, 3, 3] and got[0][1] == 0 and got[0][2] == 1
    assert [g[1] for g in sorted(got, key=lambda g: g[1])] == [sum(x[2] for x in sorted(got, key=lambda g: g[1])[:k]) for k in range(6)]
    token_files.write_token_files(docs.limit(0), path + "-none", public_tokenizers.path("word_bpe_49k.json"), id_col="d.id")
    assert token_files.token_file_index(spark, path + "-none").count() == 0


@pytest.mark.parametrize("lower", [False, True])
def test_tokenizers_that_take_no_spans_get_whole_texts(spark, tmp_path, lower):
    """A word tokenizer that keeps case, and one whose words have signs inside."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    ship(spark)
    t = Tokenizer(models.WordLevel({"?": 0, "Apple": 1, "apple": 2, "a.b": 3, "pie": 4}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    if lower:
        t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "t.json"))
    texts = ["Apple apple pie", "a.b pie", "", None, "pie " * 5000, "apple a.b"]
    path = new_path(spark, "tokens")
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, str(tmp_path / "t.json"), end_id=9)
    found = {r.doc_id: r.ids for r in token_files.read_token_files(spark, path).collect()}
    assert found == {i: [*t.encode(x or "").ids, 9] for i, x in enumerate(texts)}
    assert found[0] == ([2, 2, 4, 9] if lower else [1, 2, 4, 9]) and found[1] == [3, 4, 9]


def test_spans_are_used_for_the_known_tokenizer_only():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import json

    known = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    assert token_files.splits_at_spans(json.dumps(known))
    known["normalizer"]["normalizers"].pop()
    assert not token_files.splits_at_spans(json.dumps(known))
    assert not token_files.splits_at_spans(json.dumps(json.load(open(public_tokenizers.path("byte_bpe_50k.json")))))


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_ids_are_committed_where_all_paths_meet(kind):
    """Long texts: ids come out while the text goes in, what is kept stays small, and a look costs a window."""
    rnd = random.Random(7)
    pieces = ["a", "b", "ab", "ba", "c", "cab", "▁", "▁c"] + [f"<0x{k:02X}>" for k in range(256)]
    if kind == "unigram":
        model = piece_coding.PieceModel.unigram(pieces, {i: -1.0 - i / 10 for i in range(8)}, [8 + k for k in range(256)])
    else:
        public_tokenizers = pytest.importorskip("public_tokenizers")
        model = piece_coding.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoder, out, early, most = piece_coding.StreamingEncoder(model), [], 0, 0
    text = "".join(rnd.choice("abc▁") for _ in range(6000))
    for k in range(0, len(text), 50):
        out += encoder.feed(text[k : k + 50])
        early, most = max(early, len(out)), max(most, len(encoder.back))
    out += encoder.finish()
    assert out == piece_coding.StreamingEncoder(model).encode(text)
    assert early > 0.9 * len(out) and most < 12 * model.longest + 100


def test_paths_that_never_meet_take_linear_time():
    """Two paths through abab... of equal scores run side by side to the end."""
    import time

    pieces = ["a", "b", "ab", "ba"] + [f"<0x{k:02X}>" for k in range(256)]
    model = piece_coding.PieceModel.unigram(pieces, {0: -3.0, 1: -3.0, 2: -1.0, 3: -1.0}, [4 + k for k in range(256)])
    took = []
    for n in (20_000, 160_000):
        start = time.process_time()
        assert piece_coding.StreamingEncoder(model).encode("ab" * (n // 2)) == [2] * (n // 2)
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0]

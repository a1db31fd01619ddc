"""Empty tables, null and odd ids, ties, long texts, and odd column names of the text operators."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm import chat_format, decontamination, hamming_search, language_id, near_dedup, piece_coding, substring_dedup, url_filter
from strata.llm.shared import table
from strata.plans.session import ship

EVENT = "conv_id long, message long, seq long, kind string, role string, text string"


def test_empty_tables(spark):
    ship(spark)
    none = lambda schema: spark.createDataFrame([], schema)
    entries = "scope string, key string, action string, day int"
    assert url_filter.filter_urls(none("id int, url string, d int"), none(entries), "id", "url", "d").count() == 0
    some = spark.createDataFrame([(1, "http://a.org/", 3)], "id int, url string, d int")
    assert url_filter.filter_urls(some, none(entries), "id", "url", "d").first().n_active == 0
    codes = spark.createDataFrame([(1, 5)], "id long, code long")
    asked = codes.select(F.col("id").alias("query_id"), "code")
    assert hamming_search.hamming_topk(codes.limit(0), asked).count() == 0 and hamming_search.hamming_topk(codes, asked.limit(0)).count() == 0
    assert hamming_search.hamming_topk(codes, asked).count() == 0
    folded = chat_format.fold_events(none(EVENT))
    assert folded.count() == 0 and chat_format.conversation_digests(chat_format.render(folded)).count() == 0 and chat_format.conversation_documents(chat_format.render(folded)).count() == 0
    profiles = language_id.language_profiles(spark.createDataFrame([("a b", "x")], "text string, lang string"))
    assert language_id.identify(none("id int, text string"), profiles).count() == 0
    public_tokenizers = pytest.importorskip("public_tokenizers")
    model = piece_coding.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert piece_coding.code_pieces(none("doc_id long, text string"), model).count() == 0
    odd = spark.createDataFrame([(None, "hi"), (None, None), ("5", "x" * 100_000)], "id string, text string").select(F.col("id").alias("a.id"), "text", F.lit(1).alias("ids"))
    assert sorted((r.doc_id or 0, len(r.decoded)) for r in piece_coding.code_pieces(odd, model, id_col="a.id").collect()) == [(0, 0), (0, 2), (5, 100_000)]


def test_ids_that_are_no_integers_are_errors_and_not_nulls(spark):
    """Near copies under such ids must not pass through undeduplicated without a word."""
    ship(spark)
    docs = spark.createDataFrame([(f"doc-{x}", "one two three four five six " * 20) for x in "abc"], "doc_id string, text string")
    benchmark = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    for run in (near_dedup.near_dedup, near_dedup.drop_near_duplicates, substring_dedup.substring_dedup, substring_dedup.remove_repeats):
        with pytest.raises(Exception, match="is no integer: doc-"):
            run(docs).collect()
    assert decontamination.decontaminate(docs.union(spark.createDataFrame([("doc-d", "one")], docs.schema)), benchmark).collect() == [("doc-d", "one")]  # judges rows, not ids
    numbered = docs.withColumn("doc_id", F.xxhash64("doc_id"))
    assert near_dedup.drop_near_duplicates(numbered).count() == 1


def test_languages_over_several_passes_ties_and_columns(spark):
    ship(spark)
    taught = spark.createDataFrame([("aab", "bb"), ("aab", "aa"), ("xyz zyx", "cc"), ("quq", "dd")], "text string, lang string")
    profiles = language_id.language_profiles(taught)
    docs = spark.createDataFrame([(1, "aab", "old"), (1, "zyx", "old"), (2, "quq " * 100_000, None), (None, None, "old"), (3, "", "x")], "id long, text string, lang_pred string").withColumn("a.b", F.lit(7)).withColumn("row", F.lit(8))
    wide = language_id.identify(docs, profiles)
    assert wide.columns == ["id", "text", "a.b", "row", "lang_pred", "score"]
    key = lambda df: sorted((str(r.text)[:3], r.lang_pred, r.score, r["a.b"], r.row) for r in df.collect())
    assert key(wide) == key(language_id.identify(docs, profiles, languages=1)) == key(language_id.identify(docs, profiles, languages=3))
    assert [x[1] for x in key(wide)] == ["und", "und", "aa", "dd", "cc"]  # equal distances: the first language in order


def test_op10_equals_brute_force(spark, sf):
    ship(spark)
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        padded = f" {' '.join(words)} "
        return collections.Counter(g for n in (1, 2, 3) for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) != " ") if words else None

    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:400]]
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and (c := grams(r.text)):
            counts[r.lang].update(c)
    place = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in counts.items()}
    want = {}
    for r in rows:
        c = grams(r.text)
        if not c:
            want[r.doc_id] = (held[r.doc_id], "und", 0.0)
            continue
        own = ranked(c)
        d, lang = min((sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)), lang) for lang, p in place.items())
        want[r.doc_id] = (held[r.doc_id], lang, pytest.approx(max(0.0, 1 - d / (400 * len(own)))))
    assert {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.op10_language_id(spark, sf).collect()} == want


def test_chat_logs_fold_back_to_their_turns(spark):
    ship(spark)
    turns = [(c, t, r, x) for c in range(12) for t, r, x in ((0, "user", f"héllo <|im_end|> {c}"), (1, "assistant", "😀" * (c + 1)), (1, "assistant", "other"), (None, "system", None), (2, "assistant", ""))]
    turns += [(None, 0, "user", "no conversation"), (None, 0, "user", "no conversation"), (77, 0, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat_format.conversation_events(df)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == {"create", "delta", "regenerate", "edit", "delete"}
    shuffled = log.orderBy(F.xxhash64("message", "seq", "text"))
    rendered = chat_format.render(chat_format.fold_events(shuffled))
    want = collections.defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda y: (y[0] is None, y[0] or 0, y[1] is not None, y[1] or 0, y[2], y[3] or "")):
        want[c].append((r, x or ""))
    docs = {r.conv_id: r for r in chat_format.conversation_documents(rendered).collect()}
    for r in chat_format.conversation_digests(rendered).collect():
        own, doc = want[r.conv_id], docs[r.conv_id]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        learned = [b for a, b in own if a == "assistant"]
        assert [chat_format.unescape(doc.formatted[m.start : m.end]) for m in doc.mask] == learned
        assert (r.loss_chars, r.formatted_chars) == (sum(map(len, learned)), len(doc.formatted))
    assert set(docs) == set(want)


def test_events_of_equal_place_apply_in_a_fixed_order(spark):
    ship(spark)
    events = [(1, 0, 0, "create", "user", "a"), (1, 0, 1, "delta", None, "c"), (1, 0, 1, "delta", None, "b"), (1, 0, 1, "delta", None, "b"), (None, 0, 0, "create", "user", "n")]
    for parts in (1, 3):
        got = {(r.conv_id, r.text) for r in chat_format.fold_events(spark.createDataFrame(events, EVENT).repartition(parts)).collect()}
        assert got == {(1, "abbc"), (None, "n")}


def test_captures_with_odd_columns(spark):
    ship(spark)
    entries = spark.createDataFrame([("host", "a.org", "block", "3"), ("host", "a.org", "allow", "x"), ("host", "a.org", "block", "3")], "scope string, key string, action string, day string")
    caps = spark.createDataFrame([("p", "http://a.org/" + "x" * 100_000, "4"), ("p", "http://a.org/", "2"), ("p", "http://a.org/", "2"), (None, "http://a.org", "n")], "id string, url string, day string").withColumnsRenamed({"id": "c.id", "url": "c.url"})
    out = url_filter.filter_urls(caps, entries, "c.id", "c.url", "day")
    assert {r.n_active for r in out.where("id = 'p' and day = '2'").collect()} == {0}
    assert sorted((str(r.id), len(r.url), r.blocked) for r in out.collect()) == [("None", 12, False), ("p", 13, False), ("p", 100_013, True)]


def test_repeated_captures_meet_each_entry_once(spark):
    ship(spark)
    entries = spark.createDataFrame([("host", "a.org", "block", 3), ("domain", "org", "allow", 1), ("domain", "com", "block", 9)], "scope string, key string, action string, day int")
    rows = [(1, "http://a.org/x", 5)] * 3 + [(1, "http://a.org/x", 2), (2, "http://a.org/x", 5), (3, "http://b.com/", 5), (3, "http://b.com/", 5)]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "id int, url string, d int").repartition(4), entries, "id", "url", "d")
    found = {(r.id, r.day): (r.n_active, r.n_block, r.n_allow, r.blocked) for r in out.collect()}
    assert found == {(1, 5): (2, 1, 1, False), (1, 2): (1, 0, 1, False), (2, 5): (2, 1, 1, False), (3, 5): (0, 0, 0, False)} and out.count() == 4


def test_a_long_conversation_is_one_document(spark):
    """20,000 turns: the ranges follow one another and hold each assistant text, in time that grows with the turns."""
    ship(spark)
    n = 20_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("message"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    row = chat_format.conversation_documents(chat_format.render(turns.repartition(5))).first()
    assert len(row.mask) == n // 2 and all(a.end <= b.start for a, b in zip(row.mask, row.mask[1:]))
    assert [row.formatted[m.start : m.end] for m in row.mask] == [f"t{i}" for i in range(1, n, 2)]

"""The text operators against brute force, round trips and held-out rows, on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import chat_format, decontamination, hamming_search, html_extract, language_id, near_dedup, piece_coding, queries, substring_dedup, token_files, url_filter
from strata.llm.shared import new_path, table
from strata.plans.session import ship
from tests.test_queries import same

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    """Shared passages, copies, repeats, short, long, empty and null texts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(70)]
    out = [" ".join([*(word() for _ in range(rnd.randint(0, 60))), *passage[rnd.randint(0, 10) :], *(word() for _ in range(rnd.randint(0, 60)))]) for _ in range(12)]
    shared = [word() for _ in range(56)]
    out += [" ".join([*(word() for _ in range(20)), *shared[:55], word()]), " ".join(x for _ in range(6) for x in [*shared, "s", *(word() for _ in range(2))])]
    out += [out[0], out[0], out[1].replace(" ", "\t\n", 5), None, "", " \n", "one", "one two", "a b " * 200, "a b " * 150, "x" * 50_000]
    base = [word() for _ in range(300)]
    for k in range(10):
        near = list(base)
        for _ in range(k):
            near[rnd.randrange(300)] = word()
        out.append(" ".join(near))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[0], "y", 0), (3, texts[3], "z", 0)]
    return spark.createDataFrame(rows, DOCS + ", row string, runs int").repartition(3)


def _words(text):
    return (text or "").encode().split()


def _gone(words, me, first):
    return [any(first[tuple(words[s : s + 50])] < me for s in range(max(0, k - 49), min(k, len(words) - 50) + 1)) for k in range(len(words))]


@pytest.mark.parametrize("limit", [4096, 2, 1])
def test_substring_dedup(docs, texts, limit, monkeypatch):
    first = {}
    for i, t in enumerate(texts):
        w = _words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    found = substring_dedup.repeated_windows.__defaults__
    monkeypatch.setattr(substring_dedup.repeated_windows, "__defaults__", (*found[:-1], limit))
    got = collections.defaultdict(list)
    for r in substring_dedup.substring_dedup(docs).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert len(got[3]) == 2 and got[None][0][1] == 0
    for i, t in enumerate(texts):
        w = _words(t)
        gone = _gone(w, i, first)
        assert got[i][0] == (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())


def test_substring_dedup_of_shared_ids_and_odd_columns(spark):
    ship(spark)
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    text = lambda lo, hi, *more: " ".join([*words[lo:hi], *more])
    rows = [("1", text(0, 120)), ("2", text(60, 200)), ("2", "short"), ("2", text(300, 400)), (None, text(0, 120)), (None, text(0, 120)), ("3", text(300, 400, "end")), ("4", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("a.b", F.monotonically_increasing_id()).withColumn("runs", F.lit(1)).withColumn("mark", F.lit("m"))
    out = substring_dedup.remove_repeats(docs)
    want = [("1", text(0, 120)), ("2", text(120, 200)), ("2", "short"), ("2", text(300, 400)), (None, text(0, 120)), (None, text(0, 120)), ("3", "end"), ("4", None)]
    assert out.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    found = sorted((r.doc_id, r.start, r.n_words, r.words) for r in substring_dedup.maximal_repeats(docs).collect())
    assert found == [(2, 0, 60, text(60, 120)), (3, 0, 100, text(300, 400))]
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(docs, width=3)


def test_remove_repeats_keeps_columns(docs):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_near_dedup(docs, texts):
    for size, percent, defaults in ((3, 85, (16, 512)), (3, 85, (1, 3)), (3, 85, (0, 2)), (5, 80, (16, 512))):
        near_dedup.near_duplicate_links.__defaults__ = defaults
        sets = []
        for t in texts:
            w = (t or "").encode().lower().split()
            sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
        root = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0:
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
        got = {r.doc_id: r for r in near_dedup.near_dedup(docs, size=size, percent=percent).collect()}
        assert {i: (got[i].n_shingles, got[i].component_id) for i in range(len(texts))} == {i: (len(sets[i]), root[i]) for i in range(len(texts))}
        assert got[None].kept and got[None].component_id is None
    near_dedup.near_duplicate_links.__defaults__ = (16, 512)


def test_pigeonhole_covers_the_bound():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        bound = near_dedup.distance_bound(percent / 100)
        a = rng.integers(0, 1 << 15, (200, near_dedup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            row[rng.permutation(near_dedup.SYMBOLS)[:bound]] += 1
        x, y = near_dedup._chunk_keys(a, bound), near_dedup._chunk_keys(b, bound)
        assert np.any([p == q for p, q in zip(x, y)], axis=0).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[102] == 100


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join((texts[2] or "").split()[:30])), (2, "one"), (3, None), (4, "!?"), (None, "one two"), (5, "ONE, Two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wide = decontamination.benchmark_hits(docs, bench)
    full = decontamination.benchmark_hits(docs, bench, filter_bits=64)  # a set so full that every window is a candidate
    assert wide.exceptAll(full).count() == 0 and full.exceptAll(wide).count() == 0
    got = {r.doc_id: r for r in wide.collect()}
    at = texts.index("one two")
    assert got[at].n_hit == 2 and list(got[at]["items"]) == ["2", "5"]
    assert got[2].n_hit >= 25 and got[texts.index("")].n_words == 0
    clean = decontamination.remove_spans(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() and decontamination.benchmark_hits(clean, bench).where("n_hit > 0").count() == 0
    assert decontamination.benchmark_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_decontamination_by_row(spark, bits):
    ship(spark)
    rows = [(1, "one two", "a"), (1, "zzz", "b"), (None, "x one two y", "c"), (None, "clean", "d"), (2, None, "e"), (3, "w " * 200_000 + "one two", "f"), (1, "one two", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").withColumnRenamed("hits", "x.y").withColumn("key", F.lit(1)).repartition(2)
    bench = spark.createDataFrame([(7, "one two"), (7, "one two"), (8, "ONE two!")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.benchmark_hits(docs, bench, filter_bits=bits).collect())
    assert got == sorted([(1, 2, 2, ("7", "8"))] * 2 + [(1, 1, 0, ()), (0, 4, 2, ("7", "8")), (0, 1, 0, ()), (2, 0, 0, ()), (3, 200_002, 2, ("7", "8"))])
    kept = decontamination.decontaminate(docs, bench, filter_bits=bits)
    assert kept.columns == docs.columns and sorted(r["x.y"] for r in kept.collect()) == ["b", "d", "e"]
    cut = {r["x.y"]: r.text for r in decontamination.remove_spans(docs, bench, filter_bits=bits).collect()}
    assert (cut["a"], cut["b"], cut["c"], cut["e"]) == ("", "zzz", "x y", None) and len(cut["f"]) == 399_999
    assert decontamination.benchmark_hits(docs.limit(0), bench).count() == 0 and decontamination.decontaminate(docs.limit(0), bench).count() == 0


def test_token_files(spark, docs, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, model = new_path(spark, "test"), public_tokenizers.path("word_bpe_49k.json")
    extra = ["it's a <|endoftext|> dog's,'re x", "É́a ...'s …,x", "x<|startoftext|>y\tz"]
    every = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 900)), DOCS))
    token_files.write_token_files(every, path, model)
    t, start = Tokenizer.from_file(model), 0
    known = {**dict(enumerate(texts)), **dict(enumerate(extra, 900))}
    rows = token_files.token_file_index(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == sorted(known)
    for r in rows:
        ids = [*t.encode(known[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_piece_coding(docs, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), piece_coding.PieceModel.load(path)
    got = {r.doc_id: r for r in piece_coding.decode_pieces(piece_coding.encode_pieces(docs, model), model).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == sp.encode(t or "") and got[i].decoded == (t or "")
    encoder, rnd = piece_coding.StreamingEncoder(model), random.Random(5)
    for _ in range(300):
        w = "".join(rnd.choice("aabbther  .,'é漢😀\n0") for _ in range(rnd.randint(1, 90)))
        out = []
        for k in range(0, len(w), 7):
            out += encoder.feed(("▁" if k == 0 else "") + w[k : k + 7].replace(" ", "▁"))
        assert out + encoder.finish() == sp.encode(w)
    long = encoder.feed("▁" + "the" * 2000)
    assert len(long) > 1900 and len(encoder.back) < 200


def test_language_id(spark, sf):
    from pyspark.sql import Row

    rows = language_id.op10_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    profiles = language_id.language_profiles(spark.createDataFrame([Row(text="the cat and the dog", lang="en"), Row(text="der Hund und die Katze", lang="de"), Row(text=None, lang="fr"), Row(text="x", lang=None)]))
    got = language_id.identify(spark.createDataFrame([(1, "THE dog"), (2, "und die"), (3, "123 !"), (4, None), (5, "")], "id int, text string"), profiles)
    assert [r.lang_pred for r in got.orderBy("id").collect()] == ["en", "de", "und", "und", "und"]
    empty = language_id.language_profiles(spark.createDataFrame([], "text string, lang string"))
    assert language_id.identify(spark.createDataFrame([("a b",)], "text string"), empty).first().lang_pred == "und"


def test_profiles_count_whole_texts(spark):
    rows = [("ab ab", "x"), ("ab", "x"), ("b", "x")]
    got = language_id.language_profiles(spark.createDataFrame(rows, "text string, lang string")).orderBy("rank").collect()
    assert [r.gram for r in got[:6]] == ["b", "b ", "a", " a", "ab", " ab"]


PAGE = """<html><head><title>no</title></head><body><div id="cookie-banner">We use cookies on this site for all that we do.</div><nav><a href="/">Home</a></nav>
<main><article class="post"><h1>Title &amp; more</h1><p>One<br>two &#233;<p>Three</p><form><label>Mail</label></form><aside class="related">see also</aside>
<script>var a = "<p>no</p>";</script><ul><li>x <b>y</b></li></ul></article><section id="comments"><p>I liked this post very much, thank you all.</p></section></main><footer>f</footer>"""


def test_html_extraction(spark, sf):
    ship(spark)
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>" * 5000), (5, "u", "<!-- open <p>x</p>")]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title & more\nOne two é\nThree\nx y", 2: "", 3: "", 4: "", 5: ""}
    import html as h
    import re

    pages = table(spark, sf, "pages").collect()
    own = {r.page_id: r.text for r in html_extract.op2_html_text(spark, sf).collect()}
    for p in pages:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        want = [x for x in (" ".join(h.unescape(re.sub(r"<[^>]+>", " ", part)).split()) for part in parts) if x]
        assert own[p.page_id] == "\n".join(want)


def test_html_keeps_articles():
    tree = html_extract.fit_tree(*html_extract.training_rows())
    long = "The council met on Tuesday evening to discuss the plans for the new bridge, which engineers expect to take three years to build and to cost far more than was first thought."
    story = f"<article><h1>Plans</h1><p>{long}</p><p>{long}</p></article>"
    want = f"Plans\n{long}\n{long}"
    for wrap in ("class='overflow-hidden'", "style='overflow:hidden'", "title='The hidden valley'", "data-x='display:none'", "class='no-sidebar'", "class='has-header'", "class='sidebar'", "class='social tags'", "hidden='false'"):
        assert html_extract.main_text(f"<body><div {wrap}>{story}</div>", tree) == want, wrap
    for lead in ("<head><title>t</title><body>", "<head><meta charset=x><style>p{}</style>", "<html><head><title>t</title><div>"):
        assert html_extract.main_text(lead + story, tree) == want, lead
    assert html_extract.main_text(f"<head><title>t</title>{long}", tree) == long
    for wrap in ("hidden", "hidden=''", "style='color:red; display : none'"):
        assert html_extract.main_text(f"<body><div {wrap}>{story}</div>", tree) == "", wrap
    for wrap in ("no-sidebar", "has-header"):
        assert html_extract.main_text(f"<body><div class='{wrap}'><p>{long}</p><p>{long}</p></div>", tree) == f"{long}\n{long}"
    assert html_extract.main_text(f"<body>{story}<article class='comment'><p>{long}</p></article>", tree) == want


def test_url_filter(spark):
    entries = [("domain", "a.com", "block", 10), ("domain", "a.com", "remove", 20), ("host", "x.a.com", "allow", 15), ("host", "x.a.com", "allow", 15), ("url", "b.org/p", "block", 0), (None, "q", "block", 1), ("host", "c.net", "odd", 1)]
    caps = [(1, "http://www.A.com:80/z?q", 9), (2, "http://www.a.com/z", 10), (3, "https://u@x.a.com/", 15), (4, "http://a.com", 20), (5, "http://b.org/p/#f", 3), (6, None, 3), (7, "nonsense", 3), (8, "http://notb.org/p", 3), (9, "http://b.org/p", None)]
    out = url_filter.filter_urls(spark.createDataFrame(caps, "id int, url string, d int"), spark.createDataFrame(entries, "scope string, key string, action string, day int"), "id", "url", "d")
    got = {r.id: (r.n_active, r.blocked) for r in out.collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (2, False), 4: (0, False), 5: (1, True), 6: (0, False), 7: (0, False), 8: (0, False), 9: (0, False)}


def test_url_list_keys_are_normalised(spark):
    entries = [("url", "http://B.org/News/", "block", 0), ("url", "https://u@c.org:443/Top?q#f", "block", 0), ("url", "d.org/Path", "block", 0), ("host", "http://E.org:80/", "block", 0), ("domain", "F.org.", "block", 0)]
    urls = ["http://b.org/News", "http://b.org/news", "http://C.org/Top/", "http://D.org/Path?x", "http://d.org/path", "https://e.org/x", "http://g.f.org/"]
    out = url_filter.filter_urls(spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)], "id int, url string, d int"), spark.createDataFrame(entries, "scope string, key string, action string, day int"), "id", "url", "d")
    assert [r.blocked for r in out.orderBy("id").collect()] == [True, False, True, True, False, True, True]


def test_hamming_search(spark):
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)] + [5] * 40 + [7, -1, 0]
    rows = spark.createDataFrame([*enumerate(codes), (None, 5), (500, None), (0, codes[0])], "id long, code long")
    q = [0, 61, 101]
    for m in (4, 8):
        got = collections.defaultdict(list)
        for r in hamming_search.hamming_topk(rows, rows.where(F.col("id").isin(q)).select(F.col("id").alias("query_id"), "code"), k=5, segments=m).orderBy("rank").collect():
            got[r.query_id].append((r.distance, r.neighbor_id))
        for i in q:
            every = sorted((((codes[i] ^ c) & (2**64 - 1)).bit_count(), j) for j, c in enumerate(codes) if j != i)
            assert got[i] == every[:5]
    few = hamming_search.hamming_topk(rows.where("id < 3"), rows.where("id = 0").select(F.col("id").alias("query_id"), "code"), k=5, segments=8)
    assert few.count() == 2


def test_hamming_search_by_wide_segments(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 3)]
    codes = [b ^ sum(1 << int(x) for x in rng.choice(62, k % 7, replace=False)) for b in base for k in range(14)]
    rows = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    out = hamming_search.hamming_topk(rows, rows.where("id % 14 = 0").select(F.col("id").alias("query_id"), "code"), k=5, segments=2)
    got = collections.defaultdict(list)
    for r in out.orderBy("rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    for i in (0, 14, 28):
        assert got[i] == sorted((((codes[i] ^ c) & (2**64 - 1)).bit_count(), j) for j, c in enumerate(codes) if j != i)[:5]


def test_hamming_masks_and_widths(spark):
    row = spark.createDataFrame([(1,)], "id int")
    for width, radius in ((5, 0), (5, 2), (5, 5), (32, 3)):
        got = [r.flip for r in hamming_search._flipped(row, width, radius).collect()]
        assert len(got) == len(set(got)) == math.comb(width, radius) and all(x.bit_count() == radius and x < 1 << width for x in got)
    assert all(64 // hamming_search.segment_count(n) <= 16 for n in (1, 2000, 10**7, 10**9, 10**12))


def test_chat_folding(spark):
    events = [
        (1, 0, 0, "create", "user", "hi"), (1, 1, 1, "create", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 5, "delta", None, "d"), (1, 1, 4, "regenerate", "assistant", "c"), (1, 2, 6, "create", "user", "gone"), (1, 2, 7, "delete", None, None),
        (1, 3, 8, "create", "user", "old"), (1, 3, 9, "edit", None, "<|im_end|>\\ <\\|"), (2, 0, 0, "create", "assistant", None), (2, 1, 0, "odd", "user", "x"),
    ]
    log = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string").repartition(3)
    folded = chat_format.fold_events(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in folded.collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "cd"), (1, 3): ("user", "<|im_end|>\\ <\\|"), (2, 0): ("assistant", "")}
    rendered = chat_format.render(folded)
    assert rendered.where(F.size(F.split("formatted", r"<\|im_end\|>")) != 2).count() == 0
    row = {r.conv_id: r for r in chat_format.conversation_digests(rendered).collect()}[1]
    assert row.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\ncd\nuser\n<|im_end|>\\ <\\|\n").hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (3, 2, hashlib.sha256(b"cd").hexdigest())
    for text in ("<|", "<\\", "<\\|<|", "a<", "\\<|x"):
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.encoding_stage(spark, docs, sf)
    assert last.join(docs.withColumnRenamed("text", "given"), "doc_id").where("given <> text").count() == 0


def test_pipeline_rejects_by_language(spark, sf):
    import corpus_pipeline

    rnd = random.Random(5)
    docs = table(spark, sf, "documents")
    junk = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(500)), "zzzz qqqq " * 30, "Привет мир, как дела " * 9, "1 2 3", None]
    more = spark.createDataFrame([(10**6 + i, t, "en") for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    every = docs.unionByName(more, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, every, sf).select("doc_id").collect()}
    # By brute force: each text against each profile, and quartiles of the taught rows.
    rows, held = every.select("doc_id", "text", "lang").collect(), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        words = "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()
        text = f" {' '.join(words)} "
        if words and not held(r.doc_id):
            counts[r.lang].update(g for n in (1, 2, 3) for k in range(len(text) - n + 1) if (g := text[k : k + n]) != " ")
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:400]]
    place = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in counts.items()}
    best = {}
    for r in rows:
        words = "".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()
        text = f" {' '.join(words)} "
        own = ranked(collections.Counter(g for n in (1, 2, 3) for k in range(len(text) - n + 1) if (g := text[k : k + n]) != " ")) if words else []
        if own:
            d, lang = min((sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)), lang) for lang, p in place.items())
            best[r.doc_id] = (lang, max(0.0, 1 - d / (400 * len(own))))
    taught = collections.defaultdict(list)
    for r in rows:
        if not held(r.doc_id) and r.doc_id in best and best[r.doc_id][0] == r.lang:
            taught[r.lang].append(round(best[r.doc_id][1], 3))
    floor = {lang: (q := np.percentile(x, [25, 75]))[0] - 3 * (q[1] - q[0]) for lang, x in taught.items()}
    assert kept == {i for i, (lang, score) in best.items() if score > 0 and score >= floor.get(lang, 0)}
    assert kept == {r.doc_id for r in docs.collect()}


def test_pipeline_run_is_its_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    rows = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.text) for r in df.collect())
    assert rows(docs) == rows(corpus_pipeline.run(spark, sf))


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_sql(spark, sf, name):
    ship(spark)
    same(spark, sf, queries.queries()[name], queries.oracles()[name])

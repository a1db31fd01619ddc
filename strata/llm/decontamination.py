"""Removal of benchmark passages from training documents.

The windows of ``width`` consecutive words of all benchmark items (an item of
fewer words is one window) are hashed, and the hashes are broadcast as a set of
bits, of ``filter_bits`` at most whatever the benchmark's size.  Every text is
scanned once: windows whose hash may be in the set become candidates, and a join
with the benchmark's windows on length, hash and words verifies each of them.  A
larger benchmark fills the set more and so gives more candidates to join, with
the same result.

Each row of the documents has a key of its own from the scan on, so rows with a
null id and rows that share an id are judged by their own text.  Rows without a
candidate are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.shared import id_of, packed, plain, stored, table, unpacked

WIDTH = 10
#: Bits of the broadcast set at most (32 MB), and bits for each window while they fit.
FILTER_BITS = 1 << 28
BITS_PER_WINDOW = 64

_HITS = "array<struct<first:int,length:int,hash:bigint,words:string>>"
_ARROW_HITS = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()), ("words", pa.string())]))
_WINDOW = "item string, length int, hash long, words string"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words_at(raw: bytes, w: ws.Words, first: int, length: int) -> str:
    return b" ".join(raw[s:e] for s, e in zip(w.start[first : first + length].tolist(), w.end[first : first + length].tolist())).decode("utf-8", "replace")


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(0).to_pylist()
            for w in ws.scan(b.column(1), "alnum", lower=True):
                raw = w.data.tobytes().translate(_LOWER)
                count = np.diff(w.bounds)
                for length in sorted(set(np.minimum(count, width).tolist()) - {0}):
                    at, hashes, doc = ws.windows(w, length)
                    own = np.minimum(count[doc], width) == length
                    at, hashes, doc = at[own], hashes[own], doc[own]
                    names = [items[w.first + i] for i in doc.tolist()]
                    words = [_words_at(raw, w, k, length) for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array(np.full(len(at), length, np.int32)), pa.array(hashes.view(np.int64)), pa.array(words, pa.string())], names=["item", "length", "hash", "words"]
                    )

    return run


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, length, hash, words) of the items' distinct windows; items without words or with a null id have none."""
    items = benchmark.select(plain(item_col).cast("string").alias("item"), plain(text_col).cast("string").alias("text")).where("item is not null")
    return stored(items.mapInArrow(_item_windows(width), _WINDOW).distinct(), "windows")


def _slots(bits: int) -> Column:
    return F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)))


def hash_set(windows: DataFrame, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """The hashes of a table (hash) as a set of bits, two for each; at most ``filter_bits`` / 64 words of it come to the driver."""
    bits = min(filter_bits, max(64, 1 << (BITS_PER_WINDOW * windows.count()).bit_length()))
    slots = windows.select(F.explode(_slots(bits)).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("set")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def may_hold(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a set of :func:`hash_set`."""
    mask = np.uint64(64 * len(known) - 1)
    ok = np.ones(len(hashes), dtype=bool)
    for slot in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        ok &= (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def _scan(shared, lengths: list[int]):
    """Rows with their number of words and the windows whose hash may be in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            others = [n for n in b.schema.names if n != "scanned"]
            for w in ws.scan(b.column("scanned"), "alnum", lower=True):
                hits: list[list | None] = [None] * w.docs
                raw = b""
                for length in lengths:
                    at, hashes, doc = ws.windows(w, length)
                    for k in np.flatnonzero(may_hold(known, hashes)).tolist():
                        raw = raw or w.data.tobytes().translate(_LOWER)
                        i, first = int(doc[k]), int(at[k])
                        hits[i] = hits[i] or []
                        hits[i].append({"first": first - int(w.bounds[i]), "length": length, "hash": int(hashes[k].view(np.int64)), "words": _words_at(raw, w, first, length)})
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n).slice(w.first, w.docs) for n in others), pa.array(np.diff(w.bounds).astype(np.int64)), pa.array(hits, _ARROW_HITS)], names=[*others, "n_words", "hits"]
                )

    return run


def _scanned(rows: DataFrame, windows: DataFrame, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a column ``scanned`` of texts) stored with key, n_words and hits; and (key, spans, items) of the rows that hold a window."""
    shared = rows.sparkSession.sparkContext.broadcast(hash_set(windows, filter_bits))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most ``width`` rows
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "scanned")
    found = rows.mapInArrow(_scan(shared, lengths), f"{kinds}, n_words long, hits {_HITS}")
    # The key is fixed once the table is written.
    scanned = stored(found.withColumn("key", F.monotonically_increasing_id()), "scanned")
    hits = scanned.where("hits is not null").select("key", F.explode("hits").alias("h")).select("key", "h.first", "h.length", "h.hash", "h.words")
    known = hits.join(windows, ["length", "hash", "words"])
    spans = F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("length")).alias("end"))))
    return scanned, known.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which come in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["first"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (the ids of the items that occur, sorted as strings).

    Null texts have no words; items without words or with a null id have no
    window.  Rows with a null id and rows that share one are judged by their
    own text.  An empty benchmark or an empty table gives no hits.
    """
    windows = benchmark_windows(benchmark, item_col, item_text_col, width)
    rows = docs.select(id_of(id_col).alias("doc_id"), plain(text_col).cast("string").alias("scanned"))
    scanned, held = _scanned(rows, windows, filter_bits)
    none = F.array().cast("array<string>")
    clean = scanned.where("hits is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    judged = scanned.where("hits is not null").join(held, "key", "left")
    return clean.unionByName(judged.select("doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")))


def _with_rows(docs: DataFrame, text_col: str) -> DataFrame:
    text = plain(text_col)
    return docs.select(packed(docs, text_col).alias("row"), text.cast("string").alias("text"), text.cast("string").alias("scanned"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; ids play no part."""
    scanned, held = _scanned(_with_rows(docs, text_col), benchmark_windows(benchmark, item_col, item_text_col, width), filter_bits)
    kept = scanned.where("hits is null").select("row", "text").unionByName(scanned.where("hits is not null").join(held, "key", "left_anti").select("row", "text"))
    return kept.select(*unpacked(docs, "row", **{text_col: F.col("text")}))


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column("spans").to_pylist()
        for w in ws.scan(b.column("text"), "alnum", lower=True):
            raw, out = w.data.tobytes(), []
            edge = ws._string_buffers(b.column("text"))[1][w.first : w.first + w.docs + 1]
            for i in range(w.docs):
                at, stop, own = int(edge[i] - edge[0]), int(edge[i + 1] - edge[0]), int(w.bounds[i])
                kept = []
                for x in spans[w.first + i]:
                    lo, hi = int(w.start[own + x["first"]]), int(w.end[own + x["end"] - 1])
                    if lo > at:
                        kept.append(raw[at:lo])
                    at = max(at, hi)
                kept.append(raw[at:stop])
                out.append(b" ".join(x for x in (k.strip() for k in kept) if x).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("row").slice(w.first, w.docs), pa.array(out, pa.string())], names=["row", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of the text.

    Texts without an occurrence are unchanged; what is left around a cut is
    joined by one space.
    """
    scanned, held = _scanned(_with_rows(docs, text_col), benchmark_windows(benchmark, item_col, item_text_col, width), filter_bits)
    judged = scanned.where("hits is not null").join(held, "key", "left")
    kept = scanned.where("hits is null").select("row", "text").unionByName(judged.where("spans is null").select("row", "text"))
    cut = judged.where("spans is not null").select("row", "text", "spans").mapInArrow(_without_spans, f"row {scanned.schema['row'].dataType.simpleString()}, text string")
    return kept.unionByName(cut).select(*unpacked(docs, "row", **{text_col: F.col("text")}))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {
    "op7_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as k
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as k
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
hits as (select distinct dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.k = bw.k),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join its using (doc_id)
""",
}

"""Removal of long word sequences that earlier documents already have.

A sparse generalised suffix tree, split by prefixes of variable length:

1. Every window of ``width`` words has an *anchor*, the smallest hash among
   its ``ANCHOR`` word k-grams.  Equal windows have equal anchors, so suffixes
   need comparing only inside the group of one anchor, the first prefix.
   Neighbouring windows with one anchor form a *segment*, about one row for
   twenty words.
2. Segments with the same content, by two independent 64-bit hashes, are one
   leaf, that of the smallest document (a partial aggregation); occurrences in
   other documents are repeats, and those in the same document, its twins, share
   what the tree finds out about it.
3. A group of at most ``group_limit`` segments fits in memory and is one
   subtree.  A larger one is split: its suffixes, one for each window, go by
   the hash of their first words, a quarter of the width, then half of it, then
   all of it, until a group fits; a prefix that only one document has is
   dropped at once.
4. A task sorts the suffixes of a subtree by their words, takes the common
   prefixes of neighbours and reads the repeats off the internal nodes of a
   depth of ``width`` words or more.  Runs of such suffixes are the maximal
   repeats.  A prefix of ``width`` words is such a node by itself, so a group of
   any size needs only its smallest document, by a partial aggregation.

No step holds all suffixes of a group of unbounded size, and no step drops a
window: the limit does not change the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.shared import discard, id_of, keyed_text, packed, plain, stored, table, unpacked

WIDTH = 50
ANCHOR = 8
SEGMENT_WINDOWS = 64
GROUP_LIMIT = 2048
TREE_WINDOWS = 1 << 16

_SEGMENT = "doc_id long, mark int, anchor long, content long, content2 long, start int, n int"
_PIECE = "anchor long, doc_id long, mark int, base int, start int, words string"
_RUN = "doc_id long, mark int, base int, start int, n int"
#: A text: its id, and a mark that tells texts of one id apart.
_TEXT = ("doc_id", "mark")


def _batch(columns: dict[str, np.ndarray], like: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names = [x.strip().split(" ") for x in like.split(",")]
    arrays = []
    for name, kind in names:
        v = columns[name]
        if kind == "long" and v.dtype == np.uint64:
            v = v.view(np.int64)
        arrays.append(pa.array(v, type=kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in names])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Entry i is min(x[i : i + width]); the tail is of no use."""
    m, p = x.copy(), 1
    while p * 2 <= width:
        m[:-p] = np.minimum(m[:-p], m[p:])
        p *= 2
    rest = width - p
    if rest:
        m[:-rest] = np.minimum(m[:-rest], m[rest:])
    return m


def _totals(hashes: np.ndarray) -> np.ndarray:
    up, _ = ws._WORDS.get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total


def _span_hash(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words from lo to hi, wherever they stand."""
    _, down = ws._WORDS.get(len(total))
    return ws.mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _two_totals(w: ws.Words) -> list[np.ndarray]:
    """Sums over two word hashes that depend on different byte values."""
    return [_totals(w.hash), _totals(ws.span_hashes(w.data, w.start, w.end, ws.byte_values(False, 31)))]


def _segments(width: int):
    anchor_words = min(ANCHOR, width)
    span = width - anchor_words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w in ws.scan(b.column(2), "space", lower=False):
                at, _, doc = ws.windows(w, width)
                if not len(at):
                    continue
                k_at, k_hash, _ = ws.windows(w, anchor_words)
                grams = np.full(len(w.hash), np.uint64(2**64 - 1))
                grams[k_at] = k_hash
                anchor = _sliding_min(grams, span)[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                run_start = np.flatnonzero(new)
                within = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
                first = np.flatnonzero(within % SEGMENT_WINDOWS == 0)
                n = np.diff(np.append(first, len(at)))
                lo, hi = at[first], at[first] + n + width - 1
                content, content2 = (_span_hash(t, lo, hi) for t in _two_totals(w))
                row = w.first + doc[first]
                yield _batch({"doc_id": ids[row], "mark": marks[row], "anchor": anchor[first], "content": content, "content2": content2, "start": lo - w.bounds[doc[first]], "n": n}, _SEGMENT)

    return run


def _listed(b: pa.RecordBatch) -> Iterator[tuple]:
    """Of rows (doc_id, mark, text, parts): the words of a slice of texts, and of each part its row, anchor, base, start in the text, windows, first word."""
    lists = b.column(3)
    offsets, parts = lists.offsets.to_numpy(), lists.values
    anchor, base, start, n = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    for w in ws.scan(b.column(2), "space", lower=False):
        lo, hi = offsets[w.first], offsets[w.first + w.docs]
        owner = np.repeat(np.arange(w.docs), np.diff(offsets[w.first : w.first + w.docs + 1]))
        yield w, w.first + owner, anchor[lo:hi], base[lo:hi], start[lo:hi], n[lo:hi], w.bounds[owner] + start[lo:hi]


def _cut(width: int):
    """The words of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w, row, anchor, base, start, n, word in _listed(b):
                raw = w.data.tobytes()
                for lo in range(0, len(row), 65_536):
                    part = slice(lo, lo + 65_536)
                    text = [raw[s:e].decode("utf-8", "replace") for s, e in zip(w.start[word[part]].tolist(), w.end[word[part] + n[part] + width - 2].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[part], pa.int64()), pa.array(ids[row[part]], pa.int64()), pa.array(marks[row[part]], pa.int32()), *(pa.array(x[part], pa.int32()) for x in (base, start)), pa.array(text, pa.string())],
                        names=["anchor", "doc_id", "mark", "base", "start", "words"],
                    )

    return run


def prefix_lengths(width: int) -> list[int]:
    """The lengths by which suffixes of large groups are split, one after the other."""
    return sorted({max(1, width // 4), max(1, width // 2), width})


def _suffixes(width: int):
    """Each window of the parts, with hashes of its first words, and a second one of all of its words."""
    lengths = prefix_lengths(width)
    like = "doc_id long, mark int, base int, start int, " + ", ".join(f"p{x} long" for x in lengths) + ", check long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w, row, _, _, start, n, word in _listed(b):
                count = n.astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first, row = np.repeat(word, count) + step, np.repeat(row, count)
                total, other = _two_totals(w)
                columns = {"doc_id": ids[row], "mark": marks[row], "base": np.repeat(start, count), "start": np.repeat(start, count) + step, "check": _span_hash(other, first, first + width)}
                yield _batch(columns | {f"p{x}": _span_hash(total, first, first + x) for x in lengths}, like)

    return run, like


def deep_nodes(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Internal nodes of a depth of ``width`` words of the suffix tree over the suffixes at ``at`` of numbered words.

    The suffixes are put in order by their first ``width`` words; neighbours
    that share all of them hang below one node.  Returns the order and the
    node of each suffix in that order.
    """
    rows = np.ascontiguousarray(words.astype(">u4")[at[:, None] + np.arange(width)])
    order = np.argsort(rows.view(np.dtype((np.void, 4 * width))).ravel(), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    node = np.concatenate([[0], np.cumsum(common < width)])
    return order, node


def _subtree(rows: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The maximal repeats of some groups: runs of suffixes below nodes that an earlier document has too."""
    t = pa.Table.from_batches(rows).combine_chunks()
    ids, marks, segment, begin = (t.column(c).to_numpy() for c in ("doc_id", "mark", "base", "start"))
    # Words are numbered by their bytes, so what is equal here is equal in the texts.
    split = pc.ascii_split_whitespace(t.column("words").combine_chunks())
    words = split.values.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    size = np.diff(split.offsets.to_numpy()).astype(np.int64)
    count = size - width + 1
    lead = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order, node = deep_nodes(words, np.repeat(lead, count) + step, width)
    doc = ids[owner[order]]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    repeat = np.zeros(len(order), dtype=bool)
    repeat[order] = doc > np.minimum.reduceat(doc, first)[node]
    at = np.flatnonzero(repeat)
    if len(at):
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
        head = np.flatnonzero(new)
        own = owner[at[head]]
        yield _batch({"doc_id": ids[own], "mark": marks[own], "base": segment[own], "start": begin[own] + step[at[head]], "n": np.diff(np.append(head, len(at)))}, _RUN)


def _trees(width: int):
    """Rows come sorted by anchor; whole groups are put together up to TREE_WINDOWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != anchor[0]:
                edges = np.concatenate([[0], edges])
            done = 0
            for e in edges.tolist():
                if e > done:
                    held.append(b.slice(done, e - done))
                    rows += e - done
                    done = e
                if rows * 20 >= TREE_WINDOWS:
                    yield from _subtree(held, width)
                    held, rows = [], 0
            if done < b.num_rows:
                held.append(b.slice(done))
                rows += b.num_rows - done
        if held:
            yield from _subtree(held, width)

    return run


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): texts that share an id have marks of their own."""
    return keyed_text(docs, id_col, text_col).select("doc_id", F.hash("text").alias("mark"), "text")


def _split_groups(suffixes: DataFrame, width: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Parts (doc_id, mark, anchor, base, start, n) of groups that fit, by the shortest prefix that makes them fit, and runs of the others."""
    parts, rest = None, suffixes
    for length in prefix_lengths(width)[:-1]:
        key = f"p{length}"
        groups = rest.groupBy(key).agg(F.count("*").alias("k"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(key, "k")
        both = stored(rest.join(stored(groups, "groups"), key), "suffixes")
        small = both.where(F.col("k") <= limit).select("doc_id", "mark", F.col(key).alias("anchor"), "base", "start", F.lit(1).alias("n"))
        parts = small if parts is None else parts.unionByName(small)
        rest = both.where(F.col("k") > limit).drop("k")
    key = [f"p{width}", "check"]
    least = stored(rest.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("last > least").drop("last"), "groups")
    return parts, rest.join(least, key).where("doc_id > least").select("doc_id", "mark", "base", "start", F.lit(1).alias("n"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Runs of windows whose words also start in a document with a smaller id.

    Returns (doc_id, mark, start, n): the ``n`` windows that start at word
    ``start`` and the words after it, in the text of that id and mark.  A row
    may come more than once.  Rows with a null id
    take no part, an id that is no integer is an error; a null text has no words.  Texts of fewer than ``width`` words
    have no window.  Rows that share an id are texts of one document: none of
    them repeats another.
    """
    if width < 4:
        raise ValueError("width must be at least 4")
    text = _marked(docs, id_col, text_col).where("doc_id is not null")
    segments = stored(text.mapInArrow(_segments(width), _SEGMENT), "segments")
    content = ["anchor", "content", "content2"]
    contents = segments.groupBy(*content).agg(F.min(F.struct("doc_id", "mark", "start", "n")).alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("places"))
    contents = stored(contents.select(*content, "least.*", "last", "places"), "contents")
    leaf = contents.where("places > 1").select(*content, F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), F.col("start").alias("of_start"))
    again = stored(segments.join(leaf, content).where("doc_id > of_id or mark <> of_mark or start <> of_start").drop("content", "content2"), "again")
    copies = again.where("doc_id > of_id").select(*_TEXT, "start", "n")
    mixed = contents.groupBy("anchor").agg(F.count("*").alias("k"), F.min("doc_id").alias("lo"), F.max("last").alias("hi")).where("k > 1 and lo < hi").select("anchor", "k")
    mixed = stored(mixed, "mixed")
    open_ = stored(contents.join(mixed, "anchor").select("anchor", *_TEXT, F.col("start").alias("base"), "start", "n", "k"), "open")
    discard(segments, contents)
    twins = again.where("doc_id = of_id").join(mixed.select("anchor"), "anchor").select("doc_id", F.col("of_mark").alias("mark"), F.col("of_start").alias("base"), F.col("mark").alias("twin"), F.col("start").alias("place"))

    def with_text(part: DataFrame) -> DataFrame:
        lists = part.groupBy(*_TEXT).agg(F.collect_list(F.struct("anchor", "base", "start", "n")).alias("parts"))
        return text.join(lists, list(_TEXT)).select(*_TEXT, "text", "parts")

    parts, deep = open_.where(F.col("k") <= group_limit).drop("k"), None
    hot = open_.where(F.col("k") > group_limit)
    if not hot.isEmpty():
        cut, like = _suffixes(width)
        small, deep = _split_groups(stored(with_text(hot).mapInArrow(cut, like), "suffixes"), width, group_limit)
        parts = parts.unionByName(small)
    found = with_text(parts).mapInArrow(_cut(width), _PIECE).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_trees(width), _RUN)
    found = stored(found if deep is None else found.unionByName(deep), "found")
    discard(open_)
    of_twins = found.join(twins, [*_TEXT, "base"]).select("doc_id", F.col("twin").alias("mark"), (F.col("place") + F.col("start") - F.col("base")).alias("start"), "n")
    return copies.unionByName(found.drop("base")).unionByName(of_twins)


def _runs(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    return repeated_windows(docs, id_col, text_col, width).groupBy(*_TEXT).agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, start, n_words, words): the stretches of each text that earlier documents have, as long as they go, from word ``start`` on."""
    joined = _marked(docs, id_col, text_col).join(_runs(docs, id_col, text_col, width), list(_TEXT)).select("doc_id", "text", "runs")
    return joined.mapInArrow(_stretches(width), "doc_id long, start long, n_words long, words string")


def _stretches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, runs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], _covered(len(words), runs, width).astype(int), [0]])))
                out += [(doc, s, e - s, b" ".join(words[s:e]).decode("utf-8", "surrogatepass")) for s, e in edge.reshape(-1, 2).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "n_words", "words"])

    return run


def _covered(n_words: int, runs, width: int) -> np.ndarray:
    mark = np.zeros(n_words + 1, dtype=np.int64)
    for r in runs or ():
        mark[min(r["start"], n_words)] += 1
        mark[min(r["start"] + r["n"] + width - 1, n_words)] -= 1
    return np.cumsum(mark[:-1]) > 0


def _kept(text: str | None, runs, width: int) -> tuple[int, int, str, str]:
    """Words, removed words, digest of the kept words, the text without the removed spans."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not runs:
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text
    gone = _covered(len(words), runs, width)
    kept = b" ".join(x for x, g in zip(words, gone.tolist()) if not g)
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")


def _apply(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_kept(t, r, width) for t, r in zip(b.column("text").to_pylist(), b.column("runs").to_pylist())]
            out = [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())]
            if with_text:
                out += [pa.array([r[3] for r in rows], pa.string()), *(b.column(i) for i in range(3, b.num_columns))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text", *b.schema.names[3:]] if with_text else [])
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    See :func:`repeated_windows` for what is removed; a null text has no words
    and an empty digest.  Windows are judged on the input alone.
    """
    joined = _marked(docs, id_col, text_col).join(_runs(docs, id_col, text_col, width), list(_TEXT), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_apply(width, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated spans cut out of the text; other columns stay.

    A text without repeats is unchanged.  In a text with repeats the words
    that stay are joined by one space; if none stays it is empty.
    """
    text = plain(text_col).cast("string")
    left = docs.select(id_of(id_col).alias("doc_id"), F.hash(text).alias("mark"), text.alias("text"), packed(docs, text_col).alias("row"))
    joined = left.join(_runs(docs, id_col, text_col, width), list(_TEXT), "left").select("doc_id", "text", "runs", "row")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_apply(width, True), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, row {kind}")
    return out.select(*unpacked(docs, "row", **{text_col: F.col("kept_text")}))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {
    "op1_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 48)) as i, unnest(list_transform(range(1, len(ws) - 48), lambda k: sha256(array_to_string(ws[k:k + 49], ' ')))) as h from w where len(ws) >= 50),
hit as (select doc_id, i from win join (select h, min(doc_id) as first from win group by h) using (h) where first < doc_id),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
near as (select word.doc_id, j, word, coalesce(max(i) over (partition by word.doc_id order by j) > j - 50, false) as gone from word left join hit on hit.doc_id = word.doc_id and hit.i = word.j)
select w.doc_id, count(j) as n_words, count(j) filter (where gone) as n_removed, sha256(coalesce(string_agg(word, ' ' order by j) filter (where not gone), '')) as kept_sha256
from w left join near on near.doc_id = w.doc_id group by w.doc_id
"""
}

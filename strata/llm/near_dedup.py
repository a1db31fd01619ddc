"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set of word shingles gets a signature of ``SYMBOLS`` b-bit MinHash
values; the signature distance of two sets is the number of values that
differ.  For sets of a similarity of at least ``threshold`` that number is
binomial at worst, so a distance bound is chosen whose excess has a
probability of at most ``MISS``.  The join guarantees all pairs within that
bound: the values are split into so many chunks that, by pigeonhole, one chunk
has at most one error, and that error is enumerated by leaving out each value
of a chunk in turn.  Two signatures within the bound then share at least one of
these keys.

Documents with the same set collapse to one representative first, so groups of
copies never meet in the join.  No group of documents under one key is paired
off as a whole:

1. Each key names a pivot, the document that shares most keys with others, and
   every document of the key meets the pivot only.  Near copies collapse into
   the pivot's component here, with one pair for each document and pivot.
2. Keys whose documents are still in different components stay open.  The
   documents outside a key's largest component are its minority; if there are
   at most ``SMALL``, each of them is compared by signature with all documents
   of the key, which are dealt out in blocks.
3. Documents of other open keys are split by a second pigeonhole: of two
   signatures within the bound d, the d + 1 values that are rarest among these
   documents share one.  A passage that many documents have is a frequent value
   and so no key.  Keys of these values are compared as in 2; those with more
   than ``SMALL`` in their minority on full sets, each block of the minority
   with each block of the key, with at most one link returned for each document
   and pair of blocks.

Every link is confirmed on the full shingle sets.  Links become components by
rounds of star joins, each in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.shared import discard, id_of, keyed_text, stored, table

SYMBOLS = 64
BITS = 16
MISS = 1e-7
SMALL = 16
BLOCK = 512
#: Documents whose values are counted at once, and most frequent values that are known, where rare values are keys.
COUNTED, COMMON = 8192, 1 << 16

_SIGNED = "doc_id long, n_shingles long, set_hash long, set_hash2 long, signature binary"


@lru_cache
def distance_bound(threshold: float, miss: float = MISS, symbols: int = SYMBOLS, bits: int = BITS) -> int:
    """Smallest d with P(more than d of the values differ) <= miss at ``threshold``."""
    p = (1 - threshold) * (1 - 2.0**-bits)
    tail = 1.0
    for d in range(symbols + 1):
        tail -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
        if tail <= miss:
            return d
    return symbols


def chunks(bound: int, symbols: int = SYMBOLS) -> list[np.ndarray]:
    """Value positions of so many chunks that ``bound`` errors leave one with at most one."""
    n = min(symbols, bound // 2 + 1)
    return np.array_split(np.arange(symbols), n)


def shingle_sets(w: ws.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their bounds.

    A document with fewer words than ``size`` has its whole sequence as its
    one shingle; one without words has none.
    """
    _, h, doc = ws.windows(w, size)
    count = np.diff(w.bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    for i in short.tolist():
        own = w.hash[w.bounds[i] : w.bounds[i + 1]]
        one = ws.Words(0, np.array([0, len(own)]), own, own, own, own)
        h = np.append(h, ws.windows(one, len(own))[1])
        doc = np.append(doc, i)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(w.docs + 1))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = ws.keyed(SYMBOLS, 99) | np.uint64(1)
        for b in batches:
            for w in ws.scan(b.column(1), "space", lower=True):
                h, at = shingle_sets(w, size)
                n = np.diff(at)
                has = np.flatnonzero(n)
                sig = np.zeros((w.docs, SYMBOLS), dtype=np.uint16)
                sums = np.zeros((2, w.docs), dtype=np.uint64)
                if len(has):
                    starts = at[has]
                    for k in range(SYMBOLS):
                        sig[has, k] = ws.mix64(np.minimum.reduceat(h * factor[k], starts)) & np.uint64((1 << BITS) - 1)
                    for j, seed in enumerate((3, 5)):
                        sums[j, has] = np.add.reduceat(ws.mix64(h ^ ws.keyed(1, seed)[0]), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(w.first, w.docs),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "set_hash2", "signature"],
                )

    return run


def _chunk_keys(sig: np.ndarray, bound: int) -> list[np.ndarray]:
    """One array of keys for each chunk and each value that it leaves out."""
    out = []
    for c, cols in enumerate(chunks(bound)):
        for leave in cols.tolist():
            v = np.full(len(sig), np.uint64(c * 1000 + leave))
            for j in cols.tolist():
                if j != leave:
                    v = ws.mix64(v * np.uint64(31) + sig[:, j].astype(np.uint64))
            out.append(v)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), SYMBOLS)


def _emit_keys(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                keys = _chunk_keys(_matrix(part.column(1)), bound)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], names=["key", "doc_id"])

    return run


def _values(signatures: pa.Array) -> np.ndarray:
    """The values of each signature as keys of their own, a row each."""
    return ws.mix64(_matrix(signatures).astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(32)))


def _emit_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values that at least two of up to ``COUNTED`` rows have, and their number there."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

    held, rows = [], 0
    for b in batches:
        for lo in range(0, b.num_rows, COUNTED):
            part = b.slice(lo, COUNTED)
            held.append(_values(part.column(0)).ravel())
            rows += part.num_rows
            if rows >= COUNTED:
                yield counted(held)
                held, rows = [], 0
    if held:
        yield counted(held)


def _emit_rarest(bound: int, common: np.ndarray, count: np.ndarray):
    """The ``bound + 1`` rarest values of each signature; ``common`` are sorted keys of known numbers, and all others count as rarer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                keys = _values(part.column(2))
                n = np.zeros(keys.shape, dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                    n = np.where(common[at] == keys, count[at], 0)
                first = np.lexsort((keys, n), axis=1)[:, : bound + 1]
                keys = np.take_along_axis(keys, first, axis=1)
                ids, own = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), keys.shape[1]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(own)], names=["key", "doc_id", "component"])

    return run


def _within(percent: int, bound: int):
    """Those pairs (a, b) whose set sizes and signatures allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                ok &= np.count_nonzero(_matrix(b.column("sig_a")) != _matrix(b.column("sig_b")), axis=1) <= bound
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _small_pairs(percent: int, bound: int):
    """Candidate pairs of a key's minority with all of its documents; rows come sorted by key and block, the minority first."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, minor, ids, n, own = (t.column(c).to_numpy() for c in ("key", "block", "minor", "doc_id", "n_shingles", "component"))
        sig = _matrix(t.column("signature").combine_chunks())
        last = np.append(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key))
        ends = np.repeat(last, np.diff(np.concatenate([[0], last])))
        rows, step = np.flatnonzero(minor == 0), 1
        while True:
            rows = rows[rows + step < ends[rows]]
            if not len(rows):
                break
            i, j = rows, rows + step
            near = (own[i] != own[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[near], j[near]
            near = np.count_nonzero(sig[i] != sig[j], axis=1) <= bound
            x, y = ids[i[near]], ids[j[near]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            edge = int(np.searchsorted(key, key[-1], side="left"))
            if edge == 0 and rest and rest[-1].column("key")[-1].as_py() == key[0]:
                rest.append(batch)
                continue
            yield from compare(pa.Table.from_batches([*rest, batch.slice(0, edge)]))
            rest = [batch.slice(edge)]
        if rest:
            yield from compare(pa.Table.from_batches(rest))

    return run


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets have the similarity: intersections by products of incidence matrices."""
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(n), size)
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, 4096), dtype=np.float32)
        part[owner[s:e], column[s:e] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _hot_links(size: int, percent: int):
    """Joined pairs of keys with many documents, two blocks at a time, on full sets.

    Rows come sorted by (key, left, right).  Of each group of linked documents
    every member is paired with the smallest, not with every other.
    """

    def compare(t: pa.Table) -> pa.RecordBatch:
        ids, sets = t.column("doc_id").to_numpy(), []
        for w in ws.scan(t.column("text"), "space", lower=True):
            h, at = shingle_sets(w, size)
            sets += [h[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        alike = _similar(sets, percent)
        label = ids.copy()
        while True:  # smallest id among linked documents, until nothing changes
            least = np.where(alike, label[None, :], np.iinfo(np.int64).max).min(axis=1)
            least = np.minimum(least, label)
            if (least == label).all():
                break
            label = least
        own = label != ids
        return pa.RecordBatch.from_arrays([pa.array(label[own]), pa.array(ids[own])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, l, r = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "left", "right"))
            edges = np.flatnonzero((k[1:] != k[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                group = (int(k[s]), int(l[s]), int(r[s]))
                if held and group != current:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                current = group
                held.append(batch.slice(s, e - s))
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for name in ("text_a", "text_b"):
                own = []
                for w in ws.scan(b.column(name), "space", lower=True):
                    h, at = shingle_sets(w, size)
                    own += [h[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                sets.append(own)
            ok = []
            for x, y in zip(*sets):
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which is no u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected links (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds until all links are between a
    node and its component; each round is written to the shared folder.  The
    smallest neighbours are a table of their own, so that Spark can split the
    join of a node that has many links.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        pairs = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, stored(pairs.select("e.*").where("u <> v").distinct(), "small")
        discard(last, least, large, low)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _confirmed(pairs: DataFrame, reps: DataFrame, text: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that have the similarity: by size and signature first, then on the full sets of their texts."""
    bound = distance_bound(percent / 100)
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"sig_{x}"))
    near = stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_within(percent, bound), "a long, b long").distinct(), "near")
    texts = lambda x: text.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    full = near.join(texts("a"), "a").join(texts("b"), "b").select("a", "b", "text_a", "text_b")
    confirmed = stored(full.mapInArrow(_verify(size, percent), "a long, b long"), "confirmed")
    discard(near)
    return confirmed


def _open_keys(members: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, doc_id, component) of keys with several components, with ``k``, ``minor`` (0 in the minority): those with a minority of at most ``small``, and the others."""
    own = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    span = own.groupBy("key").agg(F.sum("n").alias("k"), F.max(F.struct("n", "component")).alias("top")).where("k > top.n")
    keys = stored(span.select("key", "k", (F.col("k") - F.col("top.n")).alias("rest"), F.col("top.component").alias("major")), "open")
    open_ = stored(members.join(keys, "key").select("key", "doc_id", "component", "k", "rest", (F.col("component") == F.col("major")).cast("int").alias("minor")), "open")
    return open_.where(F.col("rest") <= small), open_.where(F.col("rest") > small)


def _minor_pairs(members: DataFrame, reps: DataFrame, percent: int, bound: int, block: int) -> DataFrame:
    """Candidate pairs between the minority and all documents of each key; a key's documents are dealt out in blocks that each have the whole minority."""
    blocks = F.ceil(F.col("k") / block).cast("int")  # of about eight times the minority, so that it is not repeated often
    own = F.array(F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    dealt = members.select("key", "doc_id", "component", "minor", F.explode(F.when(F.col("minor") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(own)).alias("block"))
    rows = dealt.join(reps, "doc_id").select("key", "block", "minor", "doc_id", "component", "n_shingles", "signature")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "minor").mapInArrow(_small_pairs(percent, bound), "a long, b long").distinct()


def near_duplicate_links(reps: DataFrame, text: DataFrame, size: int, percent: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that give the same components as all links between representatives; see the module's text.

    These are the documents of the pivots' components with the smallest one, and
    those pairs of components that later steps link.
    """
    bound = distance_bound(percent / 100)
    keys = reps.select("doc_id", "signature").mapInArrow(_emit_keys(bound), "key long, doc_id long")
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
    members = stored(keys.join(sizes, "key"), "members")
    score = members.groupBy("doc_id").agg(F.sum("k").alias("score"))
    best = members.join(score, "doc_id").groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m"))
    pivots = stored(best.select("key", (-F.col("m.d")).alias("pivot")), "pivots")
    met = members.join(pivots, "key").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).where("a <> b").distinct()
    own = components(_confirmed(met, reps, text, size, percent)).select(F.col("node").alias("doc_id"), "component")
    discard(sizes, pivots)
    placed = stored(members.select("key", "doc_id").join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "placed")
    few, hot = _open_keys(placed, small)
    discard(members, placed)
    pairs = _minor_pairs(few, reps, percent, bound, min(block, 8 * max(small, 1)))
    hot = stored(hot.select("doc_id", "component").distinct(), "hot")
    n, joined = hot.count(), None
    if n:
        few, many = _open_keys(stored(_rarest_values(hot, n, reps, bound), "rare"), small)
        pairs = pairs.unionByName(_minor_pairs(few, reps, percent, bound, min(block, 8 * max(small, 1))))
        joined = _block_links(many, text, size, percent, block)
    links = _confirmed(pairs, reps, text, size, percent)
    links = links.unionByName(joined) if joined is not None else links
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("component").alias(f"own_{x}"))
    root = lambda x: F.coalesce(f"own_{x}", x).alias(x)
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(root("a"), root("b")).where("a <> b")
    return own.select(F.col("component").alias("a"), F.col("doc_id").alias("b")).unionByName(between)


def _rarest_values(hot: DataFrame, n: int, reps: DataFrame, bound: int) -> DataFrame:
    """(key, doc_id, component) of the n documents (doc_id, component): the bound + 1 values of their signatures that are rarest among them.

    Two signatures within the bound share one of these values whatever the order
    of all values is, as long as it is the same for both; frequent values come last
    so that they are no keys.  So it is enough to count in tasks, and to know the
    ``COMMON`` most frequent values.
    """
    signed = hot.join(reps, "doc_id").select("doc_id", "component", "signature")
    counted = signed.select("signature").coalesce(max(1, n // COUNTED)).mapInArrow(_emit_common, "key long, n long")
    top = counted.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key").limit(COMMON).collect()
    common, count = np.array([r.key for r in top], dtype=np.int64).view(np.uint64), np.array([r.n for r in top], dtype=np.int64)
    order = np.argsort(common)
    return signed.mapInArrow(_emit_rarest(bound, common[order], count[order]), "key long, doc_id long, component long")


def _block_links(many: DataFrame, text: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Links of keys with a large minority, on full sets, by pairs of blocks."""
    # Blocks of the minority are numbered first; two blocks of the largest component need not meet.
    of_minor, of_major = F.ceil(F.col("rest") / block).cast("int"), F.ceil((F.col("k") - F.col("rest")) / block).cast("int")
    place = F.when(F.col("minor") == 0, F.pmod(F.xxhash64("doc_id"), of_minor)).otherwise(of_minor + F.pmod(F.xxhash64("doc_id"), of_major)).cast("int")
    placed = many.select("key", "doc_id", place.alias("block"), F.when(F.col("minor") == 0, of_minor + of_major).otherwise(of_minor).alias("others"))
    met = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(F.least("block", o).alias("left"), F.greatest("block", o).alias("right")))
    dealt = placed.select("key", "doc_id", F.explode(met).alias("m")).select("key", "m.left", "m.right", "doc_id").join(text, "doc_id").select("key", "left", "right", "doc_id", "text")
    return dealt.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInArrow(_hot_links(size, percent), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of ``size``-word shingles (words between white space, A-Z folded).  Texts
    without words, and null texts, link with nothing.  The component is the
    smallest id reachable.  Rows with a null id are
    kept, without a component; rows that share an id count as one document with
    several texts and are kept or dropped together.
    """
    text = keyed_text(docs, id_col, text_col)
    signed = stored(text.mapInArrow(_sign(size), _SIGNED), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("set_hash", "set_hash2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "classes")
    links = near_duplicate_links(classes.select("doc_id", "n_shingles", "signature"), text.where("doc_id is not null"), size, percent)
    joined = components(links)
    placed = classes.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set_hash", "set_hash2", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = signed.drop("signature").join(placed, ["set_hash", "set_hash2", "n_shingles"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with only the document of the smallest id of each component."""
    out = near_dedup(docs, id_col, text_col, size, percent).where("not kept").select(F.col("doc_id").alias("__copy"))
    return docs.join(out, id_of(id_col) == F.col("__copy"), "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES = {
    "op3_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as set from w where len(ws) > 0),
e as (select doc_id, len(set) as n, unnest(set) as shingle from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n + b.n) as total from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id and 100 * b.n >= 85 * a.n and 100 * a.n >= 85 * b.n group by all),
link as (select a, b from shared where 100 * k >= 85 * (total - k)),
sides as (select a, b from link union all select b, a from link),
reach as (select doc_id as node, doc_id as root from documents union select sides.b, root from reach join sides on sides.a = node where root < sides.b),
c as (select node, min(root) as root from reach group by node)
select d.doc_id, coalesce(len(set), 0) as n_shingles, root as component_id, root = d.doc_id as kept from documents d left join s on s.doc_id = d.doc_id join c on c.node = d.doc_id
"""
}

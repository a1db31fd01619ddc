"""Spelling variants: frequent words one edit apart, each grouped under its far more frequent neighbour.

The words of all texts are counted, and those frequent enough are the vocabulary.
It is hashed into blocked Bloom filters, one per word length, which are
broadcast.  Every word generates its one-letter deletions and replacements (an
insertion is a deletion of the longer word), and probes the filter of the edit's
length.  Only edits that the filter has are shuffled, to an exact join with the
vocabulary that removes the false ones.  A pair of words is found once, from the
longer or the smaller word, and counts for both.

The filters take ``BITS_PER_WORD`` bits a word and at most ``FILTER_BYTES`` at a
time.  A vocabulary that needs more is hashed in several passes, each for a part
of the hash values, with the same result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.shared import plain, stored, table

MIN_LENGTH, MIN_COUNT = 5, 3
FILTER_BYTES, BITS_PER_WORD = 1 << 26, 16
#: Words of this many letters and more share a filter.
LONGEST_SHARD = 64
#: Words of a task that probes, edits hashed at once, and bytes of text counted at once.
PROBE_ROWS, PROBES, SLICE = 20_000, 1 << 19, 1 << 22

_U = np.uint64
_P, _Q = _U(0xD6E8FEB86659FD93), _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_LETTER = ws.keyed(256, 13)
_LANES = 4  # of 64 bits, with a bit each of a word


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crc32(low: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from the checksum ``before`` it."""
    size = end - start
    out = before.copy()
    for k in np.flatnonzero(size > 64).tolist():
        out[k] = zlib.crc32(low[start[k] : end[k]].tobytes(), int(before[k]))
    short = np.flatnonzero(size <= 64)
    order = short[np.argsort(-size[short], kind="stable")]
    state, first, left = ~before[order], start[order], size[order]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # spans longer than j
        part = state[:n]
        state[:n] = _CRC[(part ^ low[first[:n] + j]) & 0xFF] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out


def _count(mistype: int, min_length: int):
    """Counts of words, slice by slice.  With ``mistype`` a word whose checksum with its document's id that number divides loses a letter."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32

    def words(part: np.ndarray, edge: np.ndarray, ids: list) -> Iterator[pa.RecordBatch]:
        low = fold[part]
        lead = low == 0xC3  # U+00C0 to U+00FF are this byte and one more
        letter = ((low >= 97) & (low <= 122)) | lead
        letter[1:] |= lead[:-1]
        inside = np.zeros(len(low) + 2, dtype=np.int8)
        inside[1:-1] = letter
        cut = np.zeros(len(low) + 1, dtype=bool)
        cut[edge] = True
        start = np.flatnonzero((inside[1:] == 1) & ((inside[:-1] == 0) | cut))
        end = np.flatnonzero((inside[:-1] == 1) & ((inside[1:] == 0) | cut))
        pairs = np.zeros(len(low) + 1, dtype=np.int64)
        np.cumsum(lead, out=pairs[1:])
        long = end - start - (pairs[end] - pairs[start]) >= min_length
        start, end = start[long], end[long]
        mistyped: Counter[str] = Counter()
        if mistype and len(start):
            doc = np.searchsorted(edge, start, side="right") - 1
            known = np.array([i is not None for i in ids])
            own = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
            crc = _crc32(low, start, end, own[doc])
            hit = (crc % np.uint32(mistype) == 0) & known[doc]
            for k in np.flatnonzero(hit).tolist():
                word = low[start[k] : end[k]].tobytes().decode()
                k = int(crc[k]) % len(word)
                if len(word) > min_length:
                    mistyped[word[:k] + word[k + 1 :]] += 1
            start, end = start[~hit], end[~hit]
        if len(start):
            key, check = (ws.span_hashes(low, start, end, ws.keyed(256, seed)) for seed in (7, 19))
            _, first, place, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if (check[first][place] == check).all():
                yield pa.RecordBatch.from_arrays([ws.span_strings(low, start[first], (end - start)[first]), pa.array(n)], names=["word", "n"])
            else:  # two words with one hash
                for s, e in zip(start.tolist(), end.tolist()):
                    mistyped[low[s:e].tobytes().decode()] += 1
        if mistyped:
            yield pa.RecordBatch.from_arrays([pa.array(list(mistyped)), pa.array(list(mistyped.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_pylist() if mistype else []
            for row, part, edge in ws.slices(b.column("text"), SLICE):
                yield from words(part, edge, ids[row : row + len(edge) - 1])

    return run


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, mistype: int = 0) -> DataFrame:
    """(word, n) of the words that occur ``min_count`` times or more in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower
    case and at least ``min_length`` code points; a null text has none.  With
    ``mistype``, a test of the grouping, a word of a document loses a letter
    where ``mistype`` divides the CRC-32 of ``id:word``, namely the letter at
    that checksum modulo its length; rows without an id lose none.
    """
    rows = docs.select(plain(id_col).cast("string").alias("id"), plain(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_count(mistype, min_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return ws.mix64(total + _U(length * 0xA0761D6478BD642F % (1 << 64)))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(n, _P)]), dtype=_U)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, letters as a matrix); every letter is one byte of Latin-1."""
    raw = [w.encode("latin-1") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield n, at, np.frombuffer(b"".join(raw[k] for k in at.tolist()), dtype=np.uint8).reshape(len(at), n)


class Filters:
    """Blocked Bloom filters by word length: a word has a block of its length's filter, and one bit in each lane of it."""

    def __init__(self, counts: dict[int, int], limit: int, bits: int = BITS_PER_WORD):
        self.shards = {n: max(1, -(-c * bits // (64 * _LANES))) for n, c in sorted(counts.items())}
        self.passes = -(-sum(self.shards.values()) * 8 * _LANES // max(limit, 8 * _LANES))
        self.shards = {n: -(-c // self.passes) for n, c in self.shards.items()}
        self.first = dict(zip(self.shards, np.cumsum([0, *self.shards.values()]).tolist()))
        self.blocks = sum(self.shards.values())
        self.lanes = np.zeros((_LANES, 0), dtype=_U)

    def turn(self, key: np.ndarray) -> np.ndarray:
        """The pass that a key belongs to."""
        return (key >> _U(24)) % _U(self.passes)

    def block(self, key: np.ndarray, length: int) -> np.ndarray:
        n = min(length, LONGEST_SHARD)
        return ((key >> _U(32)) * _U(self.shards[n]) >> _U(32)).astype(np.int64) + self.first[n]

    @staticmethod
    def bit(key: np.ndarray, lane: int) -> np.ndarray:
        return _U(1) << ((key >> _U(6 * lane)) & _U(63))

    def may_hold(self, key: np.ndarray, length: int, turn: int) -> np.ndarray:
        """Places of the keys that may be in the filter of a length."""
        if min(length, LONGEST_SHARD) not in self.shards:
            return np.empty(0, np.int64)
        at = np.flatnonzero(self.turn(key) == turn) if self.passes > 1 else np.arange(len(key))
        block = self.block(key[at], length)
        for lane in range(_LANES):
            ok = (self.lanes[lane][block] & self.bit(key[at], lane)) != 0
            at, block = at[ok], block[ok]
        return at

    def fill(self, words: DataFrame, turn: int) -> None:
        """Set the bits of one pass: at most ``FILTER_BYTES`` of lanes come to the driver, merged before."""
        self.lanes = np.zeros((_LANES, 0), dtype=_U)  # those of another pass are not sent to the tasks
        with_lanes = "block long, " + ", ".join(f"l{i} long" for i in range(_LANES))
        merged = words.select("word").mapInArrow(_lanes(self, turn), with_lanes).groupBy("block").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(_LANES)]).toArrow()
        self.lanes = np.zeros((_LANES, self.blocks), dtype=_U)
        at = merged.column("block").to_numpy()
        for i in range(_LANES):
            self.lanes[i][at] = merged.column(f"l{i}").to_numpy().view(_U)


def _lanes(filters: Filters, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, _, letters in _by_length(b.column(0).to_pylist()):
                key = _key((_LETTER[letters] * _powers(n)[:n]).sum(axis=1, dtype=_U), n)
                key = key[filters.turn(key) == turn]
                columns = [pa.array(filters.block(key, n)), *(pa.array(filters.bit(key, i).view(np.int64)) for i in range(_LANES))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", *(f"l{i}" for i in range(_LANES))])

    return run


def _probe(shared, alphabet: np.ndarray, turn: int):
    """Rows (word, n) with each edit that the filters may have: (word, n, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        value = _LETTER[alphabet]
        for b in batches:
            words, found = b.column("word").to_pylist(), []
            for n, at, letters in _by_length(words):
                power = _powers(n)
                for lo in range(0, len(at), max(1, PROBES // (n * len(alphabet)))):
                    own, part = at[lo : lo + max(1, PROBES // (n * len(alphabet)))], letters[lo : lo + max(1, PROBES // (n * len(alphabet)))]
                    term = _LETTER[part] * power[:n]
                    up_to = np.cumsum(term, axis=1, dtype=_U)
                    total = up_to[:, -1]
                    # Deletions: what follows moves one place down.  Of a run of equal letters the first one goes.
                    less = up_to - term + (total[:, None] - up_to) * _Q
                    new = np.ones(part.shape, dtype=bool)
                    new[:, 1:] = part[:, 1:] != part[:, :-1]
                    row, place = np.nonzero(new)
                    for k in filters.may_hold(_key(less[new], n - 1), n - 1, turn).tolist():
                        w, p = int(own[row[k]]), int(place[k])
                        found.append((w, words[w][:p] + words[w][p + 1 :]))
                    # Replacements by greater letters; the others are found from the other word.
                    step = max(1, PROBES // (len(own) * len(alphabet)))
                    for p0 in range(0, n, step):
                        old = part[:, p0 : p0 + step, None]
                        row, place, to = np.nonzero(alphabet > old)
                        key = (total[:, None, None] + (value - _LETTER[old]) * power[p0 : min(p0 + step, n), None])[row, place, to]
                        for k in filters.may_hold(_key(key, n), n, turn).tolist():
                            w, p = int(own[row[k]]), int(place[k]) + p0
                            found.append((w, words[w][:p] + chr(alphabet[to[k]]) + words[w][p + 1 :]))
            at = pa.array([w for w, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("word").take(at), b.column("n").take(at), pa.array([e for _, e in found], pa.string())], names=["word", "n", "near"])

    return run


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n) of all pairs of a stored vocabulary (word, n) that one edit turns into each other, each pair once."""
    spark = words.sparkSession
    sizes = words.groupBy(F.least(F.char_length("word"), F.lit(LONGEST_SHARD)).alias("size")).count().collect()  # LONGEST_SHARD rows at most
    counts = {r["size"]: r["count"] for r in sizes}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct().collect()  # 90 at most
    alphabet = np.array(sorted(ord(r.letter) for r in letters), dtype=np.uint8)
    filters = Filters(counts, filter_bytes)
    spread = words.repartition(-(-sum(counts.values()) // PROBE_ROWS) or 1, "word")
    edits = []
    for turn in range(filters.passes):
        filters.fill(words, turn)
        shared = spark.sparkContext.broadcast(filters)
        edits.append(stored(spread.mapInArrow(_probe(shared, alphabet, turn), "word string, n long, near string"), "edits"))
        shared.unpersist()
    if not edits:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    return reduce(DataFrame.unionByName, edits).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form).

    A round doubles the steps that a word has taken; a form has at least twice
    the count, so there are 63 steps, that is six rounds, at most.  Words that
    have arrived leave the rounds.
    """
    open_, done = stored(forms.select("word", F.col("form").alias("at")), "open"), []
    steps = open_.select(F.col("word").alias("at"), F.col("at").alias("next"))
    while True:
        moved = stored(open_.join(steps, "at", "left"), "moved")
        done.append(moved.where("next is null").select("word", F.col("at").alias("root")))
        open_ = moved.where("next is not null").select("word", F.col("next").alias("at"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # Words that arrive have taken all steps there are; for the others a step becomes two.
        twice = steps.join(steps.select(F.col("at").alias("next"), F.col("next").alias("far")), "next", "left")
        steps = stored(twice.select("at", F.coalesce("far", "next").alias("next")), "steps")


def spelling_variants(words: DataFrame, ratio: int = 2, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words.

    A word's form is its near word of largest n, ties to the smaller word, if
    that n is at least ``ratio`` times the word's own; else null, as form_n is.
    The root is where the forms lead in the end, the word itself if it has none.
    ``ratio`` must be at least 2, so that forms never lead back.  An empty
    vocabulary gives no row.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = words if hasattr(words, "stored_at") else stored(words, "words")
    pair = near_words(words, filter_bytes)
    way = lambda a, b: F.struct(F.col(a).alias("word"), (-F.col(f"{b}_n" if b == "near" else "n")).alias("less"), F.col(b).alias("near"))
    ways = pair.select(F.explode(F.array(way("word", "near"), way("near", "word"))).alias("w")).select("w.*")
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("b"))
    found = words.join(best, "word", "left").withColumn("ok", -F.col("b.less") >= F.col("n") * ratio)
    forms = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("b.near")).alias("form"), F.when(F.col("ok"), -F.col("b.less")).alias("form_n")), "forms")
    roots = _roots(forms.where("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents"), mistype=97))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {
    "op13_spelling_variants": r"""
with recursive tab as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(i))),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents where text is not null),
own as (select doc_id, run, count(*) as n from runs where length(run) >= 5 group by all),
bytes as (select doc_id, run, n, flatten(list_transform(regexp_extract_all(doc_id::varchar || ':' || run, '.'), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from own),
crc as (select doc_id, run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, y: xor(t[xor(c, y) % 256 + 1], c // 256)), 4294967295::bigint) as h from bytes, tab),
typed as (select case when h % 97 = 0 and doc_id is not null then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from crc),
v as (select word, sum(n)::bigint as n from typed where length(word) >= 5 group by 1 having sum(n) >= 3),
d as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select word, n, unnest(range(length(word))) as i from v)),
pairs as (
  select a.word, b.word as near, b.n as near_n from d a join d b on a.less = b.less and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select d.word, v.word, v.n from d join v on d.less = v.word
  union select v.word, d.word, d.n from d join v on d.less = v.word),
best as (select word, count(*) as n_near, max(near_n) as top from pairs group by 1),
f as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when top >= 2 * v.n then (select min(near) from pairs p where p.word = v.word and p.near_n = top) end as form,
    case when top >= 2 * v.n then top end as form_n from v left join best using (word)),
walk as (select word, coalesce(form, word) as reached, form is not null as more from f union all select w.word, coalesce(f.form, f.word), f.form is not null from walk w join f on f.word = w.reached where w.more)
select f.word, form, reached as root, n, n_near, form_n::bigint as form_n from f join walk on walk.word = f.word and not more
"""
}

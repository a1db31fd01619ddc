"""Language identification by rank-order n-gram profiles.

Texts are lower-cased, every run of other characters than letters becomes one
space, and the 1- to ``MAX_N``-grams of letters and spaces are counted over all
training texts, whole.  A language's profile is its ``PROFILE`` most frequent
n-grams in order.  A text's own most frequent n-grams are compared with each
profile by the out-of-place distance: the sum of the differences of ranks, with
the largest difference for n-grams that the profile does not have.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.shared import packed, plain, stored, table

MAX_N = 3
PROFILE = 400
LANGUAGES = 1000
UNKNOWN = "und"

_GRAM = "lang string, gram string, n long"
_SLICE = 1 << 19
_ROWS = 512


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that not all their texts are Python strings at once."""
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            yield b.slice(lo, _ROWS)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """A flag for each code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    """Letters in lower case with one space around and between words; empty if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter()[raw]
    if not letter.any():
        return np.empty(0, np.uint32)
    gap = np.ones(len(raw), dtype=bool)
    gap[1:] = letter[:-1]
    kept = np.where(letter, raw, np.uint32(32))[letter | gap]
    head = [] if kept[0] == 32 else [32]
    tail = [] if kept[-1] == 32 else [32]
    return np.concatenate([head, kept, tail]).astype(np.uint32)


def _codes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Integer codes of the n-grams of each length; grams of a lone space are left out."""
    x = points.astype(np.int64)
    code = x
    for n in range(1, MAX_N + 1):
        if n > 1:
            code = (code[:-1] << 21) | x[n - 1 :]
        if len(code):
            yield n, code[code != 32] if n == 1 else code


def _gram(code: int, n: int) -> str:
    return "".join(chr((code >> (21 * k)) & 0x1FFFFF) for k in reversed(range(n)))


def top_grams(points: np.ndarray, limit: int) -> list[str]:
    """The most frequent n-grams; ties go to the shorter, then to the smaller one."""
    counts, codes, sizes = [], [], []
    for n, code in _codes(points):
        u, c = np.unique(code, return_counts=True)
        counts.append(c)
        codes.append(u)
        sizes.append(np.full(len(u), n))
    c, u, s = (np.concatenate(x) for x in (counts, codes, sizes))
    if len(c) > limit:
        least = np.partition(c, len(c) - limit)[len(c) - limit]
        keep = c >= least
        c, u, s = c[keep], u[keep], s[keep]
    order = np.lexsort((u, s, -c))[:limit]
    return [_gram(int(u[i]), int(s[i])) for i in order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of a batch by language, slice by slice."""
    for b in batches:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            x = np.concatenate(waiting.pop(lang)).astype(np.int64)
            sizes.pop(lang)
            alphabet, dense = np.unique(x, return_inverse=True)
            bound = dense == np.searchsorted(alphabet, 32)
            size, out, code = len(alphabet), [], dense
            ok = np.ones(len(x), dtype=bool)
            for n in range(1, MAX_N + 1):
                if n > 1:
                    # Two spaces in a row separate texts; no gram runs across them.
                    ok = ok[:-1] & ~(bound[n - 2 : len(x) - 1] & bound[n - 1 :])
                    code = code[:-1] * size + dense[n - 1 :]
                own = code[ok & ~bound] if n == 1 else code[ok]
                if size**n <= 4 * len(x):
                    c = np.bincount(own, minlength=1)
                    u = np.flatnonzero(c)
                    c = c[u]
                else:
                    u, c = np.unique(own, return_counts=True)
                digits = [(u // size**k) % size for k in reversed(range(n))]
                grams = ["".join(map(chr, t)) for t in zip(*(alphabet[d].tolist() for d in digits))]
                out.append((grams, c))
            grams = [g for part, _ in out for g in part]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(np.concatenate([c for _, c in out]).astype(np.int64))], names=["lang", "gram", "n"])

        for part in _parts([b]):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                p = code_points(text)
                if len(p):
                    waiting.setdefault(lang, []).append(p)
                    sizes[lang] = sizes.get(lang, 0) + len(p)
                    if sizes[lang] > _SLICE:
                        yield flush(lang)
        for lang in list(waiting):
            yield flush(lang)


def language_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of each language's ``size`` most frequent n-grams, from rank 0.

    Rows with a null text or language teach nothing.  Ties go to the shorter,
    then to the smaller n-gram.
    """
    rows = labelled.select(plain(lang_col).cast("string").alias("lang"), plain(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, _GRAM).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.char_length("gram"), "gram")
    return counts.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < size).select("lang", "gram", "rank")


def _predict(shared, size: int):
    """Rows with the better of what they have and the best of some languages; of equal ones what they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, place, ranks = shared.value
        absent = len(ranks) - 1
        most = float(size)
        for b in _parts(batches):
            best, score = b.column("lang_pred").to_pylist(), b.column("score").to_pylist()
            for i, text in enumerate(b.column("text").to_pylist()):
                p = code_points(text) if text else ()
                if not len(p):
                    continue
                grams = top_grams(p, size)
                at = np.fromiter((place.get(g, absent) for g in grams), dtype=np.int64, count=len(grams))
                own = np.arange(len(grams))[:, None]
                known = ranks[at]
                distance = np.where(known < 0, size, np.abs(known - own)).sum(axis=0)
                k = int(distance.argmin())
                found = max(0.0, 1.0 - float(distance[k]) / (most * len(grams)))
                if best[i] == UNKNOWN or found > score[i]:
                    best[i], score[i] = langs[k], found
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["row", "text", "lang_pred", "score"])

    return run


def _model(profiles: DataFrame, langs: list[str]):
    """The profiles of at most LANGUAGES languages: LANGUAGES times the profile size rows."""
    rows = profiles.where(F.col("lang").isin(langs)).collect()
    column = {x: k for k, x in enumerate(langs)}
    place: dict[str, int] = {}
    for r in rows:
        place.setdefault(r.gram, len(place))
    ranks = np.full((len(place) + 1, len(langs)), -1, dtype=np.int64)
    for r in rows:
        ranks[place[r.gram], column[r.lang]] = r.rank
    return langs, place, ranks


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = PROFILE, languages: int = LANGUAGES) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced).

    The score is one minus the distance over the largest one; texts that are
    null or have no letter get ``und`` and 0, as do all if there is no profile.
    Equal distances go to the language that sorts first.  Profiles are broadcast
    for ``languages`` languages at a time; with more of them every text is
    compared in several passes, with the same result.
    """
    spark = docs.sparkSession
    known = stored(profiles, "profiles")
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(packed(docs, text_col, "lang_pred", "score").alias("row"), plain(text_col).cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    like = f"row {rows.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double"
    for lo in range(0, len(langs), languages):
        shared = spark.sparkContext.broadcast(_model(known, langs[lo : lo + languages]))
        rows = rows.mapInArrow(_predict(shared, size), like)
    place = {c: i for i, c in enumerate(docs.columns)}
    return rows.select(*[(F.col("text") if c == text_col else F.col(f"row.c{place[c]}")).alias(c) for c in kept], "lang_pred", "score")


def held_out(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    profiles = language_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES = {
    "op10_language_id": r"""
with d as (select doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '\P{L}+', ' ', 'g')) as t, doc_id::varchar as s from documents),
h as (select doc_id, lang, t, xor(4294967295, list_reduce(range(8 * len(s)), lambda c, k: xor(case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])::bigint) else c end >> 1, case when (case when k % 8 = 0 then xor(c, ascii(s[k // 8 + 1])::bigint) else c end) % 2 = 1 then 3988292384::bigint else 0::bigint end), 4294967295::bigint)) % 5 = 0 as held_out from d),
x as (select doc_id, regexp_extract_all(' ' || t || ' ', '.') as c from d where t <> ''),
g as (select doc_id, unnest(list_concat(list_filter(c, lambda y: y <> ' '), list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) as gram from x),
own as (select doc_id, gram, count(*) as n from g group by all),
total as (select lang, gram, sum(n) as n from own join h using (doc_id) where not held_out and lang is not null group by all),
profile as (select lang, gram, row_number() over (partition by lang order by n desc, len(gram), gram) - 1 as rank from total qualify rank < 400),
top as (select doc_id, gram, row_number() over (partition by doc_id order by n desc, len(gram), gram) - 1 as place from own qualify place < 400),
size as (select doc_id, count(*) as n from top group by 1),
near as (select doc_id, lang, sum(400 - abs(rank - place)) as gain from top join profile using (gram) group by all),
far as (select size.doc_id, l.lang, 400 * n - coalesce(gain, 0) as distance, n from size cross join (select distinct lang from profile) l left join near on near.doc_id = size.doc_id and near.lang = l.lang),
best as (select doc_id, lang, greatest(0, 1 - distance::double / (400::double * n)) as score from far qualify row_number() over (partition by doc_id order by distance, lang) = 1)
select h.doc_id, held_out, coalesce(best.lang, 'und') as lang_pred, coalesce(score, 0)::double as score from h left join best on best.doc_id = h.doc_id
"""
}

"""Token-id files: ORC stripes with run-length encoded integers.

Documents are range-partitioned and sorted by id, encoded, and written one
ORC file per partition.  ORC encodes the ids in integer runs, keeps row
indexes (minimum and maximum per ``orc.row.index.stride`` rows) and a Bloom
filter on the document id, so stripes are read in parallel and a look-up by id
skips the stripes and row groups that can't hold it.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import wordscan as ws
from strata.llm.idpool import IdPool
from strata.llm.shared import keyed_text, new_path, stored, table

END_ID = 1
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}

_tokenizers: dict[str, tuple] = {}


#: Spans that a worker process keeps the ids of, some 60 bytes each.
POOL = 1_500_000
_pools: dict[str, IdPool] = {}


def _tokenizer(path: str):
    """The tokenizer of this worker process, its control strings, and whether it takes a text in spans."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _tokenizers[path] = (t, [x.content.encode() for x in t.get_added_tokens_decoder().values()], splits_at_spans(t.to_str()))
    return _tokenizers[path]


#: The normaliser and the pre-tokenizer of a lower-casing word tokenizer, as its file has them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_spans(description: str) -> bool:
    """Whether :func:`spans` holds for a tokenizer, by its JSON: its words and case folding are the ones known to allow it, and it has no random choices."""
    d = json.loads(description)
    return d["normalizer"] == _NORMALIZER and d["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_WORDS, _BYTES]} and not d["model"].get("dropout") and not d["truncation"] and not d["padding"]


def _pool(path: str) -> IdPool:
    """The spans that this worker process knows: the next task's texts have many of the same ones."""
    if path not in _pools:
        tokenizer = _tokenizer(path)[0]
        _pools[path] = IdPool(lambda found: [e.ids for e in tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in found], add_special_tokens=False)], limit=POOL)
    return _pools[path]


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    sign = ((b >= 33) & (b <= 47)) | ((b >= 58) & (b <= 64)) | ((b >= 91) & (b <= 96)) | ((b >= 123) & (b <= 126))
    sign[ord("'")] = False
    return letter, sign


def spans(part: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans whose encodings, put together, are the encoding of the text.

    A lower-casing word tokenizer drops spaces and keeps letters and signs in
    different words, so a text may be cut at spaces and between an ASCII
    letter and an ASCII sign.  The apostrophe is no such sign, since endings
    such as ``'s`` are words of their own.
    """
    letter, sign = _letter_table()
    is_letter, is_sign, is_text = letter[part], sign[part], part != 0x20
    cut = np.ones(len(part), dtype=bool)
    cut[1:] = ~is_text[:-1] | (is_letter[1:] & is_sign[:-1]) | (is_sign[1:] & is_letter[:-1])
    cut[edge[:-1][edge[:-1] < len(part)]] = True
    start = np.flatnonzero(is_text & cut)
    stop = np.ones(len(part), dtype=bool)
    stop[:-1] = cut[1:] | ~is_text[1:]
    return start, np.flatnonzero(is_text & stop) + 1


def _whole(tokenizer, tail: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text encoded as a whole, for tokenizers that may look across words or keep case; up to a slice of texts at a time."""
    for b in batches:
        for row, part, edge in ws.slices(b.column(1)):
            raw = part.tobytes()
            found = tokenizer.encode_batch_fast([raw[s:e].decode("utf-8", "replace") for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())], add_special_tokens=False)
            ids = pa.array([e.ids + tail for e in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(ids)), ids], names=["doc_id", "ids"])


def _encode(path: str, end_id: int | None):
    tail = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, special, in_spans = _tokenizer(path)
        if not in_spans:
            yield from _whole(tokenizer, tail, batches)
            return
        pool = _pool(path)
        value, second = ws.byte_values(lower=True), ws.byte_values(lower=True, seed=29)
        for b in batches:
            for row, part, edge in ws.slices(b.column(1)):
                start, end = spans(part, edge)
                ids, count = pool.ids_of(ws.span_hashes(part, start, end, value), ws.span_hashes(part, start, end, second), start, end, part)
                at = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, edge)]
                raw = part.tobytes()
                odd = {i for i in range(len(edge) - 1) if any(x in raw[edge[i] : edge[i + 1]] for x in special)} if any(x in raw for x in special) else ()
                lists = []
                for i in range(len(edge) - 1):
                    own = ids[at[i] : at[i + 1]]
                    if i in odd:  # a control string is one token, signs and letters together
                        own = np.array(tokenizer.encode(raw[edge[i] : edge[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.int32)
                    lists += [own, np.array(tail, dtype=np.int32)]
                sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)).reshape(-1, 2).sum(axis=1)
                values = pa.array(np.concatenate(lists), pa.int32())
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, len(edge) - 1), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, partitions: int | None = None) -> None:
    """Encode every text and write (doc_id, ids) as ORC files in ascending id order.

    A null text is empty; a null id sorts first, and an id that is no integer is
    an error; rows that share an id are all written.  ``end_id`` is put after each
    document unless it is None.  Texts go to the tokenizer in spans where it is
    known to take them so, and whole otherwise.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        at = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("file"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "file", "n_tokens", "ids_crc32"],
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of token files; filters on doc_id prune stripes and row groups."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def look_up(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; files' and stripes' minima and Bloom filters rule out what need not be read."""
    return read_token_files(spark, path).where(F.col("doc_id").isin([int(i) for i in ids]))


def token_file_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of token files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids of all documents before it.  Sums run
    inside each file; the files' totals, one row per file, are summed across
    files.  Rows that share an id keep a fixed order by length and checksum.
    """
    rows = read_token_files(spark, path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))
    digests = stored(rows.mapInArrow(_digest, "doc_id long, file string, n_tokens long, ids_crc32 long"), "digests")
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    totals = placed.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("least"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(before.select("file", "before"), "file")
    return joined.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_file_index(spark, path)


QUERIES = {"op5_token_files": op5_token_files}
ORACLES: dict[str, str] = {}

"""Jobs over binary files: arrays, audio and checksums."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import wave
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.session import scratch


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def binary_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """(path, length, content) of the files below a folder with a suffix, in any case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", "length", "content").where(F.lower("path").endswith(suffix.lower()))


def list_audio(spark: SparkSession, path: str, suffix: str = ".wav") -> DataFrame:
    """(track_id, path, length) of the audio files in a folder, or below it if it has none itself; contents are not read."""
    flat = binary_files(spark, path, suffix, recursive=False)
    found = flat if not flat.select("path").isEmpty() else binary_files(spark, path, suffix)
    return found.select(stem(F.col("path")).alias("track_id"), "path", "length").orderBy("path")


def _arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for track, content in zip(f.track_id, f.content):
            x = np.load(io.BytesIO(content), allow_pickle=False)
            if not 1 <= x.ndim <= 4:
                raise ValueError(f"array of rank {x.ndim} in {track}")
            # (segments, layers, time, dim): missing axes in front; a rank of three has no time.
            x = x.reshape((1, 1, 1, -1)) if x.ndim == 1 else x[None, :, None, :] if x.ndim == 2 else x[:, :, None, :] if x.ndim == 3 else x
            rows = [(track, s, t, layer, x[s, layer, t].astype(float).tolist()) for s in range(x.shape[0]) for t in range(x.shape[2]) for layer in range(x.shape[1])]
            yield pd.DataFrame(rows, columns=["track_id", "segment_idx", "t", "layer", "vec"])


def ingest_npy(files: DataFrame) -> DataFrame:
    """(track_id, segment_idx, t, layer, vec) of ``.npy`` files of rank one to four; pickles are refused."""
    named = files.select(stem(F.col("path")).alias("track_id"), "content")
    return named.mapInPandas(_arrays, "track_id string, segment_idx int, t int, layer int, vec array<double>")


def _targets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for track, content in zip(f.track_id, f.content):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    category, _, field = name.removesuffix(".npy").replace(".", "/", 1).partition("/")
                    rows.append((track, category, field, np.atleast_1d(np.load(io.BytesIO(z.read(name)), allow_pickle=False)).astype(float).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["track_id", "category", "field", "values"])


def ingest_targets(files: DataFrame) -> DataFrame:
    """(track_id, category, field, values) of ``.npz`` files with plain arrays named ``category.field``; pickles are refused."""
    named = files.select(F.regexp_replace(stem(F.col("path")), "_(segment_)?targets$", "").alias("track_id"), "content")
    return named.mapInPandas(_targets, "track_id string, category string, field string, values array<double>")


def _pcm(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    return rate, x.reshape(-1, channels).mean(axis=1, dtype=np.float32)


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for track, content in zip(f.track_id, f.content):
            try:
                rate, x = _pcm(content)
                rows.append((track, rate, x.tolist(), None))
            except Exception as e:  # one bad file does not stop the job; the error is a column
                rows.append((track, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["track_id", "sample_rate", "samples", "error"]).astype({"sample_rate": "Int32"})


def decode_wav(files: DataFrame) -> DataFrame:
    """(track_id, sample_rate, samples, error) of PCM files; samples are the mean over channels."""
    named = files.select(stem(F.col("path")).alias("track_id"), "content")
    return named.mapInPandas(_decode, "track_id string, sample_rate int, samples array<float>, error string")


def _probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, content in zip(f.path, f.content):
            try:
                with wave.open(io.BytesIO(content)) as w:
                    rows.append((path, True, w.getframerate(), w.getnframes() / w.getframerate(), w.getnchannels(), len(w.readframes(1))))
            except Exception:
                rows.append((path, False, None, None, None, None))
        yield pd.DataFrame(rows, columns=["path", "readable", "sample_rate", "duration", "channels", "probe"]).astype({"sample_rate": "Int32", "channels": "Int32", "probe": "Int32"})


def validate_audio(files: DataFrame, min_duration: float = 1.0) -> DataFrame:
    """(path, valid, readable, sample_rate, duration, channels, errors) of audio files."""
    found = files.select("path", "content").mapInPandas(_probe, "path string, readable boolean, sample_rate int, duration double, channels int, probe int")
    errors = F.array_compact(F.array(
        F.when(~F.col("readable"), "unreadable header"), F.when(F.col("duration") < min_duration, "too short"), F.when(F.col("readable") & (F.coalesce("probe", F.lit(0)) == 0), "no samples"),
    ))
    return found.select("path", (F.size(errors) == 0).alias("valid"), "readable", "sample_rate", "duration", "channels", errors.alias("errors"))


#: Bytes of a file that a task holds while it reads it.
BLOCK = 1 << 22


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, size) of the files below a folder, by a listing; no content is read.  Empty and hidden files are left out, as Spark's reader does."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return rows.select(F.regexp_extract("path", f"/{base}/(.*)$", 1).alias("file"), "path", F.col("length").alias("size"))


def _one_a_task(files: DataFrame) -> DataFrame:
    """Files dealt to tasks by name, a few to each, so that listing many small ones and few large ones both spread."""
    return files.repartition(max(1, min(10_000, files.count())), "path")


def _digest(blocks: Iterator[bytes]) -> tuple[int, str, str]:
    size, sha, md5 = 0, hashlib.sha256(), hashlib.md5(usedforsecurity=False)
    for b in blocks:
        size += len(b)
        sha.update(b)
        md5.update(b)
    return size, sha.hexdigest(), md5.hexdigest()


#: Schemes that tasks open by themselves; files of other stores come through Spark's reader, whole.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _open(path: str):
    """(Arrow file system, name in it) of a path, or of a URI that is not escaped, as Spark lists it; ``s3a`` is the same store as ``s3``."""
    if not re.match("^(?!file:)[a-z0-9]+://", path):
        return pa_fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pa_fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@"))


def _blocks(path: str, block: int) -> Iterator[bytes]:
    """A file in blocks, through the file system of its URI."""
    fs, name = _open(path)
    with fs.open_input_stream(name) as stream:
        while b := stream.read(block):
            yield b


def checksum_table(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, size, sha256, md5) of every file below a folder.

    Files of the stores in ``STREAMED`` are read in blocks and may be larger than
    memory.  Other stores are read by Spark, a file as one value, which ends at 2 GB.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(name, *_digest(_blocks(p, block))) for name, p in zip(f.file, f.path)]
            yield pd.DataFrame(found, columns=["file", "size", "sha256", "md5"])

    listed = file_names(spark, path).select("file", "path")
    if _streamed(listed):
        return _one_a_task(listed).mapInPandas(run, "file string, size long, sha256 string, md5 string")
    whole = binary_files(spark, path).join(listed, "path")
    return whole.select("file", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def _streamed(listed: DataFrame) -> bool:
    """Whether tasks open these files by themselves; the files below one folder are in one store."""
    row = listed.select("path").first()
    return row is None or (re.match("^([a-z0-9]+):", row.path) or ["", "file"])[1] in STREAMED


def copy_files(spark: SparkSession, source: str, target: str, block: int = BLOCK) -> DataFrame:
    """Copy every file below a folder byte by byte between stores of ``STREAMED``; return (file, size, sha256, md5) of what was read.

    A file is written under another name and renamed when it is whole; one that
    is there with the same size and digest is left, so a run that was stopped
    goes on where it ended, and a damaged one is written again.  Files of the
    target that the source lacks stay.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for name, path in zip(f.file, f.path):
                own = _digest(_blocks(path, block))
                to, base = _open(target)
                there = to.get_file_info(f"{base}/{name}")
                if not (there.is_file and there.size == own[0] and _digest(_blocks(f"{target}/{name}", block)) == own):
                    draft = f"{base}/{name}.{uuid.uuid4().hex}.part"
                    to.create_dir(draft.rsplit("/", 1)[0], recursive=True)
                    with to.open_output_stream(draft) as out:
                        for b in _blocks(path, block):
                            out.write(b)
                    to.move(draft, f"{base}/{name}")
                found.append((name, *own))
            yield pd.DataFrame(found, columns=["file", "size", "sha256", "md5"])

    source, target = source.rstrip("/"), target.rstrip("/")
    listed = file_names(spark, source).select("file", "path")
    if not _streamed(listed):
        raise ValueError(f"files of {source} can't be copied by tasks")
    done = _one_a_task(listed).mapInPandas(run, "file string, size long, sha256 string, md5 string")
    path = scratch(spark, "copied")
    done.write.parquet(path)  # the copy happens once, here
    return spark.read.schema(done.schema).parquet(path)


#: Samples that one transform of a batch of segments takes.
TRANSFORMED = 1 << 20


def _spectra(rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (track_id, segment_idx, samples) to rows of bins; segments of one length are transformed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("samples").value_lengths().to_numpy(zero_copy_only=False)
            for n in map(int, np.unique(lengths)):
                at, step, freq = np.flatnonzero(lengths == n), max(1, TRANSFORMED // max(1, n)), np.fft.rfftfreq(n, 1 / rate)
                for lo in range(0, len(at), step):
                    part = b.take(pa.array(at[lo : lo + step]))
                    x = part.column("samples").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                    mag = np.abs(np.fft.rfft(x))
                    own = pa.array(np.repeat(np.arange(len(x)), len(freq)))
                    bins = [pa.array(np.tile(freq, len(x))), pa.array(mag.ravel(), from_pandas=True)]
                    yield pa.RecordBatch.from_arrays([part.column("track_id").take(own), part.column("segment_idx").take(own), *bins], names=["track_id", "frame", "freq", "mag"])

    return run


def spectra(segments: DataFrame, rate: float) -> DataFrame:
    """(track_id, frame, freq, mag) of segments with samples: one row per bin of each segment's spectrum."""
    kind = segments.schema["track_id"].dataType.simpleString()
    return segments.select("track_id", F.col("segment_idx").cast("int").alias("segment_idx"), "samples").mapInArrow(_spectra(rate), f"track_id {kind}, frame int, freq double, mag double")


def encode_batches(segments: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], length: int, n_layers: int, batch_size: int = 32) -> DataFrame:
    """(track_id, segment_idx, layers) by a user's encoder from (batch, samples) to (batch, layers, dim)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    def make():
        encode = make_encoder()
        return lambda x: encode(np.asarray(x)).reshape(len(x), -1)

    run = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[length]])
    flat = segments.select("track_id", "segment_idx", run(F.col("samples").cast("array<double>")).alias("flat"))
    width = F.size("flat") / n_layers
    return flat.select("track_id", "segment_idx", F.transform(F.sequence(F.lit(0), F.lit(n_layers - 1)), lambda k: F.slice("flat", (k * width + 1).cast("int"), width.cast("int"))).alias("layers"))


def encode_safely(segments: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 32) -> DataFrame:
    """(track_id, segment_idx, layers, error): as :func:`encode_batches`, with a row's failure in ``error`` instead of an end of the job.

    A batch that fails is encoded row by row, so that the other rows of it are kept.
    """
    kind = segments.schema["track_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for f in frames:
            for lo in range(0, len(f), batch_size):
                part = f.iloc[lo : lo + batch_size]
                try:
                    encode = encode or make_encoder()
                    found = [(x.tolist(), None) for x in encode(np.stack(part.samples.to_list()))]
                except Exception:
                    found = []
                    for samples in part.samples:
                        try:
                            encode = encode or make_encoder()
                            found.append((encode(np.asarray(samples)[None])[0].tolist(), None))
                        except Exception as e:
                            found.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame({"track_id": part.track_id, "segment_idx": part.segment_idx, "layers": [x for x, _ in found], "error": [e for _, e in found]})

    rows = segments.select("track_id", "segment_idx", F.col("samples").cast("array<double>").alias("samples"))
    return rows.mapInPandas(run, f"track_id {kind}, segment_idx int, layers array<array<double>>, error string")


def random_projection(length: int, n_layers: int, dim: int, seed: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A deterministic encoder for tests: fixed random projections, one per layer."""

    def make():
        w = np.random.default_rng(seed).standard_normal((length, n_layers * dim)) / np.sqrt(length)
        return lambda x: (x @ w).reshape(len(x), n_layers, dim)

    return make


def status_counts(statuses: DataFrame) -> DataFrame:
    """(status, n) of rows with a status column, with a total."""
    return statuses.groupBy("status").agg(F.count("*").alias("n")).unionByName(statuses.agg(F.lit("total").alias("status"), F.count("*").alias("n")))

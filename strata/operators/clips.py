"""Clip tables: identity, bounds, filters, metadata, splits and look-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.ranking import checksum_ranks

CLIP_COLUMNS = ("clip_id", "dataset_id", "recording_id", "track_id", "segment_idx", "start_sec", "end_sec", "split", "embedding_path", "work_id")


def hop_seconds(duration: float, overlap: float) -> float:
    if duration <= 0 or not 0 <= overlap < 1:
        raise ValueError("duration must be positive and overlap in [0, 1)")
    return duration * (1 - overlap)


def clip_id(dataset: str, track: Column, segment: Column) -> Column:
    return F.format_string("%s:%s:%05d", F.lit(dataset), track, segment)


def build_clips(segments: DataFrame, dataset: str, duration: float = 5.0, overlap: float = 0.5, metadata: DataFrame | None = None) -> DataFrame:
    """Clip rows of (track_id, segment_idx[, embedding_path]); bounds follow from the segment's number."""
    hop = hop_seconds(duration, overlap)
    path = F.col("embedding_path") if "embedding_path" in segments.columns else F.lit("")
    start = F.col("segment_idx") * F.lit(hop)
    clips = segments.select(clip_id(dataset, F.col("track_id"), F.col("segment_idx")).alias("clip_id"), F.lit(dataset).alias("dataset_id"), "track_id", "segment_idx", start.alias("start_sec"), (start + duration).alias("end_sec"), F.lit("unspecified").alias("split"), path.alias("embedding_path"))
    return with_metadata(clips, metadata).select(*CLIP_COLUMNS)


def with_metadata(clips: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """recording_id (the track by default) and work_id (empty by default) of each clip."""
    if metadata is None:
        return clips.withColumn("recording_id", F.col("track_id")).withColumn("work_id", F.lit(""))
    known = metadata.select("track_id", F.col("recording_id").alias("_r"), F.col("work_id").alias("_w"))
    joined = clips.drop("recording_id", "work_id").join(known, "track_id", "left")
    return joined.withColumn("recording_id", F.coalesce("_r", "track_id")).withColumn("work_id", F.coalesce("_w", F.lit(""))).drop("_r", "_w")


def filter_clips(clips: DataFrame, **allowed: Iterable[str] | None) -> DataFrame:
    """Clips whose columns are in the sets given; None is no filter and an empty set keeps nothing."""
    for column, values in allowed.items():
        if values is not None:
            values = list(values)
            clips = clips.where(F.col(column).isin(values) if values else F.lit(False))
    return clips


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    found = [str(r[0]) for r in duplicates(df, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"repeated {key}: {', '.join(found)}")
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def text_blob(metadata: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(track_id, blob): the fields' non-blank values in order, joined by a space."""
    fields = fields or sorted(c for c in metadata.columns if c != "track_id")
    parts = [F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in fields]
    return metadata.select("track_id", F.concat_ws(" ", *parts).alias("blob"))


def blob_of(tracks: DataFrame, metadata: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The blob of each track; null for a track without metadata."""
    return tracks.join(text_blob(metadata, fields), "track_id", "left")


def nearest_clip(clips: DataFrame, wanted: DataFrame) -> DataFrame:
    """(track_id, start, clip_id) of the clip that starts nearest to a wanted start; ties go by clip id.

    ``wanted`` has (track_id, start); negative starts are an error, unknown tracks give no row.
    """
    checked = wanted.withColumn("start", F.when(F.col("start") >= 0, F.col("start")).otherwise(F.raise_error(F.lit("negative start")).cast("double")))
    return checked.join(clips.select("track_id", "clip_id", "start_sec"), "track_id").groupBy("track_id", "start").agg(F.min_by("clip_id", F.struct(F.abs(F.col("start_sec") - F.col("start")), "clip_id")).alias("clip_id"))


def clip_by_id(clips: DataFrame, wanted: str) -> DataFrame:
    found = clips.where(F.col("clip_id") == wanted)
    if found.isEmpty():
        raise KeyError(f"unknown clip {wanted}")
    return found


def gather_vectors(clips: DataFrame, vectors: DataFrame) -> DataFrame:
    """Clips with the vector of their segment; clips without one are left out."""
    return clips.join(vectors.select("track_id", "segment_idx", "vec"), ["track_id", "segment_idx"])


def split_by_recording(clips: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Clips with a split; all clips of a recording get the same one.

    Recordings are put in the order of a checksum; numbers of recordings are
    the floor of each share, and the rest is the test split.
    """
    if min(train, validation, test) < 0 or train <= 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("shares must be non-negative, with a positive training share, and sum to 1")
    ranked = checksum_ranks(clips, "recording_id", seed)
    n_train, n_val = F.floor(F.col("total") * train), F.floor(F.col("total") * validation)
    part = F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "validation").otherwise("test")
    return clips.drop("split").join(ranked.select("recording_id", part.alias("split")), "recording_id")


def training_view(clips: DataFrame, features: DataFrame, targets: DataFrame, target_keys: list[str], extra: list[DataFrame] = ()) -> DataFrame:
    """Clips with features, further per-clip tables, and target values with a mask in a fixed order.

    ``targets`` has (clip_id, targets map<string,double>); every join keeps all clips.
    """
    out = clips.join(features, "clip_id", "left")
    for table in extra:
        out = out.join(table, "clip_id", "left")
    out = out.join(targets, "clip_id", "left")
    values = F.array(*[F.try_element_at("targets", F.lit(k)) for k in target_keys])
    return out.withColumn("target_values", values).withColumn("target_mask", F.transform(values, lambda v: v.isNotNull())).withColumn("has_targets", F.col("targets").isNotNull())


def resolve_audio(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """(track_id, path) of the one file whose stem is the track; none or several are an error."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    found = tracks.select("track_id").join(files.select(stem.alias("track_id"), "path"), "track_id", "left").groupBy("track_id").agg(F.count("path").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
    problem = F.concat(F.col("n").cast("string"), F.lit(" audio files for "), F.col("track_id"), F.lit(": "), F.concat_ws(", ", F.slice("paths", 1, 3)))
    return found.select("track_id", F.when(F.col("n") == 1, F.get("paths", F.lit(0))).otherwise(F.raise_error(problem).cast("string")).alias("path"))

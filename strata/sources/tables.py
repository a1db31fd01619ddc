"""Reading and writing of clip indexes, metadata, features, targets and results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators.clips import CLIP_COLUMNS, hop_seconds, require_columns, require_unique
from strata.operators.pooling import layer_matrix, mean_vectors
from strata.sources.feature_store import read_feature_rows, write_features  # noqa: F401

CLIP_SCHEMA = "clip_id string, dataset_id string, recording_id string, track_id string, segment_idx int, start_sec double, end_sec double, split string, embedding_path string, work_id string"
REQUIRED_METADATA = ("recording_id", "work_id", "track_id")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


def read_clip_index(spark: SparkSession, path: str) -> DataFrame:
    """Clips of an index file, in clip order; work_id is empty by default and ids are unique."""
    rows = require_columns(_rows(spark, path), [c for c in CLIP_COLUMNS if c != "work_id"])
    if "work_id" not in rows.columns:
        rows = rows.withColumn("work_id", F.lit(""))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("work_id", "embedding_path")})
    types = dict(x.strip().split(" ") for x in CLIP_SCHEMA.split(","))
    clips = rows.select(*[F.col(c).cast(types[c]).alias(c) for c in CLIP_COLUMNS])
    if not clips.where(" or ".join(f"{c} is null" for c in CLIP_COLUMNS)).isEmpty():
        raise ValueError("a required clip column has a missing value")
    return require_unique(clips, "clip_id").orderBy("clip_id")


def write_clip_index(clips: DataFrame, path: str) -> None:
    seconds = [F.format_string("%.6f", F.col(c)).alias(c) if c in ("start_sec", "end_sec") else F.col(c) for c in CLIP_COLUMNS]
    if path.endswith(".csv"):
        clips.select(*seconds).write.option("header", True).csv(path)
    else:
        clips.select(*CLIP_COLUMNS).write.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return normalise_metadata(_rows(spark, path))


def normalise_metadata(rows: DataFrame) -> DataFrame:
    """Trimmed strings, missing values empty; the required columns are present and filled, tracks unique."""
    require_columns(rows, REQUIRED_METADATA)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    clean = rows.select(*[F.when(F.lower(text(c)) == "nan", "").otherwise(text(c)).alias(c) for c in rows.columns])
    if not clean.where(" or ".join(f"{c} = ''" for c in REQUIRED_METADATA)).isEmpty():
        raise ValueError("a required metadata value is empty")
    return require_unique(clean, "track_id")


def write_metadata(metadata: DataFrame, path: str) -> None:
    extras = sorted(set(metadata.columns) - set(REQUIRED_METADATA))
    metadata.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*REQUIRED_METADATA, *extras)]).write.option("header", True).csv(path)


def read_layer(spark: SparkSession, path: str, layer: int, n_layers: int, feature_type: str = "aggregated") -> DataFrame:
    """(track_id, vec) of one layer, pooled to one vector per track; other layers' files are not read."""
    if not 0 <= layer < n_layers:
        raise ValueError(f"layer {layer} is not in 0..{n_layers - 1}")
    rows = read_feature_rows(spark, path).where((F.col("feature_type") == feature_type) & (F.col("layer") == layer))
    if rows.isEmpty():
        raise FileNotFoundError(f"no {feature_type} features of layer {layer} in {path}")
    return mean_vectors(rows, ["track_id"], F.col("vec")).orderBy("track_id")


def _features(spark: SparkSession, path: str, feature_type: str) -> DataFrame:
    rows = read_feature_rows(spark, path).where(F.col("feature_type") == feature_type)
    if rows.isEmpty():
        raise FileNotFoundError(f"no {feature_type} features in {path}")
    return rows


def read_layer_matrix(spark: SparkSession, path: str, n_layers: int, dim: int, feature_type: str = "aggregated") -> DataFrame:
    """(track_id, layers): all layers of each track, pooled over segments and time; a track with another shape is an error."""
    stacks = layer_matrix(mean_vectors(_features(spark, path, feature_type), ["track_id", "layer"], F.col("vec")))
    return stacks.select("track_id", V.require_shape(F.col("layers"), n_layers, dim, F.col("track_id")).alias("layers")).orderBy("track_id")


def read_track_vectors(spark: SparkSession, path: str, n_layers: int, dim: int, layer: int | None = None, feature_type: str = "aggregated") -> DataFrame:
    """(track_id, vec) of one layer, or of all layers end to end."""
    if layer is not None:
        return read_layer(spark, path, layer, n_layers, feature_type)
    return read_layer_matrix(spark, path, n_layers, dim, feature_type).select("track_id", V.flatten_layers(F.col("layers")).alias("vec"))


def read_clip_vectors(spark: SparkSession, path: str, layer: int, n_layers: int, duration: float = 5.0, overlap: float = 0.5, feature_type: str = "segments") -> DataFrame:
    """(track_id, segment_idx, start_sec, end_sec, vec) of one layer, pooled over time, with the bounds that follow from the segment's number."""
    if not 0 <= layer < n_layers:
        raise ValueError(f"layer {layer} is not in 0..{n_layers - 1}")
    start = F.col("segment_idx") * F.lit(hop_seconds(duration, overlap))
    rows = mean_vectors(_features(spark, path, feature_type).where(F.col("layer") == layer), ["track_id", "segment_idx"], F.col("vec"))
    return rows.select("track_id", "segment_idx", start.alias("start_sec"), (start + duration).alias("end_sec"), "vec").orderBy("track_id", "segment_idx")


def cached_tracks(existing: DataFrame, types: Iterable[str]) -> DataFrame:
    """Tracks of (track_id, feature_type) that have all the types."""
    types = sorted(set(types))
    return existing.where(F.col("feature_type").isin(types)).groupBy("track_id").agg(F.countDistinct("feature_type").alias("n")).where(F.col("n") == len(types)).select("track_id")


def missing_tracks(wanted: DataFrame, existing: DataFrame, types: Iterable[str]) -> DataFrame:
    """Wanted tracks that still lack one of the types."""
    return wanted.join(cached_tracks(existing, types), "track_id", "left_anti")


def read_features(spark: SparkSession, path: str, types: Iterable[str]) -> DataFrame:
    """Features of the types, of tracks that have all of them."""
    rows = read_feature_rows(spark, path).where(F.col("feature_type").isin(sorted(set(types))))
    return rows.join(cached_tracks(rows.select("track_id", "feature_type"), types), "track_id", "left_semi")


def read_targets(long: DataFrame, specs: DataFrame) -> DataFrame:
    """(track_id, target, y) of long targets (track_id, category, field, values) by specs.

    ``specs`` has (target, category, field, reduce ``mean`` or ``first``,
    required).  A track that lacks a required field is left out; a missing
    optional field is null.
    """
    value = F.when(F.col("reduce") == "first", F.get("values", F.lit(0))).otherwise(F.aggregate("values", F.lit(0.0), lambda s, v: s + v) / F.size("values"))
    value = F.when(~F.isnan(value), value)
    tracks = long.select("track_id").distinct()
    wanted = tracks.join(F.broadcast(specs))
    found = wanted.join(long, ["track_id", "category", "field"], "left").withColumn("y", value)
    lacks = found.where(F.col("required") & F.col("values").isNull()).select("track_id").distinct()
    return found.join(lacks, "track_id", "left_anti").select("track_id", "target", "y")


def read_curves(long: DataFrame, category: str, frames: int) -> DataFrame:
    """(track_id, target, curve) of a category's fields; a curve of another length, or with no number, is null."""
    ok = (F.size("values") == frames) & F.exists("values", lambda v: ~F.isnan(v))
    return long.where(F.col("category") == category).select("track_id", F.col("field").alias("target"), F.when(ok, F.col("values")).alias("curve"))


def gate_midi(targets: DataFrame, available: DataFrame, names: Iterable[str]) -> DataFrame:
    """Targets with the named ones null on tracks whose ``midi_available`` is false; a track without a flag has it."""
    known = targets.join(available.select("track_id", F.col("midi_available").alias("_m")), "track_id", "left")
    return known.withColumn("y", F.when(F.col("target").isin(list(names)) & ~F.coalesce("_m", F.lit(True)), None).otherwise(F.col("y"))).drop("_m")


def read_segment_targets(long: DataFrame) -> DataFrame:
    """(track_id, segment_idx, target, y) of (track_id, category, field, values); tracks with fields of different lengths are left out."""
    even = long.groupBy("track_id").agg(F.countDistinct(F.size("values")).alias("n")).where("n = 1").select("track_id")
    rows = long.join(even, "track_id").select("track_id", F.concat_ws(".", "category", "field").alias("target"), F.posexplode("values").alias("segment_idx", "y"))
    return rows.where(~F.isnan("y") & F.col("y").isNotNull()).select("track_id", "segment_idx", "target", "y")


def merge_targets(*tables: DataFrame) -> DataFrame:
    """Union of target tables (track_id, target, y); of two values of one key the later table's wins."""
    out = None
    for k, t in enumerate(tables):
        part = t.select("track_id", "target", "y").withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    last = Window.partitionBy("track_id", "target").orderBy(F.col("_k").desc())
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("track_id", "target", "y")


def write_probe_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def read_probe_results(spark: SparkSession, path: str) -> DataFrame:
    """Probe results of a Parquet folder, or of JSON keyed by layer with a ``weighted_sum`` part.

    Keys that are neither a number nor ``weighted_sum`` are left out.
    """
    if not path.endswith(".json"):
        return spark.read.parquet(path)
    metric = "struct<r2_score:double,r2_mean:double,correlation:double,rmse:double,n_valid:bigint,coverage:double,layer_weights:array<double>,gain:double>"
    text = spark.read.text(path, wholetext=True)
    by_layer = text.select(F.explode(F.from_json("value", f"map<string,map<string,{metric}>>")).alias("key", "targets"))
    rows = by_layer.select("key", F.explode("targets").alias("target", "m")).where("key = 'weighted_sum' or key rlike '^[0-9]+$'")
    mixed = F.col("key") == "weighted_sum"
    return rows.select(
        F.when(mixed, "weighted_sum").otherwise("best_layer").alias("mode"), F.when(~mixed, F.expr("try_cast(key as int)")).alias("layer"), "target",
        F.coalesce("m.r2_score", "m.r2_mean").alias("r2_score"), "m.correlation", "m.rmse", "m.n_valid", "m.layer_weights", F.col("m.gain").alias("r2_gain"), "m.coverage",
    )

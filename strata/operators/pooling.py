"""Pooling of layered embeddings by group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vectors(df: DataFrame, keys: list[str], vec: Column) -> DataFrame:
    """(keys, vec): the mean of the group's vectors, entry by entry in double; one partial sum a task and group is shuffled."""
    rows = df.select(*keys, vec.cast("array<double>").alias("vec")).where("vec is not null")
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))


def track_means(segments: DataFrame) -> DataFrame:
    """(track_id, layer, vec) pooled over segments, from one row per layer of a segment."""
    return mean_vectors(segments, ["track_id", "layer"], F.col("vec"))


def time_means(steps: DataFrame) -> DataFrame:
    """(track_id, segment_idx, layer, vec) pooled over the time steps of a segment."""
    return mean_vectors(steps, ["track_id", "segment_idx", "layer"], F.col("vec"))


def layer_rows(stacks: DataFrame, keys: list[str], layers: str = "layers") -> DataFrame:
    """One row per layer of stacks ``array<array<float>>``: (keys, layer, vec)."""
    return stacks.select(*keys, F.posexplode(layers).alias("layer", "vec"))


def layer_matrix(rows: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, layers): the layers of a track in one stack, from rows (key, layer, vec)."""
    stacked = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "vec"))).alias("s"))
    return stacked.select(key, F.col("s.vec").alias("layers"))

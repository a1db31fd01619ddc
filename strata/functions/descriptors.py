"""Target descriptors and the registry of aspects, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Scalar targets: name, category, field, how its values become one, and whether a track needs it; fixed names.
SCALAR_TARGETS = (
    ("spectral_centroid", "timbre", "spectral_centroid", "mean", True),
    ("spectral_rolloff", "timbre", "spectral_rolloff", "mean", True),
    ("spectral_bandwidth", "timbre", "spectral_bandwidth", "mean", True),
    ("zero_crossing_rate", "timbre", "zero_crossing_rate", "mean", True),
    ("tempo", "rhythm", "tempo", "first", True),
    ("onset_density", "rhythm", "onset_density", "first", True),
    ("dynamic_range", "dynamics", "dynamic_range", "first", True),
    ("dynamic_variance", "dynamics", "dynamic_variance", "first", True),
    ("crescendo_strength", "dynamics", "crescendo_strength", "first", True),
    ("diminuendo_strength", "dynamics", "diminuendo_strength", "first", True),
    ("harmonic_complexity", "harmony", "harmonic_complexity", "first", True),
    ("attack_slopes", "articulation", "attack_slopes", "mean", True),
    ("attack_sharpness", "articulation", "attack_sharpness", "mean", True),
    ("phrase_regularity", "phrasing", "phrase_regularity", "first", True),
    ("num_phrases", "phrasing", "num_phrases", "first", True),
    ("rubato", "expression", "rubato", "first", False),
    ("velocity_mean", "expression", "velocity_mean", "first", False),
    ("velocity_std", "expression", "velocity_std", "first", False),
    ("velocity_range", "expression", "velocity_range", "first", False),
    ("articulation_ratio", "expression", "articulation_ratio", "first", False),
    ("tempo_variability", "expression", "tempo_variability", "first", False),
    ("onset_timing_std", "expression", "onset_timing_std", "first", False),
)

#: Targets that a segment of a few seconds can have; fixed names.
SEGMENT_TARGETS = (
    "spectral_centroid", "spectral_rolloff", "spectral_bandwidth", "zero_crossing_rate", "dynamic_range", "dynamic_variance",
    "crescendo_strength", "diminuendo_strength", "harmonic_complexity", "attack_slopes", "attack_sharpness",
)

#: Registered targets: name, kind and length of a curve (null for a scalar); fixed names.
REGISTERED_TARGETS = (
    ("tis_tension", "curve", 60),
    ("dynamic_arc", "curve", 60),
    ("local_tempo", "curve", 60),
    ("centroid_trajectory", "curve", 60),
    ("novelty", "curve", 60),
    ("midi_articulation_hist", "midi_curve", 16),
    ("midi_perf_tempo", "midi_curve", 60),
    ("midi_velocity_std", "midi_scalar", None),
    ("midi_ioi_std", "midi_scalar", None),
    ("midi_pedal_ratio", "midi_scalar", None),
)

#: Aspects: name and the targets that can validate it, in order; fixed names.
ASPECTS = (
    ("brightness", ("spectral_centroid",)),
    ("texture", ("spectral_rolloff", "zero_crossing_rate")),
    ("warmth", ("spectral_bandwidth", "spectral_centroid")),
    ("tempo", ("tempo",)),
    ("rhythmic_energy", ("onset_density",)),
    ("dynamics", ("dynamic_range", "dynamic_variance")),
    ("harmonic_richness", ("harmonic_complexity",)),
    ("articulation", ("attack_slopes", "attack_sharpness")),
    ("phrasing", ("phrase_regularity", "num_phrases")),
    ("tension", ("tis_tension",)),
    ("dynamic_arc", ("dynamic_arc",)),
    ("rhythmic_flow", ("local_tempo",)),
    ("brightness_trajectory", ("centroid_trajectory",)),
    ("structure", ("novelty",)),
    ("micro_articulation", ("midi_articulation_hist",)),
    ("performance_expression", ("midi_velocity_std", "midi_ioi_std", "midi_pedal_ratio")),
)


def target_specs(spark: SparkSession) -> DataFrame:
    """(target, category, field, reduce, required) of the scalar targets, as ``read_targets`` takes them."""
    return spark.createDataFrame(list(SCALAR_TARGETS), "target string, category string, field string, reduce string, required boolean")


def registered_targets(spark: SparkSession) -> DataFrame:
    """(target, kind, n_frames) of the registered targets."""
    return spark.createDataFrame(list(REGISTERED_TARGETS), "target string, kind string, n_frames int")


def aspect_registry(spark: SparkSession) -> DataFrame:
    """(aspect, target, ord): candidates in order, as ``resolve_aspects`` takes them."""
    rows = [(name, target, k) for name, targets in ASPECTS for k, target in enumerate(targets)]
    return spark.createDataFrame(rows, "aspect string, target string, ord int")

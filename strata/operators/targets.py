"""Descriptive targets from tables of frames, chroma, tempograms and note events.

Frame tables are long: (track_id, frame, x).  A curve is an array of a fixed
number of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V

CURVE_FRAMES = 60
CURVE_SECONDS = 30.0
PEDAL_CC, PEDAL_ON = 64, 64


def _by(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order)


def curve_of(frames: DataFrame, n: int, fill: float = 0.0) -> DataFrame:
    """(track_id, curve) of (track_id, frame, x): one entry for each of n frames, ``fill`` where there is none."""
    m = frames.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "x"))).alias("m"))
    return m.select("track_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(fill))).alias("curve"))


def sliding_segments(signals: DataFrame, length: int, hop: int) -> DataFrame:
    """(track_id, segment_idx, start, samples) of signals (track_id, samples): windows at each hop, with one anchored at the end.

    A signal that is too short is padded with zeros to one segment.
    """
    n = F.size("samples")
    full = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(hop))).otherwise(F.array(F.lit(0)))
    starts = F.when((n > length) & ((n - length) % hop != 0), F.concat(full, F.array(n - length))).otherwise(full)
    cut = signals.select("track_id", "samples", F.posexplode(starts).alias("segment_idx", "start"))
    part = F.slice("samples", F.col("start") + 1, length)
    return cut.select("track_id", "segment_idx", "start", F.concat(part, F.array_repeat(F.lit(0.0).cast("double"), F.lit(length) - F.size(part))).alias("samples"))


def frame_energy(segments: DataFrame) -> DataFrame:
    """(track_id, frame, rms, zcr) of segments with samples."""
    x = V.doubles(F.col("samples"))
    n = F.size(x)
    energy = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    signs = F.transform(x, lambda v: F.when(v < 0, 1).otherwise(0))
    turns = F.aggregate(F.zip_with(F.slice(signs, 1, n - 1), F.slice(signs, F.lit(2), n - 1), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    return segments.select("track_id", F.col("segment_idx").alias("frame"), F.sqrt(energy / n).alias("rms"), (turns / n).alias("zcr"))


def spectral_moments(spectra: DataFrame, rolloff: float = 0.85) -> DataFrame:
    """(track_id, frame, centroid, bandwidth, rolloff) of (track_id, frame, freq, mag), one row per bin."""
    w = Window.partitionBy("track_id", "frame")
    c = spectra.withColumn("total", F.sum("mag").over(w)).withColumn("centroid", F.sum(F.col("freq") * F.col("mag")).over(w) / F.col("total"))
    c = c.withColumn("cum", F.sum("mag").over(w.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("track_id", "frame").agg(
        F.max("centroid").alias("centroid"),
        F.sqrt(F.sum(F.col("mag") * (F.col("freq") - F.col("centroid")) ** 2) / F.max("total")).alias("bandwidth"),
        F.min(F.when(F.col("cum") >= rolloff * F.col("total"), F.col("freq"))).alias("rolloff"),
    )


def bucket_mean(frames: DataFrame, n: int, fill: float = 0.0, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Proportional pooling of (keys, frame, x) to n frames; short tracks stay left-aligned and are filled."""
    size = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(_by(*keys, order="frame")) - 1
    at = F.when(F.col("size") <= n, F.col("place")).otherwise(F.least(F.floor(F.col("place") * n / F.col("size")), F.lit(n - 1)))
    pooled = frames.select(*keys, "frame", "x").withColumn("size", size).withColumn("place", place).groupBy(*keys, at.cast("int").alias("frame")).agg(F.avg("x").alias("x"))
    grid = frames.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame"))
    return grid.join(pooled, [*keys, "frame"], "left").withColumn("x", F.coalesce("x", F.lit(fill)))


def bucket_mean_equal(frames: DataFrame, n: int) -> DataFrame:
    """Pooling to n frames of equal width; the remainder is left out, and tracks of fewer frames stay left-aligned with zeros behind."""
    size = F.count("*").over(Window.partitionBy("track_id"))
    place = F.row_number().over(_by("track_id", order="frame")) - 1
    rows = frames.select("track_id", "frame", "x").withColumn("width", F.greatest(F.floor(size / n), F.lit(1))).withColumn("at", F.floor(place / F.col("width")))
    pooled = rows.where(F.col("at") < n).groupBy("track_id", F.col("at").cast("int").alias("frame")).agg(F.avg("x").alias("x"))
    short = frames.groupBy("track_id").agg(F.count("*").cast("int").alias("size")).where(F.col("size") < n)
    return pooled.unionByName(short.select("track_id", F.explode(F.sequence(F.col("size"), F.lit(n - 1))).alias("frame"), F.lit(0.0).alias("x")))


def normalise(frames: DataFrame, how: str) -> DataFrame:
    """x per track by ``minmax`` (flat is 0), ``zscore`` (deviation below 1e-6 is 0) or ``peak`` (no positive peak is 0)."""
    w = Window.partitionBy("track_id")
    lo, hi, mean, sd = F.min("x").over(w), F.max("x").over(w), F.avg("x").over(w), F.stddev_pop("x").over(w)
    rules = {
        "minmax": F.when(hi - lo > 0, (F.col("x") - lo) / (hi - lo)).otherwise(0.0),
        "zscore": F.when(sd < 1e-6, 0.0).otherwise((F.col("x") - mean) / (sd + 1e-6)),
        "peak": F.when(hi > 0, F.col("x") / hi).otherwise(0.0),
    }
    return frames.withColumn("x", rules[how])


#: Radii of the six DFT bins of a chroma vector; fixed values.
TENSION_RADII = (3.0, 8.0, 11.5, 15.0, 14.5, 7.5)


def tonal_tension(chroma: DataFrame) -> DataFrame:
    """(track_id, frame, x): weighted length of DFT bins 1 to 6 of the unit-sum chroma."""
    total = F.sum("energy").over(Window.partitionBy("track_id", "frame"))
    c = chroma.withColumn("p", F.when(total > 0, F.col("energy") / total).otherwise(0.0))
    sums = []
    for k in range(1, 7):
        angle = -2 * math.pi * k * F.col("pc") / 12.0
        sums += [F.sum(F.col("p") * F.cos(angle)).alias(f"re{k}"), F.sum(F.col("p") * F.sin(angle)).alias(f"im{k}")]
    length = sum(((F.col(f"re{k}") ** 2 + F.col(f"im{k}") ** 2) * r * r for k, r in enumerate(TENSION_RADII, 1)), F.lit(0.0))
    return c.groupBy("track_id", "frame").agg(*sums).select("track_id", "frame", F.sqrt(length).alias("x"))


def tension_curve(chroma: DataFrame, n: int = CURVE_FRAMES) -> DataFrame:
    """(track_id, frame, x): the tension of the chroma pooled to n frames, scaled to 0..1 within the track."""
    pooled = bucket_mean(chroma.select("track_id", "pc", "frame", F.col("energy").alias("x")), n, keys=("track_id", "pc"))
    return normalise(tonal_tension(pooled.withColumnRenamed("x", "energy")), "minmax")


def novelty(chroma: DataFrame, radius: int = 8) -> DataFrame:
    """(track_id, frame, x): checkerboard novelty of the cosine self-similarity along its diagonal.

    Frames that the kernel does not fit around, and all of
    tracks shorter than the kernel, have 0.  A frame meets only the frames within
    the kernel around it, by an equality join on the offset, so the work is
    linear in the number of frames.
    """
    vec = chroma.groupBy("track_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("pc", "energy"))), lambda e: e["energy"].cast("double")).alias("v"))
    vec = vec.withColumn("v", V.l2_normalise(F.col("v")))
    reach = 2 * radius
    left = vec.select("track_id", F.col("frame").alias("i"), F.col("v").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("d"))
    pairs = left.join(vec.select("track_id", (F.col("frame")).alias("j"), F.col("v").alias("b")), (F.col("j") == F.col("i") + F.col("d")) & (left["track_id"] == vec["track_id"])).select(left["track_id"], "i", "j", V.dot(F.col("a"), F.col("b")).alias("s"))
    # Offsets -radius .. -1 and 1 .. radius stand for the 2 * radius rows of the kernel, without an axis at zero.
    offsets = [d for d in range(-radius, radius + 1) if d]
    kernel = F.array(*[F.lit(math.exp(-((d / radius) ** 2))) for d in offsets])
    last = F.max("j").over(Window.partitionBy("track_id"))
    spread = pairs.withColumn("last", last).select("track_id", "i", "j", "s", "last", F.explode(F.sequence(F.greatest(F.col("j") - radius + 1, F.lit(radius)), F.least(F.col("i") + radius, F.col("last") - radius + 1))).alias("frame"))
    x, y = F.col("i") - F.col("frame"), F.col("j") - F.col("frame")
    inside = (x >= -radius) & (y <= radius - 1)
    w = F.get(kernel, x + radius) * F.get(kernel, y + radius) * F.when((x < 0) == (y < 0), 1.0).otherwise(-1.0) * F.when(x == y, 1.0).otherwise(2.0)
    raw = spread.where(inside & (F.col("frame") >= radius) & (F.col("frame") <= F.col("last") - radius + 1)).groupBy("track_id", "frame").agg(F.sum(F.col("s") * w).alias("x"))
    grid = vec.select("track_id", "frame")
    return grid.join(raw, ["track_id", "frame"], "left").select("track_id", "frame", F.coalesce("x", F.lit(0.0)).alias("x"))


def novelty_curve(first: DataFrame, second: DataFrame, n: int = CURVE_FRAMES) -> DataFrame:
    """Average of the peak-normalised novelties of two feature tables, over the frames that both have, pooled to n frames."""
    frames = lambda t: t.select("track_id", "frame").distinct()
    a = normalise(novelty(first.join(frames(second), ["track_id", "frame"], "left_semi")), "peak")
    b = normalise(novelty(second.join(frames(first), ["track_id", "frame"], "left_semi")), "peak")
    both = a.join(b.withColumnRenamed("x", "z"), ["track_id", "frame"]).select("track_id", "frame", ((F.col("x") + F.col("z")) / 2).alias("x"))
    return bucket_mean_equal(both, n)


def local_tempo(tempogram: DataFrame, rate: float, hop: float, centre: float = 120.0) -> DataFrame:
    """(track_id, frame, x): bpm of the best lag of each frame under a log-normal prior, from (track_id, frame, lag, mag)."""
    bpm = F.when(F.col("lag") > 0, 60.0 * rate / (hop * F.col("lag")))
    prior = F.when((bpm >= 40) & (bpm <= 240), F.exp(-0.5 * (F.log2(bpm) - math.log2(centre)) ** 2)).otherwise(0.0)
    score = F.round(F.log1p("mag") * prior, 9)
    return tempogram.select("track_id", "frame", "lag", bpm.alias("bpm"), score.alias("score")).groupBy("track_id", "frame").agg(F.max_by("bpm", F.struct("score", -F.col("lag"))).alias("bpm"), F.max("score").alias("top")).select("track_id", "frame", F.when(F.col("top") > 0, F.col("bpm")).otherwise(120.0).alias("x"))


def tempo_curve(tempogram: DataFrame, rate: float, hop: float, n: int = CURVE_FRAMES) -> DataFrame:
    """(track_id, curve): median-smoothed log2 tempo pooled to n frames; 1 where there is none."""
    seq = local_tempo(tempogram, rate, hop).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda e: e["x"]).alias("v"))
    smooth = seq.select("track_id", F.posexplode(V.median_of_window(F.col("v"), 5)).alias("frame", "bpm")).select("track_id", "frame", V.tempo_level(F.col("bpm")).alias("x"))
    return curve_of(bucket_mean(smooth, n, 1.0), n, 1.0)


#: Added to energies before the logarithm, and the lowest level; fixed values.
LEVEL_EPS, LEVEL_FLOOR = 1e-10, -60.0


def dynamic_arc(frames: DataFrame, n: int = CURVE_FRAMES) -> DataFrame:
    """(track_id, curve): energy (track_id, frame, x) pooled in equal buckets, in decibels above the floor, smoothed, scaled to 0..1."""
    level = F.greatest(20 * F.log10(F.col("x") + LEVEL_EPS), F.lit(LEVEL_FLOOR))
    pooled = bucket_mean_equal(frames, n).withColumn("x", level)
    seq = pooled.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda e: e["x"]).alias("v"))
    smooth = seq.select("track_id", F.posexplode(V.gaussian_smooth(F.col("v"))).alias("frame", "x"))
    return curve_of(normalise(smooth, "minmax"), n)


def centroid_curve(centroids: DataFrame, n: int = CURVE_FRAMES) -> DataFrame:
    """(track_id, curve): hertz (track_id, frame, x) pooled, as log2(hz + 1), standardised."""
    level = bucket_mean(centroids, n).withColumn("x", F.log2(F.col("x") + 1))
    return curve_of(normalise(level, "zscore"), n)


def inter_onset(notes: DataFrame) -> DataFrame:
    """Notes with ``ioi``, the time since the track's last onset (null for the first)."""
    return notes.withColumn("ioi", F.col("onset") - F.lag("onset").over(Window.partitionBy("track_id").orderBy("onset", "seq")))


def performance_tempo(notes: DataFrame, n: int = CURVE_FRAMES, seconds: float = CURVE_SECONDS) -> DataFrame:
    """(track_id, frame, x): log2 tempo from the median of the onset distances within a second of each frame's centre.

    Fewer than three onsets carry the last value on, from 1; tracks with
    fewer than four onsets have no rows.  Onsets meet frames by half-second bins.
    """
    step = seconds / n
    many = notes.groupBy("track_id").agg(F.count("*").alias("n")).where("n >= 4").select("track_id")
    own = notes.join(many, "track_id").select("track_id", "onset", "seq")
    first, last = F.ceil((F.col("onset") - 1.0) / step - 0.5 - 1e-6), F.floor((F.col("onset") + 1.0) / step - 0.5 + 1e-6)
    centre = (F.col("frame") + 0.5) * F.lit(step)
    near = own.select("track_id", "onset", "seq", F.explode(F.sequence(first, last)).alias("frame")).where((F.col("frame") >= 0) & (F.col("frame") < n) & (F.col("onset") >= centre - 1.0) & (F.col("onset") <= centre + 1.0))
    gaps = near.withColumn("ioi", F.col("onset") - F.lag("onset").over(Window.partitionBy("track_id", "frame").orderBy("onset", "seq")))
    per = gaps.groupBy("track_id", "frame").agg(F.count("*").alias("n"), F.expr("percentile(ioi, 0.5)").alias("gap")).where((F.col("n") >= 3) & (F.col("gap") > 0)).select("track_id", "frame", V.tempo_level(60.0 / F.col("gap")).alias("v"))
    grid = many.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("frame"))
    w = _by("track_id", order="frame").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(per, ["track_id", "frame"], "left").select("track_id", F.col("frame").cast("int").alias("frame"), F.coalesce(F.last("v", True).over(w), F.lit(1.0)).alias("x"))


def performance_tempo_curve(notes: DataFrame, n: int = CURVE_FRAMES, seconds: float = CURVE_SECONDS) -> DataFrame:
    c = curve_of(performance_tempo(notes, n, seconds), n, 1.0)
    return c.select("track_id", V.median_of_window(F.col("curve"), 3).alias("curve"))


def articulation(notes: DataFrame, bins: int = 16, top: float = 1.5) -> DataFrame:
    """(track_id, bin, p): shares of notes by length over distance to the next onset; a single note is spread evenly."""
    w = Window.partitionBy("track_id").orderBy("onset", "seq")
    ratio = F.least(F.greatest((F.col("offset") - F.col("onset")) / F.greatest(F.col("next") - F.col("onset"), F.lit(1e-3)), F.lit(0.0)), F.lit(top))
    ratios = notes.withColumn("next", F.lead("onset").over(w)).where("next is not null").withColumn("r", ratio)
    counts = ratios.groupBy("track_id", F.least(F.width_bucket("r", F.lit(0.0), F.lit(top), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = notes.groupBy("track_id").agg(F.count("*").alias("notes")).select("track_id", "notes", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    p = F.when(F.col("notes") < 2, 1.0 / bins).otherwise(F.coalesce("n", F.lit(0)) / (F.col("notes") - 1))
    return grid.join(counts, ["track_id", "bin"], "left").select("track_id", "bin", p.alias("p"))


def _pedal_changes(controls: DataFrame) -> DataFrame:
    """(track_id, t, change) of the pedal's events: the change that each makes to its instrument, -1, 0 or 1."""
    instrument = F.col("instrument") if "instrument" in controls.columns else F.lit(0)
    events = controls.where((F.col("cc") == PEDAL_CC) & F.col("track_id").isNotNull() & F.col("t").isNotNull()).select("track_id", instrument.alias("instrument"), "t", F.col("event_id").alias("seq"), (F.col("value") >= PEDAL_ON).cast("int").alias("on"))
    own = Window.partitionBy("track_id", "instrument").orderBy("t", "seq")
    held = events.repartition("track_id").withColumn("held", F.coalesce(F.last("on", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return held.select("track_id", "t", (F.col("held") - F.lag("held", 1, 0).over(own)).alias("change"))


def _with_pedal(controls: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows of ``asks`` (track_id, t, more columns) with ``on``, the state of the pedal as of their time.

    A track's events and times are sorted together, so nothing is joined.  Each
    event counts as the change that it makes to its instrument; the pedal is down
    while the changes so far sum to more than 0.
    """
    more = [c for c in asks.columns if c not in ("track_id", "t")]
    changes = _pedal_changes(controls).select("track_id", "t", *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in more], F.lit(0).alias("kind"), "change")
    both = changes.unionByName(asks.select("track_id", "t", *more, F.lit(1).alias("kind"), F.lit(0).alias("change")))
    down = F.sum("change").over(Window.partitionBy("track_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("on", (down > 0).cast("int")).where("kind = 1").select("track_id", "t", *more, "on")


def pedal_state(controls: DataFrame, grid: DataFrame) -> DataFrame:
    """(track_id, t, on): as-of state of the pedal at grid times; instruments are joined by or.

    The state is that of the last event at or before the time; none is off.
    """
    return _with_pedal(controls, grid.select("track_id", "t"))


def pedal_curve(controls: DataFrame, tracks: DataFrame, n: int = CURVE_FRAMES, seconds: float = CURVE_SECONDS, sub: int | None = None) -> DataFrame:
    """(track_id, frame, x): share of each frame with the pedal down, at the centres of a grid of about 10 ms.

    ``tracks`` has (track_id, duration), one row a track; the pedal is up past the
    duration.  Between two events the grid's points are counted, not made, so the
    work grows with events and frames and not with ``sub``.
    """
    sub = sub or max(4, int(round(seconds / n / 0.01)))
    step, points = seconds / n / sub, n * sub
    centre = lambda g: (g + 0.5) * F.lit(step)

    def first(t: Column) -> Column:
        """The first point of the grid at or after t, by the same numbers as the grid's."""
        near = F.floor(t / F.lit(step)).cast("long")
        among = F.when(centre(near - 1) >= t, near - 1).when(centre(near) >= t, near).when(centre(near + 1) >= t, near + 1).otherwise(near + 2)
        return F.when(t > centre(F.lit(points - 1)), F.lit(points).cast("long")).when(t <= centre(F.lit(0)), F.lit(0).cast("long")).otherwise(among)

    ends = tracks.where("track_id is not null").select("track_id", F.lit(None).cast("double").alias("t"), F.lit(0).alias("change"), F.coalesce(first(F.col("duration").cast("double")), F.lit(0)).alias("end"))
    events = _pedal_changes(controls).select("track_id", F.col("t").cast("double").alias("t"), "change", F.lit(None).cast("long").alias("end"))
    own = Window.partitionBy("track_id").orderBy(F.col("t").asc_nulls_first())
    so_far = F.sum("change").over(own.rowsBetween(Window.unboundedPreceding, 0))
    both = events.unionByName(ends).select("track_id", "t", F.lead("t").over(own).alias("next"), (so_far > 0).alias("down"), F.first("end").over(own).alias("end"))
    held = both.where("end is not null").select("track_id", F.col("t").isNull().alias("grid"), first(F.col("t")).alias("a"), F.least(F.coalesce(first(F.col("next")), F.lit(points)), "end").alias("b"), "down")
    # Each track's own row stands for its frames; a stretch with the pedal down, for the frames that it touches.
    frame = lambda g: F.floor(g / F.lit(sub)).cast("int")
    touched = F.when(F.col("grid"), F.sequence(F.lit(0), F.lit(n - 1))).when(F.col("down") & (F.col("b") > F.col("a")), F.sequence(frame(F.col("a")), frame(F.col("b") - 1)))
    share = held.select("track_id", "grid", "a", "b", F.explode(touched).alias("frame"))
    at = F.col("frame").cast("long") * sub
    count = F.least(F.col("b"), at + sub) - F.greatest(F.col("a"), at)
    return share.groupBy("track_id", "frame").agg((F.sum(F.when(F.col("grid"), 0).otherwise(count)) / F.lit(sub)).alias("x"))


def expressivity(notes: DataFrame) -> DataFrame:
    """(track_id, velocity_std, log_ioi_std): null with fewer than two notes, 0 without a positive distance."""
    g = inter_onset(notes).groupBy("track_id").agg(F.count("*").alias("n"), F.stddev_pop("velocity").alias("v"), F.stddev_pop(F.when(F.col("ioi") > 0, F.log(F.col("ioi") + 1e-6))).alias("s"))
    return g.select("track_id", F.when(F.col("n") >= 2, F.col("v")).alias("velocity_std"), F.when(F.col("n") >= 2, F.coalesce("s", F.lit(0.0))).alias("log_ioi_std"))


def midi_scalars(notes: DataFrame, controls: DataFrame, tracks: DataFrame, n: int = CURVE_FRAMES, seconds: float = CURVE_SECONDS, sub: int | None = None) -> DataFrame:
    """(track_id, midi_velocity_std, midi_ioi_std, midi_pedal_ratio): :func:`expressivity` and the mean of the pedal curve; null with fewer than two notes."""
    pedal = pedal_curve(controls, tracks, n, seconds, sub).groupBy("track_id").agg(F.avg("x").alias("ratio"))
    found = expressivity(notes).join(pedal, "track_id", "left")
    return found.select("track_id", F.col("velocity_std").alias("midi_velocity_std"), F.col("log_ioi_std").alias("midi_ioi_std"), F.when(F.col("velocity_std").isNotNull(), F.coalesce("ratio", F.lit(0.0))).alias("midi_pedal_ratio"))


def align_notes(notes: DataFrame, durations: DataFrame) -> DataFrame:
    """Notes (track_id, seq, onset, offset, velocity) that start within the duration, with clipped offsets, numbered by onset."""
    kept = notes.join(durations, "track_id").where(F.col("onset") <= F.col("duration")).withColumn("offset", F.least("offset", "duration")).drop("duration")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("onset", "seq")))


def piano_roll(notes: DataFrame, rate: float, frames: int) -> DataFrame:
    """(track_id, pitch, frame, velocity): the loudest note of each sounding cell, within ``frames``."""
    lo, hi = F.floor(F.col("onset") * rate), F.greatest(F.floor(F.col("onset") * rate), F.ceil(F.col("offset") * rate) - 1)
    cells = notes.select("track_id", "pitch", "velocity", F.explode(F.sequence(lo, hi)).alias("frame")).where(F.col("frame") < frames)
    return cells.groupBy("track_id", "pitch", F.col("frame").cast("int").alias("frame")).agg(F.max("velocity").alias("velocity"))


def monotonic_runs(frames: DataFrame) -> DataFrame:
    """(track_id, rise, fall): |change| times number of steps of the first longest rising and falling run of (track_id, frame, x)."""
    w = _by("track_id", order="frame")
    d = frames.withColumn("sign", F.signum(F.col("x") - F.lag("x").over(w)).cast("int"))
    d = d.withColumn("new", F.when(F.coalesce(F.lag("sign").over(w) == F.col("sign"), F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prior", F.lag("x").over(w))
    runs = d.where("sign <> 0").groupBy("track_id", "run", "sign").agg(F.count("*").alias("n"), F.min("frame").alias("start"), F.min_by("prior", "frame").alias("first"), F.max_by("x", "frame").alias("last"))
    size = F.abs(F.col("last") - F.col("first")) * F.col("n")
    best = lambda s: F.max_by(F.when(F.col("sign") == s, size), F.when(F.col("sign") == s, F.struct("n", -F.col("start"))))
    found = runs.groupBy("track_id").agg(best(1).alias("rise"), best(-1).alias("fall"))
    return frames.select("track_id").distinct().join(found, "track_id", "left").select("track_id", F.coalesce("rise", F.lit(0.0)).alias("rise"), F.coalesce("fall", F.lit(0.0)).alias("fall"))


def dynamics(frames: DataFrame) -> DataFrame:
    """(track_id, dynamic_range, dynamic_variance) of energy frames (track_id, frame, x)."""
    mean = F.avg("x").over(Window.partitionBy("track_id"))
    return frames.withColumn("r", F.col("x") / (mean + 1e-8)).groupBy("track_id").agg((F.max("x") - F.min("x")).alias("dynamic_range"), F.var_pop("r").alias("dynamic_variance"))


def smoothed(frames: DataFrame, window: int = 51, order: int = 3) -> DataFrame:
    """(track_id, frame, x): each track's frames after polynomial smoothing, numbered from 0."""

    def run(batches):
        for f in batches:
            yield f.assign(v=[V.savgol_smooth(v, window, order) for v in f.v])

    kind = frames.schema["track_id"].dataType.simpleString()
    seq = frames.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda e: e["x"].cast("double")).alias("v"))
    return seq.mapInPandas(run, f"track_id {kind}, v array<double>").select("track_id", F.posexplode("v").alias("frame", "x"))


def dynamics_fields(frames: DataFrame) -> DataFrame:
    """(track_id, dynamic_range, dynamic_variance, crescendo_strength, diminuendo_strength): runs are those of the smoothed energy."""
    runs = monotonic_runs(smoothed(frames)).withColumnsRenamed({"rise": "crescendo_strength", "fall": "diminuendo_strength"})
    return dynamics(frames).join(runs, "track_id")


def onset_peaks(frames: DataFrame, distance: int = 1) -> DataFrame:
    """(track_id, frame, x) of local maxima of at least half the mean, the higher first, at least ``distance`` apart.

    A track's peaks are thinned in one group, in time linear but for a sort.
    """
    w = _by("track_id", order="frame")
    mean = F.avg("x").over(Window.partitionBy("track_id"))
    top = frames.withColumn("p", F.lag("x").over(w)).withColumn("q", F.lead("x").over(w)).withColumn("m", mean).where((F.col("x") > F.col("p")) & (F.col("x") > F.col("q")) & (F.col("x") >= 0.5 * F.col("m"))).select("track_id", "frame", "x")
    if distance <= 1:
        return top
    kind, frame = (frames.schema[c].dataType.simpleString() for c in ("track_id", "frame"))
    return top.withColumn("x", F.col("x").cast("double")).groupBy("track_id").applyInPandas(_thin(distance), f"track_id {kind}, frame {frame}, x double")


def _thin(distance: int):
    """Peaks from the highest down, each without those nearer than the distance that are left; linear but for the sort."""

    def run(pdf):
        pdf = pdf.sort_values("frame", ignore_index=True)
        at, x = pdf.frame.to_numpy(), pdf.x.to_numpy()
        low, high = np.searchsorted(at, at - distance, side="right"), np.searchsorted(at, at + distance, side="left")
        keep = np.ones(len(at), dtype=bool)
        for i in np.lexsort((at, -x)).tolist():
            if keep[i]:
                keep[low[i] : high[i]] = False
                keep[i] = True
        return pdf.loc[keep, ["track_id", "frame", "x"]]

    return run


def onset_density(frames: DataFrame, seconds_per_frame: float, distance: int = 1) -> DataFrame:
    """(track_id, density): peaks per second."""
    length = frames.groupBy("track_id").agg((F.count("*") * seconds_per_frame).alias("s"))
    peaks = onset_peaks(frames, distance).groupBy("track_id").agg(F.count("*").alias("n"))
    return length.join(peaks, "track_id", "left").select("track_id", (F.coalesce("n", F.lit(0)) / F.col("s")).alias("density"))


#: Frames of a stretch of a track that one row of a task holds.
STRETCH = 1024


def _lagged(lags: int, stretch: int):
    """Sums of products of rows (track_id, stretch, frames): frames of the stretch with those up to ``lags`` - 1 later."""

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        frames = b.column("frames")
        flat, row = frames.flatten(), np.repeat(np.arange(b.num_rows), pc.list_value_length(frames).to_numpy())
        at = flat.field("frame").to_numpy() - b.column("stretch").to_numpy()[row] * stretch
        known = flat.field("x").is_valid().to_numpy(zero_copy_only=False)
        x = np.where(known, flat.field("x").fill_null(0.0).to_numpy(zero_copy_only=False), 0.0)
        value, there, valued = (np.zeros((b.num_rows, int(at.max()) + 1)) for _ in range(3))
        for table, v in ((value, x), (there, 1.0), (valued, known)):
            np.add.at(table, (row, at), v)
        finite, found = np.isfinite(x).all(), []
        for lag in range(min(lags, value.shape[1])):
            m = min(stretch, value.shape[1] - lag)
            pairs, both = (np.einsum("ij,ij->i", t[:, :m], t[:, lag : lag + m]) for t in (there, valued))
            if finite:
                r = np.einsum("ij,ij->i", value[:, :m], value[:, lag : lag + m])
            else:
                r = np.where(valued[:, :m] * valued[:, lag : lag + m] > 0, value[:, :m] * value[:, lag : lag + m], 0.0).sum(axis=1)
            own = np.flatnonzero(pairs)
            found.append((own, np.full(len(own), lag, dtype=np.int32), r[own], both[own] == 0))
        own, lag, r, null = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([b.column("track_id").take(pa.array(own)), pa.array(lag), pa.array(r, mask=null)], names=["track_id", "lag", "r"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                yield compare(b.slice(lo, 256))

    return run


def autocorrelation(frames: DataFrame, lags: int = 100) -> DataFrame:
    """(track_id, lag, r): sums of products with the frame ``lag`` later, for each lag that a track has.

    Tracks are cut into stretches, each with the first frames of the next one, so
    that a frame is sent once or twice, whatever the number of lags is.
    """
    if lags <= 0:
        raise ValueError("lags must be positive")
    stretch = max(STRETCH, lags)
    own = F.floor(F.col("frame") / stretch).cast("long")
    also = F.when(F.col("frame") - own * stretch < lags - 1, F.array(own, own - 1)).otherwise(F.array(own))
    rows = frames.where("track_id is not null and frame is not null").select("track_id", F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.explode(also).alias("stretch"))
    cut = rows.groupBy("track_id", "stretch").agg(F.collect_list(F.struct("frame", "x")).alias("frames"))
    kind = frames.schema["track_id"].dataType.simpleString()
    return cut.mapInArrow(_lagged(lags, stretch), f"track_id {kind}, lag int, r double").groupBy("track_id", "lag").agg(F.sum("r").alias("r"))


#: Major and minor key profiles of probe-tone ratings; fixed values.
KEY_PROFILES = {
    "major": (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88),
    "minor": (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17),
}


def key_profile(chroma: DataFrame) -> DataFrame:
    """(track_id, mode, tonic, r): correlation of the mean chroma with each of the 24 rotated key profiles."""
    spark = chroma.sparkSession
    rows = [(m, t, (pc + t) % 12, v) for m, profile in KEY_PROFILES.items() for t in range(12) for pc, v in enumerate(profile)]
    profiles = F.broadcast(spark.createDataFrame(rows, "mode string, tonic int, pc int, v double"))
    mean = chroma.groupBy("track_id", F.col("pc").cast("int").alias("pc")).agg(F.avg("energy").alias("e"))
    return mean.join(profiles, "pc").groupBy("track_id", "mode", "tonic").agg(F.corr("e", "v").alias("r"))


def harmonic_change(chroma: DataFrame) -> DataFrame:
    """(track_id, frame, x): the mean over pitch classes of the |difference| to the next frame; the last frame has none."""
    after = F.lead("energy").over(Window.partitionBy("track_id", "pc").orderBy("frame"))
    steps = chroma.withColumn("d", F.abs(after - F.col("energy"))).where("d is not null")
    return steps.groupBy("track_id", "frame").agg(F.avg("d").alias("x"))


def tonal_stability(chroma: DataFrame) -> DataFrame:
    """(track_id, pc, x): 1 / (1 + variance over time) of each pitch class."""
    return chroma.groupBy("track_id", "pc").agg((1 / (1 + F.var_pop("energy"))).alias("x"))


def harmonic_complexity(chroma: DataFrame) -> DataFrame:
    """(track_id, x): entropy of the mean chroma."""
    mean = chroma.groupBy("track_id", "pc").agg(F.avg("energy").alias("e"))
    p = mean.withColumn("p", F.col("e") / (F.sum("e").over(Window.partitionBy("track_id")) + 1e-8))
    return p.groupBy("track_id").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-8))).alias("x"))


#: Decibels below the track's peak that a level is cut at; a fixed value.
LEVEL_RANGE = -80.0


def attacks(frames: DataFrame, onsets: DataFrame, span: int) -> DataFrame:
    """(track_id, onset, slope, sharpness) of onsets (track_id, onset frame) on energy frames.

    The envelope is in decibels below the track's peak.  Slopes are fitted over
    ``span`` frames from the onset on and are not negative; a window that runs past
    the end has none.  The sharpness is the |step| from the onset to the next
    frame; an onset on the last frame has none.
    """
    top = F.max("x").over(Window.partitionBy("track_id"))
    w = _by("track_id", order="frame")
    level = F.greatest(20 * F.log10(F.greatest(F.col("x"), F.lit(1e-5)) / F.greatest(top, F.lit(1e-5))), F.lit(LEVEL_RANGE))
    db = frames.withColumn("db", level).withColumn("step", F.abs(F.lead("db").over(w) - F.col("db")))
    asks = onsets.select("track_id", "onset", F.explode(F.sequence(F.col("onset"), F.col("onset") + span - 1)).alias("frame"))
    near = asks.join(db, ["track_id", "frame"])
    slope = F.when((F.count("*") == span) & F.lit(span > 1), F.greatest(F.regr_slope("db", F.col("frame").cast("double")), F.lit(0.0)))
    return near.groupBy("track_id", "onset").agg(slope.alias("slope"), F.max(F.when(F.col("frame") == F.col("onset"), F.col("step"))).alias("sharpness"))


def attack_fields(frames: DataFrame, onsets: DataFrame, span: int) -> DataFrame:
    """(track_id, attack_slopes, attack_sharpness): the values of :func:`attacks` in the order of the onsets, without missing ones; a single 0 if there is none."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("onset", c)))), lambda e: e[c])
    values = attacks(frames, onsets, span).groupBy("track_id").agg(ordered("slope").alias("a"), ordered("sharpness").alias("b"))
    filled = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<double>"))) == 0, F.array(F.lit(0.0))).otherwise(F.col(c))
    return frames.select("track_id").distinct().join(values, "track_id", "left").select("track_id", filled("a").alias("attack_slopes"), filled("b").alias("attack_sharpness"))


def phrases(boundaries: DataFrame) -> DataFrame:
    """(track_id, regularity, n): variation of the gaps between boundaries (track_id, t), and their number."""
    gaps = boundaries.withColumn("g", F.lead("t").over(_by("track_id", order="t")) - F.col("t"))
    return gaps.groupBy("track_id").agg(F.coalesce(F.stddev_pop("g") / F.avg("g"), F.lit(0.0)).alias("regularity"), F.count("g").alias("n"))


def targets_long(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(track_id, category, field, values) of tables (track_id, value) by category and field."""
    out = None
    for (category, field), t in tables.items():
        value = F.col(next(c for c in t.columns if c != "track_id"))
        values = value if dict(t.dtypes)[next(c for c in t.columns if c != "track_id")].startswith("array") else F.array(value.cast("double"))
        part = t.select("track_id", F.lit(category).alias("category"), F.lit(field).alias("field"), values.cast("array<double>").alias("values"))
        out = part if out is None else out.unionByName(part)
    return out


def all_targets(jobs: dict[str, Callable[[], dict[tuple[str, str], DataFrame]]]) -> tuple[DataFrame | None, dict[str, str]]:
    """((track_id, category, field, values), errors by job): every job's targets in one table.

    A job that can't be planned or fails on its first rows is left out with its
    error, and the others go on.
    """
    tables, errors = {}, {}
    for name, job in jobs.items():
        try:
            made = job()
            for t in made.values():
                t.limit(1).collect()
            tables |= made
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return (targets_long(tables) if tables else None), errors


def targets_of_tracks(frames: DataFrame, generators: dict[str, Callable[[pd.DataFrame], dict[str, object]]]) -> DataFrame:
    """(track_id, category, field, values, error): every category's fields of every track, failures kept to their track and category.

    A generator takes the rows of one track, in the order of ``frame``, and returns
    its fields, numbers or arrays.  One that raises, or returns what is no number,
    gives one row with the error and no field; the track's other categories and all
    other tracks go on.  A track is one group.
    """
    kind = frames.schema["track_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, own = [], pdf.sort_values("frame", ignore_index=True)
        for category, generate in generators.items():
            try:
                made = {f: np.atleast_1d(np.asarray(v, dtype=float)).ravel().tolist() for f, v in generate(own.copy()).items()}
                rows += [(own.track_id[0], category, f, v, None) for f, v in made.items()]
            except Exception as e:
                rows.append((own.track_id[0], category, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["track_id", "category", "field", "values", "error"])

    return frames.groupBy("track_id").applyInPandas(run, f"track_id {kind}, category string, field string, values array<double>, error string")


def missing_targets(targets: DataFrame, required: DataFrame) -> DataFrame:
    """(track_id, category, field) that the required (category, field) table lists and a track lacks."""
    tracks = targets.select("track_id").distinct()
    wanted = tracks.withColumn("w", F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.field).alias("field")) for r in required.collect()])).select("track_id", F.explode("w").alias("w")).select("track_id", "w.*")
    return wanted.join(targets.select("track_id", "category", "field"), ["track_id", "category", "field"], "left_anti")

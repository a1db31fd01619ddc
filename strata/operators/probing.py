"""Cross-validated ridge probes of layers against targets, as tables.

The sums of products of vectors and targets per layer and fold are made in one
pass, and all fits and metrics follow from them; see :mod:`strata.operators.grams`.
With a penalty the normal equations have a solution for any number of rows, so few
rows need no way of their own.

Folds are dealt over the ids of a table once, so that all targets share them; a
target may have folds of its own (target, id, fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import grams as G
from strata.operators.ranking import checksum_ranks

#: Target columns that share one matrix; more targets are probed in several blocks.
BLOCK_COLUMNS = 1000
TAUS = (0.1, 0.25, 0.5, 1.0, 2.0, 4.0)
_METRICS = "r2_score double, correlation double, rmse double, n_valid long"


def kfold(ids: DataFrame, key: str = "id", folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold) with fold sizes that differ by one at most, in checksum order."""
    return checksum_ranks(ids, key, seed).select(key, ((F.col("place") - 1) % F.least(F.lit(folds), F.col("total"))).cast("int").alias("fold"))


def grouped_kfold(rows: DataFrame, key: str, group: str, folds: int = 5, seed: int = 42, by_size: bool = True) -> DataFrame:
    """(key, fold) with all rows of a group in one fold; one single group falls back to :func:`kfold`.

    Groups go by size, largest first, to the fold with the fewest rows so far;
    which groups of one size go where is by checksum.  The sizes that there are,
    at most the square root of twice the rows, pass through the driver, groups
    do not.  Without ``by_size`` groups are dealt in checksum order, whatever their
    sizes, and a single group is fold 0.
    """
    if not by_size:
        return rows.select(key, group).join(kfold(rows.select(group).distinct(), group, folds, seed), group).select(key, "fold")
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    counts = sizes.groupBy("size").count().orderBy(F.col("size").desc()).collect()
    total = sum(r["count"] for r in counts)
    if total < 2:
        return kfold(rows, key, folds, seed)
    shares = _deal([(r["size"], r["count"]) for r in counts], min(folds, total))
    table = rows.sparkSession.createDataFrame(shares, "size long, even long, k int, cuts array<long>")
    past = F.col("place") - F.col("even") * F.col("k")
    fold = F.when(past <= 0, (F.col("place") - 1) % F.col("k")).otherwise(F.size(F.filter("cuts", lambda c: c < past)))
    groups = _ranked_in_size(sizes, group, seed).join(F.broadcast(table), "size").select(group, fold.cast("int").alias("fold"))
    return rows.select(key, group).join(groups, group).select(key, "fold")


def _deal(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, groups of it that every fold gets, k, running sums of what the folds get beyond) of (size, count), largest size first."""
    loads, out = [0] * k, []
    for size, count in sizes:
        low, high = min(loads), max(loads) + size * (count + 1)
        while high - low > 1:  # the highest level that the groups of this size can fill all folds to
            level = (low + high) // 2
            low, high = (level, high) if sum(max(0, level - x) // size for x in loads) <= count else (low, level)
        got = [max(0, low - x) // size for x in loads]
        for f in sorted(range(k), key=lambda f: (loads[f] + got[f] * size, f))[: count - sum(got)]:
            got[f] += 1
        loads = [x + g * size for x, g in zip(loads, got)]
        even, cuts = min(got), []
        for g in got:
            cuts.append((cuts[-1] if cuts else 0) + g - even)
        out.append((size, even, k, cuts))
    return out


def _ranked_in_size(sizes: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, size, place): the place from 1 by checksum among the groups of one size, ranked by prefixes of the checksum."""
    keyed = sizes.withColumn("sum", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")).cast("binary"))).withColumn("head", F.substring("sum", 1, 3))
    heads = keyed.groupBy("size", "head").count()
    before = heads.withColumn("before", F.sum("count").over(Window.partitionBy("size").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)))  # 4096 rows a size
    inside = F.row_number().over(Window.partitionBy("size", "head").orderBy("sum", group))
    return keyed.withColumn("n", inside).join(before.drop("count"), ["size", "head"]).select(group, "size", (F.coalesce("before", F.lit(0)) + F.col("n")).alias("place"))


def folds_of_single_groups(values: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(target, id, fold) for targets whose values (target, id, group, y) lie in one group only: ungrouped folds over those rows."""
    known = values.where("y is not null")
    alone = known.groupBy("target").agg(F.min("group").alias("lowest"), F.max("group").alias("highest")).where("lowest = highest").select("target")
    rows = known.join(F.broadcast(alone), "target").select("target", "id")
    order = Window.partitionBy("target").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id")  # the rows of one group
    ranked = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("target")))
    return ranked.select("target", "id", (F.col("place") % F.least(F.lit(folds).cast("long"), F.col("n"))).cast("int").alias("fold"))


def valid_targets(targets: DataFrame, n_folds: int = 5, scalar: bool = True) -> DataFrame:
    """(target, n_valid, coverage) of targets with enough values and, if scalar, some variance."""
    stats = targets.groupBy("target").agg(F.count("y").alias("n_valid"), (F.count("y") / F.count("*")).alias("coverage"), F.stddev_pop("y").alias("sd"))
    keep = (F.col("n_valid") >= n_folds) & ((F.col("sd") > 1e-10) if scalar else F.lit(True))
    return stats.where(keep).select("target", "n_valid", "coverage")


def fit_metrics(predictions: DataFrame, keys: list[str], n_folds: int = 5) -> DataFrame:
    """r2_score, correlation, rmse and n_valid of pooled predictions (y, p).

    Fewer rows than folds give (-999, 0, 999); a constant y or p has correlation 0.
    """
    stats = predictions.groupBy(*keys).agg(
        F.sum((F.col("y") - F.col("p")) ** 2).alias("res"), (F.var_pop("y") * F.count("*")).alias("tot"), F.corr("y", "p").alias("c"),
        F.stddev_pop("y").alias("sy"), F.stddev_pop("p").alias("sp"), F.count("*").alias("n_valid"),
    )
    few = F.col("n_valid") < n_folds
    return stats.select(
        *keys,
        F.when(few, -999.0).otherwise(F.when(F.col("tot") > 0, 1 - F.col("res") / F.col("tot")).otherwise(0.0)).alias("r2_score"),
        F.when(few | (F.col("sy") <= 1e-10) | (F.col("sp") <= 1e-10), 0.0).otherwise(F.col("c")).alias("correlation"),
        F.when(few, 999.0).otherwise(F.sqrt(F.col("res") / F.col("n_valid"))).alias("rmse"),
        "n_valid",
    )


def align(features: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows (model, target, fold, id, vec, y) of features (id, layer, vec), targets (id, target, y) and folds (id, fold)."""
    return features.join(targets, "id").join(folds, "id").select(F.col("layer").cast("int").alias("model"), "target", "fold", "id", "vec", "y")


def _named_values(values: str, names: list[str]) -> Column:
    return F.array(*[F.try_element_at(values, F.lit(n)).cast("double") for n in names])


def target_arrays(targets: DataFrame, names: list[str]) -> DataFrame:
    """(id, ys): the named targets of (id, target, y) in that order, null where missing."""
    known = targets.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "y"))).alias("m"))
    return known.select("id", _named_values("m", names).alias("ys"))


def _curve_arrays(curves: DataFrame, names: list[str], widths: list[int]) -> DataFrame:
    """(id, ys): the frames of the named curves (id, target, curve) end to end, null where a curve is missing or has another length."""
    known = curves.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "curve"))).alias("m"))
    frames = lambda n, k: F.try_element_at("m", F.lit(n))
    each = [F.when(F.size(frames(n, k)) == k, frames(n, k)).otherwise(F.array_repeat(F.lit(None).cast("double"), k)) for n, k in zip(names, widths)]
    return known.select("id", F.concat(*each).alias("ys"))


class _Plan:
    """The rows that the sums are made of, and which target is which place of which model.

    Targets are in blocks of ``BLOCK_COLUMNS`` columns, one model each; a target
    with folds of its own is a model of its own.  The driver holds the targets'
    names, which are descriptors, and their widths.

    Stacks that have ``values``, a map of scalar targets, are not joined with the
    targets, which then only name what is probed.
    """

    def __init__(self, stacks: DataFrame, targets: DataFrame, folds: DataFrame, own_folds: DataFrame | None, curves: bool):
        width = F.max(F.size("curve")).alias("w") if curves else F.lit(1).alias("w")
        value = "curve" if curves else "y"
        known = targets.where(F.col(value).isNotNull())
        sizes = [(r.target, r.w) for r in known.groupBy("target").agg(width).orderBy("target").collect()]
        apart = {r.target for r in own_folds.select("target").distinct().collect()} if own_folds is not None else set()
        blocks: list[list[tuple[str, int]]] = []
        for name, w in sizes:
            if name not in apart:
                if not blocks or sum(x for _, x in blocks[-1]) + w > BLOCK_COLUMNS:
                    blocks.append([])
                blocks[-1].append((name, w))
        self.models = {f"block{i}": b for i, b in enumerate(blocks)} | {f"own{i}": [x] for i, x in enumerate(x for x in sizes if x[0] in apart)}
        self.widths = {m: [w for _, w in b] for m, b in self.models.items()}
        self.names = targets.sparkSession.createDataFrame([(m, t, n) for m, b in self.models.items() for t, (n, _) in enumerate(b)], "model string, t int, target string")
        self.rows, self.n = None, folds.count()
        for model, block in self.models.items():
            names, widths = [n for n, _ in block], [w for _, w in block]
            if "values" in stacks.columns:
                with_ys = stacks.withColumn("ys", _named_values("values", names)).where(F.exists("ys", lambda y: y.isNotNull()))
            else:
                part = known.where(F.col("target").isin(names))
                with_ys = stacks.join(_curve_arrays(part, names, widths) if curves else target_arrays(part, names), "id")
            by = own_folds.where(F.col("target") == names[0]).select("id", "fold") if model.startswith("own") else folds
            starts = [sum(widths[:i]) for i in range(len(widths))]
            made = with_ys.join(by, "id").select(F.lit(model).alias("model"), F.col("fold").cast("int").alias("fold"), "id", "layers", "ys", G.gaps_of(F.col("ys"), starts).alias("gaps"))
            self.rows = made if self.rows is None else self.rows.unionByName(made)

    def named(self, found: DataFrame) -> DataFrame:
        return found.join(F.broadcast(self.names), ["model", "t"])


def _layer_maps(features: DataFrame) -> DataFrame:
    """(id, layers): the vectors of each id by layer; features that have ``layers`` are stacks already."""
    if "layers" in features.columns:
        return features
    return features.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("layer").cast("int"), V.doubles(F.col("vec")).alias("vec")))).alias("layers"))


def _probe(features: DataFrame, targets: DataFrame, folds: DataFrame, alpha: float, n_folds: int, own_folds: DataFrame | None, curves: bool) -> DataFrame:
    plan = _Plan(_layer_maps(features), targets, folds, own_folds, curves)
    if plan.rows is None:
        return targets.sparkSession.createDataFrame([], f"layer int, target string, {G.METRICS}")
    return plan.named(G.layer_metrics(G.sums_of_products(plan.rows, plan.n), plan.widths, alpha, n_folds, curves))


def probe_layers(features: DataFrame, targets: DataFrame, folds: DataFrame, alpha: float = 1.0, n_folds: int = 5, own_folds: DataFrame | None = None) -> DataFrame:
    """(layer, target, metrics): every layer against every scalar target, in one job.

    ``own_folds`` (target, id, fold) replaces the folds of the targets in it.
    """
    found = _probe(features, targets, folds, alpha, n_folds, own_folds, False)
    return found.select("layer", "target", "r2_score", "correlation", "rmse", "n_valid")


def probe_curves(features: DataFrame, curves: DataFrame, folds: DataFrame, alpha: float = 1.0, n_folds: int = 5) -> DataFrame:
    """(layer, target, r2_mean, rmse_mean, n_valid, r2_pc1) of curve targets (id, target, curve array).

    All frames of a target are fitted at once.  The first component is fitted
    on the training folds only, once per fold left out.  A curve of another
    length than the longest of its target counts as missing; n_valid counts curves.
    """
    found = _probe(features, curves.withColumn("curve", V.doubles(F.col("curve"))), folds, alpha, n_folds, None, True)
    return found.select("layer", "target", "r2_mean", "rmse_mean", "n_valid", "r2_pc1")


def mix_candidates(layer_results: DataFrame, n_layers: int) -> DataFrame:
    """(target, candidate, weights): softmax(base / tau) for three bases and the taus, in order."""
    per = layer_results.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("layer", "r2_score"))).alias("r"))
    r2 = F.transform(F.sequence(F.lit(0), F.lit(n_layers - 1)), lambda i: F.coalesce(F.try_element_at("r", i), F.lit(0.0)))
    base = per.select("target", r2.alias("r2"))
    zero = F.transform("r2", lambda _: F.lit(0.0))
    clipped = F.transform("r2", lambda v: F.greatest(v, F.lit(0.0)))
    best = F.array_position("r2", F.array_max("r2")) - 1
    spike = F.transform("r2", lambda _, i: F.when(i == best, 1.0).otherwise(0.0))
    bases = base.select("target", F.posexplode(F.array(zero, clipped, spike)).alias("kind", "base"))
    taus = F.array(*map(F.lit, TAUS))
    spread = bases.select("target", "kind", "base", F.posexplode(taus).alias("t", "tau"))
    return spread.select("target", (F.col("kind") * len(TAUS) + F.col("t")).cast("int").alias("candidate"), V.softmax(F.transform("base", lambda v: v / F.col("tau"))).alias("weights"))


def _probe_mixes(features: DataFrame, targets: DataFrame, folds: DataFrame, mixes: DataFrame, n_layers: int, alpha: float, n_folds: int, own_folds: DataFrame | None, curves: bool) -> DataFrame:
    """(target, candidate, metrics) of ids that have all layers."""
    every = F.array(*map(F.lit, range(n_layers)))
    stacks = _layer_maps(features).withColumn("layers", F.map_filter("layers", lambda k, _: k.between(0, n_layers - 1)))
    stacks = stacks.where(F.size(F.array_except(every, F.map_keys("layers"))) == 0)
    plan = _Plan(stacks, targets, folds, own_folds, curves)
    if plan.rows is None:
        return targets.sparkSession.createDataFrame([], f"target string, candidate int, {G.METRICS}")
    sums = G.sums_of_products(plan.rows, plan.n, cross=True)
    return plan.named(G.mix_metrics(sums, mixes.join(F.broadcast(plan.names), "target"), plan.widths, n_layers, alpha, n_folds, curves))


def _best_mix(found: DataFrame, mixes: DataFrame, layer_results: DataFrame, score: str) -> DataFrame:
    first = Window.partitionBy("target").orderBy(F.round(score, 10).desc(), "candidate")
    best = found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    single = layer_results.groupBy("target").agg(F.max(score).alias("single"))
    return best.join(mixes, ["target", "candidate"]).join(single, "target").withColumn("layer_weights", F.col("weights")).withColumn("r2_gain", F.col(score) - F.col("single"))


def probe_mixes(features: DataFrame, targets: DataFrame, folds: DataFrame, layer_results: DataFrame, n_layers: int, alpha: float = 1.0, n_folds: int = 5, own_folds: DataFrame | None = None) -> DataFrame:
    """(target, r2_score, correlation, rmse, n_valid, layer_weights, r2_gain): the best mix of layers of each scalar target."""
    mixes = G.stored(mix_candidates(layer_results, n_layers), "mixes")
    found = _probe_mixes(features, targets, folds, mixes, n_layers, alpha, n_folds, own_folds, False)
    return _best_mix(found, mixes, layer_results, "r2_score").select("target", "r2_score", "correlation", "rmse", "n_valid", "layer_weights", "r2_gain")


def probe_curve_mixes(features: DataFrame, curves: DataFrame, folds: DataFrame, layer_results: DataFrame, n_layers: int, alpha: float = 1.0, n_folds: int = 5) -> DataFrame:
    """(target, r2_mean, rmse_mean, n_valid, layer_weights, r2_gain): the best mix of layers of each curve target, by r2_mean."""
    mixes = G.stored(mix_candidates(layer_results.withColumn("r2_score", F.col("r2_mean")), n_layers), "mixes")
    found = _probe_mixes(features, curves.withColumn("curve", V.doubles(F.col("curve"))), folds, mixes, n_layers, alpha, n_folds, None, True)
    return _best_mix(found, mixes, layer_results, "r2_mean").select("target", "r2_mean", "rmse_mean", "n_valid", "layer_weights", "r2_gain")


RESULT_COLUMNS = ("mode", "layer", "target", "r2_score", "correlation", "rmse", "r2_mean", "r2_pc1", "rmse_mean", "n_valid", "layer_weights", "r2_gain")
_RESULT_TYPES = {"layer": "int", "n_valid": "long", "layer_weights": "array<double>", "target": "string"}


def _as_results(found: DataFrame, mode: str) -> DataFrame:
    own = found.withColumn("mode", F.lit(mode))
    return own.select(*[(F.col(c) if c in own.columns else F.lit(None)).cast(_RESULT_TYPES.get(c, "string" if c == "mode" else "double")).alias(c) for c in RESULT_COLUMNS])


def first_ids(features: DataFrame, n: int) -> DataFrame:
    """The first n ids in order, for a trial run on few tracks."""
    return features.select("id").distinct().orderBy("id").limit(n)


def discover(features: DataFrame, targets: DataFrame, n_layers: int, folds: int = 5, seed: int = 42, mixes: bool = True, curves: DataFrame | None = None, n_samples: int | None = None) -> DataFrame:
    """Probe results (mode, layer, target, metrics, layer_weights, r2_gain, coverage) of tracks.

    ``features`` has (id, layer, vec), ``targets`` (id, target, y), ``curves``
    (id, target, curve).  Scalar rows have r2_score, correlation and rmse; curve
    rows have r2_mean, r2_pc1 and rmse_mean.  Targets that fail the gate, and
    tables with fewer ids than folds, give no row.
    """
    if n_samples is not None:
        features = features.join(first_ids(features, n_samples), "id", "left_semi")
    with_target = targets.select("id") if curves is None else targets.select("id").union(curves.select("id"))
    both = features.select("id").distinct().intersect(with_target.distinct())
    fold_table, known = G.stored(kfold(both, "id", folds, seed), "folds"), targets.join(both, "id")
    gate = valid_targets(known, folds)
    out = _discover(features, known.join(gate.select("target"), "target"), fold_table, gate, n_layers, folds, mixes)
    if curves is None:
        return out
    present = curves.join(both, "id")
    shapes = valid_targets(present.select("target", F.when(F.col("curve").isNotNull(), 1.0).alias("y")), folds, scalar=False)
    kept = present.join(shapes.select("target"), "target")
    layers = G.stored(probe_curves(features, kept, fold_table, n_folds=folds), "layers")
    found = _as_results(layers, "best_layer")
    if mixes:
        found = found.unionByName(_as_results(probe_curve_mixes(features, kept, fold_table, layers, n_layers, n_folds=folds), "weighted_sum"))
    return out.unionByName(found.join(shapes.select("target", "coverage"), "target"))


def discover_and_save(features: DataFrame, targets: DataFrame, n_layers: int, path: str, **how) -> DataFrame:
    """:func:`discover`, written as Parquet and read back."""
    discover(features, targets, n_layers, **how).write.mode("overwrite").parquet(path)
    return features.sparkSession.read.parquet(path)


def _discover(features, targets, fold_table, gate, n_layers, folds, mixes, own_folds=None) -> DataFrame:
    layers = G.stored(probe_layers(features, targets, fold_table, n_folds=folds, own_folds=own_folds), "layers")
    out = _as_results(layers, "best_layer")
    if mixes:
        out = out.unionByName(_as_results(probe_mixes(features, targets, fold_table, layers, n_layers, n_folds=folds, own_folds=own_folds), "weighted_sum"))
    return out.join(gate.select("target", "coverage"), "target")


def align_segments(features: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, track_id, segment_idx, layer, vec, target, y) of tracks with as many feature as target segments.

    ``features`` has (track_id, segment_idx, layer, vec), ``targets`` (track_id, segment_idx, target, y).
    """
    n_f = features.groupBy("track_id").agg(F.countDistinct("segment_idx").alias("n_features"))
    n_t = targets.groupBy("track_id").agg(F.countDistinct("segment_idx").alias("n_targets"))
    equal = n_f.join(n_t, "track_id").where("n_features = n_targets").select("track_id")
    joined = features.join(equal, "track_id").join(targets, ["track_id", "segment_idx"])
    return joined.withColumn("id", F.concat_ws(":", "track_id", "segment_idx"))


def _segment_stacks(features: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, track_id, layers, known) of the segments of :func:`align_segments`, one row each: vectors by layer and an array of (target, y).

    Both tables meet in one grouping by track, so no row is made for each layer and target.
    """
    keys = ["track_id", "segment_idx"]
    vecs = features.select(*keys, F.struct(F.col("layer").cast("int").alias("layer"), V.doubles(F.col("vec")).alias("vec")).alias("f"))
    met = vecs.unionByName(targets.select(*keys, F.struct("target", "y").alias("t")), allowMissingColumns=True).where("track_id is not null and segment_idx is not null")
    segments = met.repartition("track_id").groupBy(*keys).agg(F.collect_set("f").alias("f"), F.collect_set("t").alias("known"))
    in_track = lambda c: F.count(F.when(F.size(c) > 0, 1)).over(Window.partitionBy("track_id"))
    equal = segments.withColumn("equal", in_track("f") == in_track("known")).where("equal and size(f) > 0 and size(known) > 0")
    return equal.select(F.concat_ws(":", *keys).alias("id"), "track_id", F.map_from_entries("f").alias("layers"), "known")


def discover_segments(features: DataFrame, targets: DataFrame, n_layers: int, folds: int = 5, seed: int = 42, mixes: bool = True) -> DataFrame:
    """As :func:`discover`, on segments, with all segments of a track in one fold; adds n_groups and n_tracks.

    A target with values in one track only is probed with ungrouped folds over its segments.

    The given tables are read once, for a table of one row a segment; all that follows reads that.
    """
    rows = G.stored(_segment_stacks(features, targets), "segments")
    ys = rows.select("id", "track_id", F.inline("known"))
    groups = ys.where("y is not null").groupBy("target").agg(F.countDistinct("track_id").alias("n_groups"))
    tracks = rows.agg(F.countDistinct("track_id").alias("n_tracks"))
    gate = G.stored(valid_targets(ys, folds).join(groups, "target").join(F.broadcast(tracks)), "gate")
    fold_table = G.stored(grouped_kfold(rows.select("id", "track_id"), "id", "track_id", folds, seed), "folds")
    kept = ys.join(F.broadcast(gate.select("target")), "target")
    own = G.stored(folds_of_single_groups(kept.select("target", "id", F.col("track_id").alias("group"), "y"), folds, seed), "folds")
    values = F.map_from_entries(F.filter("known", lambda e: e["target"].isNotNull() & e["y"].isNotNull()))
    found = _discover(rows.select("id", "layers", values.alias("values")), kept.select("id", "target", "y"), fold_table, gate, n_layers, folds, mixes, own)
    return found.join(F.broadcast(gate.select("target", "n_groups", "n_tracks")), "target")


def best_layers(results: DataFrame) -> DataFrame:
    """(target, layer, r2_score, confidence) of the best single layer; ties go to the lowest layer."""
    single = results.where("mode = 'best_layer' and r2_score is not null")
    best = single.groupBy("target").agg(F.max_by(F.struct("layer", "r2_score"), F.struct("r2_score", -F.col("layer"))).alias("b"))
    return best.select("target", "b.layer", F.round("b.r2_score", 4).alias("r2_score"), V.confidence(F.col("b.r2_score")).alias("confidence"))


def resolve_aspects(results: DataFrame, aspects: DataFrame, min_r2: float = 0.5, mode: str = "auto", margin: float = 0.02, curves: bool = True) -> DataFrame:
    """(aspect, target, mode, layer, layer_weights, r2_score, confidence, n_valid, coverage) of validated aspects.

    ``aspects`` has (aspect, target, ord): candidates in order.  In mode
    ``auto`` a mix wins over the best layer by more than ``margin``.  With
    ``curves`` the score of a curve target is its r2_mean.
    """
    if curves and "r2_mean" in results.columns:
        results = results.withColumn("r2_score", F.coalesce("r2_score", "r2_mean"))
    results = results.where("r2_score is not null")
    if mode not in ("auto", "best_layer", "weighted_sum"):
        raise ValueError(f"unknown mode {mode}")
    fields = F.struct("layer", "layer_weights", "r2_score", "r2_gain", "n_valid", "coverage")
    single = results.where("mode = 'best_layer'").groupBy("target").agg(F.max_by(fields, F.struct("r2_score", -F.col("layer"))).alias("s"))
    mixed = results.where("mode = 'weighted_sum'").groupBy("target").agg(F.max_by(fields, "r2_score").alias("w"))
    both = single.join(mixed, "target", "full")
    wins = {"best_layer": F.lit(False), "weighted_sum": F.lit(True), "auto": F.col("s").isNull() | (F.col("w.r2_score") > F.col("s.r2_score") + margin)}[mode]
    use_mix = F.col("w").isNotNull() & wins
    picked = both.withColumn("mode", F.when(use_mix, "weighted_sum").otherwise("best_layer")).withColumn("b", F.when(use_mix, F.col("w")).otherwise(F.when(F.lit(mode != "weighted_sum"), F.col("s")))).where("b is not null")
    ranked = aspects.join(picked, "target").where(F.col("b.r2_score") >= min_r2)
    first = Window.partitionBy("aspect").orderBy(F.col("b.r2_score").desc(), "ord")
    return ranked.withColumn("n", F.row_number().over(first)).where("n = 1").select("aspect", "target", "mode", "b.layer", "b.layer_weights", "b.r2_score", "b.r2_gain", V.confidence(F.col("b.r2_score")).alias("confidence"), "b.n_valid", "b.coverage")

"""Ridge fits and their out-of-fold metrics from sums of products alone.

A row has a model, a fold, vectors of one or all layers, and all target columns in
one array.  The sums of products of (1, vector, targets) per model, layer and fold
are made in one pass; a target that some rows lack has one more matrix, the sums
over the rows that lack it, which is taken off.  So the matrices grow with the
targets that have gaps, not with the patterns of gaps.  Training sums of a fold
are the total less its own, and residuals, correlations and errors on the fold are
quadratic forms of its own sums: no second pass over the rows.

A mix of layers has the sum over pairs of layers of weight times weight times
their block as its matrix, so candidates of weights need no pass either.

Rows are dealt to tasks by model, layers, fold, gap and a part of at most about
``PART_ROWS`` rows; a task holds one matrix at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.plans.session import scratch

PART_ROWS = 1 << 16
#: Candidates of a target that a task holds matrices of.
CHUNK = 6
_KEYS = ("model", "a", "b", "fold", "gap")
_METRICS = ("r2_score", "correlation", "rmse", "n_valid", "r2_mean", "rmse_mean", "r2_pc1")
METRICS = "r2_score double, correlation double, rmse double, n_valid long, r2_mean double, rmse_mean double, r2_pc1 double"


def stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sum_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by their keys: the sums of products of each key, one row of the matrix per output row."""
    held, current = None, None

    def rows() -> pa.RecordBatch:
        n = len(held)
        keys = [pa.array([v] * n, pa.string() if c == "model" else pa.int32()) for c, v in zip(_KEYS, current)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(range(n), pa.int32()), pa.array(held.tolist(), pa.list_(pa.float64()))], names=[*_KEYS, "i", "row"])

    for b in batches:
        if not b.num_rows:
            continue
        keys = pd.DataFrame({c: b.column(c).to_pandas() for c in _KEYS})
        edge = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows]):
            key = tuple(keys.iloc[lo])
            matrix = lambda c: b.column(c).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)  # noqa: B023, E731
            left = matrix("left")
            if key[1] != key[2]:
                product = left.T @ matrix("right")
            else:
                z = np.column_stack([np.ones(hi - lo), left, *([np.nan_to_num(matrix("ys").astype(float))] if key[4] < 0 else [])])
                product = z.T @ z
            if key != current:
                if held is not None:
                    yield rows()
                held, current = product, key
            else:
                held += product
    if held is not None:
        yield rows()


def sums_of_products(rows: DataFrame, n: int, cross: bool = False) -> DataFrame:
    """(model, a, b, fold, gap, i, row) of rows (model, fold, id, layers map of layer to vector, ys, gaps).

    ``gaps`` are the places of the targets that the row lacks.  With gap -1 the
    matrix is that of all rows; else of those that lack that target.  With
    ``cross`` there is a block for each pair of layers.  ``n`` is about the number
    of rows, which sets the parts that they are dealt to.
    """
    parts = max(1, -(-n // PART_ROWS))
    keyed = rows.select("model", "fold", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "layers", "ys", F.explode(F.concat(F.array(F.lit(-1)), "gaps")).alias("gap"))
    one = keyed.select(*("model", "fold", "part", "gap", "ys"), "layers", F.explode("layers").alias("a", "left"))
    if cross:
        pairs = one.select("model", "fold", "part", "gap", "ys", "a", "left", F.explode(F.map_filter("layers", lambda k, _: k >= F.col("a"))).alias("b", "right"))
    else:
        pairs = one.select("model", "fold", "part", "gap", "ys", "a", "left", F.col("a").alias("b"), F.lit(None).cast("array<double>").alias("right"))
    own = F.col("a") == F.col("b")
    slim = pairs.select(*_KEYS, "part", "left", F.when(~own, F.col("right")).alias("right"), F.when(own & (F.col("gap") < 0), F.transform("ys", lambda y: F.coalesce(y, F.lit(0.0)))).alias("ys"))
    dealt = slim.repartition(*_KEYS, "part").sortWithinPartitions(*_KEYS)
    partial = dealt.mapInArrow(_sum_products, "model string, a int, b int, fold int, gap int, i int, row array<double>")
    return stored(partial.groupBy(*_KEYS, "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")), "grams")


def solve_ridge(gram: np.ndarray, xy: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts on raw columns, from the sums of products of (1, x) with itself and with the targets.

    Columns are standardised with the population deviation (1 where it is 0);
    the intercept is not penalised.
    """
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:] / n, xy[0] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale < 1e-12] = 1.0
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(len(mean)), (xy[1:] - n * np.outer(mean, y_mean)) / scale[:, None]) / scale[:, None]
    return w, y_mean - mean @ w


class _Pooled:
    """Sums of y, p, their squares and product over all folds, for several columns."""

    def __init__(self, width: int):
        self.sums = np.zeros((6, width))

    def add(self, gram: np.ndarray, xy: np.ndarray, yy: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
        n, sy, sx = gram[0, 0], xy[0], gram[1:, 0] @ w
        spp = np.einsum("ic,ic->c", w, gram[1:, 1:] @ w) + 2 * b * sx + n * b * b
        self.sums += np.stack([np.full(len(b), n), sy, yy, sx + n * b, spp, np.einsum("ic,ic->c", w, xy[1:]) + b * sy])

    def metrics(self, n_folds: int) -> tuple[np.ndarray, ...]:
        """(r2, correlation, rmse, n) of each column; fewer rows than folds give (-999, 0, 999), and a constant y or p correlation 0."""
        n, y, yy, p, pp, py = self.sums
        safe = np.maximum(n, 1)
        res, tot = np.maximum(yy - 2 * py + pp, 0), np.maximum(yy - y * y / safe, 0)
        sy, sp = np.sqrt(tot / safe), np.sqrt(np.maximum(pp - p * p / safe, 0) / safe)
        r2 = np.where(tot > 1e-20 * safe, 1 - res / np.where(tot > 0, tot, 1), 0.0)
        c = np.where((sy > 1e-10) & (sp > 1e-10), (py - y * p / safe) / safe / np.where(sy * sp > 0, sy * sp, 1), 0.0)
        few = n < n_folds
        return np.where(few, -999.0, r2), np.where(few, 0.0, c), np.where(few, 999.0, np.sqrt(res / safe)), n


def evaluate(grams: list[np.ndarray], xys: list[np.ndarray], yys: list[np.ndarray], groups: list[list[int]], alpha: float, n_folds: int, curves: bool) -> list[tuple]:
    """The metrics of each group of columns, from the sums of each fold.

    A group is one column, or the frames of a curve: then also the mean over
    frames, and the fit of the first component, whose axis is fitted on the
    training folds.  Folds that leave nothing to train on are not predicted.
    """
    pooled = _Pooled(xys[0].shape[1])
    first = _Pooled(len(groups))
    total = sum(grams), sum(xys), sum(yys)
    for gram, xy, yy in zip(grams, xys, yys):
        train, train_xy, train_yy = total[0] - gram, total[1] - xy, total[2] - yy
        n = train[0, 0]
        if n < 0.5 or gram[0, 0] < 0.5:
            continue
        pooled.add(gram, xy, np.diag(yy), *solve_ridge(train, train_xy, alpha))
        if curves:
            axes, offsets, squares = np.zeros((xy.shape[1], len(groups))), np.zeros(len(groups)), np.zeros(len(groups))
            for g, at in enumerate(groups):
                mean = train_xy[0, at] / n
                top = np.linalg.eigh(train_yy[np.ix_(at, at)] / n - np.outer(mean, mean))[1][:, -1]
                axes[at, g] = top * (1 if top[np.argmax(np.abs(top))] >= 0 else -1)
                offsets[g] = axes[at, g] @ mean
                squares[g] = axes[at, g] @ yy[np.ix_(at, at)] @ axes[at, g]
            own, own_train = xy @ axes - np.outer(gram[:, 0], offsets), train_xy @ axes - np.outer(train[:, 0], offsets)
            squares += -2 * offsets * (xy[0] @ axes) + gram[0, 0] * offsets**2
            first.add(gram, own, squares, *solve_ridge(train, own_train, alpha))
    r2, corr, rmse, n = pooled.metrics(n_folds)
    if not curves:
        return [(float(r2[at[0]]), float(corr[at[0]]), float(rmse[at[0]]), int(round(n[at[0]])), None, None, None) for at in groups]
    pc1 = first.metrics(n_folds)[0]
    return [(None, None, None, int(round(n[at].max())), float(r2[at].mean()), float(np.sqrt((rmse[at] ** 2).mean())), float(pc1[g])) for g, at in enumerate(groups)]


def _columns(widths: list[int]) -> list[list[int]]:
    edge = np.cumsum([0, *widths]).tolist()
    return [list(range(lo, hi)) for lo, hi in zip(edge, edge[1:])]


def layer_metrics(sums: DataFrame, widths: dict[str, list[int]], alpha: float, n_folds: int, curves: bool = False) -> DataFrame:
    """(model, layer, t, metrics) of every target t of every layer; ``widths`` has the columns of each model's targets.

    Targets without gaps share their matrices and one factorisation; a target
    with gaps is a group of its own, which gets the layer's matrices and its own.
    """
    gaps = sums.where("gap >= 0").groupBy("model").agg(F.collect_set("gap").alias("with_gaps"))  # as many as targets
    base = sums.where("gap < 0").join(F.broadcast(gaps), "model", "left")
    base = base.select("model", "a", "fold", "gap", "i", "row", F.coalesce("with_gaps", F.array().cast("array<int>")).alias("with_gaps"))
    base = base.withColumn("own", F.explode(F.concat(F.array(F.lit(-1)), "with_gaps")))
    gap = sums.where("gap >= 0").select("model", "a", "fold", "gap", "i", "row", F.array().cast("array<int>").alias("with_gaps"), F.col("gap").alias("own"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        model, layer, own = pdf.model.iloc[0], int(pdf.a.iloc[0]), int(pdf.own.iloc[0])
        full = {(int(f), int(g)): np.stack(x.sort_values("i").row.to_list()) for (f, g), x in pdf.groupby(["fold", "gap"])}
        columns = _columns(widths[model])
        lacking = set(next(r for g, r in zip(pdf.gap, pdf.with_gaps) if g < 0))
        targets = [own] if own >= 0 else [t for t in range(len(columns)) if t not in lacking]
        if not targets:
            return pd.DataFrame([], columns=["model", "layer", "t", *_METRICS])
        at = [c for t in targets for c in columns[t]]
        grams, xys, yys = [], [], []
        for f in sorted({f for f, g in full if g < 0}):
            m = full[f, -1]
            d = len(m) - sum(widths[model])
            grams.append(m[:d, :d] - full.get((f, own), 0) if own >= 0 else m[:d, :d])
            xys.append(m[:d][:, [d + c for c in at]])
            yys.append(m[np.ix_([d + c for c in at], [d + c for c in at])])
        found = evaluate(grams, xys, yys, _columns([len(columns[t]) for t in targets]), alpha, n_folds, curves)
        return pd.DataFrame([(model, layer, t, *r) for t, r in zip(targets, found)], columns=["model", "layer", "t", *_METRICS])

    return base.unionByName(gap).groupBy("model", "a", "own").applyInPandas(solve, f"model string, layer int, t int, {METRICS}").where("n_valid > 0")


def mix_metrics(sums: DataFrame, mixes: DataFrame, widths: dict[str, list[int]], n_layers: int, alpha: float, n_folds: int, curves: bool = False) -> DataFrame:
    """(model, t, candidate, metrics) of every mix (model, t, candidate, weights) of layers 0 to ``n_layers`` - 1, from the blocks of all pairs of layers.

    A task has the matrices of at most ``CHUNK`` candidates of a target, and
    streams the blocks of all pairs of layers past them.
    """
    chunks = mixes.groupBy("model", "t", F.expr(f"candidate div {CHUNK}").cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("candidate", "weights"))).alias("mix"))
    wanted = chunks.select("model", "t", "chunk", "mix")
    # All blocks go to each chunk of their model, those of gaps to the chunks of their target.
    met = sums.join(F.broadcast(wanted), "model").where((F.col("gap") < 0) | (F.col("gap") == F.col("t")))
    dealt = met.repartition("model", "t", "chunk").sortWithinPartitions("model", "t", "chunk", "fold", "gap", "a", "b", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if current is None:
                return
            model, t, _ = current
            names, folds = state["names"], sorted(state["gram"])
            width = _columns([widths[model][t]])
            out = [(model, t, c, *evaluate([state["gram"][f][k] for f in folds], [state["xy"][f][k] for f in folds], [state["yy"][f] for f in folds], width, alpha, n_folds, curves)[0]) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_pylist([dict(zip(("model", "t", "candidate", *_METRICS), r)) for r in out], schema=schema)

        schema = pa.schema([("model", pa.string()), ("t", pa.int32()), ("candidate", pa.int32()), *((m, pa.int64() if m == "n_valid" else pa.float64()) for m in _METRICS)])
        for b in batches:
            keys = pd.DataFrame({c: b.column(c).to_pandas() for c in ("model", "t", "chunk", "fold", "gap", "a", "b")})
            edge = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(keys)]):
                model, t, chunk, fold, gap, p, q = keys.iloc[lo]
                if (model, t, chunk) != current:
                    yield from done()
                    mix = b.column("mix")[lo].as_py()
                    current, state = (model, t, chunk), {"names": [m["candidate"] for m in mix], "w": np.array([m["weights"] for m in mix]), "gram": {}, "xy": {}, "yy": {}}
                at = b.column("i").slice(lo, hi - lo).to_numpy()
                rows = b.column("row").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                w, sign = state["w"], -1.0 if gap >= 0 else 1.0
                y_at = _columns(widths[model])[t]
                d = rows.shape[1] + 1 if p != q else rows.shape[1] - (sum(widths[model]) if gap < 0 else 0)
                if fold not in state["gram"]:
                    state["gram"][fold], state["xy"][fold], state["yy"][fold] = np.zeros((len(w), d, d)), np.zeros((len(w), d, len(y_at))), np.zeros((len(y_at), len(y_at)))
                gram, xy = state["gram"][fold], state["xy"][fold]
                if p != q:
                    add = (w[:, p] * w[:, q])[:, None, None] * rows
                    gram[:, at + 1, 1:] += sign * add
                    gram[:, 1:, at + 1] += sign * add.transpose(0, 2, 1)
                    continue
                head, inner = at == 0, (at > 0) & (at < d)
                gram[:, at[inner], 1:] += sign * (w[:, p] ** 2)[:, None, None] * rows[inner][None, :, 1:d]
                if head.any():  # sums of the vector, which are linear in the weights, and the count
                    x = sign * w[:, p][:, None] * rows[head][0, 1:d]
                    gram[:, 0, 1:] += x
                    gram[:, 1:, 0] += x
                    if p == 0:
                        gram[:, 0, 0] += sign * rows[head][0, 0]
                if gap < 0:
                    own = [d + c for c in y_at]
                    xy[:, at[inner]] += w[:, p][:, None, None] * rows[inner][:, own]
                    if p == 0:
                        if head.any():
                            xy[:, 0] += rows[head][0, own]
                        for k, c in enumerate(own):
                            if (at == c).any():
                                state["yy"][fold][k] += rows[at == c][0, own]
        yield from done()

    return dealt.select("model", "t", "chunk", "fold", "gap", "a", "b", "i", "row", "mix").mapInArrow(run, f"model string, t int, candidate int, {METRICS}").where("n_valid > 0")


def gaps_of(ys: Column, starts: list[int]) -> Column:
    """The places of the targets, by their first columns, that an array of columns lacks."""
    return F.filter(F.transform(F.array(*map(F.lit, starts)), lambda s, t: F.when(F.get(ys, s).isNull(), t)), lambda t: t.isNotNull())



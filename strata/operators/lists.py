"""Inverted lists of bounded size, and exact nearest neighbours through them.

Lists come from two levels of centres fitted on a bounded sample: large lists of
the first level get centres of their own in the second.  What still is too large,
such as many equal vectors, is dealt to numbered parts by id, and a query of the
list goes to all its parts.  So no list is one task, however the vectors cluster.

Each list knows its radius, the largest angle of a row to the centre.  No row of a
list is nearer to a query than the angle to the centre less the radius.  A query
probes lists in the order of that bound, in rounds, until its k-th neighbour is
nearer than the bound of every list left: the result is that of comparing all
pairs, and what is compared depends on how the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators.index import LIST_ROWS, SAMPLE, centroids
from strata.operators.search import QUERY_BLOCK, _unit_rows, best_of_all, block_topk
from strata.plans.session import scratch

#: Centres that tasks hold, give or take a factor of two.
MAX_CENTRES = 4096
#: Lists that a query probes in each round; the last round probes all that are left within the bound.
ROUNDS = (2, 8)
#: A query that has more lists than this left after the rounds, or after an earlier round with at least ``WIDE_SHARE`` of all rows,
#: is compared with all rows, in blocks of at most ``WIDE_BLOCK`` rows on both sides, ``WIDE_BLOCKS`` or more where there are
#: rows enough: its vector is then sent once for each block of rows, not once for each list.
WIDE_LISTS, WIDE_SHARE, WIDE_BLOCK, WIDE_BLOCKS = 32, 0.9, 1 << 16, 8
#: Rows that meet all centres at once.
_ROWS = 128
_SLACK = 2e-9


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _units(vectors: DataFrame, key: str, label: str) -> DataFrame:
    """(key, vec) with unit vectors, stored in parts for all cores however few files they come from; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit_rows(b)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=[key, "vec"])

    rows = vectors.where("vec is not null").select(F.col(key).cast("long").alias(key), F.col("vec").cast("array<double>").alias("vec"))
    return _stored(rows.repartition(key).mapInArrow(run, f"{key} long, vec array<double>"), label)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)


def _split(seed: int):
    """Centres of each first-level list by a k-means of its sample rows; ``own`` says how many."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, k = np.stack(pdf.vec.to_list()), int(pdf.own.iloc[0])
        found = x[np.random.default_rng(seed).permutation(len(x))[:k]]
        for _ in range(10 if len(found) > 1 else 1):
            near = _nearest(x, found)
            found = np.stack([x[near == i].mean(axis=0) if (near == i).any() else found[i] for i in range(len(found))])
        return pd.DataFrame({"centre": found.tolist()})

    return run


def _assigned(centres: np.ndarray):
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, _ROWS) for whole in batches for lo in range(0, whole.num_rows, _ROWS)):
            if b.num_rows:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = (x @ unit.T).argmax(axis=1)
                angle = np.arccos(np.clip((x * unit[near]).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(near.astype(np.int32)), pa.array(angle)], names=["id", "vec", "list_id", "angle"])

    return run


def balanced_lists(vectors: DataFrame, list_rows: int = LIST_ROWS, seed: int = 7, sample: int = SAMPLE, max_centres: int = MAX_CENTRES) -> tuple[DataFrame, DataFrame]:
    """((id, vec, list_id, part), (list_id, centre, radius, n, parts)) of vectors (id, vec), all rows in one part of one list.

    A part has ``list_rows`` rows, give or take what hashing does.  Vectors become
    unit vectors; null ones are left out, and zero ones stay zero.  Lists without
    rows are left out.  More than ``max_centres`` centres are never made: larger
    tables get more parts a list.
    """
    if list_rows <= 0:
        raise ValueError("list_rows must be positive")
    spark = vectors.sparkSession
    flat = _units(vectors, "id", "unit")
    n = flat.count()
    table = "list_id int, centre array<double>, radius double, n long, parts int"
    if not n:
        return spark.createDataFrame([], "id long, vec array<double>, list_id int, part int"), spark.createDataFrame([], table)
    wanted = min(max_centres, -(-n // list_rows))
    first = max(2, round(wanted**0.5))  # k-means takes no fewer
    tops = np.array(centroids(flat, first, seed, sample))
    share = min(1.0, sample / n)
    part = flat.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).mapInArrow(_assigned(tops), "id long, vec array<double>, list_id int, angle double")
    sizes = part.groupBy("list_id").count()  # one row for each first-level centre
    total = sizes.agg(F.sum("count")).first()[0] or 1
    own = sizes.select("list_id", F.greatest(F.lit(1), F.least(F.ceil(F.col("count") * wanted / total), F.col("count"))).cast("int").alias("own"))
    fine = part.join(F.broadcast(own), "list_id").groupBy("list_id").applyInPandas(_split(seed), "centre array<double>")
    centres = np.array([r.centre for r in fine.collect()])  # at most twice max_centres
    lists = _stored(flat.mapInArrow(_assigned(centres), "id long, vec array<double>, list_id int, angle double"), "lists")
    stats = lists.groupBy("list_id").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    stats = stats.withColumn("parts", F.ceil(F.col("n") / list_rows).cast("int"))
    middle = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "list_id int, centre array<double>")
    unit = F.transform("centre", lambda x: x / F.greatest(V.norm(F.col("centre")), F.lit(1e-12)))
    known = middle.join(stats, "list_id").select("list_id", unit.alias("centre"), "radius", "n", "parts")
    dealt = lists.join(F.broadcast(stats.select("list_id", "parts")), "list_id").select("id", "vec", "list_id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    return _stored(dealt, "parts"), _stored(known, "centres")


def _first(bound: np.ndarray, n: int) -> np.ndarray:
    """The columns of each row's first n places by bound, ties by column; a few places without sorting the rest."""
    if n > 32:
        return np.argsort(-bound, axis=1, kind="stable")[:, :n]
    left, at, out = bound.copy(), np.arange(len(bound)), np.empty((len(bound), n), dtype=np.int64)
    for i in range(n):
        out[:, i] = left.argmax(axis=1)
        left[at, out[:, i]] = -np.inf
    return out


def _probes(centres: np.ndarray, radius: np.ndarray, names: np.ndarray, parts: np.ndarray, rows: np.ndarray, step: int | None, count: bool = False):
    """Queries (query_id, q, reach, done) with the lists of their next ``step`` places (all, if None) that may hold a row of similarity ``reach``; with ``count`` the queries with the number of these lists and of their rows."""
    wide = np.minimum(radius, np.pi)
    cos, sin = np.cos(wide), np.sin(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, _ROWS) for whole in batches for lo in range(0, whole.num_rows, _ROWS)):
            q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = q @ centres.T
            np.clip(s, -1, 1, out=s)
            bound = np.square(s)
            np.sqrt(np.subtract(1, bound, out=bound), out=bound)
            bound *= sin
            bound += s * cos
            bound[s >= cos] = 1.0  # the cosine of the angle to the centre less the radius
            bound[np.linalg.norm(q, axis=1) == 0] = 0.0  # all similarities of a zero vector are 0
            done, reach = b.column("done").to_numpy(), b.column("reach").to_numpy()
            last = min(int(done.max()) + (step or 0), len(names))
            first = _first(bound, last)
            near = (np.take_along_axis(bound, first, axis=1) >= reach[:, None] - _SLACK) & (np.arange(last) >= done[:, None])
            if step is None:
                chosen = bound >= reach[:, None] - _SLACK
                np.put_along_axis(chosen, first, near, axis=1)
                if count:
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chosen.sum(axis=1).astype(np.int32)), pa.array((chosen @ rows.astype(np.float64)).astype(np.int64))], names=[*b.schema.names, "lists", "rows"])
                    continue
                row, found = np.nonzero(chosen)
            else:
                row, place = np.nonzero(near & (np.arange(last) < done[:, None] + step))
                found = first[row, place]
            yield pa.RecordBatch.from_arrays(
                [b.column("query_id").take(pa.array(row)), b.column("q").take(pa.array(row)), pa.array(names[found]), pa.array(parts[found]), pa.array(rows[found])], names=["query_id", "q", "list_id", "parts", "n"]
            )

    return run


def similar_through_lists(lists: DataFrame, centres: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True, rounds: tuple[int, ...] = ROUNDS, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, similarity, rank), (round, pairs)): the k rows most like each query (query_id, vec), exactly, and what was compared.

    Ties of the similarity to nine places go to the smaller id.  With
    ``exclude_self`` a row is no neighbour of the query of its id.  Fewer than k
    rows give fewer neighbours.  Query ids must be unique; null vectors have no
    neighbours.  The queries of a list meet each of its parts in blocks, so a
    task holds a block of queries and streams a part.  Queries that no bound keeps
    from most lists meet all rows in larger blocks.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    table = centres.orderBy("list_id").collect()  # at most twice MAX_CENTRES rows
    spark = queries.sparkSession
    if not table:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int"), spark.createDataFrame([], "round int, pairs long")
    known = (np.array([r.centre for r in table]), np.array([r.radius for r in table]) + 1e-7, *(np.array([r[c] for r in table], dtype=t) for c, t in (("list_id", np.int32), ("parts", np.int32), ("n", np.int64))))
    unit = _units(queries, "query_id", "queries").select("query_id", F.col("vec").alias("q"))
    open_, wide = unit.withColumns({"reach": F.lit(-2.0), "done": F.lit(0)}), []
    best = spark.createDataFrame([], "query_id long, id long, similarity double, place double")
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "id")
    counts, total = [], int(known[4].sum())
    for number, step in enumerate((*rounds, None)):
        if number or step is None:
            left_over = _stored(open_.mapInArrow(_probes(*known, None, count=True), "query_id long, q array<double>, reach double, done int, lists int, rows long"), "queries")
            many = F.col("lists") > WIDE_LISTS
            if step is not None:
                many &= F.col("rows") >= WIDE_SHARE * total
            n_wide, n = left_over.agg(F.count_if(many), F.count("*")).first()
            if n_wide:
                wide.append((n_wide, left_over.where(many).select(F.col("query_id").alias("id"), F.col("q").alias("vec"), "reach")))
            open_ = left_over.where(~many).drop("lists", "rows")
            if n == n_wide:
                break
        probes = _stored(open_.mapInArrow(_probes(*known, step), "query_id long, q array<double>, list_id int, parts int, n long"), "probes")
        counts.append(probes.agg(F.lit(number).alias("round"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")))
        # The queries of a list are dealt to blocks; each block meets each part of the list.
        asked_of = probes.groupBy("list_id").agg(F.ceil(F.count("*") / query_block).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
        left = lambda list_col, block_col: (F.col(list_col).cast("long") * (1 << 31) + block_col).alias("left")
        asked = probes.join(F.broadcast(asked_of), "list_id").select(left("list_id", block), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("right"), F.lit(0).alias("corpus"), F.col("query_id").alias("id"), F.col("q").alias("vec"))
        rows = lists.join(F.broadcast(asked_of), "list_id").select("list_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("part").alias("right"), F.lit(1).alias("corpus"), "id", "vec")
        rows = rows.select(left("list_id", F.col("b")), "right", "corpus", "id", "vec")
        met = asked.unionByName(rows).repartition("left", "right").sortWithinPartitions("left", "right", "corpus")
        found = met.mapInArrow(block_topk(k, exclude_self), "query_id long, id long, similarity double, place double")
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = _stored(ranked, "best").drop("rank")
        if step is not None:
            reach = best.groupBy("query_id").agg(F.min("place").alias("last"), F.count("*").alias("have"))
            reach = reach.select("query_id", F.when(F.col("have") == k, F.col("last")).alias("found"))
            open_ = _stored(open_.join(reach, "query_id", "left").select("query_id", "q", F.coalesce("found", F.lit(-2.0)).alias("reach"), (F.col("done") + step).alias("done")), "queries")
    if wide:
        asked, n_wide = reduce(DataFrame.unionByName, [df for _, df in wide]), sum(n for n, _ in wide)
        counts.append(spark.range(1).select(F.lit(len(rounds)).alias("round"), F.lit(n_wide * total).cast("long").alias("pairs")))
        block = lambda n: -(-n // max(-(-n // WIDE_BLOCK), min(WIDE_BLOCKS, -(-n // QUERY_BLOCK))))
        every = best_of_all(lists.select("id", "vec"), asked, k, exclude_self, block(n_wide), block(total))
        rest = best.join(asked.select(F.col("id").alias("query_id")), "query_id", "left_anti")
        best = _stored(rest.unionByName(every).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
    ranked = best.withColumn("rank", F.row_number().over(order)).drop("place")
    if not counts:
        return ranked, spark.createDataFrame([], "round int, pairs long")
    return ranked, reduce(DataFrame.unionByName, counts)

"""Vector indexes as Parquet folders: flat, inverted lists and product codes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators.search import QUERY_BLOCK, _unit_rows, block_topk
from strata.plans.session import scratch

SAMPLE = 100_000
#: Rows of a list that one task takes; larger lists are in numbered parts.
LIST_ROWS = 20_000


def flat_index(vectors: DataFrame) -> DataFrame:
    """(id, vec) with unit vectors; null vectors are left out."""
    return vectors.where("vec is not null").withColumn("vec", V.l2_normalise(F.col("vec")))


def centroids(vectors: DataFrame, n: int, seed: int, sample: int) -> list[list[float]]:
    """Centres of a k-means over the ``sample`` rows of the smallest checksums; n rows of numbers."""
    part = vectors.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(sample).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=15, distanceMeasure="euclidean").fit(part)
    return [c.tolist() for c in model.clusterCenters()]


def _assign(centres: np.ndarray, spill: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argsort(axis=1, kind="stable")[:, :spill]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "vec", "list_ids"])

    return run


def ivf_index(vectors: DataFrame, nlist: int, seed: int = 7, sample: int = SAMPLE, spill: int = 1, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """((id, vec, list_id, part), (list_id, centre, parts)); centres are fitted on a bounded sample, every row is in a list.

    With ``spill`` over 1 a row is in that many lists, the nearest ones, and
    has all of them in ``list_ids``.  A list of more than ``list_rows`` rows is in
    several parts, by id, so that a cluster with most of the rows is many tasks.
    """
    if nlist <= 0 or not 0 < spill <= nlist:
        raise ValueError("nlist must be positive, and spill from 1 to nlist")
    flat = flat_index(vectors).select(F.col("id").cast("long").alias("id"), "vec")
    centres = centroids(flat, nlist, seed, sample)
    lists = flat.mapInArrow(_assign(np.array(centres), spill), "id long, vec array<double>, list_ids array<int>")
    lists = lists.select("id", "vec", F.explode("list_ids").alias("list_id"), "list_ids") if spill > 1 else lists.select("id", "vec", F.get("list_ids", 0).alias("list_id"))
    sizes = {r.list_id: r["count"] for r in lists.groupBy("list_id").count().collect()}  # nlist rows
    table = vectors.sparkSession.createDataFrame([(i, c, max(1, -(-sizes.get(i, 0) // list_rows))) for i, c in enumerate(centres)], "list_id int, centre array<double>, parts int")
    parts = F.broadcast(table.select("list_id", "parts"))
    return lists.join(parts, "list_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "vec", "list_id", *(["list_ids"] if spill > 1 else []), "part"), table


def _probe(centres: np.ndarray, names: np.ndarray, parts: np.ndarray, nprobe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = (-2 * q @ centres.T + (centres**2).sum(axis=1)).argsort(axis=1, kind="stable")[:, :nprobe]
                lists, counts = (pa.array(x[near].astype(np.int32).tolist(), pa.list_(pa.int32())) for x in (names, parts))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("q"), lists, counts], names=["query_id", "q", "probed", "parts"])

    return run


def _best_of_lists(lists: DataFrame, centres: DataFrame, queries: DataFrame, k: int, nprobe: int, vectors: Callable[[pa.RecordBatch], np.ndarray] = _unit_rows) -> DataFrame:
    """(query_id, id, similarity, place): the k best rows of each part of the ``nprobe`` lists nearest to each query (query_id, vec); each row once per query.

    The queries of a list are dealt to blocks, and each block meets each part in
    one task as one product of matrices.  ``vectors`` makes the rows' vectors.
    """
    table = centres.orderBy("list_id").collect()  # nlist rows, a parameter of the index
    unit = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), V.l2_normalise(F.col("vec")).alias("q"))
    found = _probe(np.array([r.centre for r in table]), np.array([r.list_id for r in table]), np.array([r.parts for r in table]), nprobe)
    probed = unit.mapInArrow(found, "query_id long, q array<double>, probed array<int>, parts array<int>")
    each = probed.select("query_id", "q", "probed", F.explode(F.arrays_zip("probed", "parts")).alias("p"))
    each = each.select("query_id", "q", "probed", F.col("p.probed").alias("list_id"), F.col("p.parts").alias("parts"))
    asked_of = F.broadcast(each.groupBy("list_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")))  # nlist rows
    left = lambda block: (F.col("list_id").cast("long") * (1 << 31) + block).alias("left")
    spill, more = "list_ids" in lists.columns, [c for c in lists.columns if c not in ("id", "list_id", "list_ids", "part", "vec")]
    none = lambda c: F.lit(None).cast(lists.schema[c].dataType if c in lists.columns else "array<double>").alias(c)
    asked = each.join(asked_of, "list_id").select(
        left(F.pmod(F.xxhash64("query_id"), F.col("blocks"))), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("right"), F.lit(0).alias("corpus"), F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("vec"), "list_id",
        *([F.col("probed"), none("list_ids")] if spill else []), *[none(c) for c in more],
    )
    vec = F.col("vec").cast("array<double>").alias("vec") if "vec" in lists.columns else none("vec")
    rows = lists.join(asked_of, "list_id").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = rows.select(left(F.col("block")), F.col("part").alias("right"), F.lit(1).alias("corpus"), "id", vec, "list_id", *([F.lit(None).cast("array<int>").alias("probed"), "list_ids"] if spill else []), *more)
    met = asked.unionByName(rows).repartition("left", "right").sortWithinPartitions("left", "right", "corpus")
    return met.mapInArrow(block_topk(k, False, vectors, len(table) if spill else 0), "query_id long, id long, similarity double, place double")


def write_lists(lists: DataFrame, centres: DataFrame, path: str, nprobe: int) -> None:
    """Save inverted lists in a folder per list, with the centres and the number of lists that a search probes by default."""
    if nprobe <= 0:
        raise ValueError("nprobe must be positive")
    lists.repartition("list_id", "part").write.partitionBy("list_id").parquet(f"{path}/lists")
    centres.withColumn("nprobe", F.lit(nprobe)).coalesce(1).write.parquet(f"{path}/centres")


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(lists, centres, default nprobe); a search reads the folders of its probed lists only."""
    centres = spark.read.parquet(f"{path}/centres")
    return spark.read.parquet(f"{path}/lists"), centres.drop("nprobe"), centres.first().nprobe


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return scored.select("query_id", "id", "similarity", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def probe_ivf(lists: DataFrame, centres: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(query_id, id, similarity, rank) from the ``nprobe`` lists nearest to each query (query_id, vec)."""
    if nprobe <= 0 or k <= 0:
        raise ValueError("k and nprobe must be positive")
    return _best(_best_of_lists(lists, centres, queries, k, nprobe), k)


def parse_factory(text: str) -> tuple[int, int, int]:
    """(lists, subspaces, bits) of ``IVFn,PQmxb``."""
    m = re.fullmatch(r"IVF(\d+),PQ(\d+)x(\d+)", text)
    if not m:
        raise ValueError(f"not supported: {text}; use IVFn,PQmxb")
    return int(m[1]), int(m[2]), int(m[3])


def _residuals(centres: np.ndarray):
    """Vectors less the centre of their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - centres[b.column("list_id").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())) if c == "vec" else b.column(c) for c in b.schema.names], names=b.schema.names)

    return run


def _centre_table(centres: DataFrame) -> np.ndarray:
    """The centres by their number; nlist rows, a parameter of the index."""
    rows = centres.select("list_id", "centre").orderBy("list_id").collect()
    return np.array([r.centre for r in rows])


def pq_index(vectors: DataFrame, factory: str, seed: int = 7, sample: int = SAMPLE, spill: int = 1) -> tuple[DataFrame, DataFrame, list[list[list[float]]]]:
    """((id, list_id, part, codes), centres, codebooks) of product-quantised unit vectors; ``list_ids`` as in :func:`ivf_index`.

    Codes stand for what is left of a vector after its list's centre, which is
    shorter than the vector, so the same codes come nearer to it.  A row in several
    lists has codes for each.
    """
    nlist, m, bits = parse_factory(factory)
    lists, centres = ivf_index(vectors, nlist, seed, sample, spill)
    kept = [c for c in lists.columns if c != "vec"]
    dim = len(centres.first().centre)
    if dim % m:
        raise ValueError("the dimension must be a multiple of the number of subspaces")
    width = dim // m
    table = _centre_table(centres)
    left = lists.mapInArrow(_residuals(table), lists.schema)
    # All subspaces take the same rows of the sample, which is written once.
    path = scratch(vectors.sparkSession, "sample")
    keyed = left.select(F.xxhash64("id", "list_id").alias("id"), "vec")
    keyed.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(sample).write.parquet(path)
    part = vectors.sparkSession.read.schema(keyed.schema).parquet(path)
    books = [centroids(part.select("id", F.slice("vec", s * width + 1, width).alias("vec")), 1 << bits, seed + s, sample) for s in range(m)]
    fitted = [np.array(x) for x in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m, width)
                codes = np.stack([((x[:, s, None, :] - fitted[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(m)], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*kept, "codes"])

    return left.mapInArrow(encode, f"id long, list_id int, {'list_ids array<int>, ' if spill > 1 else ''}part int, codes array<int>"), centres, books


def _by_codes(codes: DataFrame, centres: DataFrame, books: list[list[list[float]]], queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(query_id, id, similarity) with the k best rows of each part of the probed lists: products with the vectors that the codes stand for, the centre and the entry of each code."""
    fitted, table = np.array(books), _centre_table(centres)
    m = len(fitted)

    def decoded(b: pa.RecordBatch) -> np.ndarray:
        c = b.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m)
        return table[b.column("list_id").to_numpy()] + fitted[np.arange(m), c].reshape(b.num_rows, -1)

    return _best_of_lists(codes, centres, queries, k, nprobe, decoded)


def search_pq(codes: DataFrame, centres: DataFrame, books: list[list[list[float]]], query: list[float], k: int, nprobe: int) -> DataFrame:
    """(id, similarity) of one query by codes only, from the ``nprobe`` lists nearest to it."""
    if nprobe <= 0 or k <= 0:
        raise ValueError("k and nprobe must be positive")
    one = codes.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, vec array<double>")
    return _by_codes(codes, centres, books, one, k, nprobe).select("id", "similarity").orderBy(F.col("similarity").desc(), "id").limit(k)


def probe_pq(codes: DataFrame, centres: DataFrame, books: list[list[list[float]]], vectors: DataFrame, queries: DataFrame, k: int, nprobe: int, candidates: int) -> DataFrame:
    """(query_id, id, similarity, rank) of each query (query_id, vec) from ``nprobe`` lists.

    The ``candidates`` rows that are best by their codes are compared exactly
    with the vectors (id, vec).
    """
    if nprobe <= 0 or k <= 0 or candidates < k:
        raise ValueError("k and nprobe must be positive, and candidates at least k")
    near = _best(_by_codes(codes, centres, books, queries, candidates, nprobe), candidates).select("query_id", "id")
    exact = near.join(flat_index(vectors).select(F.col("id").cast("long").alias("id"), "vec"), "id").join(queries.select("query_id", V.l2_normalise(F.col("vec")).alias("q")), "query_id")
    return _best(exact.select("query_id", "id", V.dot(F.col("vec"), F.col("q")).alias("similarity")), k)


def manifest_rollup(index: DataFrame) -> DataFrame:
    """ntotal, dimension and the dataset id if there is exactly one."""
    return index.agg(F.count("*").alias("ntotal"), F.max(F.size("vec")).alias("dimension"), F.when(F.countDistinct("dataset_id") == 1, F.max("dataset_id")).alias("dataset_id"))

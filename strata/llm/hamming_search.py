"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are split into ``m`` segments, with an index on each.  Round
r probes, for every open query and segment, the values at a distance of exactly
r from the query's.  A code that no probe has met by then differs in at least
r + 1 bits in every segment, so its distance is at least m * (r + 1).  A query
closes once the distance of its k-th verified neighbour is below that; the
bound then covers every code that was not met.

Equal codes are one entry of the index with their ``k`` smallest ids, which is
all that an answer can use, since ties go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.shared import stored, table

BITS = 64
K = 10
#: Bits of the widest segment that is chosen by itself.
WIDTH = 16


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """A long with bit i set where entry i of the vector is positive; null for a null vector."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.coalesce(F.get(vector, i), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def segment_count(codes: int, bits: int = BITS) -> int:
    """Segments of about log2(codes) bits, but at most 16, as many as divide the code evenly.

    A segment of 32 bits has up to 6e8 values at one distance, and each probe is
    a row to shuffle; one of 16 has 12870 at most.
    """
    wish = bits / max(1.0, math.log2(max(2, codes)))
    fitting = [m for m in (2, 4, 8, 16) if bits % m == 0]
    return min([m for m in fitting if bits // m <= WIDTH] or fitting[-1:], key=lambda m: abs(math.log(m / wish)))


def _segments(code: Column, m: int, bits: int) -> Column:
    width = bits // m
    mask = F.lit((1 << width) - 1).cast("long")
    return F.array(*[F.struct(F.lit(s).alias("segment"), F.call_function("shiftrightunsigned", code, F.lit(s * width)).bitwiseAND(mask).alias("value")) for s in range(m)])


def _flipped(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """Each row with every mask of ``radius`` bits as ``flip``; the bits are chosen in rising order, one after the other."""
    own = rows.columns
    out = rows.select("*", F.lit(0).cast("long").alias("flip"), F.lit(0).alias("from"))
    for left in range(radius, 0, -1):
        chosen = out.select(*own, "flip", F.explode(F.sequence(F.col("from"), F.lit(width - left))).alias("bit"))
        out = chosen.select(*own, F.col("flip").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("flip"), (F.col("bit") + 1).alias("from"))
    return out.drop("from")


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, segments: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest codes of each query.

    ``codes`` has (id, code), ``queries`` (query_id, code).  A code is no
    neighbour of the query of its own id.  Ties go to the smaller id; null ids
    and codes take no part; repeated (id, code) rows count once.  Queries get
    fewer than k rows only if there are fewer codes.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = codes.sparkSession
    least = Window.partitionBy("code").orderBy("id")
    ranked = codes.select(F.col("id").try_cast("long").alias("id"), F.col("code").try_cast("long").alias("code")).where("id is not null and code is not null").distinct()
    # One id more than k, as a query's own id is no answer.
    index = stored(ranked.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n = index.count()
    m = segments or segment_count(n, bits)
    width = bits // m
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by_segment = stored(index.select("code", F.explode(_segments(F.col("code"), m, bits)).alias("s")).select("s.segment", "s.value", "code"), "segments")
    open_ = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("code").cast("long").alias("query_code")).where("query_id is not null and query_code is not null").distinct(), "queries")
    best = spark.createDataFrame([], "query_id long, query_code long, id long, distance int")
    closed = best
    order = Window.partitionBy("query_id", "query_code").orderBy("distance", "id")
    for radius in range(width + 1):
        # Few queries fill one file only, so they are dealt out before their probes are made.
        probes = _flipped(open_.select("query_id", "query_code").repartition(parts, "query_id", "query_code"), width, radius)
        probes = probes.select("query_id", "query_code", "flip", F.explode(_segments(F.col("query_code"), m, bits)).alias("s"))
        probes = probes.select("query_id", "query_code", F.col("s.segment").alias("segment"), F.col("s.value").bitwiseXOR(F.col("flip")).alias("value"))
        # Probes are many more than Spark's estimate from the few queries says, so they are not broadcast.
        met = probes.hint("merge").join(by_segment, ["segment", "value"])
        # A code is verified under the first segment that meets it, so it comes once per query over all rounds.
        x = F.col("code").bitwiseXOR(F.col("query_code"))
        near = [F.bit_count(F.call_function("shiftrightunsigned", x, F.lit(s * width)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))) for s in range(m)]
        first = F.lit(m)
        for s in reversed(range(m)):
            first = F.when(near[s] == radius, s).otherwise(first)
        met = met.where((F.least(*near) == radius) & (first == F.col("segment")))
        found = met.select("query_id", "query_code", "code", F.bit_count(x).cast("int").alias("distance"))
        ahead = found.withColumn("place", F.rank().over(Window.partitionBy("query_id", "query_code").orderBy("distance"))).where(F.col("place") <= k + 1).drop("place")
        ids = ahead.join(index, "code").select("query_id", "query_code", F.explode("ids").alias("id"), "distance").where("id <> query_id")
        best = stored(best.unionByName(ids).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
        bound = m * (radius + 1)
        done = best.groupBy("query_id", "query_code").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") >= k) & (F.col("far") < bound))
        closed = closed.unionByName(best.join(done.select("query_id", "query_code"), ["query_id", "query_code"]))
        open_ = stored(open_.join(done, ["query_id", "query_code"], "left_anti"), "queries")
        best = best.join(open_, ["query_id", "query_code"], "left_semi")
        if open_.isEmpty():
            break
    out = closed.unionByName(best)
    return out.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", F.col("id").alias("neighbor_id"), "distance")


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "code")
    return hamming_topk(vectors.select(F.col("vec_id").alias("id"), "code"), queries)


QUERIES = {"op6_hamming_topk": op6_hamming_topk}
ORACLES = {
    "op6_hamming_topk": """
with c as (select vec_id, list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then 1 else 0 end) as b from embeddings),
p as (select q.vec_id as query_id, c.vec_id as neighbor_id, list_sum(list_transform(range(1, 65), lambda i: case when q.b[i] <> c.b[i] then 1 else 0 end))::int as distance
      from c q join c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, neighbor_id, distance
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from p) where rank <= 10
"""
}

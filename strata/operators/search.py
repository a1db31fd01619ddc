"""Top-k cosine search over tracks, clips and aspects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.plans.session import scratch

#: Queries that a task holds, rows of the corpus that they meet in it, rows that are scored at once, and queries that meet these in single precision at once.
QUERY_BLOCK, CORPUS_BLOCK, CORPUS_SLICE, SINGLE_BLOCK = 2048, 1 << 16, 1024, 1024
#: Pairs of blocks have a task each, up to so many tasks.
BLOCK_TASKS = 10_000


def _literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def query_vector(corpus: DataFrame, query_id, id_col: str = "id", vec_col: str = "vec") -> list[float]:
    """The vector of one id, which is one row; an unknown id is an error."""
    rows = corpus.where(F.col(id_col) == query_id).select(V.doubles(F.col(vec_col))).limit(1).collect()
    if not rows:
        raise KeyError(f"unknown id {query_id}")
    return rows[0][0]


def similar_to(corpus: DataFrame, vector: list[float], k: int = 10, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, similarity) of the k rows most like a vector; ties go to the smaller id."""
    if k <= 0:
        raise ValueError("k must be positive")
    scored = corpus.select(F.col(id_col).alias("id"), V.cosine(F.col(vec_col), _literal(vector)).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "id").limit(k)


def find_similar(corpus: DataFrame, query_id, k: int = 10, exclude_self: bool = True, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, similarity) of the k rows most like the row of an id."""
    vector = query_vector(corpus, query_id, id_col, vec_col)
    return similar_to(corpus.where(F.col(id_col) != query_id) if exclude_self else corpus, vector, k, id_col, vec_col)


def _unit(lists: pa.Array, n: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None]


def _leading(k: int, own: np.ndarray, scores: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns that may be among a row's best k: of those as good as its k-th the ones with the smallest ids too, without sorting the rest."""
    if scores.shape[1] <= 4 * k:
        return own, scores, raw
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    width = int((scores >= least).sum(axis=1).max())  # k, and more where scores tie
    top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
    return tuple(np.take_along_axis(x, top, axis=1) for x in (own, scores, raw))


def _unit_rows(b: pa.RecordBatch) -> np.ndarray:
    return _unit(b.column("vec"), b.num_rows)


def _hits(above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true entries of a matrix whose width is a multiple of eight, looked for by words of eight."""
    words = above.view(np.uint64)
    row, word = np.divmod(np.flatnonzero(words), words.shape[1])
    at, bit = np.nonzero(above.reshape(*words.shape, 8)[row, word])
    return row[at], word[at] * 8 + bit


class _Best:
    """The k best rows so far of each query of a block: ids, similarities, and these to nine places.

    A ``reach`` is the similarity to nine places of a query's k-th row as known
    elsewhere, -2 for none.  If some queries have none, the first rows are scored
    whole.  After that products of single precision tell which pairs may be among
    the best, with a slack of more than their error, and only these are scored.
    """

    def __init__(self, k: int, exclude_self: bool, q_ids: np.ndarray, q: np.ndarray, reach: np.ndarray | None):
        self.k, self.exclude_self, self.q_ids, self.q, self.seen = k, exclude_self, q_ids, q, 0
        self.single = q.astype(np.float32)
        self.reach = np.full(len(q), -2.0) if reach is None else reach
        self.ids = np.zeros((len(q), k), dtype=np.int64)
        self.place, self.raw = np.full((len(q), k), -np.inf), np.full((len(q), k), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        lo, enough = 0, max(64, 4 * self.k)
        while lo < len(ids):
            # Without a reach the first slices are small, each as large as all before, so that the next ones have few candidates.
            hi = min(lo + (max(enough, self.seen) if self.reach.min() <= -2 else len(ids)), len(ids))
            if self.seen < enough and self.reach.min() <= -2:
                self.whole(ids[lo:hi], x[lo:hi])
            else:
                self._above(ids[lo:hi], x[lo:hi])
            lo, self.seen = hi, self.seen + hi - lo

    def whole(self, ids: np.ndarray, x: np.ndarray, out: np.ndarray | None = None, first: int = 0, last: int | None = None) -> None:
        """All pairs of rows with the queries from ``first`` to ``last``; those of ``out`` don't count."""
        last = len(self.q) if last is None else last
        for lo in range(first, last, QUERY_BLOCK):
            mine = slice(lo, min(lo + QUERY_BLOCK, last))
            raw = self.q[mine] @ x.T
            scores, own = np.round(raw, 9), np.broadcast_to(ids, raw.shape)
            scores[np.isnan(scores)] = -np.inf
            if self.exclude_self:
                scores[own == self.q_ids[mine, None]] = -np.inf
            if out is not None:
                scores[out[mine]] = -np.inf
            own, scores, raw = _leading(self.k, *(np.concatenate(c, axis=1) for c in ((self.ids[mine], own), (self.place[mine], scores), (self.raw[mine], raw))))
            top = np.lexsort((own, -scores), axis=1)[:, : self.k]
            self.ids[mine], self.place[mine], self.raw[mine] = (np.take_along_axis(c, top, axis=1) for c in (own, scores, raw))

    def _above(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, dim = x.shape
        other, most = x.astype(np.float32).T, max(1.0, float(np.linalg.norm(x, axis=1).max(initial=0)))
        slack = (dim + 8) * 2.0**-23 * most + 1e-9  # twice what the sums and the threshold lose by single precision, and what nine places lose
        products, above = np.empty((SINGLE_BLOCK, n), dtype=np.float32), np.zeros((SINGLE_BLOCK, -(-n // 8) * 8), dtype=bool)
        for lo in range(0, len(self.q), SINGLE_BLOCK):
            part = self.single[lo : lo + SINGLE_BLOCK]
            known = np.maximum(self.reach[lo : lo + len(part)], self.place[lo : lo + len(part), -1])
            np.dot(part, other, out=products[: len(part)])
            np.greater_equal(products[: len(part)], (known - slack).astype(np.float32)[:, None], out=above[: len(part), :n])
            if np.count_nonzero(above[: len(part)]) > len(part) * n / 8:  # groups of equal vectors
                self.whole(ids, x, None, lo, lo + len(part))
                continue
            row, col = _hits(above[: len(part)])
            for s in range(0, len(row), 1 << 16):
                self._merge(row[s : s + (1 << 16)] + lo, col[s : s + (1 << 16)], ids, x)

    def _merge(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Score pairs, which come by row, and keep each row's best k."""
        raw, own = np.empty(len(row)), ids[col]
        for s in range(0, len(row), 2048):  # what the cache holds
            np.einsum("ij,ij->i", self.q[row[s : s + 2048]], x[col[s : s + 2048]], out=raw[s : s + 2048])
        place, last = np.round(raw, 9), self.place[row, -1]
        better = (place >= self.reach[row]) & ((place > last) | ((place == last) & (own < self.ids[row, -1])))
        if self.exclude_self:
            better &= own != self.q_ids[row]
        row, own, place, raw = (c[better] for c in (row, own, place, raw))
        if not len(row):
            return
        mine = row[np.flatnonzero(np.diff(row, prepend=-1))]
        rows = np.concatenate((np.repeat(mine, self.k), row))
        own, place, raw = (np.concatenate((kept[mine].ravel(), c)) for kept, c in ((self.ids, own), (self.place, place), (self.raw, raw)))
        order = np.lexsort((own, -place, rows))
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        top = order[(first[:, None] + np.arange(self.k)).ravel()]  # each row has its k so far, and more
        self.ids[mine], self.place[mine], self.raw[mine] = (c[top].reshape(-1, self.k) for c in (own, place, raw))

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(self.place > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[row]), pa.array(self.ids[row, col]), pa.array(self.raw[row, col]), pa.array(self.place[row, col])], names=["query_id", "id", "similarity", "place"])


def block_topk(k: int, exclude_self: bool, vectors: Callable[[pa.RecordBatch], np.ndarray] = _unit_rows, lists: int = 0):
    """Rows come sorted by (left, right, corpus): the queries of a pair of blocks, then its corpus, of which a slice at a time is scored.

    ``vectors`` makes the corpus' vectors.  Queries may have a ``reach``: no row
    less similar to nine places counts.  With a number of ``lists`` a query has
    the lists it probes in ``probed`` and a row of the corpus its lists in
    ``list_ids``; the row counts only in the first of them that the query probes.
    """

    def earlier(b: pa.RecordBatch) -> np.ndarray:
        own = b.column("list_ids").flatten().to_numpy().reshape(b.num_rows, -1)
        out = np.zeros((b.num_rows, lists), dtype=np.float32)
        row, at = np.nonzero(np.cumsum(own == b.column("list_id").to_numpy()[:, None], axis=1) == 0)
        out[row, own[row, at]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, q_ids, q, reach, probed = None, [], [], [], []
        best: _Best | None = None
        for b in batches:
            if not b.num_rows:
                continue
            left, right, kind, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "corpus", "id"))
            edge = np.flatnonzero((left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                if current != (left[lo], right[lo]):
                    if best is not None:
                        yield best.rows()
                    current, q_ids, q, reach, probed, best = (left[lo], right[lo]), [], [], [], [], None
                if not kind[lo]:
                    q_ids.append(ids[lo:hi])
                    q.append(_unit(b.column("vec").slice(lo, hi - lo), hi - lo))
                    if "reach" in b.schema.names:
                        reach.append(b.column("reach").slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                    if lists:
                        probed.append(np.zeros((hi - lo, lists), dtype=np.float32))
                        np.put_along_axis(probed[-1], b.column("probed").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1), 1, axis=1)
                    continue
                if not q:
                    continue
                if best is None:
                    best = _Best(k, exclude_self, np.concatenate(q_ids), np.concatenate(q), np.concatenate(reach) if reach else None)
                    probed = [np.concatenate(probed)] if lists else []
                for s in range(lo, hi, CORPUS_SLICE):
                    rows = b.slice(s, min(CORPUS_SLICE, hi - s))
                    if lists:
                        best.whole(ids[s : s + rows.num_rows], vectors(rows), probed[0] @ earlier(rows).T > 0)
                    else:
                        best.add(ids[s : s + rows.num_rows], vectors(rows))
        if best is not None:
            yield best.rows()

    return run


def similar_to_all(corpus: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = True, id_col: str = "id", vec_col: str = "vec", query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows most like each query; ties of the similarity to nine places go to the smaller id.

    Both sides are cut into blocks by id, and each pair of blocks meets in one
    task, which keeps the best k of each query.  A block of queries is all that
    a task holds; no vector passes through the driver.  Every query is compared
    with every row; for a corpus as its own set of queries
    ``lists.similar_through_lists`` gives the same rows with fewer comparisons.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    side = lambda df: df.select(F.col(id_col).cast("long").alias("id"), V.doubles(F.col(vec_col)).alias("vec"))
    out = best_of_all(side(corpus), side(queries), k, exclude_self, query_block, corpus_block)
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("place")


def best_of_all(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool, query_block: int, corpus_block: int) -> DataFrame:
    """(query_id, id, similarity, place): the k best rows of each block of the corpus (id, vec) for each query (id, vec), of those at its ``reach`` or above if it has one."""
    side = lambda df, n: df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n_left, n_right = -(-queries.count() // query_block) or 1, -(-corpus.count() // corpus_block) or 1
    more = [c for c in queries.columns if c == "reach"]
    asked = side(queries, n_left).select(F.col("own").alias("left"), every(n_right).alias("right"), F.lit(0).alias("corpus"), "id", "vec", *more)
    known = side(corpus, n_right).select(every(n_left).alias("left"), F.col("own").alias("right"), F.lit(1).alias("corpus"), "id", "vec", *[F.lit(None).cast("double").alias(c) for c in more])
    tasks = min(n_left * n_right, BLOCK_TASKS)
    own = F.pmod(F.col("left").cast("long") * n_right + F.col("right"), F.lit(tasks)).cast("int")
    met = asked.unionByName(known).repartitionById(tasks, own).sortWithinPartitions("left", "right", "corpus")
    return met.mapInArrow(block_topk(k, exclude_self), "query_id long, id long, similarity double, place double")


def dedupe_in_time(hits: DataFrame, window: float, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Hits (keys, clip_id, start_sec, similarity) without those that start within ``window`` seconds of a better one of the same track.

    A greedy walk down the ranking; groups are bounded by the over-fetch.
    """
    if window < 0:
        raise ValueError("window must not be negative")
    if window == 0:
        return hits
    ranked = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "clip_id", "start_sec"))).alias("h"))
    kind = "array<struct<s:double,clip_id:string,start_sec:double>>"
    kept = F.aggregate("h", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["start_sec"] - x["start_sec"]) < window), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select(*keys, F.explode(kept).alias("e")).select(*keys, "e.clip_id", "e.start_sec", (-F.col("e.s")).alias("similarity"))


def query_clip(index: DataFrame, clip_id: str | None = None, track_id: str | None = None, start_sec: float | None = None) -> str:
    """The clip that a query names: by its id, or as the clip of a track that starts nearest to a time (ties by clip id)."""
    if clip_id is not None:
        if track_id is not None or start_sec is not None:
            raise ValueError("give either clip_id or track_id and start_sec")
        return clip_id
    if track_id is None or start_sec is None:
        raise ValueError("give either clip_id or both track_id and start_sec")
    if start_sec < 0:
        raise ValueError("start_sec must not be negative")
    row = index.where(F.col("track_id") == track_id).agg(F.min_by("clip_id", F.struct(F.abs(F.col("start_sec") - start_sec), "clip_id"))).first()
    if row[0] is None:
        raise KeyError(f"unknown track {track_id}")
    return row[0]


def search_by_clip(index: DataFrame, clip_id: str | None = None, k: int = 10, dedupe_window: float = 5.0, exclude_same_segment: bool = True, track_id: str | None = None, start_sec: float | None = None, fetch: int | None = None, centres: DataFrame | None = None, nprobe: int | None = None) -> DataFrame:
    """The k clips most like a clip; ``index`` has (clip_id, track_id, start_sec, vec).

    The clip is named by its id, or by a track and a time.  k clips are returned
    whenever there are k that no better one suppresses: pages of the ranking are
    walked one after the other, each without what the clips kept so far suppress,
    so every page keeps a clip at least, and what is held is a page and k clips.
    With ``fetch`` the ranking is cut at that many candidates, and fewer than k
    clips may be left.  If ``index`` has a list_id and ``centres`` (list_id, centre)
    are given, only the ``nprobe`` lists nearest to the clip are read; nprobe
    without lists is an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if nprobe is not None and (centres is None or nprobe <= 0):
        raise ValueError("nprobe must be positive and needs an index with lists")
    name = query_clip(index, clip_id, track_id, start_sec)
    vector = query_vector(index, name, "clip_id")
    rows = index
    if centres is not None:
        nearest = centres.orderBy(V.dot(F.col("centre"), F.col("centre")) - 2 * V.dot(F.col("centre"), V.l2_normalise(_literal(vector))), "list_id").limit(nprobe or 1)
        rows = index.where(F.col("list_id").isin([r.list_id for r in nearest.collect()])).dropDuplicates(["clip_id"])  # nprobe numbers
    scored = rows.select("clip_id", "track_id", "start_sec", V.cosine(F.col("vec"), _literal(vector)).alias("similarity"))
    if exclude_same_segment and fetch is None:
        scored = scored.where(F.col("clip_id") != name)
    if fetch is not None:
        top = scored.orderBy(F.col("similarity").desc(), "clip_id").limit(fetch)
        if exclude_same_segment:
            top = top.where(F.col("clip_id") != name)
        return dedupe_in_time(top, dedupe_window).select("clip_id", "track_id", "start_sec", "similarity").orderBy(F.col("similarity").desc(), "clip_id").limit(k)
    if dedupe_window < 0:
        raise ValueError("window must not be negative")
    if dedupe_window == 0:
        return scored.orderBy(F.col("similarity").desc(), "clip_id").limit(k)
    return _walk_pages(scored, k, dedupe_window)


def _walk_pages(scored: DataFrame, k: int, window: float, page: int | None = None) -> DataFrame:
    """The first k rows of the ranking that no better kept one of the same track suppresses.

    Ranked rows (clip_id, track_id, start_sec, similarity) are written once; a
    page reads on from the last row's place (similarity, clip_id).
    """
    spark, page = scored.sparkSession, page or max(25 * k, k + 25)
    path = scratch(spark, "ranking")
    scored.write.parquet(path)
    ranking, kept, after = spark.read.schema(scored.schema).parquet(path), [], None
    while len(kept) < k:
        rest = ranking
        if after is not None:
            rest = rest.where((F.col("similarity") < after[0]) | ((F.col("similarity") == after[0]) & (F.col("clip_id") > after[1])))
            near = spark.createDataFrame([(c.track_id, c.start_sec) for c in kept], "track_id string, at double")
            rest = rest.join(F.broadcast(near), (rest.track_id == near.track_id) & (F.abs(rest.start_sec - near["at"]) < window), "left_anti")  # at most k rows
        rows = rest.orderBy(F.col("similarity").desc(), "clip_id").limit(page).collect()
        for r in rows:
            if len(kept) < k and all(c.track_id != r.track_id or abs(c.start_sec - r.start_sec) >= window for c in kept):
                kept.append(r)
        if len(rows) < page:
            break
        after = (rows[-1].similarity, rows[-1].clip_id)
    return spark.createDataFrame([tuple(r) for r in kept], scored.schema)


def parse_weights(text: str) -> dict[str, float]:
    """``a=0.7,b=0.3`` as weights; repeated names add up."""
    out: dict[str, float] = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, sign, value = part.partition("=")
        if not sign or not name.strip():
            raise ValueError(f"not name=weight: {part}")
        weight = float(value)
        if weight < 0:
            raise ValueError(f"negative weight: {part}")
        out[name.strip()] = out.get(name.strip(), 0.0) + weight
    if not out or sum(out.values()) <= 0:
        raise ValueError("weights must have a positive sum")
    return out


def weights_table(texts: DataFrame) -> DataFrame:
    """(text, aspect, weight) of weight texts, by SQL functions; texts that do not parse give a null weight."""
    part = texts.select("text", F.explode(F.split("text", ",")).alias("p")).where(F.trim("p") != "")
    pairs = part.select("text", F.trim(F.split("p", "=")[0]).alias("aspect"), F.expr("try_cast(trim(split(p, '=')[1]) as double)").alias("w"))
    return pairs.groupBy("text", "aspect").agg(F.when(F.count_if(F.col("w").isNull() | (F.col("w") < 0)) == 0, F.sum("w")).alias("weight"))


def compose_layers(weights: DataFrame, aspects: DataFrame, n_layers: int, scale_by_r2: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, layer, weight) of weighted aspects (keys, aspect, weight) over resolved aspects.

    A resolved aspect has one ``layer`` or dense ``layer_weights``.
    """
    rows = weights.join(aspects, "aspect").withColumn("w", F.col("weight") * (F.col("r2_score") if scale_by_r2 else F.lit(1.0)))
    dense = F.coalesce("layer_weights", F.transform(F.sequence(F.lit(0), F.lit(n_layers - 1)), lambda i: F.when(i == F.col("layer"), 1.0).otherwise(0.0)))
    return rows.select(*keys, "w", F.posexplode(dense).alias("layer", "x")).groupBy(*keys, "layer").agg(F.sum(F.col("w") * F.col("x")).alias("weight"))


def layer_weights_of(weights: dict[str, float], aspects: DataFrame, n_layers: int, scale_by_r2: bool = False) -> list[float]:
    """Weights of the layers, at most ``n_layers`` numbers; unknown aspects are an error."""
    if not weights or min(weights.values()) < 0:
        raise ValueError("aspect weights must be non-negative and not empty")
    known = {r[0] for r in aspects.where(F.col("aspect").isin(list(weights))).select("aspect").distinct().collect()}
    if unknown := sorted(set(weights) - known):
        raise KeyError(f"unknown aspects: {', '.join(unknown)}")
    table = aspects.sparkSession.createDataFrame(list(weights.items()), "aspect string, weight double")
    found = {r.layer: r.weight for r in compose_layers(table, aspects, n_layers, scale_by_r2).collect()}
    out = [float(found.get(i) or 0.0) for i in range(n_layers)]
    if sum(out) <= 0:
        raise ValueError("the weights have no positive sum")
    return out


def search_by_aspects(matrix: DataFrame, query_id, weights: dict[str, float], aspects: DataFrame, n_layers: int, k: int = 10, min_r2: float = 0.5, scale_by_r2: bool = False) -> DataFrame:
    """(id, similarity) by the layers' mix for weighted aspects; ``matrix`` has (id, layers)."""
    mix = layer_weights_of(weights, aspects.where(F.col("r2_score") >= min_r2), n_layers, scale_by_r2)
    fused = matrix.select("id", V.fuse(F.col("layers"), mix).alias("vec"))
    return find_similar(fused, query_id, k)


def search_by_aspect(matrix: DataFrame, query_id, aspect: str, aspects: DataFrame, n_layers: int, k: int = 10) -> DataFrame:
    """(id, similarity) by one aspect: its layer, or its mix of layers."""
    rows = aspects.where(F.col("aspect") == aspect).limit(1).collect()
    if not rows:
        known = [r[0] for r in aspects.select("aspect").orderBy("aspect").limit(50).collect()]
        raise KeyError(f"aspect {aspect} has no layer; there are {', '.join(known)}")
    if rows[0]["layer"] is None:
        return search_by_aspects(matrix, query_id, {aspect: 1.0}, aspects, n_layers, k, min_r2=-1e9)
    return find_similar(matrix.select("id", V.layer(F.col("layers"), rows[0]["layer"]).alias("vec")), query_id, k)

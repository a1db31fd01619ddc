"""Queries on vectors, clips and retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import clips as C
from strata.operators import index as X
from strata.operators import lists as L
from strata.operators import pooling as P
from strata.operators import search as S
from strata.plans import views
from strata.sources import tables as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = views.SQL + sql
        return f

    return put


def _entries(df, *keys):
    """Arrays as one row per entry, rounded."""
    return df.select(*keys, F.posexplode("vec").alias("i", "x")).select(*keys, "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def _clips(s, d):
    seg = views.embeddings(s, d).select(F.format_string("t%04d", F.expr("vec_id div 10")).alias("track_id"), (F.col("vec_id") % 10).cast("int").alias("segment_idx"))
    return C.build_clips(seg, "emb", metadata=views.metadata(s, d))


def _clip_vectors(s, d):
    vecs = views.embeddings(s, d).select(F.format_string("t%04d", F.expr("vec_id div 10")).alias("track_id"), (F.col("vec_id") % 10).cast("int").alias("segment_idx"), F.col("embedding").alias("vec"))
    return C.gather_vectors(_clips(s, d), vecs)


_ENT = "select {k}, i::int as i, round(vec[i + 1], 6) as x from {t}, (select unnest(range({n})) as i)"


@query("v1_track_mean", "select track_id, layer, i::int as i, round(avg(vec[i + 1]), 6) as x from v_seg, (select unnest(range(16)) as i) group by all")
def v1(s, d):
    return _entries(P.track_means(views.segments(s, d)), "track_id", "layer")


@query("v2_time_mean", "select track_id, (segment_idx // 5)::int as segment_idx, layer, i::int as i, round(avg(vec[i + 1]), 6) as x from v_seg, (select unnest(range(16)) as i) group by all")
def v2(s, d):
    return _entries(P.time_means(views.segments(s, d).withColumn("segment_idx", F.expr("segment_idx div 5").cast("int"))), "track_id", "segment_idx", "layer")


@query("v3_layer_select", "select id, i::int as i, round(vec[i + 1], 6) as x from v_layer, (select unnest(range(16)) as i) where layer = 2")
def v3(s, d):
    return _entries(views.matrix(s, d).select("id", V.layer(F.col("layers"), 2).alias("vec")), "id")


@query("v4_flatten", "select id, i::int as i, round(vec[i + 1], 6) as x from v_vec, (select unnest(range(64)) as i)")
def v4(s, d):
    return _entries(views.matrix(s, d).select("id", V.flatten_layers(F.col("layers")).alias("vec")), "id")


@query("v5_l2_normalise", "select id, layer, i::int as i, round(vec[i + 1] / sqrt(list_dot_product(vec, vec)), 6) as x from v_layer, (select unnest(range(16)) as i)")
def v5(s, d):
    return _entries(views.layer_vectors(s, d).withColumn("vec", V.l2_normalise(F.col("vec"))), "id", "layer")


@query("v6_cosine", "select a.id, round(list_cosine_similarity(a.vec, b.vec), 6) as similarity, round(list_dot_product(a.vec, b.vec), 6) as product from v_vec a join v_vec b on b.id = a.id + 1")
def v6(s, d):
    a = views.vectors(s, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return a.join(b, "id").select("id", F.round(V.cosine(F.col("vec"), F.col("other")), 6).alias("similarity"), F.round(V.dot(F.col("vec"), F.col("other")), 6).alias("product"))


_FUSE_SQL = "f as (select id, i, sum(({w})[layer + 1]::double / {t}::double * vec[i + 1] / sqrt(list_dot_product(vec, vec))) as x from v_layer, (select unnest(range(16)) as i) group by id, i)"


@query("v7_fuse", ", " + _FUSE_SQL.format(w="[1, 2, 0, 5]", t=8) + " select id, i::int as i, round(x, 6) as x from f")
def v7(s, d):
    return _entries(views.matrix(s, d).select("id", V.fuse(F.col("layers"), [1, 2, 0, 5]).alias("vec")), "id")


def _aspects(s):
    rows = [("brightness", 1, None, 0.9), ("texture", None, [0.1, 0.2, 0.3, 0.4], 0.7), ("tempo", 3, None, 0.6)]
    return s.createDataFrame(rows, "aspect string, layer int, layer_weights array<double>, r2_score double")


@query("v9_clip_bounds", "select clip_id, recording_id, work_id, track_id, segment_idx, start_sec, end_sec from v_clips")
def v9(s, d):
    return _clips(s, d).select("clip_id", "recording_id", "work_id", "track_id", "segment_idx", "start_sec", "end_sec")


@query("v10_clip_filter", "select clip_id from v_clips where work_id in ('w01', 'w03') and recording_id in ('r0001', 'r0003', 'r0010')")
def v10(s, d):
    return C.filter_clips(_clips(s, d), work_id={"w01", "w03"}, recording_id={"r0001", "r0003", "r0010"}, split=None).select("clip_id")


@query("v11_parse_weights", ", p as (select source || '=' || (n_chars % 7) || ',' || lang || '= 0.5 ,' || source || '=1' as text from documents), q as (select text, unnest(string_split(text, ',')) as p from (select distinct text from p)) select text, trim(string_split(p, '=')[1]) as aspect, sum(trim(string_split(p, '=')[2])::double) as weight from q group by all")
def v11(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    text = F.concat("source", F.lit("="), (F.col("n_chars") % 7).cast("string"), F.lit(","), "lang", F.lit("= 0.5 ,"), "source", F.lit("=1"))
    return S.weights_table(docs.select(text.alias("text")).distinct())


@query("v12_text_blob", "select track_id, recording_id || ' ' || work_id as blob from v_meta")
def v12(s, d):
    return C.text_blob(views.metadata(s, d))


@query("v13_softmax", "select id, layer, i::int as i, round(exp(vec[i + 1] - list_max(vec)) / list_sum(list_transform(vec, lambda v: exp(v - list_max(vec)))), 6) as x from v_layer, (select unnest(range(16)) as i)")
def v13(s, d):
    return _entries(views.layer_vectors(s, d).select("id", "layer", V.softmax(V.doubles(F.col("vec"))).alias("vec")), "id", "layer")


@query("v14_confidence", "select event_id, case when value / 100 > 0.8 then 'high' when value / 100 > 0.5 then 'medium' else 'low' end as confidence from events")
def v14(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", V.confidence(F.col("value") / 100).alias("confidence"))


@query("v15_shape_check", "select id, len(vec) = 64 as ok from v_vec")
def v15(s, d):
    return views.matrix(s, d).select("id", V.has_shape(V.require_shape(F.col("layers").cast("array<array<double>>"), 4, 16, F.col("id")), 4, 16).alias("ok"))


@query("v16_tempo_level", "select event_id, round(log2(least(greatest(value, 40), 240) / 60), 6) as level from events")
def v16(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.round(V.tempo_level(F.col("value")), 6).alias("level"))


@query("v17_metadata_lookup", "select track_id, recording_id, work_id from v_meta where track_id = 't0003'")
def v17(s, d):
    return views.metadata(s, d).where("track_id = 't0003'").select("track_id", "recording_id", "work_id")


@query("v8_compose_layers", ", w as (select user_id, case event_type when 'click' then 'brightness' when 'view' then 'texture' else 'tempo' end as aspect, sum(value) as w from events group by all), a as (select 'brightness' as aspect, [0.0, 1.0, 0.0, 0.0] as l, 0.9 as r2 union all select 'texture', [0.1, 0.2, 0.3, 0.4], 0.7 union all select 'tempo', [0.0, 0.0, 0.0, 1.0], 0.6) select user_id, i::int as layer, round(sum(w * r2::double * l[i + 1]::double), 6) as weight from w join a using (aspect), (select unnest(range(4)) as i) group by user_id, i")
def v8(s, d):
    aspect = F.when(F.col("event_type") == "click", "brightness").when(F.col("event_type") == "view", "texture").otherwise("tempo")
    w = s.read.parquet(f"{d}/events.parquet").groupBy("user_id", aspect.alias("aspect")).agg(F.sum("value").alias("weight"))
    return S.compose_layers(w, _aspects(s), 4, scale_by_r2=True, keys=("user_id",)).withColumn("weight", F.round("weight", 6))


_KNN = "select id, round(list_cosine_similarity(vec, (select vec from v_vec where id = 0)), 6) as similarity from v_vec where id <> 0 order by list_cosine_similarity(vec, (select vec from v_vec where id = 0)) desc, id limit 10"


def _rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6))


@query("k1_find_similar", _KNN)
def flagship(s, d):
    return _rounded(S.find_similar(views.vectors(s, d), 0))


@query("k2_batch_knn", ", p as (select q.id as query_id, c.id, list_cosine_similarity(q.vec, c.vec) as similarity from v_vec q join v_vec c on q.id <> c.id where q.id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from p) select query_id, id, round(similarity, 6) as similarity, rank::int as rank from r where rank <= 10")
def k2(s, d):
    v = views.vectors(s, d)
    return _rounded(S.similar_to_all(v, v.where("id % 50 = 0")))


_FETCH = ", top as (select clip_id, track_id, start_sec, list_cosine_similarity(vec, (select vec from v_clips where clip_id = 'emb:t0002:00003')) as similarity from v_clips order by similarity desc, clip_id limit 250) "


@query("k3_clip_search_no_dedupe", _FETCH + "select clip_id, track_id, start_sec, round(similarity, 6) as similarity from top where clip_id <> 'emb:t0002:00003' order by top.similarity desc, clip_id limit 10")
def k3(s, d):
    return _rounded(S.search_by_clip(_clip_vectors(s, d), "emb:t0002:00003", dedupe_window=0))


@query("k4_clip_search_deduped", _FETCH + ", t as (select *, row_number() over (partition by track_id order by top.similarity desc, clip_id) as n from top where clip_id <> 'emb:t0002:00003'), walk as (select *, true as ok, [start_sec] as kept from t where n = 1 union all select t.*, len(list_filter(kept, lambda y: abs(y - t.start_sec) < 5)) = 0 as ok, case when len(list_filter(kept, lambda y: abs(y - t.start_sec) < 5)) = 0 then list_append(kept, t.start_sec) else kept end from walk join t on t.track_id = walk.track_id and t.n = walk.n + 1) select clip_id, track_id, start_sec, round(similarity, 6) as similarity from walk where ok order by walk.similarity desc, clip_id limit 10")
def k4(s, d):
    return _rounded(S.search_by_clip(_clip_vectors(s, d), "emb:t0002:00003"))


ORACLES["k4_clip_search_deduped"] = ORACLES["k4_clip_search_deduped"].replace("with ", "with recursive ", 1)


@query("k3_clip_search_by_time", _FETCH.replace("'emb:t0002:00003'", "'emb:t0004:00002'") + "select clip_id, track_id, start_sec, round(similarity, 6) as similarity from top where clip_id <> 'emb:t0004:00002' order by top.similarity desc, clip_id limit 10")
def k3_time(s, d):
    return _rounded(S.search_by_clip(_clip_vectors(s, d), track_id="t0004", start_sec=4.4, dedupe_window=0))


@query("k5_aspect_search", ", l as (select id, vec from v_layer where layer = 1) select id, round(list_cosine_similarity(vec, (select vec from l where id = 3)), 6) as similarity from l where id <> 3 order by list_cosine_similarity(vec, (select vec from l where id = 3)) desc, id limit 10")
def k5(s, d):
    return _rounded(S.search_by_aspect(views.matrix(s, d), 3, "brightness", _aspects(s), 4))


@query("k6_aspects_search", ", " + _FUSE_SQL.format(w="[0.03, 0.56, 0.09, 0.32]", t=1) + ", g as (select id, list(x order by i) as vec from f group by id) select id, round(list_cosine_similarity(vec, (select vec from g where id = 3)), 6) as similarity from g where id <> 3 order by list_cosine_similarity(vec, (select vec from g where id = 3)) desc, id limit 10")
def k6(s, d):
    return _rounded(S.search_by_aspects(views.matrix(s, d), 3, {"brightness": 0.5, "texture": 0.3, "tempo": 0.2}, _aspects(s), 4))


@query("k7_first_sorted", "select track_id, recording_id from v_meta order by track_id limit 20")
def k7(s, d):
    return views.metadata(s, d).select("track_id", "recording_id").orderBy("track_id").limit(20)


@query("x1_flat_index", "select id, i::int as i, round(vec[i + 1] / sqrt(list_dot_product(vec, vec)), 6) as x from v_vec, (select unnest(range(64)) as i)")
def x1(s, d):
    return _entries(X.flat_index(views.vectors(s, d)), "id")


@query("x2_ivf_full_probe", ", p as (select q.id as query_id, c.id, list_cosine_similarity(q.vec, c.vec) as similarity from v_vec q, v_vec c where q.id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from p) select query_id, id, round(similarity, 6) as similarity, rank::int as rank from r where rank <= 10")
def x2(s, d):
    lists, centres = X.ivf_index(views.vectors(s, d), 8)
    queries = views.vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return _rounded(X.probe_ivf(lists, centres, queries, 10, 8))


@query("x2_exact_lists", ", p as (select q.id as query_id, c.id, list_cosine_similarity(q.vec, c.vec) as similarity from v_vec q join v_vec c on q.id <> c.id), r as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from p) select query_id, id, round(similarity, 6) as similarity, rank::int as rank from r where rank <= 10")
def x2_exact(s, d):
    """All rows as their own queries, through lists of some 50 rows."""
    v = views.vectors(s, d)
    lists, centres = L.balanced_lists(v, 50)
    return _rounded(L.similar_through_lists(lists, centres, v.select(F.col("id").alias("query_id"), "vec"))[0])


@query("x2_ivf_four_probes")
def x2_some(s, d):
    lists, centres = X.ivf_index(views.vectors(s, d), 8, spill=2)
    queries = views.vectors(s, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return _rounded(X.probe_ivf(lists, centres, queries, 10, 4))


@query("x3_product_codes")
def x3(s, d):
    v = views.vectors(s, d)
    codes, centres, books = X.pq_index(v, "IVF8,PQ16x6", spill=2)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    return _rounded(X.probe_pq(codes, centres, books, v, queries, 10, 5, 50))


@query("j2_clips_metadata", "select clip_id, recording_id, work_id from v_clips")
def j2(s, d):
    return C.with_metadata(_clips(s, d), views.metadata(s, d)).select("clip_id", "recording_id", "work_id")


@query("j5_missing_tracks", "select distinct track_id from v_meta where track_id not in (select track_id from v_seg where layer in (0, 1) and (layer = 0 or segment_idx < 5 and track_id < 't0010') group by track_id having count(distinct layer) = 2)")
def j5(s, d):
    seg = views.segments(s, d).where("layer = 0 or (layer = 1 and segment_idx < 5 and track_id < 't0010')")
    return T.missing_tracks(views.metadata(s, d).select("track_id"), seg.select("track_id", F.col("layer").cast("string").alias("feature_type")), ["0", "1"])


@query("j7_nearest_clip", ", w as (select track_id, velocity / 6.0::double as start from (select printf('t%04d', track_id % 50) as track_id, velocity from v_notes) group by all), r as (select w.track_id, w.start, clip_id, row_number() over (partition by w.track_id, w.start order by abs(start_sec - w.start), clip_id) as n from w join v_clips c on w.track_id = c.track_id) select track_id, start, clip_id from r where n = 1")
def j7(s, d):
    wanted = views.notes(s, d).select(F.format_string("t%04d", F.col("track_id") % 50).alias("track_id"), (F.col("velocity") / 6.0).alias("start")).distinct()
    return C.nearest_clip(_clips(s, d), wanted)


@query("j10_clip_by_id", "select clip_id, track_id from v_clips where clip_id = 'emb:t0001:00004'")
def j10(s, d):
    return C.clip_by_id(_clips(s, d), "emb:t0001:00004").select("clip_id", "track_id")


@query("j12_training_view", "select clip_id, quality, quality is not null as has_quality, label_value from v_clips join v_wide on vec_id = id")
def j12(s, d):
    key = F.format_string("emb:t%04d:%05d", F.expr("id div 10"), F.expr("id % 10"))
    feats = views.vectors(s, d).select(key.alias("clip_id"), "vec")
    t = views.targets(s, d).where("y is not null").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "y"))).alias("targets")).select(key.alias("clip_id"), "targets")
    v = C.training_view(_clips(s, d), feats, t, ["quality", "label_value"])
    return v.select("clip_id", v.target_values[0].alias("quality"), v.target_mask[0].alias("has_quality"), v.target_values[1].alias("label_value"))


@query("j15_gather", "select clip_id, round(list_sum(vec), 6) as total from v_clips")
def j15(s, d):
    return _clip_vectors(s, d).select("clip_id", F.round(F.aggregate(V.doubles(F.col("vec")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a2_duplicates", "select track_id, count(*) as n from v_clips group by track_id having count(*) > 1")
def a2(s, d):
    return C.duplicates(_clips(s, d), "track_id")


@query("a10_status_counts", "select event_type as status, count(*) as n from events group by 1 union all select 'total', count(*) from events")
def a10(s, d):
    from strata.sources.files import status_counts

    return status_counts(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("status")))


@query("a11_manifest_rollup", "select count(*) as ntotal, max(len(vec))::int as dimension, 'emb' as dataset_id from v_clips")
def a11(s, d):
    return X.manifest_rollup(_clip_vectors(s, d))


@query("r8_split", ", r as (select recording_id, row_number() over (order by md5('42:' || recording_id)) as n, count(*) over () as t from (select distinct recording_id from v_clips)), p as (select recording_id, case when n <= floor(t * 0.8::double) then 'train' when n <= floor(t * 0.8::double) + floor(t * 0.1::double) then 'validation' else 'test' end as split from r) select clip_id, split from v_clips join p using (recording_id)")
def r8(s, d):
    return C.split_by_recording(_clips(s, d)).select("clip_id", "split")


@query("s17_cached_tracks", "select track_id from v_seg where layer in (0, 2) and segment_idx <= layer group by track_id having count(distinct layer) = 2")
def s17(s, d):
    rows = views.segments(s, d).where("segment_idx <= layer").select("track_id", F.col("layer").cast("string").alias("feature_type"))
    return T.cached_tracks(rows, ["0", "2"])


@query("u1_intersect", "select id from v_vec intersect select doc_id from labels")
def u1(s, d):
    return views.vectors(s, d).select("id").intersect(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id")))


@query("u2_difference", "select id from v_vec except select doc_id from labels")
def u2(s, d):
    return views.vectors(s, d).select("id").exceptAll(s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id")))


@query("u3_merge_targets", "select id as track_id, target, coalesce(case when target = 'quality' then label_value end, y) as y from (select t.id, target, y, label_value from v_targets t join v_wide w on t.id = w.id)")
def u3(s, d):
    t = views.targets(s, d).withColumnRenamed("id", "track_id")
    later = t.where("target = 'label_value'").select("track_id", F.lit("quality").alias("target"), "y")
    return T.merge_targets(t, later)

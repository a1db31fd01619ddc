"""Queries that write data of the given tables in the library's formats and read it back.

Folders lie below ``spark.checkpoint.dir``.  Files of arrays and audio are made
in tasks from the tables' rows and stay binary columns, which is what the jobs
over files take.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strata.functions import registry
from strata.functions import vectors as V
from strata.operators import clips as C
from strata.operators import index as X
from strata.operators import pooling as P
from strata.operators import search_queries as SQ
from strata.operators import target_queries as TQ
from strata.operators import targets as T
from strata.plans import views
from strata.plans.session import scratch
from strata.sources import artifacts, feature_store, files, tables
from strata.streaming.incremental import ingest_new_files

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        ORACLES[name] = views.SQL + sql
        return f

    return put


def _total(vec="vec"):
    return F.round(F.aggregate(V.doubles(F.col(vec)), F.lit(0.0), lambda a, x: a + x), 6).alias("total")


def _features(s, d) -> str:
    """A feature folder with all segments and the means of all tracks."""
    path = scratch(s, "features")
    rows = views.segments(s, d).withColumn("vec", F.col("vec").cast("array<double>"))
    feature_store.write_features(rows.withColumn("feature_type", F.lit("segments")), path)
    feature_store.write_features(P.track_means(rows).withColumns({"segment_idx": F.lit(0), "feature_type": F.lit("aggregated")}), path)
    return path


@query("s1_track_vectors", "select track_id, (layer * 16 + i)::int as i, round(avg(vec[i + 1]), 6) as x from v_seg, (select unnest(range(16)) as i) group by all")
def s1(s, d):
    return SQ._entries(tables.read_track_vectors(s, _features(s, d), views.N_LAYERS, views.DIM), "track_id")


@query("s1_one_layer", "select track_id, i::int as i, round(avg(vec[i + 1]), 6) as x from v_seg, (select unnest(range(16)) as i) where layer = 2 group by all")
def s1_layer(s, d):
    return SQ._entries(tables.read_track_vectors(s, _features(s, d), views.N_LAYERS, views.DIM, layer=2, feature_type="segments"), "track_id")


@query("s2_clip_vectors", "select track_id, segment_idx, segment_idx * 2.5::double as start_sec, segment_idx * 2.5::double + 5 as end_sec, round(list_sum(vec), 6) as total from v_seg where layer = 1")
def s2(s, d):
    return tables.read_clip_vectors(s, _features(s, d), 1, views.N_LAYERS).select("track_id", "segment_idx", "start_sec", "end_sec", _total())


@query("s3_layer_matrix", "select track_id, layer, i::int as i, round(avg(vec[i + 1]), 6) as x from v_seg, (select unnest(range(16)) as i) group by all")
def s3(s, d):
    stacks = tables.read_layer_matrix(s, _features(s, d), views.N_LAYERS, views.DIM)
    return SQ._entries(P.layer_rows(stacks, ["track_id"]), "track_id", "layer")


def _packed(make):
    """A task that turns rows (track_id, x, ...) into binary files (path, length, content)."""

    def run(frames):
        for f in frames:
            content = [make(row) for row in f.itertuples(index=False)]
            yield pd.DataFrame({"path": "/made/" + f.track_id.astype(str) + ".bin", "length": [len(c) for c in content], "content": content})

    return run


_FILES = "path string, length long, content binary"


def _npy(row) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asarray(row.x, dtype=np.float32).reshape(views.N_LAYERS, views.DIM))
    return out.getvalue()


@query("s4_ingest_npy", "select id::varchar as track_id, 0::int as segment_idx, 0::int as t, layer, i::int as i, round(vec[i + 1], 6) as x from v_layer, (select unnest(range(16)) as i)")
def s4(s, d):
    made = views.vectors(s, d).select(F.col("id").alias("track_id"), F.col("vec").alias("x")).mapInPandas(_packed(_npy), _FILES)
    return SQ._entries(files.ingest_npy(made), "track_id", "segment_idx", "t", "layer")


def _npz(row) -> bytes:
    x, out = np.asarray(row.x, dtype=float), io.BytesIO()
    np.savez(out, **{"signal.samples": x, "signal.peak": x.max()})
    return out.getvalue()


@query("s5_ingest_targets", "select track_id::varchar as track_id, 'signal' as category, 'samples' as field, frame as i, round(x, 6) as x from v_sig union all select track_id::varchar, 'signal', 'peak', 0::int, round(max(x), 6) from v_sig group by track_id")
def s5(s, d):
    made = TQ._signals(s, d).select("track_id", F.col("samples").alias("x")).mapInPandas(_packed(_npz), _FILES)
    return SQ._entries(files.ingest_targets(made).withColumnRenamed("values", "vec"), "track_id", "category", "field")


_CLIP = "select clip_id, recording_id, work_id, track_id, segment_idx, start_sec, end_sec, 'unspecified' as split from v_clips"
_CLIP_COLUMNS = ("clip_id", "recording_id", "work_id", "track_id", "segment_idx", "start_sec", "end_sec", "split")


@query("s6_clip_index_parquet", _CLIP)
def s6(s, d):
    path = scratch(s, "clips") + ".parquet"
    tables.write_clip_index(SQ._clips(s, d), path)
    return tables.read_clip_index(s, path).select(*_CLIP_COLUMNS)


@query("s6_clip_index_csv", _CLIP)
def s6_csv(s, d):
    path = scratch(s, "clips") + ".csv"
    tables.write_clip_index(SQ._clips(s, d), path)
    return tables.read_clip_index(s, path).select(*_CLIP_COLUMNS)


@query("s7_clip_index_text", "select clip_id, printf('%.6f', start_sec) as start_sec, printf('%.6f', end_sec) as end_sec from v_clips")
def s7(s, d):
    path = scratch(s, "clips") + ".csv"
    tables.write_clip_index(SQ._clips(s, d), path)
    return s.read.option("header", True).csv(path).select("clip_id", "start_sec", "end_sec")


def _moods(s, d):
    """Metadata with one more column, which is blank around its text and missing for the first work."""
    return views.metadata(s, d).withColumn("mood", F.when(F.col("work_id") != "w00", F.concat(F.lit("  "), "work_id", F.lit(" "))))


@query("s8_metadata", "select track_id, recording_id, work_id, case when work_id = 'w00' then '' else work_id end as mood from v_meta")
def s8(s, d):
    path = scratch(s, "metadata") + ".parquet"
    _moods(s, d).write.parquet(path)
    return tables.read_metadata(s, path).select("track_id", "recording_id", "work_id", "mood")


@query("s9_metadata_csv", "select 'recording_id,work_id,track_id,mood' as line union all select recording_id || ',' || work_id || ',' || track_id || ',' || case when work_id = 'w00' then '\"\"' else work_id end from v_meta")
def s9(s, d):
    path = scratch(s, "metadata") + ".csv"
    tables.write_metadata(tables.normalise_metadata(_moods(s, d)), path)
    return s.read.text(path).select(F.col("value").alias("line")).distinct()


def _texts(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


@query("s13_list_files", "select coalesce(lang, 'none') as lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::bigint as bytes from documents group by 1")
def s13(s, d):
    """The texts as files in a folder per language, found from the folder above; a line feed ends each text."""
    path = scratch(s, "texts")
    _texts(s, d).write.partitionBy("lang").text(path)
    found = files.list_audio(s, path, ".txt").select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), "length")
    return found.groupBy("lang").agg(F.sum("length").alias("bytes"))


def _wav(row) -> bytes:
    """Silence of no header for a track without a rate."""
    if row.rate is None or row.rate != row.rate:
        return b"no audio"
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(row.rate))
        w.writeframes(np.clip(np.floor(np.asarray(row.x) * 1000), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def _wavs(s, d):
    """A file for each vector: as many samples a second as its label's share of 128, none for label 0."""
    rate = F.when(F.col("label") > 0, 16 * F.col("label")).cast("double")
    rows = views.embeddings(s, d).select(F.col("vec_id").alias("track_id"), F.col("embedding").cast("array<double>").alias("x"), rate.alias("rate"))
    return rows.mapInPandas(_packed(_wav), _FILES)


@query("s14_decode_wav", "select vec_id::varchar as track_id, (16 * label)::int as sample_rate, i::int as frame, round(least(greatest(floor(embedding[i + 1]::double * 1000), -32768), 32767) / 32768, 6) as x from embeddings, (select unnest(range(64)) as i) where label > 0 union all select vec_id::varchar, null, null, null from embeddings where label <= 0 or label is null")
def s14(s, d):
    out = files.decode_wav(_wavs(s, d))
    return out.select("track_id", "sample_rate", F.posexplode_outer("samples").alias("frame", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("s15_validate_audio", "select vec_id::varchar as track_id, coalesce(label > 0 and 64 >= 16 * label, false) as valid, coalesce(label > 0, false) as readable, case when label > 0 then (16 * label)::int end as sample_rate, case when label > 0 then round(64 / (16::double * label), 6) end as duration, case when label > 0 and 64 < 16 * label then 'too short' when label > 0 then '' else 'unreadable header' end as errors from embeddings")
def s15(s, d):
    out = files.validate_audio(_wavs(s, d))
    return out.select(files.stem(F.col("path")).alias("track_id"), "valid", "readable", "sample_rate", F.round("duration", 6).alias("duration"), F.concat_ws(", ", "errors").alias("errors"))


@query("s16_write_features", """, m as (select track_id, layer, i, avg(vec[i + 1]) as x from v_seg, (select unnest(range(16)) as i) group by all),
w as (select track_id, layer, i, case when layer < 2 and substr(track_id, 5) in ('0', '2', '4', '6', '8') then max(vec[i + 1]) else avg(vec[i + 1]) end as x from v_seg, (select unnest(range(16)) as i) group by track_id, layer, i)
select 'segments' as feature_type, track_id, layer, count(*) as n, round(sum(list_sum(vec)), 6) as total from v_seg group by all union all select 'aggregated', track_id, layer, 1, round(sum(x), 6) from w group by all union all select 'best', track_id, 0, 1, round(sum(x), 6) from m where layer = 0 group by all""")
def s16(s, d):
    """Of the means of all tracks, those of layers 0 and 1 are written again for half of the tracks, as maxima; a new type comes last, and the batches become one."""
    path = _features(s, d)
    half = views.segments(s, d).where("layer < 2 and substr(track_id, 5) in ('0', '2', '4', '6', '8')")
    tops = half.select("track_id", "layer", F.posexplode("vec").alias("i", "x")).groupBy("track_id", "layer", "i").agg(F.max(F.col("x").cast("double")).alias("x"))
    tops = tops.groupBy("track_id", "layer").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("vec"))
    feature_store.write_features(tops.withColumns({"segment_idx": F.lit(0), "feature_type": F.lit("aggregated")}), path)
    means = P.track_means(views.segments(s, d).where("layer = 0").withColumn("vec", F.col("vec").cast("array<double>")))
    feature_store.write_features(means.withColumns({"segment_idx": F.lit(0), "feature_type": F.lit("best")}), path)
    feature_store.compact_features(s, path)
    return feature_store.read_feature_rows(s, path).groupBy("feature_type", "track_id", "layer").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate(V.doubles(F.col("vec")), F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


@query("s18_read_features", ", q as (select printf('t%04d', vec_id // 10) as track_id from embeddings group by 1 having max(label) >= 5) select track_id, 'segments' as feature_type, count(*) as n from v_seg join q using (track_id) group by 1 union all select track_id, 'aggregated', 4 from q")
def s18(s, d):
    """Means are written for the tracks with a label of 5 at least; only these have both types."""
    path = scratch(s, "features")
    seg = views.segments(s, d).withColumn("vec", F.col("vec").cast("array<double>"))
    marked = views.embeddings(s, d).groupBy(F.format_string("t%04d", F.expr("vec_id div 10")).alias("track_id")).agg(F.max("label").alias("top")).where("top >= 5")
    feature_store.write_features(seg.withColumn("feature_type", F.lit("segments")), path)
    means = P.track_means(seg.join(marked, "track_id", "left_semi")).withColumns({"segment_idx": F.lit(0), "feature_type": F.lit("aggregated")})
    feature_store.write_features(means, path)
    return tables.read_features(s, path, ["segments", "aggregated"]).groupBy("track_id", "feature_type").agg(F.count("*").alias("n"))


def _saved(s, d, root: str) -> str:
    return artifacts.save_index(X.flat_index(views.vectors(s, d)), root, "emb", "20240101T000000Z")


_UNIT = "select id, round(list_sum(vec) / sqrt(list_dot_product(vec, vec)), 6) as total, (select count(*) from v_vec) as ntotal, 64::bigint as dimension from v_vec"


def _loaded(found):
    vectors, manifest = found
    return vectors.select("id", _total(), F.lit(manifest["ntotal"]).cast("long").alias("ntotal"), F.lit(manifest["dimension"]).cast("long").alias("dimension"))


@query("s20_load_index", _UNIT)
def s20(s, d):
    return _loaded(artifacts.load_index(s, _saved(s, d, scratch(s, "indexes"))))


@query("s24_load_latest", _UNIT)
def s24(s, d):
    root = scratch(s, "indexes")
    artifacts.publish_index(s, _saved(s, d, f"{root}/own"), f"{root}/public")
    return _loaded(artifacts.load_latest(s, f"{root}/public", "emb"))


@query("s21_checksums", ", t as (select coalesce(source, 'none') as source, string_agg(coalesce(text, '') || chr(10), '' order by doc_id) as body from documents group by 1) select source, octet_length(encode(body))::bigint as size, sha256(body) as sha256, md5(body) as md5 from t")
def s21(s, d):
    """The texts of each source as one file, in the order of their ids, with a line feed after each."""
    path = scratch(s, "texts")
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    return files.checksum_table(s, path).select(F.regexp_extract("file", "source=([^/]*)/", 1).alias("source"), "size", "sha256", "md5")


@query("s22_index_catalog", "select 'first' as name, '20240101T000000Z' as stamp, count(*) as ntotal from v_vec union all select 'first', '20240301T000000Z', count(*) from v_layer where layer = 0 union all select 'second', '20240201T000000Z', count(*) from v_seg where layer = 1")
def s22(s, d):
    root, rows = scratch(s, "indexes"), views.layer_vectors(s, d)
    artifacts.save_index(views.vectors(s, d), root, "first", "20240101T000000Z")
    artifacts.save_index(rows.where("layer = 0"), root, "first", "20240301T000000Z", layer=0)
    artifacts.save_index(rows.where("layer = 1"), root, "second", "20240201T000000Z", layer=1)
    return artifacts.index_catalog(s, root).select("name", "stamp", "ntotal")


@query("s25_probe_results", TQ._GRADED + " select 'best_layer' as mode, layer, target, round(r2, 6) as r2_score, n_valid from e union all select 'weighted_sum', null, target, 0.6, n_valid from e where layer = 0")
def s25(s, d):
    path = scratch(s, "results")
    tables.write_probe_results(TQ._graded(s, d), path)
    return tables.read_probe_results(s, path).select("mode", "layer", "target", F.round("r2_score", 6).alias("r2_score"), "n_valid")


@query("j11_resolve_audio", "select doc_id::varchar as track_id, '/audio/' || coalesce(source, 'none') || '/' || doc_id || '.wav' as path from documents")
def j11(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    found = docs.select(F.concat(F.lit("/audio/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"))
    return C.resolve_audio(docs.select(F.col("doc_id").cast("string").alias("track_id")), found)


@query("e1_generators", ", r as (select *, abs(x) as y, abs(x) / (avg(abs(x)) over (partition by track_id) + 1e-8::double) as q from v_sig), g as (select track_id, lead(onset) over (partition by track_id order by onset) - onset as g from v_notes) select 'range' as name, track_id, round(max(y) - min(y), 6) as value from r group by 2 union all select 'regularity', track_id, round(coalesce(stddev_pop(g) / avg(g), 0), 6) from g group by 2")
def e1(s, d):
    registry.register("range", lambda x: T.dynamics(x).select("track_id", F.col("dynamic_range").alias("value")))
    registry.register("regularity", lambda x: T.phrases(x).select("track_id", F.col("regularity").alias("value")))
    made = registry.run_all({"range": views.signals(s, d).withColumn("x", F.abs("x")), "regularity": views.notes(s, d).select("track_id", F.col("onset").alias("t"))})
    one, two = (made[n].select(F.lit(n).alias("name"), "track_id", F.round("value", 6).alias("value")) for n in ("range", "regularity"))
    return one.unionByName(two)


def _summaries(limit: float):
    """An encoder with the sum and the largest value as one layer, the smallest and the mean as another; it fails above a limit."""

    def make():
        def encode(x: np.ndarray) -> np.ndarray:
            if x.max() > limit:
                raise ValueError("too loud")
            return np.stack([x.sum(axis=1), x.max(axis=1), x.min(axis=1), x.mean(axis=1)], axis=1).reshape(len(x), 2, 2)

        return encode

    return make


def _segments(s, d):
    return T.sliding_segments(TQ._signals(s, d), 20, 10)


_ENCODED = TQ._SEGS + ", z as (select track_id, segment_idx::int as segment_idx, sum(x) as a, max(x) as b, min(x) as c, avg(x) as m from g join v_sig using (track_id) where frame >= start and frame < start + 20 group by all)"


@query("e2_encode_batches", _ENCODED + " select track_id, segment_idx, round(a, 6) as total, round(b, 6) as top, round(c, 6) as low, round(m, 6) as mean from z")
def e2(s, d):
    out = files.encode_batches(_segments(s, d), _summaries(float("inf")), 20, 2)
    at = lambda k, i, name: F.round(F.col("layers")[k][i], 6).alias(name)
    return out.select("track_id", "segment_idx", at(0, 0, "total"), at(0, 1, "top"), at(1, 0, "low"), at(1, 1, "mean"))


@query("e3_encoder_errors", _ENCODED + " select track_id, segment_idx, case when b <= 0.3::double then round(a, 6) end as total, case when b > 0.3::double then 'ValueError: too loud' end as error from z")
def e3(s, d):
    out = files.encode_safely(_segments(s, d), _summaries(0.3))
    return out.select("track_id", "segment_idx", F.round(F.col("layers")[0][0], 6).alias("total"), "error")


@query("e4_extra_features", "select c.clip_id, quality, d.n_chars from v_clips c join v_wide w on c.vec_id = w.id left join documents d on d.doc_id = c.vec_id")
def e4(s, d):
    key = lambda c: F.format_string("emb:t%04d:%05d", F.expr(f"{c} div 10"), F.expr(f"{c} % 10")).alias("clip_id")
    lengths = s.read.parquet(f"{d}/documents.parquet").select(key("doc_id"), "n_chars")
    t = views.targets(s, d).where("target = 'quality' and y is not null").select(key("id"), F.create_map("target", "y").alias("targets"))
    v = C.training_view(SQ._clips(s, d), views.vectors(s, d).select(key("id"), "vec"), t, ["quality"], extra=[lengths])
    return v.select("clip_id", v.target_values[0].alias("quality"), "n_chars")


@query("e6_incremental_ingest", "select doc_id::varchar as line from documents")
def e6(s, d):
    """Files are taken once: the second run over the same folder adds nothing."""
    root = scratch(s, "ingest")
    s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string")).write.text(f"{root}/files")
    lines = lambda x: x.select(F.explode(F.split(F.trim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("line")).where("line <> ''")
    for _ in range(2):
        ingest_new_files(s, f"{root}/files", f"{root}/out", f"{root}/state", lines, ".txt")
    return s.read.parquet(f"{root}/out")

"""The given tables as the library's inputs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_LAYERS, DIM = 4, 16


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def layer_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, layer, vec): a vector is a stack of four layers."""
    layers = F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1))).alias("layer")
    return embeddings(spark, d).select(F.col("vec_id").alias("id"), layers, "embedding").select("id", "layer", F.slice("embedding", F.col("layer") * DIM + 1, DIM).alias("vec"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(track_id, segment_idx, layer, vec): ten vectors are a track."""
    return layer_vectors(spark, d).select(F.format_string("t%04d", F.expr("id div 10")).alias("track_id"), (F.col("id") % 10).cast("int").alias("segment_idx"), "layer", "vec")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(id, layers)."""
    return embeddings(spark, d).select(F.col("vec_id").alias("id"), F.array(*[F.slice("embedding", k * DIM + 1, DIM) for k in range(N_LAYERS)]).alias("layers"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return e.select(F.format_string("t%04d", F.expr("vec_id div 10")).alias("track_id"), F.format_string("r%04d", F.expr("vec_id div 20")).alias("recording_id"), F.format_string("w%02d", F.expr("(vec_id div 20) % 7")).alias("work_id")).distinct()


def targets(spark: SparkSession, d: str) -> DataFrame:
    """(id, target, y) of four scalar targets; quality is missing for many."""
    e = embeddings(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("double").alias("quality"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id"), F.log(F.col("n_chars") + 1.0).alias("log_chars"))
    lin2 = F.col("embedding")[32].cast("double") + 0.5 * F.col("embedding")[39].cast("double")
    wide = e.join(labels, "vec_id", "left").join(docs, "vec_id", "left").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label_value"), "quality", "log_chars", lin2.alias("lin2"))
    return wide.unpivot("id", ["label_value", "quality", "log_chars", "lin2"], "target", "y")


def notes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    onset = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400000000.0)
    n = e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq"), onset.alias("onset"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("dur"), F.least(F.lit(127), F.floor("value")).cast("int").alias("velocity"), "event_type")
    return n.withColumn("offset", F.col("onset") + F.col("dur"))


def controls(spark: SparkSession, d: str) -> DataFrame:
    return notes(spark, d).where("event_type = 'error'").select("track_id", F.col("seq").alias("event_id"), F.col("onset").alias("t"), F.lit(64).alias("cc"), F.col("velocity").alias("value"))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select(F.col("vec_id").alias("track_id"), F.posexplode("embedding").alias("frame", "x")).withColumn("x", F.col("x").cast("double"))


def chroma(spark: SparkSession, d: str, first: int = 0) -> DataFrame:
    return embeddings(spark, d).select(F.expr("vec_id div 50").alias("track_id"), (F.col("vec_id") % 50).cast("int").alias("frame"), F.posexplode(F.slice("embedding", first + 1, 12)).alias("pc", "energy")).withColumn("energy", F.abs(F.col("energy").cast("double")))


def tempogram(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).select(F.expr("vec_id div 50").alias("track_id"), (F.col("vec_id") % 50).cast("int").alias("frame"), F.posexplode("embedding").alias("lag", "mag")).withColumn("mag", F.abs(F.col("mag").cast("double")))


#: The same views as SQL, in front of each query's own text.
SQL = """
with v_vec as (select vec_id as id, embedding::double[] as vec from embeddings),
v_layer as (select vec_id as id, layer::int as layer, list_slice(embedding, layer * 16 + 1, layer * 16 + 16)::double[] as vec from embeddings, (select unnest(range(4)) as layer)),
v_seg as (select printf('t%04d', id // 10) as track_id, (id % 10)::int as segment_idx, layer, vec from v_layer),
v_clips as (select printf('emb:t%04d:%05d', vec_id // 10, vec_id % 10) as clip_id, printf('r%04d', vec_id // 20) as recording_id, printf('w%02d', (vec_id // 20) % 7) as work_id, printf('t%04d', vec_id // 10) as track_id, (vec_id % 10)::int as segment_idx,
  (vec_id % 10) * 2.5::double as start_sec, (vec_id % 10) * 2.5::double + 5 as end_sec, vec_id, embedding::double[] as vec from embeddings),
v_meta as (select distinct track_id, recording_id, work_id from v_clips),
v_wide as (select e.vec_id as id, e.label::double as label_value, l.quality::double as quality, ln(1 + d.n_chars) as log_chars, e.embedding[33]::double + 0.5::double * e.embedding[40]::double as lin2
  from embeddings e left join labels l on e.vec_id = l.doc_id left join documents d on e.vec_id = d.doc_id),
v_targets as (select id, 'label_value' as target, label_value as y from v_wide union all select id, 'quality', quality from v_wide union all select id, 'log_chars', log_chars from v_wide union all select id, 'lin2', lin2 from v_wide),
v_notes as (select user_id as track_id, event_id as seq, (epoch_us(ts) - 1704067200000000) / 86400000000::double as onset, json_extract_string(props, '$.k')::double / 100 as dur, least(127, floor(value))::int as velocity, event_type from events),
v_controls as (select track_id, seq as event_id, onset as t, velocity as value from v_notes where event_type = 'error'),
v_sig as (select vec_id as track_id, i::int as frame, embedding[i + 1]::double as x from embeddings, (select unnest(range(64)) as i)),
v_chroma as (select vec_id // 50 as track_id, (vec_id % 50)::int as frame, i::int as pc, abs(embedding[i + 1]::double) as energy from embeddings, (select unnest(range(12)) as i)),
v_tempogram as (select vec_id // 50 as track_id, (vec_id % 50)::int as frame, i::int as lag, abs(embedding[i + 1]::double) as mag from embeddings, (select unnest(range(64)) as i))
"""

"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.decontamination import decontaminate
from strata.llm.language_id import UNKNOWN, held_out, identify, language_profiles
from strata.llm.near_dedup import drop_near_duplicates
from strata.llm.piece_coding import PieceModel, code_pieces
from strata.llm.shared import discard, stored, table
from strata.llm.substring_dedup import remove_repeats


def score_floors(taught: DataFrame) -> DataFrame:
    """(lang_pred, floor) from the rows of known language: three quartile ranges below the lower quartile of the scores.

    Junk among the rows moves the quartiles little.  Scores count to three
    places, so a language has at most 1001 different ones.
    """
    known = taught.where(F.col("lang") == F.col("lang_pred")).select("lang_pred", F.round("score", 3).alias("score"))
    quarters = known.groupBy("lang_pred").agg(F.percentile("score", F.lit(0.25)).alias("low"), F.percentile("score", F.lit(0.75)).alias("high"))
    return quarters.select("lang_pred", (F.col("low") - 3 * (F.col("high") - F.col("low"))).alias("floor"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; texts without a letter go, and those too far from the profile of their language."""
    teaches = ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    found = stored(identify(docs, language_profiles(docs.where(teaches))), "languages")
    near = found.join(F.broadcast(score_floors(found.where(teaches))), "lang_pred", "left")
    return near.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0) & (F.col("score") >= F.coalesce("floor", F.lit(0.0)))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, size=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has."""
    return remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids and the text decoded from them."""
    import public_tokenizers

    model = PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = code_pieces(docs, model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("piece_coding", encoding_stage),
]

#: No SQL has the near-duplicate components or the piece search; tests hold the stages and run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # the next stage's documents are written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

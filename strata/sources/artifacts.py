"""Saved indexes: a folder with vectors, records, a manifest and checksums."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.files import checksum_table, copy_files

SCHEMA_VERSION = 2
STAMP = r"^\d{8}T\d{6}Z$"
#: Fields that a manifest must have; fixed names.
MANIFEST_FIELDS = ("schema_version", "index_id", "name", "kind", "metric", "dimension", "ntotal", "normalized", "layer", "nlist", "nprobe", "factory_string", "created_at_utc")
KINDS = ("flat", "ivf", "factory")


def save_index(index: DataFrame, root: str, name: str, stamp: str, kind: str = "flat", layer: int | None = None, nlist: int | None = None, nprobe: int | None = None, factory: str | None = None) -> str:
    """Write ``index`` (id, vec, ...) to root/name/stamp, which must not exist; return the folder."""
    if not re.match(STAMP, stamp):
        raise ValueError(f"not a stamp: {stamp}")
    spark, folder = index.sparkSession, f"{root}/{name}/{stamp}"
    index.write.mode("errorifexists").parquet(f"{folder}/vectors")
    stored = spark.read.parquet(f"{folder}/vectors")
    manifest = stored.agg(F.count("*").alias("ntotal"), F.max(F.size("vec")).alias("dimension")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.concat(F.lit("vid-"), F.expr("uuid()")).alias("index_id"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit("cosine_ip").alias("metric"), "dimension", "ntotal",
        F.lit(True).alias("normalized"), F.lit(layer).cast("int").alias("layer"), F.lit(nlist).cast("int").alias("nlist"), F.lit(nprobe).cast("int").alias("nprobe"), F.lit(factory).cast("string").alias("factory_string"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at_utc"),
    )
    manifest.coalesce(1).write.option("ignoreNullFields", "false").json(f"{folder}/manifest")
    checksum_table(spark, f"{folder}/vectors").write.parquet(f"{folder}/checksums")
    return folder


def read_manifest(spark: SparkSession, folder: str) -> dict:
    row = spark.read.json(f"{folder}/manifest").first()
    return row.asDict() if row else {}


def validate_manifest(manifest: dict) -> None:
    missing = sorted(set(MANIFEST_FIELDS) - set(manifest))
    if missing:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"unsupported schema version {manifest['schema_version']}")
    if not str(manifest["index_id"]).startswith("vid-"):
        raise ValueError("the index id must start with vid-")
    if manifest["kind"] not in KINDS:
        raise ValueError(f"unknown kind {manifest['kind']}")
    if manifest["kind"] == "factory" and not manifest["factory_string"]:
        raise ValueError("a factory index needs its factory string")
    if manifest["nprobe"] is not None and manifest["nprobe"] <= 0:
        raise ValueError("nprobe must be positive")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(vectors, manifest) after checks of the manifest, checksums, row count and dimension."""
    manifest = read_manifest(spark, folder)
    validate_manifest(manifest)
    saved, now = spark.read.parquet(f"{folder}/checksums"), checksum_table(spark, f"{folder}/vectors")
    if not (saved.exceptAll(now).isEmpty() and now.exceptAll(saved).isEmpty()):
        raise ValueError("the files differ from their checksums")
    vectors = spark.read.parquet(f"{folder}/vectors")
    n, low, high = vectors.agg(F.count("*"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if n != manifest["ntotal"] or (n and (low, high) != (manifest["dimension"],) * 2):
        raise ValueError("the vectors do not match the manifest")
    return vectors, manifest


def index_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, stamp, ntotal) of the saved indexes below a root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    folder = F.regexp_extract(F.input_file_name(), r"^(.*)/manifest/[^/]*$", 1)
    return rows.select(folder.alias("folder"), "name", F.regexp_extract(folder, r"([^/]*)$", 1).alias("stamp"), "ntotal").where(F.col("stamp").rlike(STAMP))


def latest_index(spark: SparkSession, root: str, name: str) -> str:
    try:
        row = index_catalog(spark, root).where(F.col("name") == name).agg(F.max_by("folder", "stamp")).first()
    except Exception as e:
        raise FileNotFoundError(f"no index {name} in {root}") from e
    if not row or not row[0]:
        raise FileNotFoundError(f"no index {name} in {root}")
    return row[0]


def publish_index(spark: SparkSession, folder: str, uri: str) -> str:
    """Copy a checked index below ``uri`` byte by byte, compare the copy with the source, and only then write the pointer to it.

    A copy that was stopped goes on where it ended.  Where a file of the copy
    differs from the source's, the pointer stays what it was.
    """
    _, manifest = load_index(spark, folder)
    folder = folder.rstrip("/")
    target = f"{uri}/{manifest['name']}/{folder.rsplit('/', 1)[-1]}"
    read = copy_files(spark, folder, target)
    there = checksum_table(spark, target)
    if not (read.exceptAll(there).isEmpty() and there.exceptAll(read).isEmpty()):
        raise ValueError("the copy differs from its source")
    load_index(spark, target)
    pointer = [(SCHEMA_VERSION, manifest["name"], manifest["index_id"], target)]
    spark.createDataFrame(pointer, "schema_version int, name string, index_id string, folder string").coalesce(1).write.mode("overwrite").json(f"{uri}/{manifest['name']}-latest")
    return target


def load_latest(spark: SparkSession, uri: str, name: str) -> tuple[DataFrame, dict]:
    """The index that the pointer names, which must agree with it."""
    pointer = spark.read.json(f"{uri}/{name}-latest").first()
    if pointer.schema_version != SCHEMA_VERSION or pointer.name != name:
        raise ValueError("the pointer is of another version or name")
    vectors, manifest = load_index(spark, pointer.folder)
    if (manifest["name"], manifest["index_id"]) != (name, pointer.index_id):
        raise ValueError("the pointer and the manifest disagree")
    return vectors, manifest

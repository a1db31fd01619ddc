"""Feature tables that take one track at a time.

A write adds a batch of files in a folder per type and layer, and a list of what
it replaces: rows of the same track, type and layer in earlier batches.  One
rename of a small version file makes it visible.  Readers take the newest version:
its batches, without what later batches replaced.  A write that dies before the
rename leaves files that no version names.

    data/batch=B/feature_type=T/layer=L/    rows
    replaced/batch=B/feature_type=T/layer=L/  (track_id, old): rows of batch ``old`` that B replaces
    versions/00000007.json                  the live batches and the columns

Nothing is rewritten by a write, so it costs what it brings.  What is replaced is
joined by track, type, layer and batch; Spark broadcasts it while it is small,
and does not shuffle the vectors then.  :func:`compact_features` makes one batch
of all, and :func:`remove_old_batches` deletes what no kept version names.

The rename must not overwrite and must be atomic, as in HDFS.  If another writer
was first, the list of what is replaced is made again against its version.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_PARTS = ("feature_type", "layer")


class _Folder:
    """The few file-system calls that a version needs, on whatever file system the path is."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> bool:
        """Write a file under another name and rename it; false if there is one of that name."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        self.fs.mkdirs(self.at(name).getParent())
        try:
            self.context.rename(draft, self.at(name), self.no_options)
            return True
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise


def _versions(folder: _Folder) -> list[int]:
    return [int(n[:-5]) for n in folder.names("versions") if n.endswith(".json") and n[:-5].isdigit()]


def _version(folder: _Folder, number: int | None = None) -> dict:
    known = _versions(folder)
    if number is not None and number not in known:
        raise FileNotFoundError(f"no version {number} in {folder.path}")
    if not known:
        return {"version": 0, "batches": [], "schema": None}
    return folder.read(f"versions/{(max(known) if number is None else number):08d}.json")


def _merged(old: StructType | None, new: StructType) -> StructType:
    """The columns of both; a column keeps its type, and a batch without it has nulls."""
    fields = {f.name: f for f in (old.fields if old else [])}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the table and {f.dataType.simpleString()} here")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


def _read(spark: SparkSession, path: str, kind: str, batches: list[str], schema: StructType) -> DataFrame:
    """Rows of some batches, with the batch; filters on type and layer read only their folders."""
    full = StructType([f for f in schema.fields if f.name not in _PARTS]).add("batch", "string").add("feature_type", "string").add("layer", "integer")
    return spark.read.schema(full).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={b}" for b in batches])


_REPLACED = StructType().add("track_id", "string").add("old", "string")


def _live(spark: SparkSession, path: str, version: dict) -> DataFrame:
    rows = _read(spark, path, "data", version["batches"], StructType.fromJson(version["schema"]))
    later = version["batches"][1:]
    if not later:
        return rows
    gone = _read(spark, path, "replaced", later, _REPLACED).select(*_PARTS, "track_id", F.col("old").alias("batch"))
    return rows.join(gone, [*_PARTS, "track_id", "batch"], "left_anti")


def read_feature_rows(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the version given; a folder without any is an error."""
    found = _version(_Folder(spark, path), version)
    if not found["batches"]:
        raise FileNotFoundError(f"no features in {path}")
    return _live(spark, path.rstrip("/"), found).drop("batch")


def write_features(features: DataFrame, path: str, attempts: int = 20) -> int:
    """Add features (track_id, feature_type, layer, ...); return the version.

    Rows of a track, type and layer that are there already are replaced as a
    whole; all others stay.  Each row must have the three keys.  A column that
    the table lacks is added; another type for a column is an error.  Without
    rows nothing changes.
    """
    spark, path = features.sparkSession, path.rstrip("/")
    folder, batch = _Folder(spark, path), f"{uuid.uuid4().hex}"
    keys = ("track_id", *_PARTS)
    if lacking := [k for k in keys if k not in features.columns]:
        raise ValueError(f"features lack {', '.join(lacking)}")
    typed = features.withColumns({"track_id": F.col("track_id").cast("string"), "layer": F.col("layer").cast("int"), "feature_type": F.col("feature_type").cast("string")})
    typed = typed.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a feature row without {k}"))).otherwise(F.col(k)) for k in keys})
    schema = _merged(None, typed.schema)
    base = _version(folder)
    _merged(StructType.fromJson(base["schema"]) if base["schema"] else None, schema)  # before anything is written
    typed.write.partitionBy(*_PARTS).parquet(f"{path}/data/batch={batch}")
    if not [n for n in folder.names(f"data/batch={batch}") if n.startswith("feature_type=")]:
        return base["version"]
    own = _read(spark, path, "data", [batch], schema).select(*_PARTS, "track_id").distinct()
    for attempt in range(attempts):
        base = _version(folder) if attempt else base
        both = _merged(StructType.fromJson(base["schema"]) if base["schema"] else None, schema)
        if base["batches"]:
            before = _live(spark, path, base).select(*_PARTS, "track_id", F.col("batch").alias("old")).distinct()
            before.join(own, [*_PARTS, "track_id"], "left_semi").write.mode("overwrite").partitionBy(*_PARTS).parquet(f"{path}/replaced/batch={batch}")
        number = base["version"] + 1
        if folder.put(f"versions/{number:08d}.json", {"version": number, "batches": [*base["batches"], batch], "schema": json.loads(both.json())}):
            return number
    raise RuntimeError(f"other writers were first {attempts} times")


def compact_features(spark: SparkSession, path: str) -> int:
    """All live rows as one batch; return the version.  Fails if another writer commits meanwhile, and changes nothing then."""
    path = path.rstrip("/")
    folder = _Folder(spark, path)
    base, batch = _version(folder), uuid.uuid4().hex
    if len(base["batches"]) < 2:
        return base["version"]
    _live(spark, path, base).drop("batch").repartition(*_PARTS, F.pmod(F.xxhash64("track_id"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy(*_PARTS).parquet(f"{path}/data/batch={batch}")
    number = base["version"] + 1
    if not folder.put(f"versions/{number:08d}.json", {"version": number, "batches": [batch], "schema": base["schema"]}):
        raise RuntimeError("another writer was first; compact again")
    return number


def remove_old_batches(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the versions but for the newest ``keep``, and the batches that no kept version names; return their names.

    Not to be run beside a write, whose batch no version names yet.
    """
    if keep < 1:
        raise ValueError("keep must be at least 1")
    folder = _Folder(spark, path)
    known = _versions(folder)
    named = {b for n in sorted(known)[-keep:] for b in _version(folder, n)["batches"]}
    for n in sorted(known)[:-keep]:
        folder.fs.delete(folder.at(f"versions/{n:08d}.json"), False)
    gone = []
    for kind in ("data", "replaced"):
        for name in folder.names(kind):
            if name.startswith("batch=") and name[6:] not in named:
                folder.fs.delete(folder.at(f"{kind}/{name}"), True)
                gone.append(name[6:])
    return sorted(set(gone))

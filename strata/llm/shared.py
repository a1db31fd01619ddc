"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.session import scratch as new_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks that read the
    table, not the work before it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(name: str) -> Column:
    """A top-level column whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_of(name: str) -> Column:
    """An id column as a long; a null id stays null, and an id that is no integer ends the job with an error.

    Ids such as URLs are given numbers first, for example ``xxhash64`` of the
    URL, or the row number of a sorted table where the order of ids matters.
    """
    number = plain(name).try_cast("long")
    return F.when(plain(name).isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit(f"{name} is no integer: "), plain(name).cast("string")))).otherwise(number)


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators work on, under fixed names; see :func:`id_of` for odd ids."""
    return docs.select(id_of(id_col).alias("doc_id"), plain(text_col).cast("string").alias("text"))


def packed(docs: DataFrame, *left_out: str) -> Column:
    """All columns but some as one struct, by position, so that any name and any number of them pass through a task."""
    return F.struct(*[plain(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in left_out], F.lit(0).alias("none"))


def unpacked(docs: DataFrame, row: str, **new: Column) -> list[Column]:
    """The columns of ``docs`` again from the struct of :func:`packed`, with some replaced."""
    return [(new[c] if c in new else F.col(f"{row}.c{i}")).alias(c) for i, c in enumerate(docs.columns)]

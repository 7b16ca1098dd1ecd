"""Pieces that the training-data operators share."""

from __future__ import annotations

import contextlib
import re
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text that isn't null, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares (spark.checkpoint.dir). What is in there goes when the session's JVM ends.

    Without that setting a session on one machine has its own below the warehouse; any other one can't tell what its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    own = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df, computed and read back from the shared folder, so that no lineage is left above it.

    instead_of: an earlier result of cut that nothing reads any more once df is written; its folder goes.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    for made in getattr(_open, "made", []):
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    if instead_of is not None:
        remove(spark, instead_of._folder)
    return out


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Folders that cut has written within the block go at its end, but those of the results that `keep` was called with."""
    made, kept = [], []
    _open.made = [*getattr(_open, "made", []), made]
    try:
        yield lambda df: kept.append(df._folder) or df
    finally:
        _open.made = _open.made[:-1]
        for folder in made:
            if folder not in kept:
                remove(spark, folder)


def read_in_place(docs: DataFrame) -> bool:
    """Whether each row of docs is a row of a file that it is read from: a scan, of which rows may be left out, but none made."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and all(c.lower() != "_metadata" for c in docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key): every row of docs as a struct, and what names it, the file it is in and its place there.

    Both stay as they are however often and in whatever splits the rows are read, and columns of any name are out of the way. What
    isn't read from files alone (a join, rows from the driver) is written first.
    """
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("_metadata.file_path", "_metadata.row_index").alias("key")
    if read_in_place(docs):
        with contextlib.suppress(AnalysisException):  # a format whose files don't number their rows
            out = docs.select(row, key)
            return out if out.schema else out
    return cut(docs.select(row)).select("row", key)

"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Paths made within each open scope, and the path that a materialized table is read from.
_SCOPES: list[list[str]] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local master does without it, in a folder of our own: executors elsewhere wouldn't see that."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sheetloom-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; it is deleted when its scope, if any, or the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables that were made in it are deleted, but for those materialized ones that are kept, which then belong to the scope around it.

    What is returned from it must read kept tables only.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_PATHS[df])
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            if path not in kept:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
            elif _SCOPES:
                _SCOPES[-1].append(path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows per Arrow batch, so that a batch of long texts stays small in a worker's memory. Plans are made lazily, so this stays set; a session that sets its own number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(rows))


def text_mark() -> Column:
    """A 64-bit hash of the column ``text``, which tells rows that repeat a doc_id apart; null for null."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for those whose (doc_id, text_mark) is among ``keys``'; nulls equal nulls."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_mark").alias("_mark"))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & text_mark().eqNullSafe(F.col("_mark")), "left_anti")


def without(docs: DataFrame, judged: DataFrame, gone: str, name: str) -> DataFrame:
    """The rows of ``docs`` but for those that ``judged``, which has a row (doc_id, text_mark, ``gone``) for each of them, tells to drop.

    Ids all of whose rows go are dropped by id alone; only where an id has rows that stay, or is null, texts' hashes tell them apart. The
    ids are written first, so that their true size decides how they are joined.
    """
    judged = materialize(judged.select("doc_id", "text_mark", F.col(gone).alias("gone")), name)
    ids = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("gone").alias("whole"), F.bool_or("gone").alias("any")).where("any")
    ids = materialize(ids.select("doc_id", "whole"), name)
    left = docs.join(ids.where("whole").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    some = judged.where("gone").join(ids.where("whole"), "doc_id", "left_anti").select("doc_id", "text_mark").distinct()
    some = materialize(some, name)
    return left if some.isEmpty() else without_rows(left, some)

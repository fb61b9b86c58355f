"""Helpers shared by the corpus operators: shared storage, text rules, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the word rules: white space is U+0020 and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the session's ``spark.checkpoint.dir``. A local session (tests) that
    has none gets a temporary one; a cluster session without it is an error,
    since a machine-local folder would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)
    return path


def release(*frames: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path in _written:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            _written.remove(path)


def _remove_written() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is None or spark.sparkContext._jsc is None:
            return
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may already be gone; the files stay then
        pass


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet (with the writer's options) to the shared folder and read it.

    A lost executor then costs a re-read, not a recomputation, and joins on the
    result have plain exchanges on both sides, which adaptive execution can split.
    The write's own shuffle files go when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-white-space characters (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repo_file(name: str) -> str:
    return str(Path(__file__).with_name(name))

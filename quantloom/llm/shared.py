"""Where jobs keep intermediate tables, and small pieces that several operators use."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}
_HOOKED: set[str] = set()
_SCRATCH: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with its file system named.

    Only where that is unset and the master is local, as in tests on one machine, a temporary
    folder is taken, one an application; on a cluster that would lose rows, and it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quantloom-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; it is deleted when the driver's Python ends."""
    application = spark.sparkContext.applicationId
    if application not in _HOOKED:
        _HOOKED.add(application)
        atexit.register(_release_at_end, spark)
    return f"{shared_folder(spark)}/{application}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as a table in the shared folder and read again.

    This cuts the lineage: the files outlive lost executors, and what follows reads only
    the columns that it needs.  `free` deletes tables that nothing reads any more, `release`
    all of an application's tables.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._settled = path
    for made in _SCRATCH:
        made.append(again)
    return again


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that `settle` wrote inside, but for those taken out of the list that it gives."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        free(*made)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*tables: DataFrame) -> None:
    """Deletes the files of `tables`, as `settle` returned them; what was computed from them must be settled itself."""
    for t in tables:
        _delete(t.sparkSession, t._settled)


def release(spark: SparkSession) -> None:
    """Deletes every table that `settle` wrote for this application."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def _release_at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the session is gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % n


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` alone, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)

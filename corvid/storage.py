"""Where intermediate tables live.

Executors may be lost at any time, so lineage is cut by writing a table into a folder that all
executors share: the one the cluster names in ``spark.checkpoint.dir``. Only a local session
without that setting gets a temporary folder of its own. Tables stay until :func:`discard` is called, since
results read them whenever they are asked for.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_KNOWN: dict[tuple, tuple] = {}
# Bytes of files up to which a table may be sent to all executors: rows may take some 30 times as much.
_SMALL = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI that Spark's writers accept."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corvid-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/corvid/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes what this application has put at fresh paths, and returns how many there were.

    For when all results that come from there have been written elsewhere: they can't be read after it.
    """
    app = spark.sparkContext.applicationId
    made = _MADE.pop(app, [])
    for key in [k for k in _KNOWN if k[0] == app]:
        del _KNOWN[key]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(conf).delete(there, True)
    return len(made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read from there.

    Files hold keys that repeat in a small part of the room that their rows take, and Spark would send a table to all executors,
    by way of the driver, for the size of its files. Only tables that are small as rows stay free to go there.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.hint("merge") if _bytes(df.sparkSession, path) > _SMALL else back


def remembered(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gave for ``key`` in this application; made anew after :func:`discard`, or once a table that it wrote is gone.

    For relations that several queries over the same tables are about; what they rest on is stored.
    """
    app = spark.sparkContext.applicationId
    full = (app, *key)
    if full in _KNOWN and all(_there(spark, path) for path in _KNOWN[full][1]):
        return _KNOWN[full][0]
    before = len(_MADE.get(app, []))
    made = make()
    _KNOWN[full] = (made, _MADE.get(app, [])[before:])
    return made


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

"""Lineage cuts that survive lost executors.

An intermediate result that several later steps read is written as a Parquet table under the folder
that the session names in ``spark.checkpoint.dir`` and read back.  The folder is shared by driver and
executors, so neither a lost executor nor a retried task can lose part of it.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables and folders that no open scope holds.
_PROCESS: list[str] = []
#: Those of the open scopes of this thread or task, innermost last; others' scopes never get or delete its tables.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: Where a materialised DataFrame lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, one of our own, which only a local session can share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="seqloom-shared-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/seqloom/{tag}-{uuid.uuid4().hex}"
    _innermost().append(path)
    return path


def _innermost() -> list[str]:
    held = _SCOPES.get()
    return held[-1] if held else _PROCESS


def delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def release(spark: SparkSession) -> int:
    """Delete all intermediates that no open scope holds, once no DataFrame that reads them is needed any more; their number."""
    gone = 0
    while _PROCESS:
        gone += delete(spark, _PROCESS.pop())
    return gone


class Scratch:
    """The tables of a ``scratch`` block."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """Leave these materialised tables to the scope outside."""
        self.kept |= {_PATHS[t] for t in tables if t in _PATHS}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete the intermediates that are made in this block at its end, but for those kept; what the block returns must
    read kept tables only."""
    own: list[str] = []
    entered = _SCOPES.set((*_SCOPES.get(), own))
    scope = Scratch()
    try:
        yield scope
    finally:
        _SCOPES.reset(entered)
        for path in own:
            if path in scope.kept:
                _innermost().append(path)
            else:
                delete(spark, path)


def materialise(df: DataFrame, tag: str, codec: str = "lz4") -> DataFrame:
    """Write ``df`` once, return a scan of what was written (same schema, also when empty)."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def join_small(
    big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "left", max_rows: int = 20_000, salts: int = 32
) -> DataFrame:
    """Equi-join ``big`` with a table that is usually small, without ever shuffling a hot key to one task.

    ``small`` has to be materialised: its rows are counted.  Up to ``max_rows`` rows it is broadcast; beyond
    that it is copied ``salts`` times and ``big`` is dealt over the copies by ``spread``, so that a key with a
    third of all rows meets ``salts`` tasks.  Nulls in keys match nulls.
    """
    left, right = big, small
    renamed = {k: f"_sl_r_{k}" for k in keys}
    for k, r in renamed.items():
        right = right.withColumnRenamed(k, r)
    on = None
    for k, r in renamed.items():
        term = left[k].eqNullSafe(right[r])
        on = term if on is None else on & term
    if small.count() <= max_rows:
        return left.join(F.broadcast(right), on, how).drop(*renamed.values())
    left = left.withColumn("_sl_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_sl_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on & (F.col("_sl_salt") == F.col("_sl_rsalt")), how).drop(*renamed.values(), "_sl_salt", "_sl_rsalt")

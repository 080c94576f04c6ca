"""Tables written to the shared folder to cut lineage, so that iterative operators restart from the last round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Tables of stash() that forget() has not deleted.
_made: set[str] = set()

#: Rows up to which a narrow side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only on a local master that has none set."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="normgraph-"))


def stash(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/normgraph-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stash_path = path
    _made.add(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.discard(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of stash() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stash_path)


def forget_all(spark: SparkSession) -> None:
    """Deletes all tables that operators have written so far, once no result of theirs is read any more. What a process leaves behind otherwise
    lies in the shared folder under names that start with normgraph-."""
    for path in sorted(_made):
        _delete(spark, path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast in joins if it has at most `limit` rows now; for a side that is joined again and again."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_sized(df: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a side that is broadcast if it has at most `limit` rows, and shuffled beyond."""
    return df.join(sized(side, limit), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Shared folders, tables written to cut lineage, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only on a local master without it."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="normgraph-")
    return _own[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/normgraph-{uuid.uuid4().hex[:12]}-{name}"


#: Bytes and rows of an Arrow batch at most, so that long texts do not fill a worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def hold_settings(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES and BATCH_ROWS, unless it has lower bounds, and the number of partitions that files are
    cut into: unset, it follows the cores alive at each read, so that an executor lost between two reads would number rows anew."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not digits or int(digits) <= 0 or int(digits) > most:
            spark.conf.set(key, str(most))


#: On a folder of the local file system Hadoop starts a chmod process for each file, for each file of checksums and for each task's folder, and such a
#: process is for a moment a second one with all of the executor's memory. So tables have no files of checksums; the pages' own are verified instead.
_WRITE = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_READ = {"parquet.page.verify-checksum.enabled": "true"}


def stash(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later steps restart from it if an executor is lost. narrow: few bytes from each of many
    tasks, which a shuffle puts into as few files as their size asks for; the order of rows is lost."""
    hold_settings(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    (df.hint("rebalance") if narrow else df).write.options(**_WRITE).parquet(path)
    back = df.sparkSession.read.options(**_READ).schema(df.schema).parquet(path)
    back._stash_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of stash() that no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stash_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    hold_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the batches, a few at a time so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


class Sink:
    """Collects output rows column by column and hands them on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4000):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    @property
    def full(self) -> bool:
        return len(self.columns[0]) >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out


#: Rows up to which a side of a join is broadcast: a few numbers a row, so about 100 MB at most.
BROADCAST_ROWS = 2_000_000


def join_sized(df: DataFrame, side: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a side of narrow rows: broadcast if it has at most so many of them, by shuffle beyond."""
    few = side.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(side) if few else side, on, how)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """doc_id, text, y of the rows whose label may be learnt: labelled, with crc32(doc_id) mod modulus other than remainder.
    Of several labels of a document the largest holds; null labels, ids and texts do not count."""
    known = labels.where(~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max(label).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL")
    return join_sized(docs.select("doc_id", "text").where("text IS NOT NULL"), known, "doc_id")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text (null: empty) leaves this remainder."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded_sample(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """A share of df's rows, somewhat over `most` of them if it has more, picked by the hash `pick` of the columns: the same rows in each run,
    whatever the partitions. Rows of equal columns are picked together, so first_picked() has to follow for a bound."""
    share = min(1.0, 1.1 * most / max(df.count(), 1))
    picked = df.withColumn("pick", F.xxhash64(*columns, F.lit(17)))
    return picked.where(F.shiftrightunsigned("pick", 12) < int(share * (1 << 52))) if share < 1 else picked


def first_picked(df: DataFrame, most: int, *ties: str) -> DataFrame:
    """The `most` rows of least `pick`, at most."""
    return df.orderBy("pick", *ties).limit(most).drop("pick")

"""Harmonic packing of token sequences.

Each document's ids, closed by an end id, are cut into pieces: full capacities first, of the rest a half, a quarter and an
eighth of the capacity where they fit, then what is left. A piece of length L is of class k = capacity // L, so L lies in
(capacity / (k + 1), capacity / k] and any k pieces of a class fit a bin. Each worker closes a bin of a class whenever it has k pieces of it, on its own;
the bins of the workers before it give their numbers. Fewer than k pieces of each class are left on a worker: the counts by worker and class, summed up, turn
those into ranks, and k successive ranks share a bin. Fewer than k pieces of each class
remain then, about 10,000 pieces at most for a capacity of 2048 whatever the input, and are packed by first fit, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import Sink, join_sized, read, rows, stash

CAPACITY, END_ID = 2048, 1
_PIECE = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "class", "local", "bin", "offset", "filled")]
)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for part in (2, 4, 8):
        if n >= capacity // part > 0:
            out.append(capacity // part)
            n -= capacity // part
    return out + [n] * (n > 0)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with their class. Those of a worker's own bins have the bin's number there, their offset and the bin's length;
    the others have their number among what the worker has left of the class."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, worker, out = encoder(path), TaskContext.get().partitionId(), Sink(_PIECE, 8000)
        waiting: dict[int, list[tuple]] = {}
        bins = 0
        for doc_id, text in rows(batches, "doc_id", "text"):
            ids = np.append(bpe.encode(text), np.array([end_id], "<u4"))
            at = 0
            for length in cut(len(ids), capacity):
                k = capacity // length
                held = waiting.setdefault(k, [])
                held.append((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
                at += length
                if len(held) == k:
                    offset, filled = 0, sum(p[2] for p in held)
                    for p in held:
                        out.add(*p, worker, k, None, bins, offset, filled)
                        offset += p[2]
                    bins += 1
                    held.clear()
            if out.full:
                yield out.take()
        for k, held in waiting.items():
            for local, p in enumerate(held):
                out.add(*p, worker, k, local, None, None, None)
        yield out.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in _PIECE))


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, longest first."""
    room: list[int] = []
    bins = [0] * len(lengths)
    low = 0  # bins before it are full
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        while low < len(room) and not room[low]:
            low += 1
        b = next((b for b in range(low, len(room)) if room[b] >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= lengths[i]
        bins[i] = b
    return bins


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A sequence is padded to the capacity unless its length is a power of two. docs has doc_id and text; more columns are ignored,
    rows with one doc_id are packed each on its own, a null text is the end id alone, a null doc_id stays null. No documents: no rows.
    """
    found = stash(pieces(docs, capacity, end_id, vocabulary), "pieces")
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "filled"]
    # a row a worker
    own = stash(found.where("bin IS NOT NULL").groupBy("worker").agg((F.max("bin") + 1).alias("n")), "workers")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bases = own.select("worker", (F.sum("n").over(Window.orderBy("worker").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    closed = join_sized(found.where("bin IS NOT NULL"), bases, "worker").withColumn("sequence_id", F.col("base") + F.col("bin"))
    left = found.where("bin IS NULL").drop("bin", "offset", "filled")
    by_class = Window.partitionBy("class")
    counts = left.groupBy("class", "worker").agg(F.count("*").alias("n")).select(
        "class",
        "worker",
        (F.sum("n").over(by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    # one row a class: at most 2 * sqrt(capacity)
    whole = left.groupBy("class").agg(F.floor(F.count("*") / F.first("class")).alias("bins")).select(
        "class",
        "bins",
        (F.lit(total) + F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bins")).alias("base"),
        (F.lit(total) + F.sum("bins").over(Window.partitionBy())).alias("first"),
    )
    ranked = left.join(counts, ["class", "worker"]).join(F.broadcast(whole), "class").withColumn("rank", F.col("before") + F.col("local"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("class")))
    full = ranked.where("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    inside = Window.partitionBy("sequence_id")
    shared = full.withColumns(
        {
            "offset": F.coalesce(F.sum("length").over(inside.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "filled": F.sum("length").over(inside),
        }
    )

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        left = pd.concat(held).sort_values(["class", "rank"], ignore_index=True)
        left["bin"] = first_fit(left["length"].tolist(), capacity)
        left["offset"] = left.groupby("bin")["length"].cumsum() - left["length"]
        left["filled"] = left.groupby("bin")["length"].transform("sum")
        left["sequence_id"] = left["bin"] + left["first"]
        yield left[result]

    few = ranked.where("bin >= bins").select(*result[:5], "class", "rank", "first").repartition(1)
    few = few.mapInPandas(rest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, filled long")
    out = closed.select(result).unionByName(shared.select(result)).unionByName(few)
    power = F.pow(F.lit(2), F.round(F.log2("filled"))).cast("long") == F.col("filled")
    return out.withColumn("padded_length", F.when(power, F.col("filled")).otherwise(F.lit(capacity).cast("long"))).drop("filled")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))

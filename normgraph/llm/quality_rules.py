"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Byte n-grams (3 and 4) of each text are hashed into BUCKETS. Two multinomials over the buckets are fitted over all
documents: the raw corpus's, smoothed by one count a bucket, and the trusted target's (documents labelled as of good quality), smoothed
by that count times the target's share of the corpus, so that a bucket that nothing has reached is even at any size. A group of
copies counts as about one document in each, whatever its size: a document weighs 1 / n, n being the number of documents that share all but PASSED
of the MINIMA minima of its five-word shingles (in the target, of trusted documents). A document's score is the mean log ratio over its n-grams; it
is kept if that is at least THRESHOLD. No chance enters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, forget, join_sized, read, rows, stash
from .jaccard_join import minhashes
from .shingles import mix, shingles
from .stats import as_bytes, base_counts

BUCKETS = 1 << 20
#: A text is kept if its n-grams are, in the geometric mean, at least half as likely in the target as in the corpus. Stated, not fitted.
THRESHOLD = math.log(1 / 2)
MIN_WORDS, MAX_REPEAT = 20, 30
#: Minima by which copies are counted, and how many of them may differ: documents of similarity 0.8 agree in 11 of 16 with 92 %, of 0.5 with 11 %.
MINIMA, PASSED = 16, 5
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of each n-gram of a text's bytes; texts of fewer than 3 bytes have none."""
    if len(data) < 3:
        return np.empty(0, np.uint32)
    wide = data.astype(np.uint32)
    three = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    four = three[:-1] | (wide[3:] << np.uint32(24))
    return np.concatenate([(three * np.uint32(0x9E3779B1)) >> _SHIFT, (four * np.uint32(0x85EBCA77)) >> _SHIFT])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's weighted counts by bucket: at most BUCKETS rows."""
    total = np.zeros((2, BUCKETS))
    held: list[tuple[np.ndarray, float, float]] = []

    def pour() -> None:
        if not held:
            return
        found, sizes = np.concatenate([h[0] for h in held]), [len(h[0]) for h in held]
        for k in (0, 1):
            total[k] += np.bincount(found, np.repeat([h[k + 1] for h in held], sizes), BUCKETS)
        held.clear()

    size = 0
    for text, target, raw in rows(batches, "text", "target", "raw"):
        found = buckets(as_bytes(text))
        held.append((found, target, raw))
        size += len(found)
        if size > 1 << 21:
            pour()
            size = 0
    pour()
    at = np.flatnonzero(total.sum(0))
    for low in range(0, len(at), 1 << 16):
        part = at[low : low + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(total[0, part]), pa.array(total[1, part])],
            names=["bucket", "target", "raw"],
        )


def _share(n: Column) -> Column:
    """1 / n in steps of 2^-30, so that sums do not depend on their order."""
    return F.when(n > 0, F.round(F.lit(float(1 << 30)) / n) / (1 << 30)).otherwise(0.0)


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, trusted, and the MINIMA keys of the text's five-word shingles; a text without words has itself for a shingle."""
    salt = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
    out = Sink(pa.schema([("row", pa.int64()), ("trusted", pa.int32()), ("keys", pa.list_(pa.int64()))]), 2000)
    for row, trusted, text in rows(batches, "row", "trusted", "text"):
        found = shingles(text)
        if not len(found):
            found = np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)
        out.add(row, trusted, mix(minhashes(found, MINIMA) ^ salt).view(np.int64))
        if out.full:
            yield out.take()
    yield out.take()


def _size(counts: str) -> Column:
    """How many documents share all but PASSED of a document's minima at least; counts lists those that are shared at all."""
    alone = MINIMA - F.size(counts)
    return F.when(alone > PASSED, 1).otherwise(F.element_at(F.sort_array(counts), F.greatest(PASSED + 1 - alone, F.lit(1))))


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """row, target, raw: the weights of the rows of docs (doc_id, text) in the two multinomials, where they are not 0 and 1; row numbers them as
    monotonically_increasing_id does. Minima are counted before the shuffle, so a group of any size is a row a task."""
    known = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(1))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").where("text IS NOT NULL")
    marked = join_sized(texts, known, "doc_id", "left").select("row", F.coalesce("trusted", F.lit(0)).alias("trusted"), "text")
    keyed = stash(marked.mapInArrow(_minima, "row long, trusted int, keys array<long>"), "minima")
    each = keyed.select("row", F.explode("keys").alias("key"), "trusted")
    counts = stash(each.groupBy("key").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).where("n > 1"), "shared")
    shared = join_sized(each.drop("trusted"), counts, "key").groupBy("row").agg(F.collect_list("n").alias("n"), F.collect_list("t").alias("t"))
    sized = keyed.select("row", "trusted").join(shared.select("row", _size("n").alias("n"), _size("t").alias("t")), "row", "left")
    sized = sized.select(
        "row",
        (F.col("trusted") * _share(F.coalesce("t", F.lit(1)))).alias("target"),
        _share(F.coalesce("n", F.lit(1))).alias("raw"),
    )
    out = stash(sized.where("target > 0 OR raw < 1"), "weights")
    forget(keyed, counts)
    return out


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket. docs has doc_id and text, trusted the doc_ids of the target; counts cover every document."""
    docs = docs.select("doc_id", "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text").where("text IS NOT NULL")
    weighed = join_sized(numbered, weights(docs, trusted), "row", "left").select(
        "text",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        F.coalesce("raw", F.lit(1.0)).alias("raw"),
    )
    counts = weighed.where("raw > 0").mapInArrow(_count, "bucket int, target double, raw double").groupBy("bucket").agg(
        F.sum("target").alias("target"),
        F.sum("raw").alias("raw"),
    )
    found = counts.toArrow()  # BUCKETS rows at most
    table = np.zeros((2, BUCKETS))
    table[0, found["bucket"].to_numpy()] = found["target"].to_numpy()
    table[1, found["bucket"].to_numpy()] = found["raw"].to_numpy()
    if not table[0].any():
        return np.zeros(BUCKETS, np.float32)
    share = table[0].sum() / table[1].sum()
    return (np.log(table[0] + share) - np.log(table[1] + 1) - np.log(share)).astype(np.float32)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("score", pa.float64()),
    ]
)
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(text: str | None, ratios: np.ndarray, threshold: float = THRESHOLD) -> tuple:
    data, words, chars, symbols, lines, repeats = base_counts(text)
    found = buckets(data)
    score = float(ratios[found].mean(dtype=np.float64)) if len(found) else 0.0
    failed = words < MIN_WORDS or 100 * repeats > MAX_REPEAT * words
    return words, chars, symbols, lines, repeats, failed, not failed and score >= threshold, score


def _ratios(docs: DataFrame, trusted: DataFrame) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(log_ratios(docs, trusted))


def assess(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs (doc_id, text; more columns are ignored): counts, base_failed, score and kept.

    A null or empty text has no words, fails the base rules and scores 0. Rows with one doc_id are judged each on its own; a null
    doc_id is never trusted. Without trusted n-grams all ratios are 0 and only the base rules decide.
    An empty table gives no rows."""
    shared = _ratios(docs, trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(_SCHEMA)
        for doc_id, text in rows(batches, "doc_id", "text"):
            out.add(doc_id, *judge(text, shared.value, threshold))
            if out.full:
                yield out.take()
        yield out.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules reject."""
    shared = _ratios(docs, trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() for x in batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([judge(t, shared.value, threshold)[6] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of which every label says good quality."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(read(spark, sf_dir, "documents"), trusted_ids(read(spark, sf_dir, "labels")))

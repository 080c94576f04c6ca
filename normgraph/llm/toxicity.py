"""Toxicity by a linear model over character n-grams scaled by naive Bayes log-count ratios.

N-grams of 3 to 7 characters (code points) of the lower-case text, words led by a blank, are hashed into BUCKETS. For each bucket, the log of the ratio
of its smoothed shares of toxic and other training documents is counted over all of them; used are all buckets whose ratios are SIGMAS standard
errors or more from even. A logistic model, fitted on a bounded sample, weighs log(1 + count) times that ratio.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, bounded_sample, first_picked, held_out, labelled, partitions, read, rows

#: SAMPLE: rows of the logistic fit at most, which bounds what reaches the driver.
BUCKETS, SIGMAS, SAMPLE = 1 << 20, 3.0, 4_000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Entries of the sampled rows that are taken at once.
BLOCK = 1 << 20
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)
_ODD = np.random.default_rng(3).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram."""
    points = np.frombuffer((" " + " ".join((text or "").lower().split()) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, h = [], points
    for n in range(2, 8):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * _BASE + points[n - 1 :]
        if n >= 3:
            out.append(((h ^ (h >> np.uint64(29))) * _ODD[n]) >> _SHIFT)
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


#: Ranges of buckets; a task's counts of a range are one row.
RANGES = 256
_COUNTS = pa.schema([("part", pa.int32()), ("counts", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's numbers of other and toxic documents with each bucket, a row for each range of buckets, and (part -1) of all."""
    total, n = np.zeros((2, BUCKETS), "<u4"), np.zeros(2, "<u4")
    for text, y in rows(batches, "text", "y"):
        total[y][np.unique(buckets(text))] += 1
        n[y] += 1
    if n.any():
        width = BUCKETS // RANGES
        parts = [n.tobytes(), *(total[:, k * width : (k + 1) * width].tobytes() for k in range(RANGES))]
        for low in range(0, len(parts), 32):
            some = parts[low : low + 32]
            yield pa.RecordBatch.from_arrays([pa.array(range(low - 1, low - 1 + len(some)), pa.int32()), pa.array(some, pa.binary())], schema=_COUNTS)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the tasks' counts of each range, as 64-bit numbers. Rows come sorted by range and are added as they pass."""
    now, total = None, np.empty(0)
    whole = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=_COUNTS)
    for part, counts in rows(batches, "part", "counts"):
        if part != now:
            if now is not None:
                yield whole()
            now, total = part, np.zeros(len(counts) // 4, "<i8")
        total += np.frombuffer(counts, "<u4")
    if now is not None:
        yield whole()


def document_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of other and toxic documents with each bucket, and of all; over every training row."""
    kind = "part int, counts binary"
    counted = train.select("text", "y").mapInArrow(_count, kind).repartition(partitions(train.sparkSession), "part").sortWithinPartitions("part")
    found = counted.mapInArrow(_sum, kind).toArrow()  # RANGES + 1 rows
    counts, total = np.zeros((2, RANGES, BUCKETS // RANGES), np.int64), np.zeros(2, np.int64)
    for part, data in zip(found["part"].to_pylist(), found["counts"].to_pylist(), strict=True):
        both = np.frombuffer(data, "<i8").reshape(2, -1)
        if part < 0:
            total = both[:, 0]
        else:
            counts[:, part] = both
    return counts.reshape(2, BUCKETS), total


def count_ratios(train: DataFrame) -> np.ndarray:
    """The log-count ratio of each bucket, 0 where it is not significant; over every training row."""
    counts, total = document_counts(train)
    (clean, toxic), (all_clean, all_toxic) = counts, total.tolist()
    p, q = (toxic + 0.5) / (all_toxic + 1), (clean + 0.5) / (all_clean + 1)
    r = np.log(p) - np.log(q)
    error = np.sqrt(np.maximum(1 / (toxic + 0.5) - 1 / (all_toxic + 1), 0) + np.maximum(1 / (clean + 0.5) - 1 / (all_clean + 1), 0))
    use = (clean + toxic > 0) & (np.abs(r) >= SIGMAS * np.maximum(error, 1e-9))
    return np.where(use, r, 0).astype(np.float32)


def inputs(text: str | None, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The significant buckets of a text and how often each occurs, counted up to 32,767."""
    found = buckets(text)
    found, counts = np.unique(found[ratios[found] != 0], return_counts=True)
    return found.astype(np.int32), np.minimum(counts, 32_767).astype(np.int16)


def minimise(f, x: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving; f gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, d, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        if steps:
            s, d, _ = steps[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, rho), a in zip(steps, reversed(alphas), strict=True):
            q += (a - rho * (d @ q)) * s
        slope, size = float(g @ q), 1.0 if steps else 1 / max(1.0, float(np.linalg.norm(g)))
        while True:
            new, g_new = f(x - size * q)
            if new <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, d = -size * q, g_new - g
        if size < 1e-10 or value - new < 1e-8:
            return x + s if new < value else x
        x, value, g = x + s, new, g_new
        if s @ d > 1e-12:
            steps = [*steps[1 - memory :], (s, d, 1 / float(s @ d))]
    return x


def logistic_loss(ends: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, penalty: float):
    """Ridge logistic loss and gradient over sparse rows; row i holds the entries up to ends[i]. The last weight is the offset."""
    cuts = [0]
    while cuts[-1] < len(y):  # some rows, or one of more than BLOCK entries
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + BLOCK, "right"))))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, gradient = 0.0, np.zeros(len(w))
        for a, b in zip(cuts, cuts[1:], strict=False):
            low, high = ends[a - 1] if a else 0, ends[b - 1]
            x, c, sizes = value[low:high], column[low:high], np.diff(ends[a:b], prepend=low)
            z, some = np.full(b - a, w[-1]), sizes > 0
            if high > low:
                z[some] += np.add.reduceat(x * w[c], (ends[a:b] - sizes - low)[some])
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:b]
            gradient[:-1] += np.bincount(c, x * np.repeat(error, sizes), len(w) - 1)
            gradient[-1] += error.sum()
            total += float((np.logaddexp(0, z) - y[a:b] * z).sum())
        gradient /= len(y)
        gradient[:-1] += penalty * w[:-1]
        return total / len(y) + penalty / 2 * float(w[:-1] @ w[:-1]), gradient

    return loss


def fit_logistic(ends: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge logistic regression over sparse rows (see logistic_loss; at: buckets below size)."""
    if not len(y) or y.min() == y.max():
        return np.zeros(size), -4.0 if not len(y) or y.min() == 0 else 4.0
    place = np.zeros(size, np.int32)
    for low in range(0, len(at), BLOCK):
        place[at[low : low + BLOCK]] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    column = np.empty_like(at)
    for low in range(0, len(at), BLOCK):
        column[low : low + BLOCK] = place[at[low : low + BLOCK]]
    w = minimise(logistic_loss(ends, column, value, y, penalty), np.zeros(len(used) + 1))
    out = np.zeros(size)
    out[used] = w[:-1]
    return out, float(w[-1])


def sampled(train: DataFrame, ratios: np.ndarray, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ends, buckets, values and y of `sample` training rows at most."""
    shared = train.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(pa.schema([("pick", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int16()))]), 500)
        for pick, text, y in rows(batches, "pick", "text", "y"):
            out.add(pick, y, *inputs(text, shared.value))
            if out.full:
                yield out.take()
        yield out.take()

    picked = bounded_sample(train.select("doc_id", "text", "y"), sample, "doc_id", "text")
    got = first_picked(picked.mapInArrow(run, "pick long, y int, at array<int>, n array<short>"), sample, "y").toArrow()
    flat = lambda c, kind: np.concatenate([np.empty(0, kind), *(x.flatten().to_numpy(zero_copy_only=False) for x in got[c].chunks)])
    ends = np.cumsum(np.array([n for x in got["at"].chunks for n in np.diff(x.offsets.to_numpy())], np.int64))
    at, counts, y = flat("at", np.int32), flat("n", np.int16), got["y"].to_numpy().astype(float)
    del got, flat  # the driver holds six bytes an entry here, and four more for its value
    value = np.empty(len(at), np.float32)
    for low in range(0, len(at), BLOCK):
        value[low : low + BLOCK] = np.log1p(counts[low : low + BLOCK], dtype=np.float32) * ratios[at[low : low + BLOCK]]
    return ends, at, value, y


def fit(train: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weight of log(1 + count) of each bucket, and the offset. Ratios count all training rows, the logistic fit `sample` rows at most.
    A label of 1 or more is toxic, any other is not."""
    train = train.withColumn("y", (F.col("y") >= 1).cast("int"))
    ratios = count_ratios(train)
    weights, offset = fit_logistic(*sampled(train, ratios, sample), BUCKETS)
    return (weights * ratios).astype(np.float32), offset


def score(text: str | None, weights: np.ndarray, offset: float) -> float:
    found = buckets(text)
    found, counts = np.unique(found[weights[found] != 0], return_counts=True)
    z = float(np.log1p(counts) @ weights[found].astype(float)) + offset
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text; more columns are ignored).

    The score depends on the text alone: equal texts score alike, a null text as an empty one. Rows whose
    crc32(doc_id) mod 5 is 0 are held out of training; of several labels of a document the largest holds. Without labels, or with one
    kind only, every score is near that kind's. An empty table gives no rows."""
    weights, offset = fit(labelled(docs, labels, "toxic", MODULUS, HELD_OUT), sample)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]))
        for doc_id, held, text in rows(batches, "doc_id", "held_out", "text"):
            s = score(text, shared.value, offset)
            out.add(doc_id, held, s, int(s >= THRESHOLD))
            if out.full:
                yield out.take()
        yield out.take()

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(MODULUS, HELD_OUT).alias("held_out"),
        "text",
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

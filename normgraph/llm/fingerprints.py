"""One-permutation MinHash fingerprints of documents.

Every shingle is hashed once: its high bits name a bin, the rest compete for the bin's minimum. Empty bins are
filled by optimal densification: bin i probes the bins of a random sequence that depends only on i, and copies the
first non-empty one, so two documents probe alike. Of each bin the low 8 bits are stored; the estimate of the
Jaccard similarity takes off the share 2^-8 of matches that happen by chance.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, partitions, read, rows
from .shingles import mix, shingles

BINS, WIDTH = 512, 5
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_PROBES = np.random.default_rng(7).integers(0, BINS, (256, BINS))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signature(text: str | None, width: int = WIDTH) -> bytes:
    """BINS packed bytes; no byte at all for a text without words."""
    hashes = shingles(text, width)
    if not len(hashes):
        return b""
    # distinct hashes are sorted, so the first of each bin is its minimum
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(bins), bool)
    np.not_equal(bins[1:], bins[:-1], out=first[1:])
    values = np.full(BINS, _EMPTY)
    values[bins[first]] = hashes[first]
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    todo = np.flatnonzero(~filled)
    for at in range(0, len(_PROBES), 16):
        if not len(todo):
            break
        probes = _PROBES[at : at + 16, todo]
        hit = filled[probes]
        found = hit.any(0)
        values[todo[found]] = values[probes[hit.argmax(0)[found], np.flatnonzero(found)]]
        todo = todo[~found]
    if len(todo):  # very few filled bins: the next filled one in circular order
        full = np.flatnonzero(filled)
        values[todo] = values[full[np.searchsorted(full, todo) % len(full)]]
    return (mix(values) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; of two texts without words 1, of one 0."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / BINS
    return min(1.0, max(0.0, (same - 2**-8) / (1 - 2**-8)))


#: Ranges' worth of rows from which on those of one doc_id are spread over ranges of their own.
HOT = 3


def _splits(docs: DataFrame, hot: dict[int | None, int]) -> dict[int | None, list[int]]:
    """Of each doc_id in hot, spread over so many equal stretches of the hash h, the least h in each stretch that has rows."""
    if not hot:
        return {}
    known = [(k, n) for k, n in hot.items() if k is not None]
    pieces = F.when(F.col("doc_id").isNull(), F.lit(hot.get(None)))
    for k, n in known:
        pieces = pieces.when(F.col("doc_id") == k, F.lit(n))
    stretch = F.floor((F.col("h") / float(1 << 64) + 0.5) * F.col("pieces"))
    some = docs.withColumn("pieces", pieces).where("pieces IS NOT NULL").groupBy("doc_id", stretch.alias("stretch")).agg(F.min("h").alias("h"))
    out: dict[int | None, list[int]] = {}
    for r in some.collect():  # a row a stretch, a few for each range at most
        out.setdefault(r["doc_id"], []).append(r["h"])
    return {k: sorted(v) for k, v in out.items()}


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows (doc_id, text) dealt into ranges of (doc_id, hash of the text) and sorted there; the first row of each range also goes, as guest,
    to the range before it (of the first range, to the last), so that each row's successor is in its own partition. A doc_id, or null, that many
    rows have is spread over ranges by the hash; copies of one text under one doc_id stay together."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    at = [k / buckets for k in range(1, buckets)]
    low, holes, n, found = docs.agg(
        F.min("doc_id"),
        F.count_if(F.col("doc_id").isNull()),
        F.count("*"),
        F.percentile_approx("doc_id", at or [0.5], 100 * buckets),
    ).first()
    often = {k: c for k, c in Counter(found or [] if at else []).items() if c >= HOT}
    if holes * buckets >= HOT * n > 0 and at:
        often[None] = math.ceil(holes * buckets / n)
    splits = _splits(docs, often)
    inner = {k: v[1:] for k, v in splits.items()}  # where ranges open inside a doc_id
    cuts = sorted({x for x in found or [] if x > low}) if at else []
    nulls = len(inner.get(None, ()))
    values = sorted(cuts + [k for k, v in inner.items() if k is not None for _ in v])  # a doc_id for each range that it opens
    last = nulls + len(values)
    table = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    upto = lambda part, x: F.size(F.filter(part, lambda y: y <= x))
    own = F.lit(nulls)
    if values:  # in two steps of the root of their number each; a folded constant, not an expression a cut
        step = max(1, math.isqrt(len(values)))
        before = step * upto(table(values[step - 1 :: step]), F.col("doc_id"))
        own = nulls + before + upto(F.slice(table(values), before + 1, F.lit(step)), F.col("doc_id"))
    opens = F.col("doc_id").isNull() if holes else F.col("doc_id") == F.lit(low)
    first = F.col("doc_id").isin([c for c in cuts if c not in splits])
    # what the hash decides: how many of a doc_id's inner ranges lie after a row, and whether the row opens one
    after, opening = F.lit(0), F.lit(False)
    for k, hashes in splits.items():
        here = F.col("doc_id").isNull() if k is None else F.col("doc_id") == k
        if inner[k]:
            after = F.when(here, len(inner[k]) - upto(table(inner[k]), F.col("h"))).otherwise(after)
        opening = F.when(here, F.col("h").isin(inner[k] + ([hashes[0]] if k in cuts else []))).otherwise(opening)
    for k in (None, low):
        if k in splits and (k is None) == bool(holes):
            opens = opens & (F.col("h") == splits[k][0])
    own = F.when(F.col("doc_id").isNull(), F.lit(nulls)).otherwise(own) - after
    guest = F.when(opens, F.lit(last)).when(first | opening, own - 1)
    target = F.array_compact(
        F.array(
            F.struct(own.alias("bucket"), F.lit(0).alias("guest")),
            F.when(guest.isNotNull(), F.struct(guest.alias("bucket"), F.lit(1).alias("guest"))),
        )
    )
    dealt = docs.select("doc_id", "text", "h", F.explode(target).alias("t")).select("doc_id", "text", "h", "t.bucket", "t.guest")
    return dealt.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("guest", "doc_id", "h", "text")


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, last = Sink(_SCHEMA, 1000), None

    def emit(one: tuple, after: tuple) -> None:
        doc_id, text, mark = one
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        changed = signature(edited)
        out.add(
            doc_id,
            len(text),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            mark.hex(),
            changed.hex(),
            likeness(mark, changed),
            likeness(mark, after[2]),
        )

    for doc_id, text, guest in rows(batches, "doc_id", "text", "guest"):
        now = (doc_id, text or "", signature(text))
        if last:
            emit(last, now)
        last = None if guest else now
        if out.full:
            yield out.take()
        if guest:
            break
    yield out.take()
    for _ in batches:  # further rows with the guest's doc_id
        pass


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness.

    docs has doc_id and text; other columns are ignored. A null text is an empty one. Rows are in the order of
    doc_id, null first; rows with one doc_id follow each other in the order of a hash of their text, and each gives a row. An empty table gives none.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_next(docs, 2 * partitions(docs.sparkSession)).mapInArrow(_compare, schema)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))

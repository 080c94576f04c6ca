"""Removal of long byte strings that occur more than once, over the whole collection.

A string of LENGTH bytes is found by its anchor, the k-gram of least hash in it: equal strings have their anchors at equal offsets, so only
strings in the same cell (anchor, offset // CELL) need comparing. All strings of a cell hold its core, LENGTH - CELL + 1 bytes, and
reach up to CELL - 1 bytes beyond it on either side, its contexts. Cores are hashed and counted; those that occur once are done.

Cores whose cells all have equal contexts are repeated throughout. For the others the cells' contexts, each distinct one once, are
the documents of a column-wise construction: a cell is a string of CELL - 1 bytes, one symbol for its core, and CELL - 1 bytes more. Each
round puts the symbol of one column, from the right, before every string and brings the order of the strings' suffixes (the
collection's transform is the column read in that order) and the common prefixes of neighbours up to date. As the strings are aligned, suffixes
of equal length are all that can match, so each round orders just these. A string of LENGTH bytes that starts in column t is
repeated if and only if its suffix shares CELL symbols with a neighbour's. The sequential files are the sorted partitions of Spark's shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, Sink, forget, join_sized, partitions, read, rows, stash
from .stats import as_bytes

LENGTH, GRAM, CELL = 400, 16, 128
#: Bytes of a passage of over fifty words: fifty-one words of four letters, with blanks between them.
PASSAGE = 51 * 5 - 1
#: Distinct contexts of a core that one task constructs; a core with more is done by counting its strings' hashes.
MOST_CONTEXTS = 50_000
#: Strings of the small groups that are constructed together.
BATCH = 4000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SEGMENT = 1 << 22


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Position of the first k-gram of least hash in each string of the length."""
    m = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = lanes[:m] * _C1 + lanes[8 : 8 + m] * _C2
    h ^= h >> np.uint64(32)
    h *= _C3
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(m, dtype=np.uint64)
    w = length - GRAM + 1
    blocks = -(-m // w)
    full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:m] = h
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(full, 1).ravel()
    n = len(data) - length + 1
    return (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def cells(data: np.ndarray, length: int = LENGTH, width: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each cell its number of CELLs from the anchor, the start of its first possible string, which may be before the
    text, and the first and last of its strings, counted from that one."""
    found = []
    for low in range(0, max(0, len(data) - length + 1), _SEGMENT):  # long texts in overlapping segments
        anchor = _anchors(data[low : low + _SEGMENT + length - 1], length)
        at = np.arange(len(anchor))
        nth = (anchor - at) // width
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (nth[1:] != nth[:-1])]))
        end = np.append(new[1:], len(at)) - 1
        found.append((anchor[new] + low, nth[new], at[new] + low, at[end] + low))
    if not found:
        return (np.empty(0, np.int64),) * 4
    anchor, nth, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (nth[1:] != nth[:-1])]))  # a segment's end may cut a cell
    end = end[np.append(new[1:], len(end)) - 1]
    base = anchor[new] - nth[new] * width - (width - 1)
    return nth[new], base, start[new] - base, end - base


_CELLS = "row long, core long, whole long, base long, first short, last short"


def _cells(length: int, width: int):
    schema = pa.schema(
        [("row", pa.int64()), ("core", pa.int64()), ("whole", pa.int64()), ("base", pa.int64()), ("first", pa.int16()), ("last", pa.int16())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0

        def take() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 6
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema, strict=True)],
                schema=schema,
            )

        digest = xxhash.xxh3_64_intdigest
        for row, text in rows(batches, "row", "text"):
            data = as_bytes(text)
            nth, base, first, last = cells(data, length, width)
            if not len(base):
                continue
            view, n = memoryview(data), len(data)
            core, whole = np.empty(len(base), np.uint64), np.empty(len(base), np.uint64)
            for i, (c, b) in enumerate(zip(nth.tolist(), base.tolist(), strict=True)):
                core[i] = digest(view[b + width - 1 : b + length], c)
                low = max(b, 0)
                whole[i] = digest(view[low : min(n, b + length + width - 1)], c * length + b + width - 1 - low)
            parts.append((np.full(len(base), row), core.view(np.int64), whole.view(np.int64), base, first, last))
            size += len(base)
            if size > 20_000:
                yield take()
                size = 0
        yield take()

    return run


def repeated_columns(strings: np.ndarray, reach: int) -> np.ndarray:
    """strings: a row of symbols each, all of one length. For each string and column, from 0 to reach - 1, whether the `reach` symbols from there
    on equal those of another string at the same column."""
    m, n = strings.shape
    order, common = np.arange(m), np.zeros(m, np.int16)  # common: with the one before in the order
    out = np.zeros((m, reach), bool)
    for column in range(n - 1, -1, -1):
        symbol = strings[order, column]
        to = np.argsort(symbol, kind="stable")
        same = symbol[to[1:]] == symbol[to[:-1]]
        # the least of common over (to[i - 1], to[i]] for equal neighbours
        low, high = to[:-1][same] + 1, to[1:][same]
        new = np.zeros(m, np.int16)
        if len(low):
            table, levels, width = [common], np.frexp(high - low + 1)[1] - 1, 1
            for _ in range(int(levels.max())):
                table.append(np.minimum(table[-1][:-width], table[-1][width:]))
                width *= 2
            least = np.empty(len(low), np.int16)
            for k in range(len(table)):
                at = np.flatnonzero(levels == k)
                least[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k) + 1])
            new[1:][same] = np.minimum(least + 1, reach)
        order, common = order[to], new
        if column < reach:
            hit = common >= reach
            hit[:-1] |= hit[1:]
            out[order, column] = hit
    return out


_FOUND = "core long, whole long, first short, last short"
_FOUND_SCHEMA = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("first", pa.int16()), ("last", pa.int16())])


def _construct(width: int):
    """Ranges of repeated strings of each distinct cell. Rows come sorted by core."""
    side = width - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(_FOUND_SCHEMA, 8000)
        held: list[tuple] = []

        def close() -> None:
            strings = np.zeros((len(held), 2 * side + 1), np.uint32)  # 0: before or after the text
            cores: dict[int, int] = {}
            for i, (core, _, _, _, _, left, right) in enumerate(held):
                strings[i, side - len(left) : side] = np.frombuffer(left, np.uint8)
                strings[i, side + 1 : side + 1 + len(right)] = np.frombuffer(right, np.uint8)
                strings[i, side] = 300 + cores.setdefault(core, len(cores))
            strings[:, :side] += 1
            strings[:, side + 1 :] += 1
            for i, (_, _, _, _, _, left, right) in enumerate(held):
                strings[i, : side - len(left)] = 0
                strings[i, side + 1 + len(right) :] = 0
            hit = repeated_columns(strings, width)
            for (core, whole, n, first, last, _, _), row in zip(held, hit, strict=True):
                if n > 1:
                    out.add(core, whole, first, last)
                    continue
                edge = np.diff(np.concatenate([[0], row[first : last + 1].astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    out.add(core, whole, first + a, first + b - 1)
            held.clear()

        for record in rows(batches, "core", "whole", "n", "first", "last", "left", "right"):
            if len(held) >= BATCH and record[0] != held[-1][0]:
                close()
            held.append(record)
            if out.full:
                yield out.take()
        if held:
            close()
        yield out.take()

    return run


def _contexts(length: int, width: int):
    schema = pa.schema(
        [
            ("core", pa.int64()),
            ("whole", pa.int64()),
            ("n", pa.int64()),
            ("first", pa.int16()),
            ("last", pa.int16()),
            ("left", pa.binary()),
            ("right", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for text, wanted in rows(batches, "text", "wanted"):
            data = as_bytes(text).tobytes()
            for x in wanted:
                b = x["base"]
                out.add(
                    x["core"],
                    x["whole"],
                    x["n"],
                    x["first"],
                    x["last"],
                    data[max(b, 0) : b + width - 1],
                    data[b + length : b + length + width - 1],
                )
            if out.full:
                yield out.take()
        yield out.take()

    return run


def spans(docs: DataFrame, length: int = LENGTH, width: int = CELL) -> DataFrame:
    """row, low, high: byte spans of the texts, each covered by repeated strings; they may overlap. docs has row and text."""
    found = stash(docs.select("row", "text").where(F.length("text") > 0).mapInArrow(_cells(length, width), _CELLS), "cells")
    counts = found.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most")).where("n > 1")
    twice = stash(counts.select("core", (F.col("least") != F.col("most")).alias("varied")), "cores")
    known = join_sized(found, twice, "core")
    varied = stash(known.where("varied").drop("varied"), "varied")
    each = varied.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "base", "first", "last")).alias("one"))
    each = stash(each.select("core", "whole", "n", "one.*"), "contexts")
    wanted = each.groupBy("row").agg(F.collect_list(F.struct("core", "whole", "n", "base", "first", "last")).alias("wanted"))
    if each.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    strings = docs.select("row", "text").join(wanted, "row").select("text", "wanted")
    strings = stash(
        strings.mapInArrow(_contexts(length, width), "core long, whole long, n long, first short, last short, left binary, right binary"),
        "strings",
    )
    large = strings.groupBy("core").agg(F.count("*").alias("k")).where(F.col("k") > MOST_CONTEXTS).select("core")
    few = join_sized(strings, large, "core", "left_anti").repartition(partitions(docs.sparkSession), "core").sortWithinPartitions("core")
    ranges = few.mapInArrow(_construct(width), _FOUND)
    # a core in too many contexts for one task: each string's hash is counted
    t = F.col("t").cast("int")
    side = F.lit(width - 1) - F.length("left")  # bytes missing on the left
    many = join_sized(strings, large, "core", "left_semi").withColumn(
        "t",
        F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))),
    )
    text = F.concat(F.substring(F.col("left"), t - side + 1, F.lit(width)), F.substring(F.col("right"), F.lit(1), t))
    many = many.withColumn("string", F.xxhash64("core", "t", text))
    common = many.groupBy("string").agg(F.sum("n").alias("k")).where("k > 1").select("string")
    rest = many.join(common, "string").select("core", "whole", t.cast("short").alias("first"), t.cast("short").alias("last"))
    ranges = stash(ranges.unionByName(rest), "ranges", narrow=True)
    inside = varied.drop("first", "last").join(ranges, ["core", "whole"])
    ends = lambda df: df.select("row", (F.col("base") + F.col("first")).alias("low"), (F.col("base") + F.col("last") + length).alias("high"))
    out = stash(ends(known.where("NOT varied")).unionByName(ends(inside)), "spans", narrow=True)
    forget(found, twice, varied, each, strings, ranges)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, low, high of maximal spans. Rows come sorted by row and low, so a text's spans are merged as they pass, however many they are."""
    out = Sink(pa.schema([("row", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]), 8000)
    now: list[int] | None = None
    for row, low, high in rows(batches, "row", "low", "high"):
        if now and now[0] == row and low <= now[2]:
            now[2] = max(now[2], high)
            continue
        if now:
            out.add(*now)
        now = [row, low, high]
        if out.full:
            yield out.take()
    if now:
        out.add(*now)
    yield out.take()


def merged(found: DataFrame) -> DataFrame:
    """row, low, high: the spans of found united, within each part of the rows' order and then over the parts, so a text with very many spans is
    spread over tasks first."""
    n = partitions(found.sparkSession)
    near = found.repartition(n, "row", F.expr("low DIV 65536")).sortWithinPartitions("row", "low").mapInArrow(
        _merged,
        "row long, low long, high long",
    )
    return near.repartition(n, "row").sortWithinPartitions("row", "low").mapInArrow(_merged, "row long, low long, high long")


def removed(n: int, found: list | None) -> np.ndarray:
    """Ends of the removed runs, as low, high, low, high, ..."""
    runs = sorted((x["low"], min(x["high"], n)) for x in found or ())
    return np.array(runs, np.int64).ravel()


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    edge = [0, *runs.tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))


def _with_spans(docs: DataFrame, length: int, width: int) -> DataFrame:
    """d (the row of docs), row, text, spans."""
    row = F.monotonically_increasing_id().alias("row")
    found = spans(docs.select(row, "text"), length, width)
    runs = merged(found).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return docs.select(F.struct("*").alias("d"), row).join(runs, "row", "left").select("d", "row", F.col("d.text").alias("text"), "spans")


def digest(docs: DataFrame, length: int = LENGTH, width: int = CELL, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes of each row of docs (doc_id, text; more columns are ignored).

    A byte goes if it is covered by a string of `length` bytes that starts anywhere else too, in this text or another, overlaps
    included. n_passage_bytes is how many are covered by such strings of `passage` bytes: they stay, but tell which texts hold a shorter passage that repeats. A
    null text is empty; rows with one doc_id are texts of their own, so a repeated row is removed whole if it is long enough. No
    rows: none. docs has to give the same rows in the same partitions each time it is read, as files do."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = merged(spans(docs.select(F.monotonically_increasing_id().alias("row"), "text"), passage, min(width, passage // 2)))
    shared = stash(short.groupBy("row").agg(F.sum(F.col("high") - F.col("low")).alias("n_passage_bytes")), "passages")
    marked = _with_spans(docs, length, width).join(shared, "row", "left")
    marked = marked.select("d.doc_id", "text", "spans", F.coalesce("n_passage_bytes", F.lit(0)).alias("n_passage_bytes"))
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()),
            ("n_passage_bytes", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for doc_id, text, found, passages in rows(batches, "doc_id", "text", "spans", "n_passage_bytes"):
            data = as_bytes(text).tobytes()
            gone = removed(len(data), found)
            out.add(
                doc_id,
                len(data),
                int((gone[1::2] - gone[::2]).sum()),
                len(gone) // 2,
                hashlib.sha256(kept_bytes(data, gone)).hexdigest(),
                passages,
            )
            if out.full:
                yield out.take()
        yield out.take()

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


def without_repeats(docs: DataFrame, length: int = LENGTH, width: int = CELL) -> DataFrame:
    """docs with the repeated bytes taken out of text; what a cut leaves of a character goes too, and n_chars (if docs has it) follows."""
    columns = docs.columns
    # the texts of the marked rows alone go through Python; the other columns, whatever their names, wait beside them
    marked = _with_spans(docs, length, width).select(
        F.struct(*(F.col(f"d.`{c}`") for c in columns if c != "text"), F.lit(1).alias("__more__")).alias("d"),
        "text",
        "spans",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in rows([batch], "text", "spans"):
                if found:
                    data = as_bytes(text).tobytes()
                    text = kept_bytes(data, removed(len(data), found)).decode("utf-8", "ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, batch.schema.field(1).type)], names=["d", "text"])

    out = marked.mapInArrow(run, StructType([marked.schema["d"], marked.schema["text"]]))
    return out.select(
        *(
            F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"d.`{c}`").alias(c) for c in columns
        )
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


def _sql(length: int, n: int) -> str:
    """Tables of the strings of so many bytes that repeat, and of the runs of bytes that they cover; n names them."""
    return f"""s{n} AS (SELECT r, i, md5(substring(x, 2 * i + 1, {2 * length})) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - {length - 1})) AS i FROM d WHERE length(x) >= {2 * length})),
h{n} AS (SELECT h FROM s{n} GROUP BY h HAVING count(*) > 1),
m{n} AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + {length}, -1) AS opens FROM s{n} SEMI JOIN h{n} ON s{n}.h = h{n}.h),
g{n} AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM m{n}),
z{n} AS (SELECT r, k, min(i) AS low, max(i) + {length} AS high FROM g{n} GROUP BY r, k)"""


#: On bytes as pairs of hexadecimal digits.
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
{_sql(LENGTH, 1)},
{_sql(PASSAGE, 2)},
gap AS (SELECT z1.r, coalesce(lag(high) OVER (PARTITION BY z1.r ORDER BY low), 0) AS a, low AS b FROM z1 UNION ALL SELECT r, max(high), NULL FROM z1 GROUP BY r),
kept AS (SELECT gap.r, string_agg(substring(x, 2 * a + 1, CASE WHEN b IS NULL THEN length(x) ELSE 2 * (b - a) END), '' ORDER BY a) AS x FROM gap JOIN d ON d.r = gap.r GROUP BY gap.r),
n AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM z1 GROUP BY r), p AS (SELECT r, sum(high - low) AS n FROM z2 GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256, CAST(coalesce(p.n, 0) AS BIGINT) AS n_passage_bytes
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r LEFT JOIN p ON p.r = d.r
"""

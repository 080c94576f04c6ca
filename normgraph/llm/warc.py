"""WARC archives of web pages, and their capture index merged from locally sorted runs.

Archives are written by Spark's text writer: a record is header, blank line and payload, and the writer's line
separator is the blank line that ends each record. So they can go to any store Spark writes, under its commit protocol.
They are read back by its text reader, a line at a time, so no archive is held whole. (Lines end with "\n" alone there: with a longer separator the
reader gave pieces that did not add up to the archive in a test.)
Each archive's index entries, sorted by URL key and timestamp, are a run. Ranges of the whole key, as many as hold RANGE_ROWS entries each,
go to a task each; Spark's external sort hands it the runs' slices one after the other, and a tree of losers merges them. The ranges in order
hold one globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, fresh_path, hold_settings, join_sized, partitions, read, rows, stash

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Index entries of a range, about: what a task of the merge holds. Repeated digests up to which they are broadcast.
RANGE_ROWS, BROADCAST_DIGESTS = 50_000, 500_000
END = "\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest and refers_to: of equal payloads of least_bytes or more, the smallest page_id is
    the response and the rest revisit it. A null page_id revisits unless all of the group are null; all rows of the smallest id are responses.
    The group's smallest id is aggregated before the shuffle, and only digests seen twice are joined back, which AQE can split; payloads too short
    to be revisits have keys of their own there, so they do not meet in one task."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    long = F.col("payload_bytes") >= least_bytes
    first = pages.where(long).groupBy(F.col("payload_digest").alias("_key")).agg(
        F.min("page_id").alias("first_id"),
        F.count("*").alias("n"),
    ).where("n > 1").drop("n")
    keyed = pages.withColumn(
        "_key",
        F.when(long, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))),
    )
    joined = join_sized(keyed, stash(first, "digests"), "_key", "left", BROADCAST_DIGESTS)
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id", "_key")


def record_text() -> Column:
    """A WARC record of a row of with_revisits(), without the blank line that ends it."""
    revisit = F.col("refers_to").isNotNull()
    at = F.date_format(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(86_400 * 365))),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    parts = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), F.lit("")),
        line("WARC-Date", at),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("html")),
    ]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 20_000) -> None:
    """Archives (gzip) of the rows of with_revisits() under path."""
    pages.select(record_text().alias("value")).write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile",
        records_per_archive,
    ).text(path)


class _Records:
    """Headers (names in lower case) and payload of each record of a stream of bytes; holds one record at a time."""

    def __init__(self, name: str):
        self.name, self.buffer, self.head = name, bytearray(), None

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        while True:
            if self.head is None:
                cut = self.buffer.find(b"\r\n\r\n")
                if cut < 0:
                    return
                lines = self.buffer[:cut].decode().split("\r\n")
                del self.buffer[: cut + 4]
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{self.name}: not a WARC record: {lines[0][:80]}")
                self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            n = int(self.head["content-length"])
            if len(self.buffer) < n + 4:
                return
            payload, end = bytes(self.buffer[:n]), self.buffer[n : n + 4]
            if end != b"\r\n\r\n":
                raise ValueError(f"{self.name}: a record does not end with a blank line")
            del self.buffer[: n + 4]
            head, self.head = self.head, None
            yield head, payload

    def close(self) -> None:
        if self.head is not None or self.buffer:
            raise ValueError(f"{self.name}: an archive ends within a record")


def parse_archive(data: bytes, name: str = "archive") -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzip archive, of one member or many."""
    records, unzip = _Records(name), zlib.decompressobj(31)
    for at in range(0, len(data), 1 << 18):
        part = data[at : at + (1 << 18)]
        while part:
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            yield from records.feed(unzip.decompress(part))
            part = unzip.unused_data
    records.close()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query in lower case, so that captures of a site sort together; no URL: empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower().rstrip('/') or '/'}{'?' + parts.query.lower() if parts.query else ''}"


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next row takes one match a level."""
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else ())
        return
    heads = [iter(r) for r in runs]
    current = [next(h, None) for h in heads]
    beats = lambda a, b: b is None or current[b] is None or (current[a] is not None and (current[a], a) <= (current[b], b))
    losers: list[int] = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        losers[node], winner = (b, a) if beats(a, b) else (a, b)
        return winner

    winner = build(1)
    while current[winner] is not None:
        yield current[winner]
        current[winner] = next(heads[winner], None)
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


_ENTRY = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("ordinal", pa.int64()),
    ]
)
ENTRY = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, ordinal long"


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


_RUN = _ENTRY.append(pa.field("place", pa.int64()))


def _entry(path: str, n: int, head: dict[str, str], payload: bytes) -> tuple:
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    kind, size = head["warc-type"], len(payload)
    if kind == "revisit":
        size = int(head["x-payload-length"])
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{path}, record {n}: the payload does not match its digest")
    url = head.get("warc-target-uri")
    return url_key(url), head["warc-date"], _page(head.get("warc-record-id")), url, kind, size, digest, _page(head.get("warc-refers-to")), path, n


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive, one sorted run. Rows are an archive's lines, in order, one archive after the other."""
    out, records, run = Sink(_RUN), None, []

    def close() -> None:
        if records:
            records.close()
            for place, row in enumerate(sorted(run, key=_order)):
                out.add(*row, place)
            run.clear()

    for path, piece in rows(batches, "path", "value"):
        if records is None or records.name != path:
            close()
            records = _Records(path)
        for head, payload in records.feed(piece + b"\n"):
            run.append(_entry(path, len(run), head, payload))
        if out.full:
            yield out.take()
    close()
    yield out.take()


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of the runs that fall in this range of keys, merged. Rows come sorted by archive and place in its run."""
    slices: list[list[tuple]] = []
    archive = None
    for row in rows(batches, *_ENTRY.names):
        if row[8] != archive:
            archive = row[8]
            slices.append([])
        slices[-1].append((_order(row), row))
    out = Sink(_ENTRY)
    for _, row in loser_tree(slices):
        out.add(*row)
        if out.full:
            yield out.take()
    yield out.take()


def read_index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives under path, each archive's sorted, with their place in its run. Payloads are checked against their digests."""
    pieces = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_runs, f"{ENTRY}, place long")


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the order of (url_key, captured, page_id): range partition i holds nothing after partition i + 1.
    Ranges are cut on the whole key, so the captures of one URL may spread over many."""
    n = max(partitions(runs.sparkSession), math.ceil(runs.count() / RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "ordinal").sortWithinPartitions("archive", "place")
    return dealt.mapInArrow(_merge, ENTRY)


def capture_history(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html; more columns are ignored) as WARC archives to path, a fresh folder in the shared
    one if none is given, reads them back and returns the merged index, a row for each page. Null html is an empty payload;
    a null page_id or url leaves out the header and comes back as null. No pages: no rows."""
    spark = pages.sparkSession
    hold_settings(spark)
    path = path or fresh_path(spark, "warc")
    write_archives(with_revisits(pages), path)
    return merge_runs(stash(read_index_runs(spark, path), "warc-runs"))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, payload_bytes, p.payload_digest,
       CASE WHEN first_id IS NOT NULL AND p.page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

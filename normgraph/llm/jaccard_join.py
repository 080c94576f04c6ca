"""Similarity join of documents by the Jaccard similarity of their word shingles, by chosen paths.

A document's shingle set is embedded as its MinHash values. A run is a tree: its root samples one or two coordinates, 1 / 0.8 on average, and
deals the sets into a child for each value; a child of more than SMALL sets samples coordinates of its own and is
split again, down to DEPTH; a small one is compared by brute force over byte sketches. Two sets of similarity s share a sampled
coordinate with probability s, so a run finds them with probability found_by_run(); runs are repeated until the target recall.

What a bucket yields is not its pairs but a spanning forest of its likely pairs. The forests' components are candidate groups; within them
each pair's exact similarity is computed, in blocks of documents, a pair in one block pair only. So links are
counted without a row for each. Documents with equal sets are one set with a count throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, forget, join_sized, partitions, read, rows, stash
from .graph import components
from .shingles import mix, shingles

WIDTH, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999999
COORDINATES, SMALL, DEPTH = 64, 2000, 3
#: Sketch bytes that have to agree: 5.7 standard errors below what similarity 0.8 gives; fewer agree with a probability of 8.2e-8.
MIN_AGREE = 33
#: Sets, and shingles, of a block of a candidate group.
BLOCK_SETS, BLOCK_SHINGLES = 1000, 4_000_000

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def found_by_run(similarity: float = THRESHOLD, depth: int = 2) -> float:
    """Probability that a pair meets in a bucket of a run after so many splits; a node samples one coordinate, every fourth two."""
    p = 1.0
    for _ in range(depth):
        one = similarity * p
        p = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    return p


def missed(runs: int, similarity: float = THRESHOLD, depth: int = DEPTH, least: int = MIN_AGREE) -> float:
    """Probability that no run yields a pair, if its buckets are split down to the depth in all. The sketch filter and the runs share the
    pair's COORDINATES minima, so it is summed over how many of them agree: among the roots' and among the others."""
    roots = runs + runs // 4
    some = lambda n, k: math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
    total = 0.0
    for k in range(roots + 1):
        for other in range(COORDINATES - roots + 1):
            agree = k + other
            below = found_by_run(agree / COORDINATES, depth - 1)
            total += some(roots, k) * some(COORDINATES - roots, other) * (1.0 if agree < least else (1 - below) ** k)
    return total


def runs_for(recall: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold is found with the target recall; a multiple of 4."""
    return next(r for r in range(4, COORDINATES, 4) if missed(r) <= 1 - recall)


RUNS = runs_for()


def minhashes(hashes: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The first n of the COORDINATES minima of a non-empty set."""
    out = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[at : at + 2048] ^ _XOR[:n]) * _ODD[:n]).min(1), out=out)
    return out


def root_coordinates(runs: int) -> list[int]:
    """Of run r, coordinate r; of every fourth run another one too."""
    if runs + runs // 4 > COORDINATES:
        raise ValueError("more runs than coordinates")
    return [*range(runs), *range(runs, runs + runs // 4)]


def _sign(runs: int, width: int):
    roots = np.array(root_coordinates(runs))
    salt = mix(roots.astype(np.uint64) + np.uint64(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("row", pa.int64()),
                ("doc_id", pa.int64()),
                ("set_key", pa.binary()),
                ("size", pa.int64()),
                ("keys", pa.list_(pa.int64())),
                ("sketch", pa.binary()),
            ]
        )
        out = Sink(schema, 2000)
        for row, doc_id, text in rows(batches, "row", "doc_id", "text"):
            found = shingles(text, width)
            if len(found):
                minima = minhashes(found)
                out.add(
                    row,
                    doc_id,
                    xxhash.xxh3_128_digest(found.tobytes()),
                    len(found),
                    mix(minima[roots] ^ salt).view(np.int64),
                    mix(minima).astype(np.uint8).tobytes(),
                )
            else:
                out.add(row, doc_id, b"", 0, [], b"")
            if out.full:
                yield out.take()
        yield out.take()

    return run


def forest(alike: list[np.ndarray]) -> np.ndarray:
    """The smallest index of each one's component; alike: rows of a symmetric matrix, packed."""
    n = len(alike)
    label = np.arange(n)
    while True:
        new = np.array([label[np.unpackbits(a, count=n).view(bool)].min(initial=n) for a in alike])
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def likely(sketches: np.ndarray) -> list[np.ndarray]:
    """For each sketch, which ones agree in MIN_AGREE bytes or more, packed."""
    out = []
    columns = np.ascontiguousarray(sketches.T)
    for at in range(0, len(sketches), 128):
        part = columns[:, at : at + 128]
        agree = np.zeros((part.shape[1], len(sketches)), np.uint8)
        for mine, theirs in zip(part, columns, strict=True):
            agree += mine[:, None] == theirs[None, :]
        out += list(np.packbits(agree >= MIN_AGREE, axis=1))
    return out


def children(key: int, sketches: np.ndarray) -> Iterator[np.ndarray]:
    """Of each coordinate that the node samples, the keys of the sets' children."""
    draw = mix(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for c in np.argsort(draw)[: 2 if int(draw[0]) & 3 == 0 else 1]:
        yield mix(draw[c] ^ (sketches[:, c].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of equal keys, as (key, sets, sketches), in parts: a part may continue the key of the one before."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, COORDINATES)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            yield int(keys[low]), sets[low:high], sketches[low:high]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of the forest of each bucket; rows come sorted by key."""
    out = Sink(pa.schema([("a", pa.int64()), ("b", pa.int64())]), 8000)
    key, held = None, []

    def close() -> None:
        if sum(len(h[0]) for h in held) < 2:
            return
        sets, sketches = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        label = forest(likely(sketches))
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, label, sets)
        for a, b in zip(sets, least[label], strict=True):
            if a != b:
                out.add(a, b)

    for now, sets, sketches in _groups(batches):
        if now != key:
            close()
            key, held = now, []
        held.append((sets, sketches))
        if out.full:
            yield out.take()
    close()
    yield out.take()


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's rows in the children of its node. Needs no other row of the node, so large ones stay spread as they lie."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("sketch", pa.binary())])
    for key, sets, sketches in _groups(batches):
        for kids in children(key, sketches):
            yield pa.RecordBatch.from_arrays([pa.array(kids), pa.array(sets), pa.array([s.tobytes() for s in sketches], pa.binary())], schema=schema)


def _edges(found: DataFrame) -> DataFrame:
    dealt = found.select("key", "a", "sketch").repartition(partitions(found.sparkSession), "key").sortWithinPartitions("key")
    return stash(dealt.mapInArrow(_compare, "a long, b long"), "paths", narrow=True)


def blocked(df: DataFrame, group: str, blocks: DataFrame, by: str) -> DataFrame:
    """Rows of df once for each pair of blocks that theirs belongs to, with low, high (the pair) and block. blocks: group, n_blocks."""
    both = join_sized(df, blocks, group)
    both = both.withColumn("block", F.pmod(F.xxhash64(by), F.col("n_blocks")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks").cast("int") - 1)))
    return both.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "n_blocks")


def likely_edges(sets: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) of the buckets' forests, and the tables that hold them. sets: row, keys, sketch. Buckets are counted first: rows of large ones go down a level where they
    lie, and only small ones are gathered."""
    found = sets.select(F.explode("keys").alias("key"), F.col("row").alias("a"), "sketch")
    edges, others = [], []
    for level in range(1, depth + 1):
        large = stash(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "large")
        others.append(large)
        some = large.limit(1).count() > 0
        edges.append(_edges(join_sized(found, large, "key", "left_anti") if some else found))
        if not some:
            break
        rest = join_sized(found, large.select("key"), "key", "left_semi").select("key", "a", "sketch")
        if level < depth:
            found = stash(rest.mapInArrow(_descend, "key long, a long, sketch binary"), "deeper")
            others.append(found)
        else:  # buckets that stay large after all splits: compared in pairs of blocks
            pairs = blocked(rest, "key", large.select("key", F.ceil(F.col("n") / SMALL).alias("n_blocks")), "a")
            edges.append(_edges(pairs.withColumn("key", F.xxhash64("key", "low", "high"))))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out, edges + others


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have at least the similarity: a symmetric matrix without its diagonal."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set is in no intersection
    column, owner = column[shared], owner[shared]
    both = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = max(64, min(4096, 4_000_000 // n))
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            both += part @ part.T
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(out, False)
    return out


_VERIFY = "row long, n_linked long, root long"


def _verify(threshold: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(pa.schema([("row", pa.int64()), ("n_linked", pa.int64()), ("root", pa.int64())]), 8000)
        now, held = None, []

        def close() -> None:
            if len(held) < 2:
                return
            ids, docs, block = (np.array([h[k] for h in held]) for k in (0, 1, 2))
            pairs = linked([h[3] for h in held], threshold)
            if now[1] != now[2]:  # pairs within a block are the block's own
                pairs &= block[:, None] != block[None, :]
            label = forest(list(np.packbits(pairs, axis=1)))
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            for i, n, root in zip(ids, pairs @ docs, least[label], strict=True):
                if n:
                    out.add(i, n, root)

        for group, low, high, block, row, docs, text in rows(batches, "label", "low", "high", "block", "row", "n_docs", "text"):
            if (group, low, high) != now:
                close()
                now, held = (group, low, high), []
            held.append((row, docs, block, shingles(text, width)))
            if out.full:
                yield out.take()
        close()
        yield out.take()

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, runs: int = RUNS, depth: int = DEPTH) -> DataFrame:
    """row, doc_id, class_id, n_links, n_equal of each row of docs (doc_id, text; more columns are ignored).

    Two documents are linked if the Jaccard similarity of their shingle sets is at least the threshold; n_links counts the other
    documents linked, those of an equal set (n_equal) too. class_id is the smallest doc_id of the connected component. A text of fewer words
    than a shingle has one shingle of all its words; texts without words, and null ones, have equal, empty sets and link to one another only.
    Rows with one doc_id are documents of their own; a null doc_id never names a class unless all of it are null. No rows: none.
    docs has to give the same rows in the same partitions each time it is read, as files do; `row` numbers them.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stash(docs.mapInArrow(_sign(runs, width), "row long, doc_id long, set_key binary, size long, keys array<long>, sketch binary"), "signed")
    sets = signed.groupBy("set_key").agg(
        F.min_by(F.struct("row", "size", "keys", "sketch"), "row").alias("s"),
        F.count("*").alias("n_docs"),
        F.min("doc_id").alias("least"),
    )
    sets = stash(sets.select("set_key", "s.*", "n_docs", "least"), "sets")
    members = signed.select("row", "doc_id", "set_key")
    edges, made = likely_edges(sets.where("size > 0"), depth)
    likely_groups = stash(components(edges).withColumnRenamed("node", "row"), "groups")
    forget(*made)
    inside = join_sized(sets.select("row", "size", "n_docs"), likely_groups, "row")
    blocks = inside.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n_blocks"))
    texts = join_sized(docs.select("row", "text"), inside.select("row", "n_docs", "label"), "row")
    pairs = blocked(texts, "label", blocks, "row").repartition(
        partitions(docs.sparkSession),
        "label",
        "low",
        "high",
    ).sortWithinPartitions("label", "low", "high")
    exact = stash(pairs.select("label", "low", "high", "block", "row", "n_docs", "text").mapInArrow(_verify(threshold, width), _VERIFY), "links", narrow=True)
    links = exact.groupBy("row").agg(F.sum("n_linked").alias("n_linked"))
    classes = components(exact.select(F.col("row").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "row")
    known = sets.select("set_key", "row", "n_docs", "least").join(links, "row", "left").join(classes, "row", "left")
    known = known.withColumns({"label": F.coalesce("label", "row"), "n_linked": F.coalesce("n_linked", F.lit(0))})
    names = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = stash(known.join(names, "label").select("set_key", "n_docs", "n_linked", "class_id", F.col("label").alias("class_row")), "known")
    forget(sets, likely_groups, exact)
    out = members.join(known, "set_key")
    return out.select(
        "row",
        "doc_id",
        "class_id",
        (F.col("n_linked") + F.col("n_docs") - 1).alias("n_links"),
        (F.col("n_docs") - 1).alias("n_equal"),
        "class_row",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id (null last), of several such the first."""
    found = join(docs, **options)
    kept = found.groupBy("class_row").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row")).select("row")
    return docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row")).join(kept, "row", "left_semi").select("d.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_equal")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS sh FROM w),
k AS (SELECT r, doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS same FROM s),
u AS (SELECT r, unnest(list_transform(sh, lambda x: md5(x))) AS h FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN k x ON x.r = a JOIN k y ON y.r = b WHERE 10 * c >= 8 * (x.n + y.n - c) UNION ALL SELECT x.r, y.r FROM k x JOIN k y ON x.r < y.r WHERE x.n = 0 AND y.n = 0),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t AS (SELECT r AS a, r AS b FROM k UNION SELECT t.a, d.b FROM t JOIN d ON d.a = t.b),
c AS (SELECT t.a, min(k.doc_id) AS class_id FROM t JOIN k ON k.r = t.b GROUP BY t.a),
l AS (SELECT a, count(*) AS n FROM d GROUP BY a), q AS (SELECT same, count(*) - 1 AS n FROM k GROUP BY same)
SELECT k.doc_id, class_id, coalesce(l.n, 0) AS n_links, q.n AS n_equal FROM k JOIN c ON c.a = k.r LEFT JOIN l ON l.a = k.r JOIN q ON q.same = k.same
"""

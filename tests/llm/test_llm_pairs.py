"""Operators across documents, and the pipeline, against brute force."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from normgraph.llm import common, graph, jaccard_join, mixing, queries, repeats
from normgraph.llm.shingles import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 900, n)]


def _corpus():
    """Exact and near copies around the threshold, one large group of near copies, a passage that all share, and odd texts."""
    rng, out = np.random.default_rng(0), [None, "", "  ", "one", "one", "one two three"]
    for g in range(12):
        base = _words(g, 120)
        for k in range(5):
            words = list(base)
            for _ in range(k):
                words[int(rng.integers(0, 120))] = "edit"
            out.append(" ".join(words))
    base = _words(99, 150)
    for _ in range(60):
        words = list(base)
        words[int(rng.integers(0, 150))] = f"x{int(rng.integers(0, 1 << 30))}"
        out.append(" ".join(words))
    passage = " ".join(_words(7777, 100))
    for g in range(25):
        out.append(" ".join(_words(1000 + g, 150)) + "\n" + passage + "\n" + " ".join(_words(2000 + g, 30)))
    out += [out[6], out[7], "ab" * 900, "é" * 500, "z" * 399, " ".join(_words(5, 30_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    texts = _corpus()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).withColumns(
        {"row": F.lit(1), "label": F.lit(2), "a": F.lit(3), "d": F.lit(4), "key": F.lit("k")}
    )
    df.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def _true_links(texts):
    sets = [set(shingles(t).tolist()) for t in texts]
    n = len(sets)
    alike = lambda x, y: (len(x & y) * 5 >= 4 * len(x | y)) if x or y else True
    links = {(i, j) for i in range(n) for j in range(i + 1, n) if alike(sets[i], sets[j])}
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(links):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return Counter(x for p in links for x in p), [find(i) for i in range(n)]


@pytest.mark.parametrize("small, block", [(2000, 1000), (4, 7)])
def test_join(docs, monkeypatch, small, block):
    """With small bounds every path is taken: deeper splits, pairs of blocks, groups over many tasks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    degree, classes = _true_links(_corpus())
    got = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: degree[i] for i in range(len(classes))}
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(classes))


def test_join_keeps_one(spark, docs):
    _, classes = _true_links(_corpus())
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes))
    none = spark.createDataFrame([], DOCS)
    assert jaccard_join.join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (2, "a b c"), (2, "q"), (2, "q")], "doc_id long, text string")
    assert sorted((r["class_id"], r["n_links"]) for r in jaccard_join.join(odd).collect()) == [(2, 1), (2, 1), (2, 2), (2, 2), (2, 2)]


def test_recall_of_the_runs():
    assert (1 - jaccard_join.found_by_run()) ** jaccard_join.RUNS <= 1 - jaccard_join.TARGET_RECALL
    rng, met, n = np.random.default_rng(1), 0, 400
    roots = jaccard_join.root_coordinates(jaccard_join.RUNS)
    for _ in range(n):
        common = rng.integers(0, 1 << 62, 160, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 62, 20, dtype=np.uint64)]) for _ in range(2))
        x, y = jaccard_join.minhashes(a)[roots], jaccard_join.minhashes(b)[roots]
        met += bool((x == y).any())
    assert met == n


def test_recall_after_all_splits_and_the_sketch():
    """Pairs of similarity 0.8, as 64 minima that agree with that probability, through roots, children and filter as the join takes them."""
    assert jaccard_join.missed(jaccard_join.RUNS) <= 1.0001e-6
    assert sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(jaccard_join.MIN_AGREE)) <= 1e-6
    rng, runs, n = np.random.default_rng(2), 4, 100_000
    agree = rng.random((n, 64)) < 0.8
    share, found = agree.mean(1), np.zeros(n, bool)
    node = lambda below: np.where(rng.random(n) < 0.25, 1 - (1 - share * below) ** 2, share * below)
    for root in jaccard_join.root_coordinates(runs):
        found |= agree[:, root] & (rng.random(n) < node(node(1.0)))
    assert abs((~found).mean() - jaccard_join.missed(runs)) < 0.004


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {x: x for p in pairs for x in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


def _true_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        step = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                step[i] += 1
                step[i + length] -= 1
        gone = np.cumsum(step)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most, segment", [(100_000, 1 << 22), (2, 1000)])
def test_repeats(docs, monkeypatch, most, segment):
    """With small bounds, counted strings and texts in segments too."""
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    monkeypatch.setattr(repeats, "_SEGMENT", segment)
    want = _true_repeats(_corpus(), 400)
    found = repeats.digest(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_passage_bytes"] for r in found} == {i: w[1] for i, w in enumerate(_true_repeats(_corpus(), repeats.PASSAGE))}


def test_repeated_columns_against_their_definition():
    rng = np.random.default_rng(6)
    for _ in range(20):
        reach = int(rng.integers(2, 7))
        strings = rng.integers(0, 2, (int(rng.integers(1, 40)), 2 * reach - 1)).astype(np.uint32)
        got = repeats.repeated_columns(strings, reach)
        for c in range(reach):
            seen = Counter(tuple(s[c : c + reach]) for s in strings)
            assert [seen[tuple(s[c : c + reach])] > 1 for s in strings] == got[:, c].tolist()


def test_cut_texts(spark, docs):
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    want = _true_repeats(_corpus(), 400)
    for r in out.collect():
        if r["text"] is not None and r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][3] and r["n_chars"] == len(r["text"])
    none = spark.createDataFrame([], DOCS)
    assert repeats.digest(none).count() == 0 and repeats.without_repeats(none).count() == 0
    same = spark.createDataFrame([(1, "q" * 450), (1, "q" * 450), (None, "unlike")], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.digest(same).collect()) == [(6, 0, 0), (450, 450, 1), (450, 450, 1)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from normgraph.llm import bpe, stats

    texts = [t for t in _corpus() if t is None or len(t) < 20_000] + ["junk%%% ***junk " * 30]
    table = pa.table(
        {
            "doc_id": pa.array(range(len(texts)), pa.int64()),
            "text": texts,
            "lang": ["en"] * len(texts),
            "source": [f"s{i % 4}" for i in range(len(texts))],
            "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
        }
    )
    pq.write_table(table, tmp_path / "documents.parquet")
    good_ids = range(6, len(texts) - 1, 2)
    pq.write_table(
        pa.table(
            {
                "doc_id": pa.array(good_ids, pa.int64()),
                "quality": pa.array([1] * len(good_ids), pa.int32()),
                "toxic": pa.array([0] * len(good_ids), pa.int32()),
            }
        ),
        tmp_path / "labels.parquet",
    )
    found, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{i}"))
        found.append(frame)
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in found[:-1])
    good, one, cut, mixed, packed = found
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    base = {i for i, t in enumerate(texts) if (c := stats.base_counts(t))[1] >= 20 and 100 * c[5] <= 30 * c[1]}
    assert set(kept) <= base and len(kept) >= 0.9 * len(base)
    ids = sorted(kept)
    classes = _true_links([kept[i] for i in ids])[1]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({ids[c] for c in classes})
    rest = sorted(r["doc_id"] for r in one.collect())
    want = dict(zip(rest, _true_repeats([kept[i] for i in rest], corpus_pipeline.PASSAGE_BYTES), strict=True))
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect()} == {i: w[3] for i, w in want.items()}
    words = cut.agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).first()["n"]
    taken = mixed.agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).first()["n"]
    assert abs(taken - 1.5 * words) <= 8
    encoder = bpe.encoder(bpe.default_vocabulary())
    tokens = sum(len(encoder.ids(r["text"])) + 1 for r in mixed.collect())
    assert packed.agg(F.sum("length").alias("n")).first()["n"] == tokens == corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length").alias("n")).first()["n"]


def test_the_pipeline_takes_passages_of_over_fifty_words_out(spark):
    """51 words that two documents share go, 30 stay; clean documents stay as they are."""
    import corpus_pipeline

    passage, short = (" ".join(f"{w}re" for w in _words(s, n)) for s, n in ((5, 51), (6, 30)))
    clean = [" ".join(_words(100 + i, 200)) for i in range(6)]
    texts = [f"{clean[0]}\n{passage}\n{clean[1]}", f"{clean[2]} {passage}", f"{clean[3]}\n{short}", f"{clean[4]} {short}", clean[5], None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    out = {r["doc_id"]: r for r in corpus_pipeline.unrepeated(spark, docs, "").collect()}
    assert out[0]["text"].split() == (clean[0] + " " + clean[1]).split() and out[1]["text"].split() == clean[2].split()
    assert all(out[i]["text"] == texts[i] for i in range(2, 7))


def test_the_pipeline_on_odd_tables(spark, tmp_path):
    """Empty tables, and repeated rows, nulls in any column and more columns of clashing names."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (7, None, None)], "doc_id long, quality int, toxic int")
    long, other = " ".join(_words(1, 3000)), " ".join(_words(2, 80))
    rows = [
        (1, long, "en", "a", 1, 5),
        (1, long, "en", "a", 1, 5),
        (None, other, None, None, None, None),
        (None, other, None, None, None, 2),
        (4, None, "en", "a", 0, 1),
        (5, "", "en", "a", 0, 1),
        (6, "few words", "en", "a", 9, 1),
    ]
    more = DOCS + ", row long"
    for name, some in (("none", []), ("odd", rows)):
        spark.createDataFrame(some, more).withColumns(
            {"__spans__": F.lit("x"), "label": F.lit(1), "key": F.lit(2)}
        ).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.where("doc_id > 0" if some else "false").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in out} == ({1, None} if some else set())


def _files(monkeypatch, module):
    """Of each table that the module writes from now on, the most files."""
    found, stash = {}, module.stash

    def run(df, name, *args, **options):
        out = stash(df, name, *args, **options)
        found[name] = max(found.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "stash", run)
    return found


def test_tables_have_no_checksum_files_but_are_verified(spark):
    df = common.stash(spark.range(0, 4000, 1, 2), "t")
    names = [f.removeprefix("file://") for f in df.inputFiles()]
    folder = Path(names[0]).parent
    assert len(names) == 2 and df.count() == 4000 and not list(folder.glob(".*.crc"))
    data = bytearray(Path(names[0]).read_bytes())
    chunk = pq.ParquetFile(names[0]).metadata.row_group(0).column(0)
    data[chunk.data_page_offset + chunk.total_compressed_size - 5] ^= 1
    Path(names[0]).write_bytes(data)
    with pytest.raises(Exception, match="(?i)page integrity|checksum|encountered error while reading"):
        df.agg(F.sum("id")).collect()
    common.forget(df)
    assert not folder.exists()


def test_few_files_of_narrow_rows_repeats(docs, monkeypatch):
    found = _files(monkeypatch, repeats)
    repeats.without_repeats(docs).count()
    assert found["ranges"] == found["spans"] == 1


def test_few_files_of_narrow_rows_join(docs, monkeypatch):
    found = _files(monkeypatch, jaccard_join)
    jaccard_join.join(docs).count()
    assert found["paths"] == found["links"] == 1


def test_few_files_of_narrow_rows_mix(docs, monkeypatch):
    found = _files(monkeypatch, mixing)
    mixing.taken_words(docs).count()
    assert found["sizes"] == 1


def test_registered():
    import __spark_entry__ as entry

    names = [*queries.QUERIES, "pipeline"]
    assert set(names) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import glob
    import os

    import duckdb

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for path in glob.glob(f"{at}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, at)
    assert set(df.columns) == set(names)
    plain = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())

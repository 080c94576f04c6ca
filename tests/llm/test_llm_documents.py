"""Operators on single documents, packing, mixing and archives, against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normgraph.llm import bpe, common, fingerprints, mixing, packing, quality_rules, rule_ensemble, shingles, stats, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word" * 100_000 + " " + "tail of a very long text " * 400


def _docs(spark, texts, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)], DOCS)
    return df.withColumns(
        {"row": F.lit("x"), "rank": F.lit(1), "label": F.lit("y"), "key": F.lit(0), "y": F.lit(2), "size": F.lit(3)}
    ) if extra else df


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "one two three four",
    _prose(0, 300),
    _prose(0, 300),
    _prose(1, 40),
    "Grüße aus Köln — çà et là\n" * 6,
    LONG,
    "a b c d e f g h " * 9,
    "line one\nline one\nx\n\nx",
]


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, TEXTS, extra=True)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_shingles_are_those_of_the_words():
    for text in TEXTS:
        words = WORD.findall(text or "")
        width = min(5, len(words))
        assert len(shingles.shingles(text)) == (len({tuple(words[i : i + width]) for i in range(len(words) - width + 1)}) if words else 0)
    assert np.array_equal(shingles.shingles("a  b\tc d\ne f"), shingles.shingles("a b c d e f"))


@settings(max_examples=60, deadline=None)
@given(st.text(" \n\tabé  x", max_size=60))
def test_word_rules(text):
    words = WORD.findall(text)
    _, n, chars, _, dup, repeat = stats.base_counts(text)
    assert (n, chars) == (len(words), sum(map(len, words)))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert dup == len(lines) - len(set(lines))
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    assert repeat == len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprint_documents(docs).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(TEXTS)))
    for i, r in enumerate(got):
        a, b = TEXTS[i] or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprints.signature(edited).hex()
        x, y = set(shingles.shingles(a).tolist()), set(shingles.shingles(b).tolist())
        true = len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r["near_next"] - true) < 0.15
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1
    assert fingerprints.fingerprint_documents(none).count() == 0
    alone = fingerprints.fingerprint_documents(docs.where("doc_id = 5")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1
    twice = fingerprints.fingerprint_documents(docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))))
    assert twice.count() == 2 * len(TEXTS)


def _plain_signature(text):
    """Bin by bin, one shingle at a time."""
    values = {}
    for h in shingles.shingles(text).tolist():
        b = h >> (64 - 9)
        values[b] = min(values.get(b, h), h)
    if not values:
        return b""
    out = []
    for b in range(512):
        at = b
        if b not in values:
            at = next((int(p) for p in fingerprints._PROBES[:, b] if int(p) in values), None)
            if at is None:
                at = min(values, key=lambda x: (x - b) % 512)
        out.append(int(shingles.mix(np.array([values[at]], np.uint64))[0]) & 255)
    return bytes(out)


def test_signatures_are_those_of_the_plain_form():
    for text in [*TEXTS, _prose(8, 3000), "a b c d e f g"]:
        assert fingerprints.signature(text) == _plain_signature(text)


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
@pytest.mark.parametrize("hot", [[], [None], [9], [0], [147], [None, 0, 9, 30]])
def test_every_row_meets_its_successor(spark, buckets, hot):
    """Also where one doc_id, null included, has a third of the rows, which are spread."""
    rows = [(3 * i, str(i)) for i in range(50)] + [(None, "n"), (9, "again")] + [(k, f"hot {k} {i}") for k in hot for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = [r["text"] for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    after, largest = {}, 0
    for part in fingerprints.with_next(df, buckets).rdd.glom().collect():
        own = [r for r in part if not r["guest"]]
        largest = max(largest, len(own))
        both = own + [r for r in part if r["guest"]][:1]
        after |= {a["text"]: b["text"] for a, b in zip(both, both[1:], strict=False)}
    assert after == dict(zip(order, [*order[1:], order[0]], strict=True))
    if buckets == 40:
        assert largest <= 12


def test_the_estimate_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for k in range(40):
        words = [f"t{x}" for x in rng.integers(0, 1 << 30, 220)]
        a, b = " ".join(words[:200]), " ".join(words[20:])
        x, y = set(shingles.shingles(a).tolist()), set(shingles.shingles(b).tolist())
        errors.append(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_archives(spark, tmp_path):
    html = ["<p>é" + "x" * 200, None, "<p>é" + "x" * 200, "short", "short", "<p>é" + "x" * 200, "a\r\n\r\nWARC/1.1\r\n" + "y" * 300]
    rows = [
        (i, u, h) for i, (h, u) in enumerate(
            zip(
                html,
                ["http://b.org/1", None, "https://www.a.org/z?Q=1", "http://a.org/z", "bad url \n", "http://b.org/1", "http://[bad"],
                strict=True,
            )
        )
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    out = warc.capture_history(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert [got[i]["refers_to"] for i in range(7)] == [None, None, 0, None, None, 0, None]
    assert [got[i]["record_type"] for i in (0, 2, 4)] == ["response", "revisit", "response"]
    order = [(r["url_key"], r["captured"], r["page_id"]) for part in out.rdd.glom().collect() for r in part]
    assert order == sorted(order)
    payloads = {}
    for path in (tmp_path / "w").glob("*.gz"):
        for head, body in warc.parse_archive(path.read_bytes()):
            payloads[head["warc-record-id"]] = body
    assert payloads["<urn:page:6>"] == html[6].encode() and payloads["<urn:page:2>"] == b""
    assert warc.capture_history(pages.where("false"), f"file://{tmp_path}/e").count() == 0
    text = [(i, f"http://x.org/{i % 3}", "line\r\n" * i + "\r\n\r\n" * (i % 4) + "\r" * (i % 3) + "\n" * (i % 2)) for i in range(60)]
    many = warc.capture_history(spark.createDataFrame(text, "page_id long, url string, html string").repartition(7), f"file://{tmp_path}/m").collect()
    assert {r["page_id"]: r["payload_bytes"] for r in many} == {i: len(h) for i, _, h in text}
    odd = spark.createDataFrame([(None, "u", "z" * 200), (4, "u", "z" * 200), (4, "u", "z" * 200)], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in warc.capture_history(odd, f"file://{tmp_path}/o").collect()) == ["response", "response", "revisit"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_the_tree_of_losers_merges(runs):
    rows = [sorted((x,) for x in r) for r in runs]
    assert list(warc.loser_tree(rows)) == sorted(x for r in rows for x in r)


def test_ids_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    reference.encode_special_tokens = True
    encoder = bpe.encoder(bpe.default_vocabulary())
    for text in [*TEXTS, "I'll <|endoftext|> 12345 ½  x\t\t y  \n\n z 日本語 🙂"]:
        ids = encoder.ids(text)
        assert ids.tolist() == reference.encode(text or "", add_special_tokens=False).ids
        assert encoder.n_bytes[ids].sum() == len((text or "").encode())


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n  x", "é<|endoftext|>\n\n<|endoftext", "end  <|endoftext|>  'll 12"]


def test_added_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    want = [reference.encode(t or "", add_special_tokens=False).ids for t in [*TEXTS, *ADDED]]
    encoder = bpe.encoder(bpe.default_vocabulary())
    for text, ids in zip([*TEXTS, *ADDED], want, strict=True):
        assert encoder.encode(text).tolist() == ids and encoder.n_bytes[ids].sum() == len((text or "").encode())
    df = _docs(spark, [*TEXTS, *ADDED])
    for r in packing.pack(df).collect():
        part = np.array([*want[r["doc_id"]], 1], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) + 1
    total = defaultdict(float)
    for r in token_counts.attribute_tokens(df).collect():
        total[r["doc_id"]] += r["n_tokens"]
    assert dict(total) == {i: float(len(ids)) for i, ids in enumerate(want)}


def test_very_long_runs(spark):
    """Two million blanks, line breaks, letters and marks, alone, between words and beside an added token."""
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(bpe.default_vocabulary()), bpe.encoder(bpe.default_vocabulary())
    runs = [c * 2_000_000 for c in (" ", "\n", "a", "!")] + [" \n\u3000" * 400_000]
    texts = [
        *runs,
        f"a{runs[0]}b{runs[1]}",
        f"{runs[0]}<|endoftext|>{runs[1]}'ll{runs[4]}é",
        " " * (bpe.LONG_RUN - 1) + "x" + " " * bpe.LONG_RUN + "\n",
    ]
    want = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    for text, ids in zip(texts, want, strict=True):
        assert encoder.encode(text).tolist() == ids
    few = _docs(spark, texts[:2])
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(few).collect()} == {0: len(want[0]) + 1, 1: len(want[1]) + 1}
    total = {
        r["doc_id"]: r["n"] for r in token_counts.attribute_tokens(few, by="field").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    }
    assert total == {0: len(want[0]), 1: len(want[1])}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=20), st.data())
def test_allocation(sizes, data):
    total = sum(sizes)
    inner = data.draw(st.lists(st.integers(0, total), max_size=6))
    bounds = np.array(sorted([0, total, *inner]))
    ends = np.cumsum(sizes)
    owner = lambda b: int(np.searchsorted(bounds, b, "right") - 1)
    for rule in token_counts.RULES:
        got, _ = token_counts.allocate(np.array(sizes), bounds, rule)
        want = np.zeros(len(bounds) - 1)
        for e, n in zip(ends, sizes, strict=True):
            held = [owner(b) for b in range(e - n, e)]
            if rule == "split":
                for h in held:
                    want[h] += 1 / n
            else:
                want[{"first": held[0], "last": held[-1], "most": max(dict.fromkeys(held), key=held.count)}[rule]] += 1
        assert np.allclose(got, want)


def test_counts_by_line_and_field(docs, none):
    got = token_counts.attribute_tokens(docs).collect()
    total = defaultdict(float)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    encoder = bpe.encoder(bpe.default_vocabulary())
    assert dict(total) == {i: float(len(encoder.ids(t))) for i, t in enumerate(TEXTS)}
    last = [(r["start_char"], r["n_chars"]) for r in got if r["doc_id"] == 11]
    assert last == [(0, 9), (9, 9), (18, 2), (20, 1), (21, 1)]
    two = token_counts.attribute_tokens(docs, fields=("lang", "text"), by="field", rule="split").where("doc_id = 3").orderBy("section").collect()
    assert [r["field"] for r in two] == ["lang", "text"] and sum(r["n_tokens"] for r in two) == len(encoder.ids("en\n\none"))
    assert token_counts.attribute_tokens(none).count() == 0


def test_packing(docs, none):
    many = docs
    for _ in range(3):
        many = many.union(many)
    for df, copies in ((docs, 1), (many, 8)):
        got = packing.pack(df).collect()
        encoder = bpe.encoder(bpe.default_vocabulary())
        ids = {i: np.append(encoder.ids(t), np.array([1], "<u4")) for i, t in enumerate(TEXTS)}
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in got:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
            by_doc[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["padded_length"]))
        for i, x in ids.items():
            assert sorted(by_doc[i]) == sorted(list(range(len(x))) * copies)
        padded = 0
        for pieces in by_sequence.values():
            at = 0
            for offset, length, to in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048 and to == (at if at & (at - 1) == 0 else 2048)
            padded += to
        assert padded <= 1.02 * copies * sum(map(len, ids.values())) + 2048
    assert packing.pack(none).count() == 0


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, goal, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        goal = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return goal
        capped |= set(over)


def test_mixing(spark, none):
    rng = np.random.default_rng(1)
    rows = [
        (
            i,
            _prose(i, int(rng.integers(0, 400))) if i % 11 else None,
            "en",
            [None, "a", "b", "hot", "hot", "hot", "É"][int(rng.integers(0, 7))] if i > 3 else "tiny",
            0,
        ) for i in range(300)
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "block": F.lit(2)})
    got = mixing.taken_words(docs, block=64).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal, taken = _targets(dict(sizes)), defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and abs(r["target"] - goal[s]) < 1e-6 and r["source_size"] == sizes[s]
    assert all(int(goal[s]) == taken[s] for s in sizes)
    assert {(r["doc_id"], r["taken"]) for r in got} == {
        (r["doc_id"], r["taken"]) for r in mixing.taken_words(docs.repartition(5), block=64).collect()
    }
    slots = sorted((r["slot"], r["source"]) for r in mixing.mix(docs, block=64)[2].collect())
    total = sum(goal.values())
    for s in goal:  # every stretch of the schedule has the sources in their shares
        n = sum(x == s for _, x in slots[: len(slots) // 2])
        assert abs(n - goal[s] / total * len(slots) / 2) < 8
    mixed = mixing.mixed_documents(docs, block=64)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in words} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_in_finer_ranges(spark, monkeypatch):
    rows = [(i, _prose(i, i % 50), "en", "ab"[i % 2], 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {(r["doc_id"], r["taken"]) for r in mixing.taken_words(docs).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0.01)
    assert {(r["doc_id"], r["taken"]) for r in mixing.taken_words(docs).collect()} == want


def test_quality_rules(spark, docs, none):
    good = [_prose(i, 60) for i in range(60)]
    junk = [" ".join(f"w{x}%%%***" for x in np.random.default_rng(i).integers(0, 500, 60)) for i in range(12)]
    df = _docs(spark, good + junk, extra=True)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)] + [(None,), (999,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality_rules.assess(df, trusted).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 72))
    assert {r["doc_id"] for r in quality_rules.keep_good(df, trusted).collect()} == set(range(60))
    counts, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, t in enumerate(good + junk):
        found = quality_rules.buckets(stats.as_bytes(t))
        np.add.at(counts, found, 1)
        if i < 60 and i % 2 == 0:
            np.add.at(target, found, 1)
    share = target.sum() / counts.sum()
    ratios = np.log(target + share) - np.log(counts + 1) - np.log(share)
    for i in (0, 1, 65):
        assert abs(got[i]["score"] - ratios[quality_rules.buckets(stats.as_bytes((good + junk)[i]))].mean()) < 1e-4
    edge = {r["doc_id"]: r for r in quality_rules.assess(docs, trusted).collect()}
    assert edge[0]["base_failed"] and edge[0]["n_words"] == 0 and edge[10]["base_failed"] and not edge[0]["kept"]
    assert quality_rules.assess(none, trusted).count() == 0


def test_quality_does_not_depend_on_copies(spark, tmp_path):
    """A clean, unlabelled group of exact and near copies that holds a third of the rows."""
    good = [" ".join(f"w{x}" for x in np.random.default_rng(i).integers(10 * i, 10 * i + 300, 150)) for i in range(80)]
    junk = [" ".join(f"w{x}%%%***" for x in np.random.default_rng(i).integers(0, 500, 60)) for i in range(20)]
    one = " ".join(f"w{x}" for x in np.random.default_rng(99).integers(0, 900, 150))
    near = [" ".join([*one.split()[:-1], f"edit{k}"]) for k in range(25)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 80, 2)], "doc_id long")
    scores = []
    for name, group in (("one", [one]), ("many", [one] * 25 + near)):
        _docs(spark, good + junk + group).repartition(3).write.parquet(str(tmp_path / name))
        got = {r["doc_id"]: r for r in quality_rules.assess(spark.read.parquet(str(tmp_path / name)), trusted).collect()}
        assert all(got[100 + i]["kept"] for i in range(len(group)))
        assert all(got[i]["kept"] for i in range(80)) and not any(got[i]["kept"] for i in range(80, 100))
        scores.append(got[100]["score"])
    assert abs(scores[0] - scores[1]) < 0.05


def test_quality_without_trusted_documents(spark, docs):
    for known in (_labels(spark, []), _labels(spark, [(5, 0, 0), (7, None, 1)])):
        got = quality_rules.assess(docs, quality_rules.trusted_ids(known)).collect()
        assert any(r["kept"] for r in got) and all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in got)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(300):
        words = _prose(i, 80).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(int(rng.integers(0, 80)), ["vilescum", "uglymoron"][int(rng.integers(0, 2))])
        texts.append(" ".join(words))
        labels.append((i, 1, int(i % 4 == 0)))
    df, known = _docs(spark, texts, extra=True), _labels(spark, labels + [(5, None, None), (None, 1, 1)])
    got = toxicity.score_documents(df, known).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    hidden = _labels(spark, [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels])
    assert {(r["doc_id"], r["score"]) for r in toxicity.score_documents(df, hidden).collect()} == {(r["doc_id"], r["score"]) for r in got}
    assert toxicity.score_documents(docs, known).count() == len(TEXTS) and toxicity.score_documents(none, known).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(docs, known.where("toxic = 0")).collect())


def _grams(text):
    t = " " + " ".join((text or "").lower().split()) + " "
    return [t[i : i + n] for n in range(3, 8) for i in range(len(t) - n + 1)]


def test_character_grams_and_ratios_against_brute_force(spark):
    """N-grams are of characters; ratios are those of plain counts, of every significant n-gram, whatever their number."""
    texts = [_prose(i, 30) + (" schönes übel" if i % 3 == 0 else " güte") for i in range(90)]
    for t in [*texts, "日本語テキスト", "", None]:
        assert len(toxicity.buckets(t)) == len(_grams(t))
    assert toxicity.buckets("日本語x").size == toxicity.buckets("abcx").size
    train = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, y int")
    ratios = toxicity.count_ratios(train)
    counts = np.zeros((2, toxicity.BUCKETS))
    for i, t in enumerate(texts):
        counts[int(i % 3 == 0), np.unique(toxicity.buckets(t))] += 1
    total = np.array([60, 30])
    p, q = (counts[1] + 0.5) / (total[1] + 1), (counts[0] + 0.5) / (total[0] + 1)
    error = np.sqrt(1 / (counts[1] + 0.5) - 1 / 31 + 1 / (counts[0] + 0.5) - 1 / 61)
    want = np.where((np.abs(np.log(p / q)) >= 3 * error) & (counts.sum(0) > 0), np.log(p / q), 0)
    assert (want != 0).sum() > 30 and np.allclose(ratios, want, atol=1e-5)


def test_the_logistic_fit_is_at_its_minimum(spark, monkeypatch):
    """The gradient, by plain loops, vanishes at the fit; blocks of rows make no difference; labels above 1 are toxic."""
    texts = [_prose(i, 30) + (" vile" if i % 3 == 0 else " kind") for i in range(90)]
    train = spark.createDataFrame([(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)], "doc_id long, text string, y int")
    ratios = toxicity.count_ratios(train)
    ends, at, value, y = toxicity.sampled(train, ratios)
    assert len(y) == 90 and y.sum() == 30
    weights, offset = toxicity.fit_logistic(ends, at, value, y, toxicity.BUCKETS)
    gradient, by_row = np.append(1e-4 * weights, 0.0), np.split(np.arange(len(at)), ends[:-1])
    for entries, label in zip(by_row, y, strict=True):
        error = 1 / (1 + np.exp(-(value[entries] @ weights[at[entries]] + offset))) - label
        np.add.at(gradient, at[entries], value[entries] * error / 90)
        gradient[-1] += error / 90
    assert np.abs(gradient).max() < 1e-4
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    again, _ = toxicity.fit_logistic(ends, at, value, y, toxicity.BUCKETS)
    assert np.allclose(again, weights, atol=1e-4)
    t = texts[0]
    found, n = np.unique(toxicity.buckets(t), return_counts=True)
    assert abs(
        toxicity.score(t, (weights * ratios).astype(np.float32), offset) - 1 / (1 + np.exp(-(np.log1p(n) @ (weights * ratios)[found] + offset)))
    ) < 1e-5
    a, b = (toxicity.fit(train.withColumn("y", F.col("y") * k)) for k in (1, 7))
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_lasso_is_at_its_minimum():
    """The conditions of the optimum: a used rule's gradient equals the penalty, an unused one's is within it."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 12)) < 0.4).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 3])))).astype(float)
    w, offset = rule_ensemble.lasso_logistic(x, y, 0.01)
    error = 1 / (1 + np.exp(-(x @ w + offset))) - y
    gradient = x.T @ error / 400
    assert 0 < (w != 0).sum() < 12 and abs(error.mean()) < 1e-4
    assert np.allclose(gradient[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(gradient[w == 0]) <= 0.01 + 1e-4).all()


def test_rules_are_what_the_columns_hold(spark):
    """Each path, checked bound by bound, against the compiled column."""
    texts = [_prose(i, 60) if i % 3 else " ".join(f"W{x}%%%" for x in range(i % 50 + 10)) for i in range(120)]
    model = rule_ensemble.train(_docs(spark, texts), _labels(spark, [(i, int(i % 3 > 0), 0) for i in range(120)]))
    got = {
        r["doc_id"]: r["score"] for r in rule_ensemble.with_features(_docs(spark, texts), "doc_id").select(
            "doc_id",
            model.column().alias("score"),
        ).collect()
    }
    for i, t in enumerate(texts):
        x = stats.features(t)
        z = model.offset + sum(w for path, w in zip(model.rules, model.weights, strict=True) if all((x[f] > cut) == above for f, above, cut in path))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_rule_ensemble(spark, docs, none):
    texts = [_prose(i, 60) if i % 3 else " ".join(f"W{x}%%%" for x in range(i % 50 + 10)) for i in range(240)]
    df, known = _docs(spark, texts, extra=True), _labels(spark, [(i, int(i % 3 > 0), 0) for i in range(240)])
    got = rule_ensemble.score_documents(df, known).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    model = rule_ensemble.train(df, known)
    assert 0 < len(model.rules) < 60
    x = np.array([stats.features(t) for t in texts])
    assert np.allclose(model.predict(x), [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])])
    edge = rule_ensemble.score_documents(docs, known).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in edge)
    assert rule_ensemble.score_documents(none, known).count() == 0
    assert len({r["score"] for r in rule_ensemble.score_documents(docs, known.where("false")).collect()}) == 1


def test_sample_is_bounded_and_never_empty(spark):
    spread = spark.range(200_000).selectExpr("id AS doc_id", "'t' AS text")
    few = common.first_picked(common.bounded_sample(spread, 5, "doc_id", "text"), 5)
    assert 1 <= few.count() <= 5
    assert few.collect() == common.first_picked(common.bounded_sample(spread.repartition(7), 5, "doc_id", "text"), 5).collect()
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS text")
    assert common.first_picked(common.bounded_sample(hot, 50, "doc_id", "text"), 50).count() <= 50
    assert common.first_picked(common.bounded_sample(hot, 5000, "doc_id", "text"), 5000).count() == 3000


def test_files_are_cut_alike_whatever_executors_live(spark):
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    common.hold_settings(spark)
    assert int(spark.conf.get(key)) == spark.sparkContext.defaultParallelism
    spark.conf.set(key, "3")
    common.hold_settings(spark)
    assert spark.conf.get(key) == "3"
    spark.conf.set(key, before) if before else spark.conf.unset(key)

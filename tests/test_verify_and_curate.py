from pyspark.sql import functions as F

from normgraph.operators import curate, verify
from normgraph.plans import tables
from normgraph.schemas import DECISIONS
from normgraph.sources import files

TEXT = "1. The provider shall establish a “risk management system” and keep it up to date throughout the whole life of the system concerned."
RECORD = "seq long, term string, entity_type string, label string, definition string, article_ref string, source_quote string, bearer string, applies_to string, confidence double, chunk_id string, chunk_file string, eli_uri string, model string"
JUDGED = RECORD + ", critic_verdict string, critic_reason string"


def _record(seq, term="risk system", kind="Requirement", ref="Art. 5(1)", quote="x", bearer=None, confidence=0.9, file="art_005.json"):
    return (seq, term, kind, term, "d", ref, quote, bearer, None, confidence, "art_5", file, f"eli{seq}", "m")


def _ground(spark, rows, kind="article", number="5"):
    chunks = spark.createDataFrame([("art_005.json", TEXT, kind, number)], "file string, text string, type string, number string")
    out = verify.ground(verify.with_chunks(spark.createDataFrame(rows, RECORD), chunks))
    return {r["seq"]: r for r in out.collect()}


def test_grounding(spark):
    quote = "establish a \"risk management system\" and keep\nit up   to date"
    typo = "keep it up to date throughout the whle life of the system concerned"
    got = _ground(
        spark,
        [
            _record(0, quote=quote),
            _record(1, quote=typo),
            _record(2, quote="deployers have to think about hazards"),
            _record(3, quote="  "),
            _record(4, quote=quote, ref="Art. 50(1)"),
            _record(5, quote=quote, ref="Art. 5"),
            _record(6, quote=None),
        ],
    )
    assert (got[0]["grounding_method"], got[0]["grounding_score"], got[0]["grounded"]) == ("exact", 100.0, True)
    assert got[1]["grounding_method"] == "fuzzy" and 95 <= got[1]["grounding_score"] < 100 and got[1]["grounded"]
    assert not got[2]["grounded"] and got[2]["grounding_reason"] == "quote not found"
    assert got[3]["grounding_score"] == 0 and got[3]["grounding_method"] is None and got[6]["grounding_score"] == 0
    assert got[4]["grounding_method"] == "exact" and not got[4]["grounded"] and "does not match chunk" in got[4]["grounding_reason"]
    assert got[5]["grounded"]


def test_records_without_a_chunk_are_rejected(spark):
    got = _ground(
        spark,
        [_record(0, quote="risk management system"), _record(1, quote="risk management system", file="gone.json"), _record(2, quote=None, file=None)],
    )
    assert sorted(got) == [0, 1, 2] and got[0]["grounded"]
    for k in (1, 2):
        assert not got[k]["grounded"] and got[k]["grounding_reason"] == "chunk not found" and got[k]["grounding_score"] == 0 and got[k]["grounding_method"] is None


def test_merging(spark):
    rows = [
        (*_record(0, "Risk Management System", ref="Art. 9", confidence=0.8), "partially", ""),
        (*_record(1, "risk management system", ref="Art. 8", confidence=0.7), "supported", ""),
        (*_record(2, "risk management system", bearer="provider"), "supported", ""),
        (*_record(3, "risk management system", kind="Obligation"), "supported", ""),
        (*_record(4, "risk management system", ref="Art. 9"), "supported", ""),
    ]
    out = verify.deduplicate(spark.createDataFrame(rows, JUDGED)).collect()
    assert [r["merged_count"] for r in out] == [3, 1, 1]
    assert out[0]["seq"] == 4 and out[0]["article_refs"] == ["Art. 9", "Art. 8"]
    assert [s["eli_uri"] for s in out[0]["sources"]] == ["eli0", "eli1", "eli4"]


def test_groups_follow_their_leader_and_not_a_chain(spark):
    a, b, c = "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaabb", "aaaaaaaaaaaaaaaabbbb"
    df = spark.createDataFrame([(0, "k", a), (1, "k", b), (2, "k", c), (3, "k", b), (4, None, a)], "seq long, block string, term string")
    got = {r["seq"]: r["leader"] for r in verify.leader_groups(df, ["block"], "term", "seq").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def _log(spark, rows):
    full = [
        (
            i,
            r[0],
            "t",
            "Actor",
            r[3] if len(r) > 3 else "supported",
            "me",
            r[1],
            r[4] if len(r) > 4 else None,
            r[2] if len(r) > 2 else None,
            None,
            "2024-01-01T00:00:00+00:00",
        ) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, DECISIONS)


def test_replay_keeps_places(spark):
    state = curate.replay(
        _log(spark, [("a", "accept"), ("b", "accept"), ("a", "reject"), ("b", "undo"), ("c", "accept"), ("b", "edit"), ("d", "undo")])
    ).orderBy("ord").collect()
    assert [(r["id"], r["action"]) for r in state] == [("a", "reject"), ("c", "accept"), ("b", "edit")]


def test_merge_chains(spark):
    state = curate.replay(
        _log(spark, [("a", "accept"), ("b", "merge", "a"), ("c", "merge", "b"), ("x", "merge", "y"), ("y", "merge", "x"), ("z", "merge", "x")])
    )
    got = {r["id"]: r["final"] for r in curate.resolve_merges(state).collect()}
    assert got == {"b": "a", "c": "a", "x": None, "y": None, "z": None}


def test_curated_view(spark):
    schema = JUDGED + ", article_refs array<string>, sources array<struct<article_ref:string,chunk_id:string,eli_uri:string,source_quote:string,critic_verdict:string,critic_reason:string>>, id string, ord long"
    row = lambda i, id, ref: (*_record(i, f"term {id}", ref=ref, bearer="who"), "supported", "", [ref], [(ref, "c", "e", f"q{id}", "supported", "")], id, i)
    records = spark.createDataFrame(
        [row(0, "a", "Art. 1"), row(1, "b", "Art. 2"), row(2, "c", "Art. 1"), row(3, "d", "Art. 4"), row(4, "e", "Art. 5")],
        schema,
    )
    log = _log(
        spark,
        [
            ("a", "edit", None, "supported", {"bearer": ["who", None], "label": ["x", "new"]}),
            ("b", "merge", "a"),
            ("c", "merge", "b"),
            ("d", "reject"),
            ("e", "merge", "d"),
            ("gone", "accept"),
        ],
    )
    state = curate.replay(log)
    entities, orphans = curate.build(records, state)
    (e,) = entities.collect()
    assert (e["id"], e["bearer"], e["label"], e["curation_status"], e["merged_ids"]) == ("a", None, "new", "edited", ["b", "c"])
    assert e["article_refs"] == ["Art. 1", "Art. 2"] and [s["source_quote"] for s in e["sources"]] == ["qa", "qb", "qc"]
    assert [r["id"] for r in orphans.collect()] == ["e"]
    s = curate.status(records, state, orphans).first()
    assert (s["decided"], s["remaining"], s["stale"], s["orphans"]) == (5, 0, 1, 1)
    ids = curate.keyed(records.drop("id", "ord").withColumn("label", F.lit("other")))
    assert {r["id"] for r in ids.collect()} == {r["id"] for r in curate.keyed(records.drop("id", "ord")).collect()}


def test_queue_order(spark):
    source = "array<struct<critic_verdict:string>>"
    rows = [
        ("s", "supported", [("supported",)], 0),
        ("p", "partially", [("partially",)], 1),
        ("m", "supported", [("partially",)], 2),
        ("u", "supported", [("unsupported",)], 3),
        ("n", None, [], 4),
        ("d", None, None, 5),
    ]
    records = spark.createDataFrame(rows, f"id string, critic_verdict string, sources {source}, ord long")
    decided = spark.createDataFrame([("d",)], "id string")
    assert [r["id"] for r in curate.queue(records, decided).collect()] == ["n", "u", "m", "p", "s"]
    assert [r["id"] for r in curate.queue(records, decided, "none").collect()] == ["n"]


def test_changes_and_suggestions(spark):
    schema = "id string, term string, entity_type string, label string, definition string, bearer string, applies_to string"
    old = spark.createDataFrame([("a", "t", "Actor", "l", "d", "b", None), ("b", "t", "Actor", "l", "d", None, None)], schema)
    new = spark.createDataFrame([("a", "t", "Actor", "l2", "d", None, None), ("b", "t", "Actor", "l", "d", None, None)], schema)
    got = {r["id"]: (r["changes"], r["action"]) for r in curate.changes(old, new).collect()}
    assert got == {"a": ({"label": ["l", "l2"], "bearer": ["b", None]}, "edit"), "b": ({}, "accept")}
    records = spark.createDataFrame(
        [(str(i), f"term {i}", "Actor" if i % 2 else "Authority") for i in range(20)],
        "id string, term string, entity_type string",
    )
    from normgraph.functions.fuzzy import token_sort_ratio_column

    best = curate.suggestions(records, records.where("id = '1'"), token_sort_ratio_column).orderBy("rank").collect()
    assert len(best) == 8 and all(r["entity_type"] == "Actor" and r["id"] != "1" for r in best)


def test_quotes_are_found_wherever_they_start(spark):
    texts = ["the cat sat on a mat by the door of the house", "a cat", "", None, "he cat sat on a mat", "one two three four five six seven"]
    quotes = [
        "e cat sat on a ma",
        "cat",
        "the cat sat on a mat by",
        "two  three",
        "ne two three four five six seve",
        "",
        None,
        "a",
        "three four five x",
        "at sat",
    ]
    got = verify.occurrences(
        spark.createDataFrame(list(enumerate(texts)), "id long, text string"),
        spark.createDataFrame(list(enumerate(quotes)), "item long, quote string"),
    ).collect()
    clean = lambda x: " ".join((x or "").split())
    assert sorted((r["item"], r["id"]) for r in got) == sorted(
        (i, k) for i, q in enumerate(quotes) for k, t in enumerate(texts) if clean(q) and clean(q) in clean(t)
    )


def test_leaders_against_their_definition(spark):
    import random

    from normgraph.functions.fuzzy import token_sort_ratio

    rng = random.Random(3)
    terms = [
        " ".join(
            rng.choice(("risk", "risks", "system", "systems", "high", "notified body", "é")) for _ in range(rng.randint(1, 5))
        ) for _ in range(150)
    ]
    rows = [(k, f"b{k % 2}", t) for k, t in enumerate(terms)]
    want, leaders = {}, {}
    for k, block, t in rows:
        hit = next((n for n, x in leaders.setdefault(block, []) if token_sort_ratio(x, t) >= 90), None)
        if hit is None:
            leaders[block].append((k, t))
        want[k] = k if hit is None else hit
    got = verify.leader_groups(spark.createDataFrame(rows, "seq long, block string, term string"), ["block"], "term", "seq")
    assert {r["seq"]: r["leader"] for r in got.collect()} == want


def test_a_session_from_the_terminal(spark, tmp_path):
    """Accept, edit, undo, merge, reject, skip and view, then status and export, as commands."""
    import json

    from normgraph import cli

    (tmp_path / "verified").mkdir()
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "c.json").write_text(json.dumps({"id": "c1", "type": "article", "text": "the whole article"}))
    rows = [
        {
            "term": f"duty {x}",
            "entity_type": "Obligation",
            "label": x,
            "definition": "d",
            "article_ref": "Art. 1",
            "source_quote": f"q{x}",
            "bearer": "b",
            "confidence": 0.9,
            "chunk_id": "c1",
            "critic_verdict": v,
        } for x, v in (("one", None), ("two", "unsupported"), ("three", "partially"), ("four", "supported"))
    ]
    (tmp_path / "verified" / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    paths = {"records": "verified", "log": "log", "entities": "out", "chunks": "chunks"}
    (tmp_path / "c.yaml").write_text("curate:\n" + "".join(f"  {k}: {tmp_path / v}\n" for k, v in paths.items()))
    said, answers = [], iter(["v", "a", "e", "", "Odd", "Requirement", "", "", "-", "", "u", "r", "weak", "m", "", "m", "1", "s"])
    run = lambda *args: cli.main(["--config", str(tmp_path / "c.yaml"), *args], lambda _: next(answers), said.append, spark)
    run()
    assert "the whole article" in said and "This session: 1 accept, 1 edit, 1 undo, 1 reject, 1 merge" in said
    log = {r["term"]: r for r in curate.replay(files.read_decisions(spark, str(tmp_path / "log"))).collect()}
    assert {t: r["action"] for t, r in log.items()} == {
        "duty one": "accept",
        "duty two": "reject",
        "duty three": "merge",
    } and log["duty two"]["reason"] == "weak"
    edits = [r for r in files.read_decisions(spark, str(tmp_path / "log")).where("action = 'edit'").collect()]
    assert edits[0]["changes"] == {"entity_type": ["Obligation", "Requirement"], "bearer": ["b", None]}
    said.clear()
    run("export")
    run("status")
    assert said[0].startswith("1 entities") and "3 | 1 | 0" in said[2]
    answers = iter(["q"])
    run("review", "--redo", "--verdict", "supported", "--reviewer", "x")
    assert any("duty four" in x for x in said)


def test_chunk_texts_are_not_broadcast(spark):
    chunks = spark.createDataFrame([("f1", "some text", "article", "1")], "file string, text string, type string, number string")
    records = spark.createDataFrame([("some text", "Art. 1", "f1"), ("some text", "Art. 1", None)], "source_quote string, article_ref string, chunk_file string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = verify.ground(verify.with_chunks(records, chunks))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["chunk_file"] or "", r["grounded"]) for r in out.collect()) == [("", False), ("f1", True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_routing_broadcasts_no_chunk(spark, monkeypatch):
    def broadcast(*_):
        raise AssertionError("a table of texts was to be broadcast")

    monkeypatch.setattr(tables, "sized", broadcast)
    chunks = spark.createDataFrame([("art_005.json", TEXT, "article", "5")], "file string, text string, type string, number string")
    rows = [(*_record(k, quote=q), "supported", "r") for k, q in enumerate(["risk management", "¤¤", "the provider", "whole life"])]
    kept, rejected = verify.route(verify.ground(verify.with_chunks(spark.createDataFrame(rows, JUDGED), chunks)))
    assert sorted((r["seq"], r["critic_verdict"]) for r in kept.collect()) == [(0, "supported"), (3, "supported")]
    assert sorted((r["seq"], r["critic_verdict"]) for r in rejected.collect()) == [(1, None), (2, None)]


def test_copies_in_small_files_are_not_broadcast(spark, tmp_path):
    """A megabyte of copies in a file of some kilobytes, far below the size up to which Spark broadcasts."""
    from normgraph import whole

    text = " ".join(f"duty {i} of the provider" for i in range(200))
    spark.range(240).selectExpr("id doc_id", f"'{text}' text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    quoted = whole._quoted(spark, str(tmp_path))
    assert "Broadcast" not in quoted._jdf.queryExecution().executedPlan().toString()
    assert quoted.where("chunk_text IS NOT NULL").count() == 200
    # kept: of each 12 documents those whose quote is verbatim or off by a letter and whose reference is at home, of numbers 0, 2, 6 and 8
    assert {(r["route"], r["critic_verdict"], r["n"]) for r in whole.routed_records(spark, str(tmp_path)).collect()} == {
        ("kept", "supported", 80),
        ("rejected", None, 160),
    }


def test_groups_of_equal_tokens_need_no_comparison(spark):
    rows = [(7, "a", "b  a"), (3, "a", "x"), (5, "a", "a b"), (4, None, "a b"), (9, "a", None), (8, "a", ""), (6, "a", "a b b"), (2, None, "b a")]
    got = verify.leader_groups(spark.createDataFrame(rows, "seq long, block string, term string"), ["block"], "term", "seq", 100.0)
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["seq"]: r["leader"] for r in got.collect()} == {7: 5, 5: 5, 3: 3, 4: 2, 2: 2, 9: 8, 8: 8, 6: 6}


def test_suggestions_compare_each_term_once(spark):
    """Against all pairs: types of many records, of few, of none and null ones, terms that many records have, in either case."""
    import random

    from normgraph.functions.fuzzy import token_sort_ratio, token_sort_ratio_column

    rng, words = random.Random(7), ["risk", "Risk", "system", "duty", "of", "care"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice(["A"] * 30 + ["B"] * 30 + ["C", "D", None])) for i in rng.sample(range(1000), 400)]
    rows += [(1000 + i, "the same term", "A") for i in range(200)] + [(2000, "Care of", "E"), (2001, None, "A")]
    asked = [r for r in rows if r[0] % 10 == 0 or r[2] in (None, "C", "D")]
    known = {None: 2, True: 0, False: 1}  # nulls come last
    want = {}
    for q, t, kind in asked:
        scored = []
        for i, u, other in rows:
            if i != q:
                score = None if t is None or u is None else token_sort_ratio(t.lower(), u.lower())
                same = None if kind is None or other is None else kind == other
                scored.append((known[same], score is None, -(score or 0), i, score))
        want |= {(q, n + 1): (x[3], x[4]) for n, x in enumerate(sorted(scored)[:8])}
    calls = spark.sparkContext.accumulator(0)

    def counted(a, b):
        @F.udf("int")
        def see(_):
            calls.add(1)
            return 0

        return token_sort_ratio_column(a, b) + see(b)

    schema = "id long, term string, entity_type string"
    records = spark.createDataFrame(rows, schema)
    got = curate.suggestions(records, spark.createDataFrame(asked, schema), counted).collect()
    assert {(r["of_id"], r["rank"]): (r["id"], r["score"]) for r in got} == want
    assert 0 < calls.value < len(rows) * len(asked) / 3

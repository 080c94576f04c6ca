import json
import os
from datetime import UTC, datetime

from pyspark.sql import functions as F

from normgraph.operators import curate, extract
from normgraph.schemas import DECISIONS, EXTRACTED
from normgraph.sources import files, markup
from normgraph.streaming import replay as stream

HTML = """<html><div id="art_5"><p class="oj-ti-art">Article&nbsp;5</p><div class="eli-title"><p class="oj-sti-art">Banned things</p></div>
<div id="005.001"><p class="oj-normal">1.   The following shall be banned:</p>
<table><tbody><tr><td><p class="oj-normal">(a)</p></td><td><p class="oj-normal">first thing<br>more</p><table><tr><td>(i)</td><td><span>nested</span></td></tr></table></td></tr></tbody></table>
<table><tr><td>alone</td></tr></table><p class="oj-normal">Closing words.</p></div>
<div id="005.002"><p class="oj-normal">2. Second.</div></div>
<div id="art_6"><p class="oj-ti-art">Article 6</p><p class="oj-sti-art">Other</p><p class="oj-normal">Only text.</p></div>
<div id="anx_III"><p class="oj-doc-ti">ANNEX III</p><p class="oj-doc-ti">Areas</p><p class="oj-ti-grseq-1">Section A</p><table><tr><td>1.</td><td><p class="oj-normal">work</p></td></tr></table><table><tr><td>2.</td><td><p class="oj-normal">school</p></td></tr></table></div>"""


def test_passages_and_rendering(spark):
    pages = spark.createDataFrame([(HTML,)], "html string")
    rows = markup.chunk_html(pages, "http://e").orderBy("chunk_id", "ord").collect()
    refs = [(r["ref"], r["level"], r["depth"], r["section"], r["text"]) for r in rows]
    assert ("5(1)", "paragraph", 0, None, "The following shall be banned:") in refs
    assert ("5(1)(a)", "point", 1, None, "first thingmore") in refs and ("5(1)(a)(i)", "point", 2, None, "nested") in refs
    assert ("Annex III(1)", "point", 1, "Section A", "work") in refs and ("6", "paragraph", 0, None, "Only text.") in refs
    assert next(r for r in rows if r["ref"] == "5(2)")["number"] == 2 and rows[0]["eli_uri"].startswith("http://e/a")
    text = {r["chunk_id"]: r["text"] for r in markup.render(markup.chunk_html(pages)).collect()}
    assert text["art_5"] == "Article 5: Banned things\n\n[5(1)] The following shall be banned:\n  [5(1)(a)] first thingmore\n    [5(1)(a)(i)] nested\n[5(1)] Closing words.\n[5(2)] Second."
    assert text["anx_III"] == "Annex III: Areas\n\nSection A\n  [Annex III(1)] work\n  [Annex III(2)] school"
    assert {r["chunk_id"] for r in markup.chunk_html(pages, scope={"articles": {"6"}, "annexes": set()}).collect()} == {"art_6", "anx_III"}
    listed = spark.createDataFrame([("article", "6")], "kind string, chunk_no string")
    assert {r["chunk_id"] for r in markup.in_scope(markup.chunk_html(pages), listed).collect()} == {"art_6", "anx_III"}


def test_scans_and_sinks(spark, tmp_path):
    assert files.overlay({"a": 1, "b": 2}, str(tmp_path / "none.yaml")) == {"a": 1, "b": 2}
    (tmp_path / "c.yaml").write_text("verify:\n  a: 5\n")
    assert files.overlay({"a": 1, "b": 2}, str(tmp_path / "c.yaml"), "verify") == {"a": 5, "b": 2}
    assert files.load_scope(str(tmp_path / "none.yaml")) == {"articles": set(), "annexes": set()}
    os.makedirs(tmp_path / "x")
    for name in ("b.jsonl", "a.jsonl"):
        (tmp_path / "x" / name).write_text("".join(json.dumps({"term": f"{name}{i}"}) + "\n\n" for i in range(3)))
    got = [r["term"] for r in files.read_records(spark, str(tmp_path / "x"), EXTRACTED).orderBy("seq").collect()]
    assert got == [f"{n}{i}" for n in ("a.jsonl", "b.jsonl") for i in range(3)]
    assert files.read_decisions(spark, str(tmp_path / "no")).count() == 0
    chunk = spark.createDataFrame(
        [("art_5", "article", "5", None), ("anx_III", "annex", None, "III")],
        "id string, type string, article_number string, annex_number string",
    )
    files.write_chunks(chunk, str(tmp_path / "chunks"))
    assert sorted(os.listdir(tmp_path / "chunks")) == ["annex_III.json", "art_005.json"]
    assert {r["file"] for r in files.read_chunks(spark, str(tmp_path / "chunks")).collect()} == {"annex_III.json", "art_005.json"}
    files.save_snapshot("<p>x</p>", "http://u", str(tmp_path / "raw"), "2024-01-01T00:00:00+00:00")
    snap = files.read_snapshot(spark, str(tmp_path / "raw"))
    assert snap.where(files.needs_download()).count() == 1 and len(snap.first()["sha256"]) == 64
    fresh = snap.withColumn("retrieved_at", F.current_timestamp().cast("string"))
    assert fresh.where(files.needs_download()).count() == 0
    assert fresh.withColumn("retrieved_at", F.lit("never")).where(files.needs_download()).count() == 1


def test_the_log_of_many_files_is_read_in_order(spark, tmp_path):
    """Lines without seq, in files that are read in blocks: by file name and line, whatever the blocks' sizes. A mixed log is numbered whole."""
    line = lambda id, action, **more: json.dumps({"id": id, "action": action, "reason": "x" * 500} | more) + "\n"
    os.makedirs(tmp_path / "log")
    (tmp_path / "log" / "2026-01.json").write_text("".join(line(f"p{i}", "accept") for i in range(90)) + line("a", "accept"))
    (tmp_path / "log" / "2026-02.json").write_text(
        "".join(line(f"q{i}", "accept") for i in range(900)) + line("a", "reject") + "\n" + line("p3", "undo", seq=1)
    )
    keys = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        log = files.read_decisions(spark, str(tmp_path / "log"))
        assert [r["id"] for r in log.orderBy("seq").collect()] == [f"p{i}" for i in range(90)] + ["a"] + [f"q{i}" for i in range(900)] + ["a", "p3"]
        state = {r["id"]: r["action"] for r in curate.replay(log).collect()}
        assert state["a"] == "reject" and "p3" not in state
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_page_is_downloaded_once(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["Accept-Language"]))
            self.send_response(202 if self.path == "/wait" else 200)
            if self.path == "/wall":
                self.send_header("x-amzn-waf-action", "challenge")
            self.end_headers()
            self.wfile.write("<p>é</p>".encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        now = datetime.now(UTC).isoformat(timespec="seconds")
        for _ in range(2):
            assert files.ingest(spark, f"{at}/page", str(tmp_path / "raw"), now).first()["html"] == "<p>é</p>"
        assert asked == [("/page", "eng")]
        files.save_snapshot("", f"{at}/page", str(tmp_path / "raw"), now)  # an empty page is asked for again
        assert files.ingest(spark, f"{at}/page", str(tmp_path / "raw"), now).first()["html"] == "<p>é</p>" and len(asked) == 2
        for path in ("wait", "wall"):
            with pytest.raises(RuntimeError):
                files.download(f"{at}/{path}")
    finally:
        server.shutdown()


def test_bundle(spark, tmp_path):
    src = tmp_path / "src"
    for p in ("docs/a.md", "docs/.gitkeep", "data/__pycache__/x.pyc", "data/b.txt", "data/empty.txt"):
        os.makedirs((src / p).parent, exist_ok=True)
        (src / p).write_text("" if "empty" in p else "text")
    out = tmp_path / "out"
    os.makedirs(out)
    assert sorted(files.bundle(spark, str(src), str(out), {"Docs": ["docs"], "Data": ["data"]}, zipped=True)) == ["data/b.txt", "docs/a.md"]
    assert "## Docs" in (out / "MANIFEST.md").read_text() and os.path.exists(f"{out}.zip")
    sizes = spark.createDataFrame([(1 << 20,), (2048,)], "n long").select(files.size_text(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in sizes] == ["1.0 MB", "2 KB"]


def test_extraction_is_cached_and_isolated(spark):
    chunks = spark.createDataFrame(
        [("c1", "f1", "e", "[5(1)] A provider shall keep records."), ("c2", "f2", "e", "boom")],
        "chunk_id string, chunk_file string, eli_uri string, text string",
    )

    def model(chunk, text):
        if text == "boom":
            raise RuntimeError("cut off")
        return extract.rule_extractor(chunk, text) + [{"term": "x", "entity_type": "Strange"}]

    records, cache, counts = extract.extract(chunks, extractor=model)
    (r,) = records.collect()
    assert (r["term"], r["bearer"], r["article_ref"], r["chunk_file"]) == ("keep records", "A provider", "Art. 5(1)", "f1")
    assert {c["chunk_id"]: (c["n"], c["error"]) for c in counts.collect()} == {"c1": (1, None), "c2": (0, "RuntimeError: cut off")}

    def never(chunk, text):
        raise AssertionError("asked again")

    again, _, _ = extract.extract(chunks.where("chunk_id = 'c1'"), cache=cache, extractor=never)
    assert again.count() == 1
    texts = records.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("seq", F.lit(1))
    judged, verdicts = extract.critique(texts)
    assert judged.first()["critic_verdict"] == "supported" and verdicts.count() == 1
    odd, none = extract.critique(texts, critic=lambda t, r: {"verdict": "maybe"})
    assert odd.first()["critic_verdict"] is None and "maybe" in odd.first()["critic_reason"] and none.count() == 0


def test_log_stream(spark, tmp_path):
    row = lambda i, id, action: (i, id, "t", "Actor", "supported", "me", action, None, None, None, f"2024-01-0{i + 1}T00:00:00Z")
    log, view = str(tmp_path / "log"), str(tmp_path / "view")
    spark.createDataFrame([row(0, "a", "accept"), row(1, "b", "accept")], DECISIONS).write.json(log)
    stream.materialise(spark, log, view, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([row(2, "a", "undo")], DECISIONS).write.mode("append").json(log)
    stream.materialise(spark, log, view, str(tmp_path / "cp")).awaitTermination()
    assert [r["id"] for r in stream.current(spark, view).collect()] == ["b"]
    spark.createDataFrame([row(3, "a", "edit"), row(4, "b", "reject")], DECISIONS).write.mode("append").json(log)
    stream.materialise(spark, log, view, str(tmp_path / "cp")).awaitTermination()
    whole = {(r["id"], r["action"], r["ord"]) for r in curate.replay(spark.read.schema(DECISIONS).json(log)).collect()}
    assert {(r["id"], r["action"], r["ord"]) for r in stream.current(spark, view).collect()} == whole == {("a", "edit", 3), ("b", "reject", 1)}
    q = stream.counts(stream.read_log(spark, log)).writeStream.outputMode("complete").format("memory").queryName("actions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM actions").first()["n"] == 5


def test_sizes_are_rounded_to_even(spark):
    totals = [512, 1536, 2560, 2561, (1 << 20) + (1 << 18), (1 << 20) + 3 * (1 << 18), (1 << 20) + (1 << 18) + 1, 12478115533, 1 << 20, 1048575]
    plain = lambda n: f"{n / (1 << 20):.1f} MB" if n >= 1 << 20 else f"{n / 1024:.0f} KB"
    got = spark.createDataFrame([(n,) for n in totals], "n long").select("n", files.size_text(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == {n: plain(n) for n in totals}


def test_manifest_of_prices_between_two_numbers(spark, tmp_path):
    import duckdb

    from normgraph import queries

    rows = [(1, "A", 0.5), (2, "A", 1024.5), (3, "A", 512.0), (4, "B", 2.5), (5, "B", 3.5), (6, "C", 1310720.5)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = queries.bundle_manifest(spark, str(tmp_path)).select("grp", "n_files", "size").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["bundle_manifest"]).fetchall())


def test_chunks_of_long_numbers_have_files_of_their_own(spark, tmp_path):
    numbers = ["7", "100", "1001", "1002", "10015"]
    rows = [(f"art_{n}", "article", n, None, f"text {n}") for n in numbers]
    chunks = spark.createDataFrame(rows, "id string, type string, article_number string, annex_number string, text string")
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    got = files.read_chunks(spark, f"file://{tmp_path}/chunks").select("id", "file", "text").collect()
    assert {r["id"]: (r["file"], r["text"]) for r in got} == {f"art_{n}": (f"art_{n.zfill(3)}.json", f"text {n}") for n in numbers}


def test_titles_with_cut_and_other_references(spark, tmp_path):
    import duckdb

    from normgraph import queries

    titles = ["a &amp; b &amp", "say &quot;x&quot; &quo", "5 &lt; 6 &#38; &nbsp;", "&amp;amp; &am", " two\n\t \xa0words\u2003", "in\u2003side &copy", "", "&amp;lt;"]
    rows = [(k, f"<html><head><title>{t}</title></head><body><ul><li>x<li class='a'>y &amp; z</ul></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame([*rows, (98, "<p>no title"), (99, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.page_titles(spark, str(tmp_path)).select("page_id", "title", "items").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["page_titles"]).fetchall())
    assert markup.tree("<p>a &amp; b &quot;").text() == 'a & b "'

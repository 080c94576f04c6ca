"""Registered queries that run whole operators over the driver's tables: parsing, grounding, merging, curation, the generated graph,
checks, and files written and read back. Beside each stands the SQL that it has to equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import cache_key, normalise
from .operators import build, curate, evaluate, extract, reason, report, shacl, verify
from .plans.tables import read
from .queries import _GRAPH, _SPACE, _STATE, _log, indel_sql, query, tpch_graph
from .schemas import BASE, BEARER_ALIASES, DCTERMS, OWL, PROV, RDF, RDFS, SKOS, SYSTEM_ALIASES, TYPE_MAP
from .sources import files, markup, rdf
from .sources.files import fresh_folder

_CLEAN = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"

# --- pages to passages ------------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the page of one article: its turns are numbered paragraphs, the role a section with a point and one inside it."""
    c = read(spark, sf_dir, "conversations")
    safe = F.replace(
        F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
        F.lit(">"),
        F.lit("&gt;"),
    )
    no, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    at = F.concat(F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad(turn, 3, "0"))
    part = F.concat(
        F.lit('<div id="'), at, F.lit('"><p class="oj-normal">'), turn, F.lit(".&nbsp; "), safe, F.lit('</p><p class="oj-ti-grseq-1">Part of '), "role",
        F.lit('</p><table><tbody><tr><td></td><td>(a)</td><td><p class="oj-normal">by  the '), "role",
        F.lit('</p><table><tr><td>(i)</td><td><span>inner</span></td></tr></table></td></tr></tbody></table><table><tr><td>no point</td></tr></table><div><p class="oj-normal">closed</p></div></div>'),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))), lambda x: x["x"]), "\n")
    page = F.concat(
        F.lit('<html><body><div class="eli-subdivision" id="art_'),
        F.first(no),
        F.lit('"><p class="oj-ti-art">Article '),
        F.first(no),
        F.lit('</p><div class="eli-title"><p class="oj-sti-art">Talk '),
        F.first(no),
        F.lit("</p></div>"),
        parts,
        F.lit("</div></body></html>"),
    )
    return c.groupBy("conv_id").agg(page.alias("html"))


_PASSAGES = f"""t AS (SELECT *, conv_id || '(' || turn || ')' AS ref, 'art_' || conv_id AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
q AS (SELECT conv_id, turn, chunk_id, ref, CAST(NULL AS VARCHAR) AS parent_ref, 'paragraph' AS level, CAST(NULL AS VARCHAR) AS label, turn AS number,
CAST(NULL AS VARCHAR) AS section, 0 AS depth, 4 * n AS ord, {_CLEAN} AS text FROM t
UNION ALL SELECT conv_id, turn, chunk_id, ref || '(a)', ref, 'point', 'a', NULL, 'Part of ' || role, 1, 4 * n + 1, 'by the ' || role FROM t
UNION ALL SELECT conv_id, turn, chunk_id, ref || '(a)(i)', ref || '(a)', 'point', 'i', NULL, NULL, 2, 4 * n + 2, 'inner' FROM t
UNION ALL SELECT conv_id, turn, chunk_id, ref, NULL, 'subparagraph', NULL, turn, NULL, 0, 4 * n + 3, 'closed' FROM t)"""


@query(
    f"""WITH {_PASSAGES} SELECT chunk_id, 'article' AS kind, CAST(conv_id AS VARCHAR) AS chunk_no, 'Talk ' || conv_id AS title,
'http://e/art_' || conv_id || '/oj' AS eli_uri, ref, parent_ref, level, label, CAST(number AS INTEGER) AS number, section, CAST(depth AS INTEGER) AS depth,
CAST(ord AS INTEGER) AS ord, md5(text) AS digest FROM q"""
)
def parse_articles(spark, sf_dir):
    found = markup.chunk_html(_pages(spark, sf_dir), "http://e")
    return found.withColumn("digest", F.md5("text")).drop("text")


@query(
    f"""WITH x AS (SELECT conv_id, string_agg(turn || '.' || chr(160) || ' ' || text || 'Part of ' || role || '(a)by  the ' || role || '(i)innerno pointclosed', chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT 'art_' || conv_id AS id, 'article' AS type, CAST(conv_id AS VARCHAR) AS number, 'Talk ' || conv_id AS title,
md5(trim(regexp_replace('Article ' || conv_id || 'Talk ' || conv_id || body, '{_SPACE}', ' ', 'g'))) AS digest FROM x"""
)
def article_texts(spark, sf_dir):
    return markup.chunk_texts(_pages(spark, sf_dir), "http://e").withColumn("digest", F.md5("text")).drop("text")


@query(f"""WITH {_PASSAGES}, h AS (SELECT *, lag(section) OVER (PARTITION BY conv_id, section IS NULL ORDER BY ord) AS last FROM q),
l AS (SELECT conv_id, ord, CASE WHEN section IS NOT NULL AND section IS DISTINCT
FROM last THEN section || chr(10) ELSE '' END || repeat('  ', CASE level WHEN 'point' THEN depth ELSE 0 END) || '[' || ref || '] ' || text AS line FROM h
WHERE NOT (level = 'paragraph' AND text = ''))
SELECT 'art_' || conv_id AS chunk_id, md5('Article ' || conv_id || ': Talk ' || conv_id || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY ord)) AS digest FROM l GROUP BY conv_id""")
def render_articles(spark, sf_dir):
    return markup.render(markup.chunk_html(_pages(spark, sf_dir), "http://e")).select("chunk_id", F.md5("text").alias("digest"))


_ROMAN = "CASE r_regionkey WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'IV' ELSE 'V' END"


@query(f"""WITH r AS (SELECT *, {_ROMAN} AS no FROM region WHERE r_regionkey < 3), n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT 'anx_' || no AS chunk_id, 'annex' AS kind, no AS chunk_no, r_name AS title, 'Annex ' || no AS ref, CAST(NULL AS VARCHAR) AS parent_ref,
'paragraph' AS level, CAST(NULL AS VARCHAR) AS label, CAST(0 AS INTEGER) AS ord, 'Nations of ' || r_name AS text FROM r
UNION ALL SELECT 'anx_' || no, 'annex', no, r_name, 'Annex ' || no || '(' || k || ')', 'Annex ' || no, 'point', CAST(k AS VARCHAR), CAST(k AS INTEGER), n_name
FROM r JOIN n ON n_regionkey = r_regionkey""")
def parse_annexes(spark, sf_dir):
    """Regions as annexes, their nations as numbered points; the scope, from a YAML file, lists three of them."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    no = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), F.col("r_regionkey") + 1)
    points = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x, i: F.concat(F.lit("<table><tr><td>"), (i + 1).cast("string"), F.lit('.</td><td><p class="oj-normal">'), x["n_name"], F.lit("</p></td></tr></table>")))
    both = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_join(points, "").alias("points"))
    page = both.select(
        F.concat(
            F.lit('<div id="anx_'),
            no,
            F.lit('"><p class="oj-doc-ti">ANNEX '),
            no,
            F.lit('</p><p class="oj-doc-ti">'),
            "r_name",
            F.lit('</p><p class="oj-normal">Nations of '),
            "r_name",
            F.lit("</p>"),
            "points",
            F.lit("</div>"),
        ).alias("html")
    )
    at = f"{fresh_folder(spark, 'scope')}/scope.yaml"
    with open(at, "w", encoding="utf-8") as f:
        f.write("scope:\n  articles: []\n  annexes: [I, II, III]\n")
    return markup.chunk_html(page, "http://e", files.load_scope(at)).select(
        "chunk_id",
        "kind",
        "chunk_no",
        "title",
        "ref",
        "parent_ref",
        "level",
        "label",
        "ord",
        "text",
    )


@query(
    """SELECT 'article' AS kind, CAST(c_nationkey AS VARCHAR) AS chunk_no, c_custkey AS id FROM customer WHERE c_nationkey IN (1, 2, 3)
UNION ALL SELECT 'annex', CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier"""
)
def scope_filter(spark, sf_dir):
    """Articles are listed in the scope; annexes are not, so all are in."""
    scope = spark.createDataFrame([("article", str(k)) for k in (1, 2, 3)], "kind string, chunk_no string")
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    chunks = c.select(F.lit("article").alias("kind"), F.col("c_nationkey").cast("string").alias("chunk_no"), F.col("c_custkey").alias("id"))
    return markup.in_scope(
        chunks.unionByName(
            s.select(F.lit("annex").alias("kind"), F.col("s_nationkey").cast("string").alias("chunk_no"), F.col("s_suppkey").alias("id"))
        ),
        scope,
    )


# --- files written and read back ---------------------------------------------------------------------------------------------------------


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted records."""
    p = read(spark, sf_dir, "part")
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    return p.select(
        F.concat("p_name", F.lit(" of "), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "s").otherwise("")).alias("term"), F.lit("Obligation").alias("entity_type"), F.col("p_name").alias("label"), F.col("p_type").alias("definition"),
        F.concat(F.lit("Art. "), F.col("p_size").cast("string")).alias("article_ref"), F.concat(F.lit("q "), F.col("p_partkey").cast("string")).alias("source_quote"), F.when(F.col("p_size") > 2, F.col("p_brand")).alias("bearer"), none.alias("applies_to"),
        (F.col("p_size") / 100).alias("confidence"), F.concat(F.lit("art_"), F.col("p_size").cast("string")).alias("chunk_id"), F.concat(F.lit("art_"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".json")).alias("chunk_file"),
        F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("http://e/"), F.col("p_size").cast("string"))).otherwise("").alias("eli_uri"), text("m").alias("model"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("cache_key"),
        F.element_at(F.array(*map(F.lit, ("supported", "partially", "unsupported", None))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("critic_verdict"), F.lit("because").alias("critic_reason"), F.col("p_partkey").alias("seq"),
    )


_TERM = "p_name || ' of ' || lower(p_type) || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END"
_RECORD = f"""r AS (SELECT p_partkey AS seq, {_TERM} AS term, 'Obligation' AS entity_type, p_name AS label, p_type AS definition, 'Art. ' || p_size AS article_ref,
'q ' || p_partkey AS source_quote, CASE WHEN p_size > 2 THEN p_brand END AS bearer, p_size / 100.0::DOUBLE AS confidence,
'art_' || p_size AS chunk_id, CASE WHEN p_size % 3 > 0 THEN 'http://e/' || p_size ELSE '' END AS eli_uri,
CASE p_partkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially' WHEN 2 THEN 'unsupported' END AS critic_verdict, 'because' AS critic_reason FROM part)"""


@query(
    f"WITH {_RECORD} SELECT cache_key, term, bearer, confidence, eli_uri, CAST(n AS BIGINT) AS n FROM (SELECT 'k' || seq AS cache_key, *, row_number() OVER (ORDER BY seq) AS n FROM r)"
)
def record_lines(spark, sf_dir):
    """Records as JSON lines in the order of their keys, blank lines between, read back with their places."""
    at = f"{fresh_folder(spark, 'records')}/all"
    files.write_records(
        _extracted(spark, sf_dir).drop("critic_verdict", "critic_reason").repartitionByRange(5, "seq").sortWithinPartitions("seq").drop("seq"),
        f"file://{at}",
    )
    found = files.read_records(spark, f"file://{at}", pattern="*.json").select("cache_key", "term", "bearer", "confidence", "eli_uri", "seq")
    # places rise by file and line: files are counted in front of each
    per = found.groupBy(F.floor(F.col("seq") / (1 << 32)).alias("file")).agg(F.count("*").alias("k"))
    before = {r["file"]: r["k"] for r in per.collect()}
    ahead = F.create_map(*(F.lit(x) for f in before for x in (f, sum(k for g, k in before.items() if g < f))))
    return found.select(
        "cache_key",
        "term",
        "bearer",
        "confidence",
        "eli_uri",
        (ahead[F.floor(F.col("seq") / (1 << 32))] + F.col("seq") % (1 << 32)).cast("long").alias("n"),
    )


@query(
    """SELECT 'art_' || conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'annex_' || conv_id || '.json' ELSE 'art_' || (CASE WHEN conv_id < 1000 THEN lpad(CAST(conv_id
AS VARCHAR), 3, '0') ELSE CAST(conv_id AS VARCHAR) END) || '.json' END AS file, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest,
CAST(count(*) AS INTEGER) AS paragraphs, min(text) AS first_text, CAST(min(turn) AS INTEGER) AS first_number FROM conversations GROUP BY conv_id"""
)
def chunk_documents(spark, sf_dir):
    """Conversations as chunks, a JSON document each, written and scanned."""
    from .schemas import CHUNKS

    c = read(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = c.groupBy("conv_id").agg(ordered.alias("x"), F.min("text").alias("least"), F.min("turn").alias("low"))
    no, annex = F.col("conv_id").cast("string"), F.col("conv_id") % 5 == 0
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], CHUNKS).schema}
    paragraphs = F.transform("x", lambda t: F.struct(F.lit("r").alias("ref"), t["turn"].cast("int").alias("number"), t["text"].alias("text"), F.array().cast("array<string>").alias("subparagraphs"), F.array().cast(kinds["paragraphs"].elementType["points"].dataType).alias("points")))
    chunks = g.select(
        F.concat(F.lit("art_"), no).alias("id"),
        F.when(annex, "annex").otherwise("article").alias("type"),
        F.when(~annex, no).alias("article_number"),
        F.when(annex, no).alias("annex_number"),
        F.col("least").alias("title"),
        F.lit("u").alias("eli_uri"),
        paragraphs.alias("paragraphs"),
        F.array_join(F.transform("x", lambda t: t["text"]), "\n").alias("text"),
        F.lit(None).cast(kinds["metadata"]).alias("metadata"),
    )
    at = f"{fresh_folder(spark, 'chunks')}/all"
    files.write_chunks(chunks, at)
    return files.read_chunks(spark, f"file://{at}").select(
        "id",
        "file",
        F.md5("text").alias("digest"),
        F.size("paragraphs").alias("paragraphs"),
        F.col("title").alias("first_text"),
        F.array_min(F.transform("paragraphs", lambda p: p["number"])).alias("first_number"),
    )


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS term, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS place FROM nation")
def entity_array(spark, sf_dir):
    """Nations as the JSON array of curated entities, read in its order."""
    import json

    at = f"{fresh_folder(spark, 'entities')}/entities.json"
    with open(at, "w", encoding="utf-8") as f:
        json.dump([{"id": str(r["n_nationkey"]), "term": r["n_name"]} for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()], f)
    from pyspark.sql import Window

    found = files.read_entities(spark, f"file://{at}")
    return found.select("id", "term", F.row_number().over(Window.orderBy("ord")).alias("place"))


@query(
    f"""WITH {_STATE}, n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) SELECT st.id, a.k AS seq, action, b.k AS ord FROM st
JOIN n a ON a.event_id = st.seq JOIN n b ON b.event_id = st.ord"""
)
def decision_files(spark, sf_dir):
    """The log in three appends without seq, which number on, read back and replayed."""
    log = _log(spark, sf_dir)
    cuts = log.agg(F.percentile("seq", [1 / 3, 2 / 3])).first()[0]
    at, line = f"file://{fresh_folder(spark, 'log')}/decisions", F.col("id").cast("string").alias("id")
    for test in (F.col("seq") <= cuts[0], (F.col("seq") > cuts[0]) & (F.col("seq") <= cuts[1]), F.col("seq") > cuts[1]):
        curate.append_decisions(log.where(test).orderBy("seq").select(line, "action"), at)
    return curate.replay(files.read_decisions(spark, at)).select(F.col("id").cast("long").alias("id"), "seq", "action", "ord")


@query("SELECT n_name AS metric, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_regionkey > 1")
def report_table(spark, sf_dir):
    """A tab-separated report, of which the wanted lines are kept."""
    n = read(spark, sf_dir, "nation")
    at = f"file://{fresh_folder(spark, 'report')}/tsv"
    n.select(
        F.col("n_name").alias("metric"),
        F.col("n_regionkey").alias("metric_value"),
        F.lit("x").alias("kind"),
    ).write.option("sep", "\t").option("header", True).csv(at)
    return files.read_report_tsv(spark, at, [r["n_name"] for r in n.where("n_regionkey > 1").collect()])


_SMALL = f"WITH {_GRAPH} SELECT s, p, o, CASE WHEN p = '{RDFS}label' THEN 'en' ELSE '' END AS o_lang, CASE WHEN p IN ('{RDFS}label', '{BASE}segment') THEN 'literal' ELSE 'iri' END AS o_kind FROM g WHERE s NOT LIKE '%#order_%'"


def _small_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch_graph(spark, sf_dir).where("s NOT LIKE '%#order_%'")


@query(_SMALL)
def n_triples_files(spark, sf_dir):
    at = f"file://{fresh_folder(spark, 'graph')}/nt"
    rdf.write_n_triples(_small_graph(spark, sf_dir), at)
    return rdf.read_graph(spark, f"{at}/*.txt").select("s", "p", "o", "o_lang", "o_kind")


@query(_SMALL)
def turtle_file(spark, sf_dir):
    at = f"{fresh_folder(spark, 'graph')}/g.ttl"
    rdf.write_turtle(_small_graph(spark, sf_dir), at, {"kg": BASE, "rdfs": RDFS})
    return rdf.read_graph(spark, f"file://{at}").select("s", "p", "o", "o_lang", "o_kind")


@query(_SMALL)
def rdf_xml_file(spark, sf_dir):
    at = f"{fresh_folder(spark, 'graph')}/g.owl"
    rdf.write_rdf_xml(_small_graph(spark, sf_dir), at)
    return rdf.read_graph(spark, f"file://{at}").select("s", "p", "o", "o_lang", "o_kind")


@query("SELECT true AS turtle_same, true AS xml_same, false AS less_same")
def round_trips(spark, sf_dir):
    """Nations in an RDF list of blank nodes, some of them named alike: written, read back and compared but for the blank nodes' names."""
    names = [r["n_name"] for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    text = f"@prefix k: <{BASE}> .\nk:all k:nations ( " + " ".join(f'[ k:name "{x}" ; k:near [ k:far "same" ] ]' for x in names) + " ) ."
    g = spark.createDataFrame([(*t, "g") for t in rdf.parse_turtle(text)], rdf.TRIPLES)
    at = fresh_folder(spark, "graph")
    rdf.write_turtle(g, f"{at}/a.ttl", {"k": BASE})
    rdf.write_rdf_xml(g, f"{at}/b.owl")
    back = [rdf.read_graph(spark, f"file://{at}/{x}") for x in ("a.ttl", "b.owl")]
    less = back[0].where(~((F.col("o") == names[0])))
    return spark.createDataFrame(
        [(build.isomorphic(g, back[0]), build.isomorphic(g, back[1]), build.isomorphic(g, less))],
        "turtle_same boolean, xml_same boolean, less_same boolean",
    )


@query("SELECT 'http://e/' || r_regionkey AS url, sha256('<p>' || r_name || '</p>') AS sha256, r_regionkey <> 1 AS wanted FROM region")
def snapshots(spark, sf_dir):
    """A page for each region: one is fresh, one a day and a second old, one empty of time, one of unreadable time, one without text."""
    out = None
    for r in read(spark, sf_dir, "region").collect():
        k = r["r_regionkey"]
        at = fresh_folder(spark, "snapshot")
        files.save_snapshot(
            f"<p>{r['r_name']}</p>",
            f"http://e/{k}",
            at,
            {0: "2024-01-01T00:00:00+00:00", 1: "2024-01-02T00:00:00+00:00", 2: "", 3: "soon", 4: "2023-01-01T00:00:00+00:00"}[k],
        )
        one = files.read_snapshot(spark, f"file://{at}")
        out = one if out is None else out.unionByName(one)
    now = F.to_timestamp(F.lit("2024-01-02T00:00:01+00:00"))
    return out.select("url", "sha256", files.needs_download(now).alias("wanted"))


@query(
    """SELECT r_name AS name, CASE WHEN r_regionkey < 3 THEN CAST(r_regionkey AS BIGINT) ELSE -1 END AS value, CAST(-1 AS BIGINT) AS by_default FROM region
UNION ALL SELECT 'extra', 7, 7"""
)
def config_overlay(spark, sf_dir):
    """Defaults, and what a section of a YAML file says instead; without the file the defaults hold."""
    regions = read(spark, sf_dir, "region").collect()
    at = f"{fresh_folder(spark, 'config')}/pipeline.yaml"
    with open(at, "w", encoding="utf-8") as f:
        f.write("other:\n  extra: 9\nevaluate:\n" + "".join(f"  {r['r_name']}: {r['r_regionkey']}\n" for r in regions if r["r_regionkey"] < 3))
    defaults = {r["r_name"]: -1 for r in regions} | {"extra": 7}
    found, bare = files.overlay(defaults, at, "evaluate"), files.overlay(defaults, f"{at}.none", "evaluate")
    return spark.createDataFrame([(k, v, bare[k]) for k, v in found.items()], "name string, value long, by_default long")


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Regions as files of a tree, with caches, place holders and an empty file beside them."""
    import os

    at = fresh_folder(spark, "tree")
    for r in read(spark, sf_dir, "region").collect():
        os.makedirs(f"{at}/docs/{r['r_regionkey']}/__pycache__", exist_ok=True)
        for name, text in (("name.txt", r["r_name"]), ("run.pyc", "x"), ("empty.md", ""), (".gitkeep", "x"), ("__pycache__/c.txt", "x")):
            with open(f"{at}/docs/{r['r_regionkey']}/{name}", "w", encoding="utf-8") as f:
                f.write(text)
    return at


@query("SELECT 'docs/' || r_regionkey || '/name.txt' AS path, CAST(length(r_name) AS BIGINT) AS length FROM region")
def file_tree(spark, sf_dir):
    return files.file_tree(spark, f"file://{_tree(spark, sf_dir)}").where(files.wanted(F.col("path"), F.col("length")))


@query(
    """SELECT 'docs/' || r_regionkey || '/name.txt' AS path, CAST(length(r_name) AS BIGINT) AS length FROM region WHERE r_regionkey < 3
UNION ALL SELECT 'MANIFEST.md', CAST(length('# Contents' || chr(10) || chr(10) || '## low' || chr(10) || chr(10) || '3 files, 0 KB' || chr(10)) AS BIGINT)"""
)
def bundle_zip(spark, sf_dir):
    """What the zip of a bundle holds: the wanted files of its groups, and the manifest."""
    import zipfile

    at, out = _tree(spark, sf_dir), f"{fresh_folder(spark, 'bundle')}/out"
    files.bundle(spark, f"file://{at}", out, {"low": [f"docs/{k}" for k in range(3)], "none": ["missing"]}, zipped=True)
    with zipfile.ZipFile(f"{out}.zip") as z:
        return spark.createDataFrame([(i.filename, i.file_size) for i in z.infolist()], "path string, length long")


# --- extraction and critic ---------------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, sha256('["m", false, {"seed": 1, "temperature": 0}, "p", "' || p_name || '"]') AS text_key, sha256('["m", true, {}, "p", "' || p_name || '", {"bearer": null, "term": "' || p_type || '"}]') AS record_key FROM part"""
)
def cache_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    record = F.struct(F.col("p_type").alias("term"), F.lit(None).cast("string").alias("bearer"))
    return p.select(
        "p_partkey",
        cache_key(F.col("p_name"), "m", False, {"temperature": 0, "seed": 1}, "p").alias("text_key"),
        cache_key(F.col("p_name"), "m", True, {}, "p", record).alias("record_key"),
    )


def _failing_extractor(chunk_id: str, text: str) -> list[dict]:
    if "breaks" in (text or ""):
        raise ValueError(chunk_id)
    return extract.rule_extractor(chunk_id, text)


def _extract(spark: SparkSession, sf_dir: str):
    """Parts as chunks of one line: some without an obligation, some that the model fails on, some answered from the cache."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("Article 5: Parts\n\n[5(1)] Each maker "),
        F.when(k % 7 == 0, "may").otherwise("shall"),
        F.lit(" keep "),
        "p_name",
        F.lit(" of "),
        F.lower("p_type"),
        F.when(k % 11 == 0, ". It breaks").otherwise(""),
    )
    chunks = p.select(
        k.cast("string").alias("chunk_id"),
        F.lit("art_005.json").alias("chunk_file"),
        F.lit("u").alias("eli_uri"),
        F.concat(text, F.lit("\n[part] "), k.cast("string")).alias("text"),
    )
    known = chunks.where(F.col("chunk_id").cast("long") % 5 == 0).select(cache_key(F.col("text"), "rules", False, {}, "").alias("cache_key"))
    one = {
        "term": "cached",
        "entity_type": "Actor",
        "label": "c",
        "definition": "d",
        "article_ref": "Art. 5",
        "source_quote": "q",
        "bearer": None,
        "applies_to": None,
        "confidence": 0.5,
    }
    import json

    answer = json.dumps([one, one | {"entity_type": "Unknown"}])
    return extract.extract(chunks, known.withColumn("answer", F.lit(answer)), _failing_extractor)


_EXTRACT = "e AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'cached' WHEN p_partkey % 11 = 0 THEN 'failed' WHEN p_partkey % 7 = 0 THEN 'none' ELSE 'asked' END AS how FROM part)"


@query(
    f"""WITH {_EXTRACT} SELECT CAST(p_partkey AS VARCHAR) AS chunk_id,
CASE how WHEN 'cached' THEN 'cached' ELSE 'keep ' || p_name || ' of ' || lower(p_type) END AS term,
CASE how WHEN 'cached' THEN 'Actor' ELSE 'Obligation' END AS entity_type, CASE how WHEN 'cached' THEN 'Art. 5' ELSE 'Art. 5(1)' END AS article_ref,
CASE how WHEN 'cached' THEN 'q' ELSE 'Each maker shall keep ' || p_name || ' of ' || lower(p_type) END AS source_quote,
CASE how WHEN 'cached' THEN NULL ELSE 'Each maker' END AS bearer, CASE how WHEN 'cached' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
'art_005.json' AS chunk_file, 'rules' AS model FROM e WHERE how IN ('cached', 'asked')"""
)
def extract_records(spark, sf_dir):
    """Of the cached answers the entity of no known type is not taken."""
    return _extract(spark, sf_dir)[0].select(
        "chunk_id",
        "term",
        "entity_type",
        "article_ref",
        "source_quote",
        "bearer",
        "confidence",
        "chunk_file",
        "model",
    )


@query(
    f"WITH {_EXTRACT} SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CAST(how IN ('cached', 'asked') AS BIGINT) AS n, CASE how WHEN 'failed' THEN 'ValueError: ' || p_partkey END AS error FROM e"
)
def extract_counts(spark, sf_dir):
    return _extract(spark, sf_dir)[2]


@query(f"WITH {_EXTRACT} SELECT count(*) AS answers FROM e WHERE how IN ('asked', 'none')")
def extract_answers(spark, sf_dir):
    """What a run adds to the cache: every answer that was asked for and did not fail."""
    return _extract(spark, sf_dir)[1].agg(F.count_distinct("cache_key").alias("answers"))


def _failing_critic(text: str, record: dict) -> dict:
    if record["label"] == "fails":
        raise ValueError("no answer")
    return {"verdict": "perhaps"} if record["label"] == "odd" else extract.rule_critic(text, record)


@query("""SELECT p_partkey AS seq, CASE WHEN p_partkey % 13 < 2 THEN NULL WHEN p_partkey % 2 = 0 THEN 'supported' WHEN p_partkey % 3 = 0 THEN 'partially' ELSE 'unsupported' END AS critic_verdict,
CASE WHEN p_partkey % 13 = 0 THEN 'ValueError: no answer' WHEN p_partkey % 13 = 1 THEN 'ValueError: verdict ''perhaps'''
WHEN p_partkey % 2 = 0 THEN 'the quote is there' WHEN p_partkey % 3 = 0 THEN 'the term is there' ELSE 'neither quote nor term is there' END AS critic_reason
FROM part""")
def critic_verdicts(spark, sf_dir):
    """Records judged by a critic that fails on some, and on others gives a verdict that there is not."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    label = F.when(k % 13 == 0, "fails").when(k % 13 == 1, "odd").otherwise("fine")
    none = F.lit(None).cast("string")
    records = p.select(
        k.alias("seq"),
        F.concat("p_name", F.lit(" "), "p_type").alias("text"),
        F.when(k % 3 == 0, F.upper("p_name")).otherwise("¤").alias("term"),
        F.lit("Actor").alias("entity_type"),
        label.alias("label"),
        F.lit("d").alias("definition"),
        k.cast("string").alias("article_ref"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise("¤").alias("source_quote"),
        none.alias("bearer"),
        none.alias("applies_to"),
        F.lit(0.5).alias("confidence"),
        F.lit("c").alias("chunk_id"),
    )
    return extract.critique(records, critic=_failing_critic)[0].select("seq", "critic_verdict", "critic_reason")


# --- grounding and merging ---------------------------------------------------------------------------------------------------------------


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, and a record on each: its quote is verbatim, spaced out and in other quotes, off by a letter, blank, absent or of a chunk that is not there."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    t, k = normalise(F.coalesce("text", F.lit(""))), F.col("seq")
    x = F.trim(F.substring(t, 11, 60))
    kind = F.when(F.length(t) < 90, 3).otherwise(k % 6)
    off = F.concat(F.substring(x, 1, 29), F.lit("¤"), F.substring(x, 31, 100))
    quote = F.when(kind == 0, x).when(
        kind == 1,
        F.concat(F.lit(" "), F.replace(F.replace(x, F.lit(" "), F.lit(" \u00a0\n ")), F.lit("'"), F.lit("’"))),
    ).when(kind == 2, off).when(kind == 4, "¤¤¤¤").when(kind == 5, x).otherwise(" ")
    number = k.cast("string")
    ref = F.when(
        k % 4 == 0,
        F.concat(F.lit(" Art. "), number, F.lit("(1)")),
    ).when(k % 4 == 1, F.concat(F.lit("Art. "), number, F.lit("0(1)"))).when(k % 4 == 2, F.concat(F.lit("Art. "), number)).otherwise(F.lit("Annex II(3)"))
    records = d.select("seq", quote.alias("source_quote"), ref.alias("article_ref"), F.when(kind == 5, "none").otherwise(number).alias("chunk_file"))
    return verify.with_chunks(records, d.select(number.alias("file"), "text", F.lit("article").alias("type"), number.alias("number")))


_GROUND = f"""d AS (SELECT doc_id AS k, trim(regexp_replace(translate(coalesce(text, ''), '‘’‚“”„', '''''''\"\"\"'), '{_SPACE}', ' ', 'g')) AS t FROM documents),
x AS (SELECT k, trim(substring(t, 11, 60)) AS x, CASE WHEN length(t) < 90 THEN 3 ELSE k % 6 END AS kind FROM d),
m AS (SELECT k, kind, CASE WHEN kind IN (0, 1) THEN 'exact' WHEN kind = 2 THEN 'fuzzy' END AS grounding_method, CASE WHEN kind IN (0,
1) THEN 100.0::DOUBLE WHEN kind = 2 THEN round_even(200 * (length(x) - 1) / (2.0::DOUBLE * length(x)), 1) ELSE 0.0::DOUBLE END AS grounding_score, k % 4 IN (0,
2) AS home,
CASE k % 4 WHEN 0 THEN ' Art. ' || k || '(1)' WHEN 1 THEN 'Art. ' || k || '0(1)' WHEN 2 THEN 'Art. ' || k ELSE 'Annex II(3)' END AS ref FROM x),
w AS (SELECT k AS seq, kind, grounding_method, grounding_score, nullif(concat_ws('; ',
CASE WHEN kind = 5 THEN 'chunk not found' WHEN grounding_method IS NULL THEN 'quote not found' END,
CASE WHEN kind <> 5 AND NOT home THEN 'reference ' || ref || ' does not match chunk' END), '') AS grounding_reason FROM m)"""


@query(f"WITH {_GROUND} SELECT seq, grounding_method, grounding_score, grounding_reason, grounding_reason IS NULL AS grounded FROM w")
def ground_records(spark, sf_dir):
    return verify.ground(_quoted(spark, sf_dir)).select("seq", "grounding_method", "grounding_score", "grounding_reason", "grounded")


@query(
    f"""WITH {_GROUND} SELECT CASE WHEN grounding_reason IS NULL THEN 'kept' ELSE 'rejected' END AS route,
CASE WHEN grounding_reason IS NULL THEN 'supported' END AS critic_verdict, count(*) AS n FROM w GROUP BY ALL"""
)
def routed_records(spark, sf_dir):
    """The rejected lose their verdict."""
    kept, rejected = verify.route(
        verify.ground(_quoted(spark, sf_dir)).withColumns({"critic_verdict": F.lit("supported"), "critic_reason": F.lit("r")})
    )
    both = kept.select(F.lit("kept").alias("route"), "critic_verdict").unionByName(
        rejected.select(F.lit("rejected").alias("route"), "critic_verdict")
    )
    return both.groupBy("route").agg(F.first("critic_verdict").alias("critic_verdict"), F.count("*").alias("n"))


_MERGED = f"""{_RECORD}, k AS (SELECT *, lower(coalesce(bearer, '')) AS b, lower(term) AS lt FROM r),
u AS (SELECT b, lt, min(seq) AS lo, array_to_string(list_sort(string_split(lt, ' ')), ' ') AS st FROM k GROUP BY b, lt),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY lo) AS i FROM u),
pr AS (SELECT y.b, y.i, x.i AS j, {indel_sql('x.st', 'y.st')} AS sim FROM o x
JOIN o y ON x.b = y.b AND x.i < y.i AND levenshtein(x.st, y.st) <= 0.1 * (length(x.st) + length(y.st))),
al AS (SELECT b, i, list(j) AS js FROM pr WHERE sim >= 90 GROUP BY b, i),
ld AS (SELECT o.b, o.i, [o.i] AS leaders, o.i AS lead FROM o WHERE i = 1
UNION ALL SELECT ld.b, o.i, CASE WHEN len(list_intersect(ld.leaders, coalesce(al.js, []))) = 0 THEN list_append(ld.leaders, o.i) ELSE ld.leaders END,
coalesce(list_min(list_intersect(ld.leaders, coalesce(al.js, []))), o.i) FROM ld JOIN o ON o.b = ld.b AND o.i = ld.i + 1 LEFT
JOIN al ON al.b = o.b AND al.i = o.i),
gr AS (SELECT k.*, f.lo AS leader FROM k JOIN o ON o.b = k.b AND o.lt = k.lt JOIN ld ON ld.b = o.b AND ld.i = o.i JOIN o f ON f.b = ld.b AND f.i = ld.lead)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.deduplicate(_extracted(spark, sf_dir))


@query(f"""WITH RECURSIVE {_MERGED}, g AS (SELECT leader, arg_min(seq, (CASE critic_verdict WHEN 'supported' THEN 0 WHEN 'partially' THEN 1 WHEN 'unsupported' THEN 2
ELSE 3 END, -confidence, seq)) AS seq, count(*) AS n,
string_agg(article_ref || '/' || source_quote || '/' || coalesce(critic_verdict, ''), ',' ORDER BY seq) AS sources FROM gr GROUP BY leader),
f AS (SELECT leader, string_agg(article_ref, ',' ORDER BY lo) AS article_refs FROM (SELECT leader, article_ref, min(seq) AS lo FROM gr GROUP BY ALL)
GROUP BY leader)
SELECT g.leader AS first_seq, seq, term, article_ref, critic_verdict, CAST(n AS INTEGER) AS merged_count, article_refs, sources FROM g JOIN f USING (leader) JOIN r USING (seq)""")
def merge_records(spark, sf_dir):
    sources = F.array_join(
        F.transform("sources", lambda s: F.concat(s["article_ref"], F.lit("/"), s["source_quote"], F.lit("/"), F.coalesce(s["critic_verdict"], F.lit("")))),
        ",",
    )
    return _merged(spark, sf_dir).select(
        "first_seq",
        "seq",
        "term",
        "article_ref",
        "critic_verdict",
        "merged_count",
        F.array_join("article_refs", ",").alias("article_refs"),
        sources.alias("sources"),
    )


@query(
    f"""WITH RECURSIVE {_MERGED}, g AS (SELECT leader, arg_min(coalesce(critic_verdict, ''),
(CASE critic_verdict WHEN 'supported' THEN 0 WHEN 'partially' THEN 1 WHEN 'unsupported' THEN 2 ELSE 3 END, -confidence, seq)) AS v FROM gr
GROUP BY leader) SELECT nullif(v, '') AS critic_verdict, count(*) AS n FROM g GROUP BY v"""
)
def merged_verdicts(spark, sf_dir):
    return verify.verdict_counts(_merged(spark, sf_dir))


# --- curation ----------------------------------------------------------------------------------------------------------------------------


def _id_sql(term: str = "term", kind: str = "entity_type", definition: str = "definition", bearer: str = "bearer", ref: str = "article_ref") -> str:
    quoted = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    return f"""substring(sha256('{{"applies_to": null, "article_refs": [' || {quoted(ref)} || '], "bearer": ' || {quoted(bearer)} || ', "definition": ' || {quoted(definition)} || ', "entity_type": ' || {quoted(kind)} || ', "term": ' || {quoted(term)} || '}}'), 1, 12)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records as verified ones, without sources of their own."""
    from .schemas import JUDGED

    return _extracted(spark, sf_dir).withColumns({"article_refs": F.array().cast("array<string>"), "sources": F.array().cast(f"array<{JUDGED}>")})


@query(
    f"""WITH {_RECORD}, i AS (SELECT *, {_id_sql()} AS id FROM r) SELECT id, min(seq) AS ord, max(seq) AS seq, arg_max(source_quote, seq) AS source_quote,
arg_max(coalesce(critic_verdict, 'none'), seq) AS verdict FROM i GROUP BY id"""
)
def keyed_records(spark, sf_dir):
    return curate.keyed(_verified(spark, sf_dir)).select(
        "id",
        "ord",
        "seq",
        "source_quote",
        F.coalesce("critic_verdict", F.lit("none")).alias("verdict"),
    )


def _curation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as records, and the events of users as decisions on those of their number. Edits give a new term and take the bearer away; a merge goes to the
    record of half the number, so that chains end at what is kept, at what is rejected, at nothing, or in the loop of number 0."""
    from .schemas import JUDGED

    c, e = read(spark, sf_dir, "customer"), read(spark, sf_dir, "events")
    id_of, none = lambda x: F.concat(F.lit("r"), x.cast("string")), F.lit(None).cast("string")
    source = lambda k: F.struct(F.concat(F.lit("Art. "), F.lit(k)).alias("article_ref"), F.lit("c").alias("chunk_id"), F.lit("u").alias("eli_uri"), F.concat(F.lit(f"q{k} "), "c_name").alias("source_quote"), F.lit("supported").alias("critic_verdict"), none.alias("critic_reason"))
    two = F.col("c_custkey") % 3 == 0
    records = c.select(
        id_of(F.col("c_custkey")).alias("id"), F.col("c_name").alias("term"), F.when(two, "Actor").otherwise("Obligation").alias("entity_type"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("definition"), F.col("c_mktsegment").alias("bearer"), none.alias("applies_to"),
        F.concat(F.lit("Art. "), (F.col("c_custkey") % 4).cast("string")).alias("article_ref"), F.lit("own quote").alias("source_quote"), F.lit(0.5).alias("confidence"), F.lit("c").alias("chunk_id"), F.lit("u").alias("eli_uri"), F.lit("m").alias("model"), F.lit("supported").alias("critic_verdict"),
        F.when(two, F.array(F.lit("Art. 1"), F.concat(F.lit("Art. "), (F.col("c_custkey") % 5).cast("string")))).otherwise(F.array().cast("array<string>")).alias("article_refs"), F.when(two, F.array(source("1"), source("2"))).otherwise(F.array().cast(f"array<{JUDGED}>")).alias("sources"),
    )
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "accept").when(F.col("event_type") == "click", "edit").when(
        F.col("event_type") == "signup",
        "reject",
    ).otherwise("merge")
    edits = F.create_map(
        F.lit("term"),
        F.array(F.lit("old"), F.concat(F.lit("New "), F.col("event_id").cast("string"))),
        F.lit("bearer"),
        F.array(F.lit("old"), none),
    )
    log = e.select(
        F.col("event_id").alias("seq"),
        id_of(F.col("user_id")).alias("id"),
        action.alias("action"),
        F.lit("me").alias("reviewer"),
        F.col("event_id").cast("string").alias("timestamp"),
        F.when(F.col("event_type") == "click", edits).alias("changes"),
        F.when(action == "merge", id_of(F.floor(F.col("user_id") / 2))).alias("target"),
    )
    return records, curate.replay(log)


_CURATED = f"""{_STATE}, mg AS (SELECT id, id // 2 AS to_id FROM st WHERE action = 'merge'), ch AS (SELECT id, to_id, 1 AS steps FROM mg
UNION ALL SELECT ch.id, mg.to_id, steps + 1 FROM ch JOIN mg ON ch.to_id = mg.id WHERE ch.to_id <> mg.to_id),
fin AS (SELECT id, arg_max(to_id, steps) AS final FROM ch GROUP BY id HAVING arg_max(to_id, steps) NOT IN (SELECT id FROM mg)),
rec AS (SELECT c_custkey AS id, c_name AS term, CASE WHEN c_custkey % 3 = 0 THEN 'Actor' ELSE 'Obligation' END AS entity_type, c_mktsegment AS bearer,
CASE WHEN c_custkey % 3 = 0 THEN ['Art. 1', 'Art. ' || c_custkey % 5] ELSE ['Art. ' || c_custkey % 4] END AS refs,
CASE WHEN c_custkey % 3 = 0 THEN ['q1 ' || c_name, 'q2 ' || c_name] ELSE ['own quote'] END AS quotes FROM customer),
dec AS (SELECT rec.*, st.action, st.seq, st.ord FROM rec JOIN st USING (id) WHERE action <> 'reject'), own AS (SELECT * FROM dec WHERE action <> 'merge'),
fold AS (SELECT dec.*, final FROM dec LEFT JOIN fin USING (id) WHERE action = 'merge'),
more AS (SELECT final, list(id ORDER BY ord) AS ids, flatten(list(refs ORDER BY ord)) AS refs, flatten(list(quotes ORDER BY ord)) AS quotes FROM fold WHERE final IS NOT NULL GROUP BY final)"""


@query(f"""WITH RECURSIVE {_CURATED}, z AS (SELECT own.*, coalesce(more.ids, []) AS merged, list_concat(own.refs, coalesce(more.refs, [])) AS all_refs,
list_concat(own.quotes, coalesce(more.quotes, [])) AS all_quotes FROM own LEFT JOIN more ON own.id = more.final)
SELECT 'r' || id AS id, CASE action WHEN 'edit' THEN 'New ' || seq ELSE term END AS term, entity_type,
CASE action WHEN 'edit' THEN NULL ELSE bearer END AS bearer, array_to_string(list_filter(all_refs, lambda x, i: list_position(all_refs, x) = i),
',') AS article_refs, array_to_string(all_quotes, ',') AS quotes,
coalesce(array_to_string(list_transform(merged, lambda x: 'r' || x), ','), '') AS merged_ids,
CASE action WHEN 'edit' THEN 'edited' ELSE 'accepted' END AS curation_status, CAST(seq AS VARCHAR) AS decided_at FROM z""")
def curated_view(spark, sf_dir):
    entities, _ = curate.build(*_curation(spark, sf_dir))
    quotes = F.array_join(F.transform("sources", lambda s: s["source_quote"]), ",")
    return entities.select(
        "id",
        "term",
        "entity_type",
        "bearer",
        F.array_join("article_refs", ",").alias("article_refs"),
        quotes.alias("quotes"),
        F.array_join("merged_ids", ",").alias("merged_ids"),
        "curation_status",
        "decided_at",
    )


@query(f"WITH RECURSIVE {_CURATED} SELECT 'r' || id AS id FROM fold WHERE final IS NULL OR final NOT IN (SELECT id FROM own)")
def curated_orphans(spark, sf_dir):
    return curate.build(*_curation(spark, sf_dir))[1]


@query(
    f"""WITH RECURSIVE {_CURATED}, e AS (SELECT entity_type, lower(CASE action WHEN 'edit' THEN 'New ' || seq ELSE term END) AS t, ord, id
FROM own) SELECT 'r' || id AS id, CAST(row_number() OVER (ORDER BY entity_type, t, ord) AS INTEGER) AS place FROM e"""
)
def curated_order(spark, sf_dir):
    """The place of each entity in the curated file, as written and read."""
    at = f"file://{fresh_folder(spark, 'curated')}/entities"
    records, state = _curation(spark, sf_dir)
    curate.build(records, state)[0].write.json(at)
    found = files.numbered_lines(spark, at, "*.json").select("place", F.get_json_object("value", "$.id").alias("id"))
    from pyspark.sql import Window

    return found.select("id", F.row_number().over(Window.orderBy("place")).alias("place"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'edit' ELSE 'accept' END AS action, concat_ws(',',
CASE WHEN p_size % 5 = 0 THEN 'bearer:' || p_brand || '>' END, CASE WHEN p_size % 3 = 0 THEN 'label:' || p_name || '>' || p_type END) AS changes FROM part"""
)
def field_changes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    row = lambda label, bearer: p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("term"), F.lit("Actor").alias("entity_type"), label.alias("label"), F.col("p_type").alias("definition"), bearer.alias("bearer"), F.lit(None).cast("string").alias("applies_to"))
    old = row(F.col("p_name"), F.col("p_brand"))
    new = row(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")), F.when(F.col("p_size") % 5 > 0, F.col("p_brand")))
    shown = F.transform(F.array_sort(F.map_entries("changes")), lambda x: F.concat(x["key"], F.lit(":"), F.coalesce(x["value"][0], F.lit("")), F.lit(">"), F.coalesce(x["value"][1], F.lit(""))))
    return curate.changes(old, new).select("id", "action", F.array_join(shown, ",").alias("changes"))


@query(f"""WITH {_RECORD} SELECT CAST(seq AS VARCHAR) AS id, md5(term || ' (' || seq || ', ' || coalesce(critic_verdict,
'not judged') || ')' || chr(10) || 'Type: Obligation' || chr(10) || 'Label: ' || label || chr(10) || 'Definition: ' || definition || chr(10) || 'Bearer: ' || coalesce(bearer, 'none') || chr(10) || 'Applies to: none' || chr(10)
|| 'Confidence: ' || format('{{:.2f}}', confidence) || chr(10) || 'References: ' || article_ref || chr(10) || chr(10) || article_ref || ' - ' || coalesce(critic_verdict, 'not judged') || chr(10) || '> ' || source_quote || chr(10) || 'Critic: because') AS digest FROM r""")
def record_cards(spark, sf_dir):
    return curate.cards(_verified(spark, sf_dir).withColumn("id", F.col("seq").cast("string"))).select("id", F.md5("card").alias("digest"))


@query(
    """WITH c AS (SELECT c_custkey, c_name FROM customer), s AS (SELECT o_orderkey, o_custkey, o_custkey + 1 AS next
FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(0 AS INTEGER) AS place, CAST(o_custkey AS VARCHAR) AS chunk_id, c_name AS title FROM s LEFT
JOIN c ON o_custkey = c_custkey UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, CAST(next AS VARCHAR), c_name FROM s LEFT JOIN c ON next = c_custkey
WHERE o_orderkey % 2 = 0"""
)
def cited_chunks(spark, sf_dir):
    """Customers as chunks, orders as records that cite one or, twice over, two of them; some are not there."""
    from .schemas import JUDGED

    o = read(spark, sf_dir, "orders")
    cite = lambda x: F.struct(F.lit("a").alias("article_ref"), x.cast("string").alias("chunk_id"), *(F.lit(None).cast("string").alias(c) for c in ("eli_uri", "source_quote", "critic_verdict", "critic_reason")))
    own, after = cite(F.col("o_custkey")), cite(F.col("o_custkey") + 1)
    sources = F.when(F.col("o_orderkey") % 2 == 0, F.array(own, after, own)).otherwise(F.array().cast(f"array<{JUDGED}>"))
    records = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("chunk_id"), sources.alias("sources"))
    chunks = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_name").alias("title"))
    return curate.chunks_of(records, chunks).select("id", "place", "chunk_id", "title")


@query("SELECT true AS iso_time, true AS named")
def reviewer_clock(spark, sf_dir):
    return spark.range(1).select(
        curate.now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|\+00:00)$").alias("iso_time"),
        (F.length(curate.reviewer()) > 0).alias("named"),
    )


# --- the graph ---------------------------------------------------------------------------------------------------------------------------


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A core graph: nations are classes with labels, regions properties, one label belongs to no term."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    classes = build.explode_triples(
        n,
        F.concat(F.lit(BASE + "Nation"), F.col("n_nationkey").cast("string")),
        build.iri(RDF + "type", F.lit(OWL + "Class")),
        build.literal(RDFS + "label", F.concat(F.lit("Nation no "), F.col("n_nationkey").cast("string")), "en"),
    )
    properties = build.explode_triples(
        r,
        F.concat(F.lit(BASE), F.lower("r_name")),
        build.iri(RDF + "type", F.lit(OWL + "ObjectProperty")),
        build.literal(RDFS + "label", F.col("r_name"), "en"),
    )
    loose = build.explode_triples(r, F.lit(BASE + "loose"), build.literal(RDFS + "label", F.lit("loose"), "en"))
    return classes.unionByName(properties).unionByName(loose.distinct())


_CORE = f"""ct AS (SELECT '{BASE}Nation' || n_nationkey AS iri, 'nation no ' || n_nationkey AS label FROM nation UNION ALL SELECT '{BASE}' || lower(r_name), lower(r_name) FROM region)"""


@query(f"WITH {_CORE} SELECT iri, label FROM ct")
def core_index(spark, sf_dir):
    core = _core(spark, sf_dir)
    return build.core_terms(core).join(build.core_labels(core), "iri", "left").select("iri", "label")


_NAME = "CASE WHEN regexp_matches(term, '[0-9A-Za-z]') THEN array_to_string(list_transform(list_filter(regexp_split_to_array(term, '[^0-9A-Za-z]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') ELSE 'Unnamed' END"
_MINT_TERM = "CASE s_suppkey % 5 WHEN 0 THEN 'Nation no ' || s_nationkey WHEN 1 THEN 'nation' || s_nationkey WHEN 2 THEN 'Thing-' || s_nationkey WHEN 3 THEN '---' ELSE ' NATION NO ' || s_nationkey || ' ' END"


@query(f"""WITH {_CORE}, e AS (SELECT s_suppkey AS id, {_MINT_TERM} AS term FROM supplier), n AS (SELECT id, trim(term) AS term, '{BASE}' || {_NAME} AS name FROM e),
c AS (SELECT n.*, coalesce(x.iri, y.iri) AS core FROM n LEFT JOIN ct x ON x.iri = n.name LEFT JOIN ct y ON y.label = lower(n.term)),
k AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS nth FROM c WHERE core IS NULL)
SELECT id, CASE WHEN nth > 1 THEN name || '_' || nth ELSE name END AS iri, false AS in_core FROM k UNION ALL SELECT id, core, true FROM c WHERE core IS NOT NULL""")
def mint_beside_core(spark, sf_dir):
    """Suppliers' terms that are a core label, a core name, neither, without a letter, or a label in other case."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    n = F.col("s_nationkey").cast("string")
    term = F.when(k % 5 == 0, F.concat(F.lit("Nation no "), n)).when(k % 5 == 1, F.concat(F.lit("nation"), n)).when(k % 5 == 2, F.concat(F.lit("Thing-"), n)).when(k % 5 == 3, "---").otherwise(
        F.concat(F.lit(" NATION NO "), n, F.lit(" "))
    )
    return build.mint(s.select(k.alias("id"), term.alias("term"), k.alias("ord")), _core(spark, sf_dir))


_KINDS = ("AISystemCategory", "ProhibitedPractice", "HighRiskArea", "Actor", "Authority", "Requirement", "Obligation")


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as curated entities of all kinds, some of a kind that there is not."""
    from .schemas import SOURCE

    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    text, none = k.cast("string"), F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, (*_KINDS, "Odd"))), (k % 8 + 1).cast("int"))
    bearer = F.when(
        k % 8 == 6,
        F.element_at(
            F.array(F.lit(" Providers "), F.lit("maker 3"), F.lit("AUTHORITY 4"), F.lit("nobody"), none, F.lit("")),
            (F.floor(k / 8) % 6 + 1).cast("int"),
        ),
    )
    applies = F.when(
        k % 8 >= 5,
        F.element_at(F.array(F.lit("AI systems"), F.lit("system 0"), F.lit("unknown"), none), (F.floor(k / 8) % 4 + 1).cast("int")),
    )
    name = F.element_at(
        F.array(*map(F.lit, ("system", "practice", "area", "maker", "authority", "requirement", "obligation", "odd"))),
        (k % 8 + 1).cast("int"),
    )
    term = F.when(k == 11, "Deployers").when(k == 19, "Nation no 3").otherwise(F.concat(name, F.lit(" "), text))
    source = lambda a, u: F.struct(F.lit(a).alias("article_ref"), F.lit("c").alias("chunk_id"), F.lit(u).alias("eli_uri"), F.concat(F.lit(f"quote of {a} in "), text).alias("source_quote"))
    sources = F.when(
        k % 2 == 0,
        F.array(source("Art. 5(1)", "http://e/art_5"), source("Annex III(2)", "http://e/anx_III")),
    ).otherwise(F.array(source("Recital 7", "http://e/rec"), source("Art. 6", "")))
    return s.select(
        text.alias("id"),
        term.alias("term"),
        kind.alias("entity_type"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Label "), text)).alias("label"),
        F.col("s_name").alias("definition"),
        bearer.alias("bearer"),
        applies.alias("applies_to"),
        F.array(F.lit("Art. 5(1)"), F.concat(F.lit("Art. "), text)).alias("article_refs"),
        sources.cast(f"array<{SOURCE}>").alias("sources"),
        F.lit(0.9).alias("confidence"),
        F.lit("supported").alias("critic_verdict"),
        F.when(k % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.lit("accepted").alias("curation_status"),
        F.lit("me").alias("reviewer"),
        F.lit("t").alias("decided_at"),
        F.array().cast("array<string>").alias("merged_ids"),
        k.alias("ord"),
    )


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN '{BASE}{v}'" for k, v in table.items()) + " END"


_ENTITIES = f"""{_CORE}, e0 AS (SELECT s_suppkey AS k, s_name, ['AISystemCategory', 'ProhibitedPractice', 'HighRiskArea', 'Actor', 'Authority', 'Requirement', 'Obligation',
'Odd'][s_suppkey % 8 + 1] AS kind, CASE s_suppkey WHEN 11 THEN 'Deployers' WHEN 19 THEN 'Nation no 3' ELSE ['system', 'practice', 'area', 'maker', 'authority',
'requirement', 'obligation', 'odd'][s_suppkey % 8 + 1] || ' ' || s_suppkey END AS term,
CASE WHEN s_suppkey % 8 = 6 THEN [' Providers ', 'maker 3', 'AUTHORITY 4', 'nobody', NULL, ''][(s_suppkey // 8) % 6 + 1] END AS bearer,
CASE WHEN s_suppkey % 8 >= 5 THEN ['AI systems', 'system 0', 'unknown', NULL][(s_suppkey // 8) % 4 + 1] END AS applies FROM supplier),
e AS (SELECT e0.*, coalesce(ct.iri, '{BASE}' || {_NAME}) AS iri, ct.iri IS NOT NULL AS in_core, kind IN ('AISystemCategory', 'Actor', 'Authority') AS cls,
CASE kind {' '.join(f"WHEN '{k}' THEN '{BASE}{v}'" for k, (_, v) in TYPE_MAP.items())} END AS parent FROM e0 LEFT
JOIN ct ON ct.label = lower(trim(term)) OR ct.iri = '{BASE}' || {_NAME} WHERE kind <> 'Odd'),
known AS (SELECT kind, lower(trim(term)) AS v, arg_min(iri, k) AS iri FROM e GROUP BY ALL),
lk AS (SELECT e.k, e.iri, 'bearer' AS col, bearer AS v, coalesce((SELECT min(x.iri) FROM known x
WHERE x.kind IN ('Actor', 'Authority') AND x.v = lower(trim(bearer))), {_case('bearer', BEARER_ALIASES)}) AS t, '{BASE}obligationOf' AS p FROM e
WHERE NOT in_core AND kind = 'Obligation' AND trim(bearer) <> ''
UNION ALL SELECT e.k, e.iri, 'applies_to', applies, coalesce((SELECT min(x.iri) FROM known x
WHERE x.kind = 'AISystemCategory' AND x.v = lower(trim(applies))), {_case('applies', SYSTEM_ALIASES)}), '{BASE}appliesToSystem' FROM e
WHERE NOT in_core AND kind IN ('Obligation', 'Requirement') AND trim(applies) <> '')"""
_SOURCES = "sr AS (SELECT iri, k, unnest(CASE WHEN k % 2 = 0 THEN [{'a': 'Art. 5(1)', 'u': 'http://e/art_5'}, {'a': 'Annex III(2)', 'u': 'http://e/anx_III'}] ELSE [{'a': 'Recital 7', 'u': 'http://e/rec'}, {'a': 'Art. 6', 'u': ''}] END, recursive := true) FROM e)"


@query(f"""WITH {_ENTITIES}, {_SOURCES}, n AS (SELECT * FROM e WHERE NOT in_core), run AS (SELECT '{BASE}run' AS s), g AS (
SELECT iri AS s, '{RDF}type' AS p, '{OWL}Class' AS o FROM n WHERE cls UNION ALL SELECT iri, '{RDFS}subClassOf', parent FROM n WHERE cls
UNION ALL SELECT iri, '{OWL}equivalentClass', {_case('term', BEARER_ALIASES)} FROM n WHERE kind = 'Actor'
UNION ALL SELECT iri, '{RDF}type', parent FROM n WHERE NOT cls UNION ALL SELECT iri, '{RDF}type', '{OWL}NamedIndividual' FROM n WHERE NOT cls
UNION ALL SELECT iri, '{RDFS}label', CASE WHEN k % 3 = 0 THEN term ELSE 'Label ' || k END FROM n UNION ALL SELECT iri, '{SKOS}definition', s_name FROM n
UNION ALL SELECT iri, '{BASE}curationStatus', 'accepted' FROM n
UNION ALL SELECT iri, '{PROV}wasGeneratedBy', '{BASE}run' FROM e UNION ALL SELECT iri, '{BASE}articleRef', 'Art. 5(1)' FROM e UNION ALL SELECT iri, '{BASE}articleRef', 'Art. ' || k FROM e
UNION ALL SELECT iri, '{BASE}sourceQuote', 'quote of ' || a || ' in ' || k FROM sr UNION ALL SELECT iri, '{BASE}hasLegalSource', nullif(u, '') FROM sr
UNION ALL SELECT u, '{RDF}type', '{BASE}LegalProvision' FROM sr WHERE u <> '' UNION ALL SELECT u, '{RDF}type', '{OWL}NamedIndividual' FROM sr WHERE u <> ''
UNION ALL SELECT u, '{RDFS}label', nullif(regexp_extract(a, '^(Art\\. [0-9]+|Annex [IVXLC]+)', 1), '') FROM sr WHERE u <> '' UNION ALL SELECT iri, p, t FROM lk
UNION ALL SELECT t, '{RDF}type', '{OWL}NamedIndividual' FROM lk
UNION ALL SELECT s, '{RDF}type', '{PROV}Activity' FROM run UNION ALL SELECT s, '{RDFS}label', 'pipeline run run' FROM run
UNION ALL SELECT s, '{DCTERMS}source', 'http://e/law' FROM run
UNION ALL SELECT s, '{DCTERMS}description', 'extraction and verification model: m' || i FROM run, range(1, 3) t(i)
UNION ALL SELECT 'http://e/g', '{RDF}type', '{OWL}Ontology' UNION ALL SELECT 'http://e/g', '{DCTERMS}title', 'generated entities'
UNION ALL SELECT 'http://e/g', '{OWL}imports', 'http://e/core' UNION ALL SELECT 'http://e/g', '{DCTERMS}license', 'http://e/free')
SELECT DISTINCT s, p, o FROM g WHERE s IS NOT NULL AND o IS NOT NULL""")
def generated_graph(spark, sf_dir):
    """The run's digest is left out of its IRI and label."""
    graph, _ = build.generate(_curated(spark, sf_dir), _core(spark, sf_dir), BASE, "http://e/g", "http://e/law", "http://e/core", "http://e/free")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "run_[0-9a-f]{12}$", "run"), "^pipeline run [0-9a-f]{12}$", "pipeline run run")
    return graph.select(bare("s").alias("s"), "p", bare("o").alias("o")).distinct()


@query(
    f"WITH {_ENTITIES} SELECT DISTINCT col AS kind, v AS text FROM lk WHERE t IS NULL UNION ALL SELECT DISTINCT 'entity_type', 'Odd' FROM supplier WHERE s_suppkey % 8 = 7"
)
def generated_warnings(spark, sf_dir):
    return build.generate(_curated(spark, sf_dir), _core(spark, sf_dir))[1]


@query(
    """WITH x AS (SELECT n_nationkey AS ord, sha256('{"id":"' || n_nationkey || '","note":null,"term":"' || n_name || '"}') AS h FROM nation), p AS (SELECT ord // 10000 AS part, sha256(string_agg(h, '' ORDER BY ord)) AS h FROM x GROUP BY ALL) SELECT substring(sha256(string_agg(h, '' ORDER BY part)), 1, 12) AS run_id FROM p"""
)
def run_digest(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return build.run_id(
        n.select(
            F.col("n_name").alias("term"),
            F.col("n_nationkey").cast("string").alias("id"),
            F.lit(None).cast("string").alias("note"),
            F.col("n_nationkey").alias("ord"),
        )
    )


@query(
    """WITH o AS (SELECT * FROM orders) SELECT (SELECT count(*) FROM customer) + 3 * (SELECT count(*) FROM nation) + 2 * count(*) + count(*) FILTER (o_orderpriority = '1-URGENT') + 5 AS axioms, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + count(*) + 2 AS logical_axioms, (SELECT count(*) FROM nation) AS classes, count(*) AS individuals FROM o"""
)
def axiom_counts(spark, sf_dir):
    """Nations are classes under a region with a label, customers their members, orders declared individuals that are placed by a customer; some carry a note."""
    n, c, o = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    at = lambda kind, key: F.concat(F.lit(f"{BASE}{kind}_"), F.col(key).cast("string"))
    g = build.explode_triples(
        n,
        at("nation", "n_nationkey"),
        build.iri(RDF + "type", F.lit(OWL + "Class")),
        build.iri(RDFS + "subClassOf", at("region", "n_regionkey")),
        build.literal(RDFS + "label", F.col("n_name"), "en"),
    )
    g = g.unionByName(build.explode_triples(c, at("customer", "c_custkey"), build.iri(RDF + "type", at("nation", "c_nationkey"))))
    g = g.unionByName(
        build.explode_triples(
            o,
            at("order", "o_orderkey"),
            build.iri(RDF + "type", F.lit(OWL + "NamedIndividual")),
            build.iri(BASE + "placedBy", at("customer", "o_custkey")),
            F.when(F.col("o_orderpriority") == "1-URGENT", build.literal(BASE + "note", F.lit("urgent"))),
        )
    )
    axioms = f"@prefix k: <{BASE}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> . k:placedBy a owl:ObjectProperty ; rdfs:domain k:Order . <http://e/g> a owl:Ontology ; owl:imports <http://e/i> . k:note a owl:AnnotationProperty ; rdfs:label \"note\" . k:Order rdfs:subClassOf [ a owl:Restriction ; owl:onProperty k:placedBy ; owl:someValuesFrom k:C ] ."
    g = g.unionByName(spark.createDataFrame(rdf.parse_turtle(axioms), "s string, p string, o string, o_kind string, o_lang string, o_dt string"))
    return evaluate.axiom_counts(g)


# --- checks, measures, diagrams ----------------------------------------------------------------------------------------------------------


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as systems of the core, regions as areas and practices of two of them, and examples that use them."""
    text = f"""@prefix k: <{BASE}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> . @prefix skos: <{SKOS}> .
k:System a owl:Class ; rdfs:label "system"@en ; skos:definition "d"@en . k:High a owl:Class ; rdfs:subClassOf k:System . k:Banned a owl:Class ; rdfs:subClassOf k:System ; owl:disjointWith k:High .
k:High owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( k:System [ a owl:Restriction ; owl:onProperty k:usedIn ; owl:someValuesFrom k:Area ] ) ] . k:Banned owl:equivalentClass k:Bad .
k:usedIn a owl:ObjectProperty ; rdfs:range k:Area ."""
    axioms = spark.createDataFrame(rdf.parse_turtle(text), "s string, p string, o string, o_kind string, o_lang string, o_dt string")
    n = read(spark, sf_dir, "nation")
    at = F.concat(F.lit(BASE + "system"), F.col("n_nationkey").cast("string"))
    examples = build.explode_triples(
        n,
        at,
        build.iri(RDF + "type", F.lit(BASE + "System")),
        F.when(F.col("n_regionkey") == 0, build.iri(BASE + "usedIn", F.lit(BASE + "work"))),
        F.when(F.col("n_regionkey") == 1, build.iri(RDF + "type", F.lit(BASE + "Bad"))),
        F.when((F.col("n_regionkey") == 2) & (F.col("n_nationkey") % 2 == 0), build.iri(BASE + "lost", F.lit(BASE + "x"))),
    )
    return axioms, examples


def _expected(spark: SparkSession, sf_dir: str, wrong: int) -> DataFrame:
    n = read(spark, sf_dir, "nation").where("n_regionkey < 3")
    classes = F.when(
        F.col("n_nationkey") == wrong,
        F.array(F.lit(BASE + "High")),
    ).when(F.col("n_regionkey") == 0, F.array(F.lit(BASE + "High"))).when(F.col("n_regionkey") == 1, F.array(F.lit(BASE + "Banned"))).otherwise(F.array().cast("array<string>"))
    return n.select(F.concat(F.lit(BASE + "system"), F.col("n_nationkey").cast("string")).alias("individual"), classes.alias("classes"))


_RISK = [BASE + "High", BASE + "Banned"]
_N_AXIOMS = 21


@query(f"""WITH w AS (SELECT min(n_nationkey) AS k FROM nation WHERE n_regionkey = 2) SELECT 'parse' AS "check", 'pass' AS status, '{_N_AXIOMS} triples' AS detail
UNION ALL SELECT 'profile', 'pass', 'none found' UNION ALL SELECT 'consistency', 'pass', 'none found'
UNION ALL SELECT 'classification', 'fail', '1 individuals in the wrong classes: {BASE}system' || k FROM w UNION ALL SELECT 'shacl', 'fail', '3 violations'
UNION ALL SELECT 'report', 'pass', '0 errors, 4 warnings, 1 info'""")
def graph_checks(spark, sf_dir):
    """All checks of a graph and its examples, one of which is expected in a class that it is not in."""
    axioms, examples = _checked(spark, sf_dir)
    wrong = read(spark, sf_dir, "nation").where("n_regionkey = 2").agg(F.min("n_nationkey")).first()[0]
    shape = shacl.Shape(
        "labelled",
        target_class=OWL + "Class",
        properties=[shacl.Property(RDFS + "label", min_count=1, language_in=("en",), message="no label")],
    )
    return reason.validate(axioms, examples, _expected(spark, sf_dir, wrong), _RISK, BASE, shacl.check(axioms, [shape]), engine="rl")


@query(
    f"""SELECT 'consistency' AS \"check\", 'fail' AS status, count(*) || ' contradictions: ' || string_agg('{BASE}system' || n_nationkey,
', ' ORDER BY '{BASE}system' || n_nationkey) AS detail FROM nation WHERE n_regionkey = 1"""
)
def contradictions(spark, sf_dir):
    """Systems that are banned and used in an area at once."""
    axioms, examples = _checked(spark, sf_dir)
    also = examples.where(F.col("o") == BASE + "Bad").select(
        "s",
        F.lit(BASE + "usedIn").alias("p"),
        F.lit(BASE + "work").alias("o"),
        "o_kind",
        "o_lang",
        "o_dt",
    )
    return reason.check_consistency(reason.reason(reason.combine(axioms, examples, also), "rl"))


@query(
    f"SELECT 'profile' AS \"check\", 'fail' AS status, '1 undeclared properties: {BASE}lost' AS detail FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0 LIMIT 1"
)
def undeclared(spark, sf_dir):
    return reason.check_profile(reason.combine(*_checked(spark, sf_dir)))


@query(
    f"""WITH p AS (SELECT 'rl' AS engine, 'classified' AS what) SELECT engine, what, '{BASE}system' || n_nationkey AS individual,
'{BASE}' || CASE n_regionkey WHEN 0 THEN 'High' ELSE 'Banned' END AS class FROM p, nation WHERE n_regionkey < 2"""
)
def engine_choice(spark, sf_dir):
    """The closure is chosen by name; it classifies as the axioms have it."""
    axioms, examples = _checked(spark, sf_dir)
    closed = reason.reason(reason.combine(axioms, examples), "rl")
    found = closed.where((F.col("p") == RDF + "type") & F.col("o").isin(_RISK))
    return found.select(
        F.lit(reason.choose_engine("rl")).alias("engine"),
        F.lit("classified").alias("what"),
        F.col("s").alias("individual"),
        F.col("o").alias("class"),
    ).distinct()


@query(f"""WITH c AS (SELECT '{BASE}nation_' || n_nationkey AS s, n_regionkey, n_nationkey FROM nation) SELECT 'WARN' AS level, 'equivalent_pair' AS rule, s AS subject FROM c WHERE n_regionkey = 0
UNION ALL SELECT 'WARN', 'missing_definition', s FROM c WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'INFO', 'missing_superclass', s FROM c WHERE n_regionkey > 2""")
def quality_rows(spark, sf_dir):
    n, at = read(spark, sf_dir, "nation"), F.concat(F.lit(BASE + "nation_"), F.col("n_nationkey").cast("string"))
    r = F.col("n_regionkey")
    g = build.explode_triples(
        n,
        at,
        build.iri(RDF + "type", F.lit(OWL + "Class")),
        F.when(F.col("n_nationkey") % 2 == 0, build.literal(SKOS + "definition", F.col("n_name"), "en")),
        F.when(r == 0, build.iri(OWL + "equivalentClass", F.lit(BASE + "x"))),
        F.when((r == 1) | (r == 2), build.iri(RDFS + "subClassOf", F.lit(BASE + "y"))),
    )
    return reason.quality_report(g, BASE)


@query(
    """SELECT 'q1' AS question, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'q2', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'q3', 0"""
)
def question_counts(spark, sf_dir):
    """Questions kept in files, over the asserted graph; one is asked of another graph, which has nothing."""
    at, head = fresh_folder(spark, "questions"), f"PREFIX kg: <{BASE}>\n"
    for name, body in {
        "q1": 'SELECT ?o WHERE { ?o a kg:Order ; kg:priority "1-URGENT" }',
        "q2": "SELECT ?c ?n WHERE { ?c kg:inNation ?n . ?n a kg:Nation }",
        "q3": "SELECT ?c WHERE { ?c a kg:Customer }",
    }.items():
        with open(f"{at}/{name}.rq", "w", encoding="utf-8") as f:
            f.write(head + body)
    g = tpch_graph(spark, sf_dir)
    return evaluate.questions(evaluate.read_questions(at), g, g.where("false"), {"q3"})


@query("SELECT CAST(3 AS BIGINT) AS questions, CAST(2 AS BIGINT) AS answered, 66.7::DOUBLE AS answered_percent")
def questions_answered(spark, sf_dir):
    return evaluate.answered(question_counts(spark, sf_dir))


@query("""WITH l AS (SELECT quality, toxic, CASE quality WHEN 1 THEN 'keep' WHEN 0 THEN 'drop' END AS a,
CASE WHEN toxic = 1 THEN 'drop' WHEN doc_id % 3 = 0 THEN 'change' ELSE 'keep' END AS b FROM labels WHERE doc_id % 5 > 0),
c AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS o FROM l WHERE a IS NOT NULL),
e AS (SELECT sum(CAST(x.n AS DOUBLE) * y.n) AS e FROM (SELECT a AS v, count(*) AS n FROM l WHERE a IS NOT NULL GROUP BY a) x JOIN (SELECT b AS v, count(*) AS n
FROM l WHERE a IS NOT NULL GROUP BY b) y ON x.v = y.v)
SELECT n, round_even(100.0::DOUBLE * o / n, 1) AS agreement, round_even((o / CAST(n AS DOUBLE) - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)), 3) AS kappa FROM c, e""")
def reviewer_agreement(spark, sf_dir):
    """Verdicts and actions by what they mean; a fifth of the rows have an action without a counterpart."""
    k = F.col("doc_id")
    verdict = F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "unsupported")
    action = F.when(k % 5 == 0, "undo").when(F.col("toxic") == 1, "reject").when(k % 6 == 0, "merge").when(k % 3 == 0, "edit").otherwise("accept")
    return evaluate.agreement(read(spark, sf_dir, "labels").select(verdict.alias("critic_verdict"), action.alias("action")))


@query("SELECT CAST((SELECT count(*) FROM region) AS INTEGER) AS files, 'annotated' AS note UNION ALL SELECT 0, 'not available'")
def gold_sample(spark, sf_dir):
    at = fresh_folder(spark, "gold")
    for r in read(spark, sf_dir, "region").collect():
        with open(f"{at}/{r['r_regionkey']}.json", "w", encoding="utf-8") as f:
            f.write("{}")
    return evaluate.gold_sample(spark, at).unionByName(evaluate.gold_sample(spark, f"{at}/none"))


@query(
    """SELECT 'with' AS which, count(*) AS n, '[' || string_agg('{"check":"' || r_name || '","status":"pass","detail":"' || r_regionkey || '"}', ',' ORDER BY r_name) || ']' AS validation FROM region UNION ALL SELECT 'without', count(*), 'not available' FROM region"""
)
def validated_metrics(spark, sf_dir):
    r = read(spark, sf_dir, "region")
    checks = r.select(F.col("r_name").alias("check"), F.lit("pass").alias("status"), F.col("r_regionkey").cast("string").alias("detail"))
    of = lambda which: r.agg(F.count("*").alias("n")).select(F.lit(which).alias("which"), "n")
    return evaluate.with_validation(of("with"), checks).unionByName(evaluate.with_validation(of("without"), None))


_HAND = "n_regionkey = 0"


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    at = F.concat(F.lit(BASE + "nation"), F.col("n_nationkey").cast("string"))
    g = build.explode_triples(
        n,
        at,
        build.iri(RDFS + "subClassOf", F.concat(F.lit(BASE + "region"), F.col("n_regionkey").cast("string"))),
        F.when(
            F.col("n_nationkey") % 2 == 0,
            build.literal(RDFS + "label", F.concat(F.lit("a very long label of a nation that has to be cut "), "n_name"), "en"),
        ),
        F.when(F.col("n_regionkey") == 0, build.literal(BASE + "curationStatus", F.lit("hand-authored"))),
    )
    return g


_LABEL = "CASE WHEN n_nationkey % 2 = 0 THEN rtrim(substring('a very long label of a nation that has to be cut ' || n_name, 1, 45)) || '…' ELSE 'nation' || n_nationkey END"


@query(f"""SELECT '  "nation' || n_nationkey || '" [label="' || {_LABEL} || '", ' || CASE WHEN {_HAND} THEN '{report.LOOK['core']}' ELSE '{report.LOOK['added']}' END || '];' AS line FROM nation
UNION ALL SELECT DISTINCT '  "region' || n_regionkey || '" [label="region' || n_regionkey || '", {report.LOOK['added']}];' FROM nation
UNION ALL SELECT '  "region' || n_regionkey || '" -> "nation' || n_nationkey || '";' FROM nation""")
def hierarchy_diagram(spark, sf_dir):
    return report.hierarchy_lines(_drawn(spark, sf_dir), BASE)


@query(f"""SELECT '  "nation' || n_nationkey || '" [label="' || {_LABEL} || '", {report.LOOK['core']}];' AS line FROM nation WHERE {_HAND}
UNION ALL SELECT DISTINCT '  "region0" [label="region0", {report.LOOK['added']}];' FROM nation WHERE {_HAND}
UNION ALL SELECT '  "region0" -> "nation' || n_nationkey || '";' FROM nation WHERE {_HAND}""")
def core_diagram(spark, sf_dir):
    return report.hierarchy_lines(_drawn(spark, sf_dir), BASE, core_only=True)


@query(f"""WITH s AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation
WHERE n_regionkey < 2) SELECT '  "e' || k || '" [label="e' || k || '", {report.LOOK['fact']}];' AS line FROM s
UNION ALL SELECT DISTINCT '  "work" [label="work", {report.LOOK['fact']}];' FROM s
UNION ALL SELECT DISTINCT '  "' || CASE r WHEN 0 THEN 'High' ELSE 'Low' END || '" [label="' || CASE r WHEN 0 THEN 'High'
ELSE 'Low' END || '", {report.LOOK['derived']}];' FROM s UNION ALL SELECT '  "e' || k || '" -> "work" [label="used in area"];' FROM s
UNION ALL SELECT '  "e' || k || '" -> "' || CASE r WHEN 0 THEN 'High' ELSE 'Low' END || '" [style=dotted, arrowhead=empty];' FROM s""")
def classification_diagram(spark, sf_dir):
    n, own = read(spark, sf_dir, "nation").where("n_regionkey < 2"), "https://example.org/examples#"
    risk = F.when(F.col("n_regionkey") == 0, F.lit(BASE + "High")).otherwise(BASE + "Low")
    g = build.explode_triples(
        n,
        F.concat(F.lit(own + "e"), F.col("n_nationkey").cast("string")),
        build.iri(RDF + "type", F.lit(OWL + "NamedIndividual")),
        build.iri(RDF + "type", risk),
        build.iri(RDF + "type", F.lit(BASE + "Other")),
        build.iri(BASE + "usedInArea", F.lit(BASE + "work")),
    )
    return report.classification_lines(g, own, BASE, ["High", "Low"])


@query("SELECT p_brand AS entity_type, count(*) AS n FROM part GROUP BY p_brand")
def curated_by_type(spark, sf_dir):
    return evaluate.by_type(read(spark, sf_dir, "part").withColumnRenamed("p_brand", "entity_type"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN false WHEN p_size % 4 = 2 THEN false ELSE true END AS valid FROM part")
def schema_check(spark, sf_dir):
    """Answers of the closed schema, some of a kind that there is not, some without a label."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    row = p.select(
        "p_partkey",
        F.col("p_name").alias("term"),
        F.when(size % 4 == 1, "Odd").otherwise("Actor").alias("entity_type"),
        F.when(size % 4 != 2, F.col("p_name")).alias("label"),
        F.lit("d").alias("definition"),
        F.lit("a").alias("article_ref"),
        F.lit("q").alias("source_quote"),
        F.lit(None).cast("string").alias("bearer"),
        F.lit(None).cast("string").alias("applies_to"),
        F.lit(0.5).alias("confidence"),
    )
    return extract.valid(row).select("p_partkey", "valid")


@query("SELECT o_orderpriority AS metric, count(*) AS value FROM orders GROUP BY o_orderpriority")
def report_file(spark, sf_dir):
    """A one-row report as JSON, read back."""
    import json

    at = f"{fresh_folder(spark, 'report')}/metrics.json"
    o = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    files.write_report(o.agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("counts")), at)
    with open(at, encoding="utf-8") as f:
        return spark.createDataFrame(list(json.load(f)["counts"].items()), "metric string, value long")


@query(f"WITH {_STATE} SELECT CAST(id AS VARCHAR) AS id, seq, action, ord FROM st")
def streamed_log(spark, sf_dir):
    """The log as a stream of two batches: each advances the state of the ids that it touches."""
    from .streaming import replay as stream
    from .schemas import DECISIONS

    at = f"file://{fresh_folder(spark, 'stream')}"
    log = _log(spark, sf_dir)
    middle = log.agg(F.percentile("seq", 0.5)).first()[0]
    named = {c.split()[0]: c.split()[1] for c in DECISIONS.split(", ")}
    full = log.select(*(F.col(c).cast(k).alias(c) if c in log.columns else F.lit(None).cast(k).alias(c) for c, k in named.items()))
    for test in (F.col("seq") <= middle, F.col("seq") > middle):
        full.where(test).write.mode("append").json(f"{at}/log")
        stream.materialise(spark, f"{at}/log", f"{at}/view", f"{at}/checkpoint").awaitTermination()
    return stream.current(spark, f"{at}/view").select("id", "seq", "action", "ord")


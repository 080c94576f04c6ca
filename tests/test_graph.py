import pytest

from normgraph.operators import build, evaluate, reason, report, shacl
from normgraph.plans import sparql
from normgraph.schemas import BASE, CURATED, OWL, RDF, RDFS, TRIPLES
from normgraph.sources import rdf

HEAD = f"@prefix k: <{BASE}> . @prefix owl: <{OWL}> . @prefix rdfs: <{RDFS}> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n"
CORE = HEAD + """
k:AISystem a owl:Class ; rdfs:label "AI system"@en ; k:curationStatus "hand-authored" ; skos:definition "d"@en .
k:HighRiskAISystem a owl:Class ; rdfs:subClassOf k:AISystem ; rdfs:label "high-risk AI system"@en .
k:ProhibitedAISystem a owl:Class ; rdfs:subClassOf k:AISystem ; owl:disjointWith k:HighRiskAISystem .
k:AnnexSystem rdfs:subClassOf k:HighRiskAISystem ; owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( k:AISystem [ a owl:Restriction ; owl:onProperty k:usedInArea ; owl:someValuesFrom k:Area ] ) ] .
k:ProhibitedAISystem owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( k:AISystem [ a owl:Restriction ; owl:onProperty k:usesPractice ; owl:someValuesFrom k:Practice ] ) ] .
k:ProviderRole a owl:Class ; rdfs:label "provider role"@en .
k:usedInArea a owl:ObjectProperty ; rdfs:range k:Area . k:usesPractice a owl:ObjectProperty .
"""
PEOPLE = HEAD + """
k:cv a k:AISystem, owl:NamedIndividual ; k:usedInArea k:work . k:social a k:AISystem, owl:NamedIndividual ; k:usesPractice k:scoring . k:chat a k:AISystem, owl:NamedIndividual .
k:scoring a k:Practice . k:work a owl:NamedIndividual .
"""


def _graph(spark, text, scope="g"):
    return spark.createDataFrame([(*t, scope) for t in rdf.parse_turtle(text, scope)], TRIPLES)


def _entity(id, term, kind, ord, bearer=None, applies=None, label=None):
    return (
        id,
        term,
        kind,
        label or term,
        f"{term} defined",
        bearer,
        applies,
        ["Art. 5(1)"],
        [("Art. 5(1)", "art_5", "http://e/art_5", "quote")],
        0.9,
        "supported",
        "model",
        "accepted",
        "me",
        "now",
        [],
        ord,
    )


def _entities(spark, rows):
    return spark.createDataFrame(rows, CURATED + ", ord long")


def _rows(df):
    return {(r["s"].removeprefix(BASE), r["p"].rsplit("#")[-1].rsplit("/")[-1], r["o"].removeprefix(BASE)) for r in df.collect()}


def test_turtle_and_xml_agree(spark, tmp_path):
    text = HEAD + 'k:a k:p "x\\"y\\n"@en, "1"^^<http://www.w3.org/2001/XMLSchema#int>, 5, true ; a k:C ; k:q [ k:r ( k:b "c" ) ] .\n[] k:s _:n . _:n k:t k:a .'
    xml = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:k="{BASE}"><k:C rdf:about="{BASE}a"><k:p xml:lang="en">x"y
</k:p><k:p rdf:datatype="http://www.w3.org/2001/XMLSchema#int">1</k:p><k:p rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</k:p><k:p rdf:datatype="http://www.w3.org/2001/XMLSchema#boolean">true</k:p>
<k:q rdf:parseType="Resource"><k:r rdf:nodeID="l"/></k:q></k:C><rdf:Description rdf:nodeID="l"><rdf:first rdf:resource="{BASE}b"/><rdf:rest rdf:parseType="Resource"><rdf:first>c</rdf:first><rdf:rest rdf:resource="{RDF}nil"/></rdf:rest></rdf:Description>
<rdf:Description><k:s rdf:nodeID="m"/></rdf:Description><rdf:Description rdf:nodeID="m"><k:t rdf:resource="{BASE}a"/></rdf:Description></rdf:RDF>"""
    (tmp_path / "a.ttl").write_text(text)
    (tmp_path / "b.owl").write_text(xml)
    a, b = (rdf.read_graph(spark, str(tmp_path / n)) for n in ("a.ttl", "b.owl"))
    assert build.isomorphic(a, b)
    assert not build.isomorphic(a, b.where("p <> '" + BASE + "t'"))
    rdf.register(spark)
    assert build.isomorphic(spark.read.format("rdf").load(str(tmp_path / "a.ttl")), b)
    rdf.write_n_triples(a, str(tmp_path / "nt"))
    assert build.isomorphic(rdf.read_graph(spark, str(tmp_path / "nt/*.txt")), a)
    rdf.write_turtle(a, str(tmp_path / "c.ttl"), {"k": BASE})
    assert build.isomorphic(rdf.read_graph(spark, str(tmp_path / "c.ttl")), a)


def test_a_broken_file_fails(spark):
    with pytest.raises(ValueError):
        rdf.parse_turtle("k:a ~~ b")


def test_minting(spark):
    core = _graph(spark, CORE)
    e = _entities(
        spark,
        [
            _entity("1", "Provider", "Actor", 0),
            _entity("2", "risk file", "Requirement", 1),
            _entity("3", "Risk File", "Obligation", 2),
            _entity("4", "high-risk AI system", "AISystemCategory", 3),
            _entity("5", "ProviderRole", "Actor", 4),
            _entity("6", "?!", "Actor", 5),
        ],
    )
    got = {r["id"]: r["iri"].removeprefix(BASE) for r in build.mint(e, core).collect()}
    assert got == {"1": "Provider", "2": "RiskFile", "3": "RiskFile_2", "4": "HighRiskAISystem", "5": "ProviderRole", "6": "Unnamed"}


def test_generated_graph(spark):
    core = _graph(spark, CORE)
    e = _entities(
        spark,
        [
            _entity("1", "provider", "Actor", 0),
            _entity("2", "keep records", "Obligation", 1, "Provider", "high-risk AI systems"),
            _entity("3", "report", "Obligation", 2, "nobody"),
            _entity("4", "high-risk AI system", "AISystemCategory", 3),
            _entity("5", "odd", "Strange", 4),
        ],
    )
    graph, warnings = build.generate(e, core)
    got = _rows(graph)
    assert {("Provider", "type", OWL + "Class"), ("Provider", "subClassOf", "OperatorRole"), ("Provider", "equivalentClass", "ProviderRole")} <= got
    assert {
        ("KeepRecords", "type", "Obligation"),
        ("KeepRecords", "type", OWL + "NamedIndividual"),
        ("KeepRecords", "obligationOf", "Provider"),
        ("Provider", "type", OWL + "NamedIndividual"),
        ("KeepRecords", "appliesToSystem", "HighRiskAISystem"),
    } <= got
    assert ("http://e/art_5", "label", "Art. 5") in got and ("KeepRecords", "definition", "keep records defined") in got
    assert ("HighRiskAISystem", "articleRef", "Art. 5(1)") in got and ("HighRiskAISystem", "label", "high-risk AI system") not in got
    assert {(r["kind"], r["text"]) for r in warnings.collect()} == {("bearer", "nobody"), ("entity_type", "Strange")}
    again = build.generate(e, core)[0]
    assert build.isomorphic(graph, again)
    merged = build.merge(core, graph, build.header(spark, "http://o", "t", "http://core").selectExpr("*", "'h' AS g"))
    assert not merged.where(f"p = '{OWL}imports'").count()


def test_questions(spark):
    g = _graph(
        spark,
        HEAD + 'k:a a k:T ; rdfs:label "A" ; k:p k:x, k:y . k:b a k:T ; rdfs:label "B" ; k:q k:z . k:c a k:T ; rdfs:label "C" ; k:p k:x ; k:q k:w, k:x .',
    )
    ask = lambda text: [tuple((v or "").removeprefix(BASE) for v in r) for r in sparql.select(g, f"PREFIX k: <{BASE}> PREFIX rdfs: <{RDFS}> " + text).collect()]
    assert ask(
        "SELECT ?l ?o WHERE { ?s a k:T ; rdfs:label ?l . OPTIONAL { ?s k:p ?o } } ORDER BY ?l ?o"
    ) == [("A", "x"), ("A", "y"), ("B", ""), ("C", "x")]
    assert ask(
        "SELECT ?l ?o WHERE { ?s a k:T ; rdfs:label ?l . OPTIONAL { ?s k:p ?o } OPTIONAL { ?s k:q ?o } } ORDER BY ?l ?o"
    ) == [("A", "x"), ("A", "y"), ("B", "z"), ("C", "x")]
    assert ask('SELECT ?l WHERE { VALUES ?o { k:x k:z } ?s k:p ?o ; rdfs:label ?l . FILTER(?l != "A") }') == [("C",)]
    assert ask("SELECT DISTINCT ?s WHERE { ?s ?p k:x } ORDER BY DESC(?s) LIMIT 1") == [("c",)]
    assert ask('SELECT ?s WHERE { ?s rdfs:label "A" }') == [("a",)] and ask("SELECT ?s WHERE { ?s a k:None }") == []
    with pytest.raises(ValueError):
        sparql.parse("SELECT ?x WHERE { ?x foo:bar ?y }")


def test_closure_classifies(spark):
    closed = reason.closure(reason.combine(_graph(spark, CORE, "c"), _graph(spark, PEOPLE, "p")))
    types = {(r["s"].removeprefix(BASE), r["o"].removeprefix(BASE)) for r in closed.where(f"p = '{RDF}type'").collect()}
    assert {("cv", "AnnexSystem"), ("cv", "HighRiskAISystem"), ("social", "ProhibitedAISystem"), ("work", "Area")} <= types
    assert not {t for t in types if t[0] == "chat"} & {("chat", "HighRiskAISystem"), ("chat", "ProhibitedAISystem")}
    assert reason.clashes(closed).count() == 0
    risk = [BASE + x for x in ("AnnexSystem", "HighRiskAISystem", "ProhibitedAISystem")]
    expect = lambda *rows: spark.createDataFrame([(BASE + a, [BASE + x for x in b]) for a, b in rows], "individual string, classes array<string>")
    assert reason.check_classification(
        closed,
        expect(("cv", ["AnnexSystem", "HighRiskAISystem"]), ("social", ["ProhibitedAISystem"]), ("chat", [])),
        risk,
    ).first()["status"] == "pass"
    assert reason.check_classification(closed, expect(("chat", ["ProhibitedAISystem"])), risk).first()["status"] == "fail"
    assert reason.check_classification(closed, expect(("cv", [])), risk).first()["status"] == "fail"
    both = reason.closure(reason.combine(_graph(spark, CORE, "c"), _graph(spark, PEOPLE + "k:cv k:usesPractice k:scoring .", "p")))
    assert reason.check_consistency(both).first()["status"] == "fail"


def test_nothing(spark):
    bad = _graph(spark, HEAD + "k:a a owl:Nothing .")
    ok = _graph(spark, HEAD + "owl:Nothing owl:equivalentClass owl:Nothing .")
    assert reason.check_consistency(bad).first()["status"] == "fail" and reason.check_consistency(ok).first()["status"] == "pass"


def test_shapes(spark):
    g = _graph(
        spark,
        HEAD + 'k:a k:curationStatus "accepted" ; rdfs:label "A"@en ; skos:definition "d"@en ; k:articleRef "r" ; k:sourceQuote "q" ; k:hasLegalSource k:l .\nk:b k:curationStatus "odd", "edited" ; rdfs:label "B"@de .\nk:c a k:Obligation . k:d a k:Obligation ; k:obligationOf k:a . k:h k:curationStatus "hand-authored" ; rdfs:label "H"@en ; skos:definition "d"@en .',
    )
    got = sorted((r["shape"], r["focus"].removeprefix(BASE)) for r in shacl.violations(g, shacl.completeness_shapes(BASE)).collect())
    assert got == [("annotated", "b")] * 4 + [("obligation", "c"), ("traceable", "b")]
    assert shacl.check(g.where("s LIKE '%a'"), shacl.completeness_shapes(BASE)).first()["status"] == "pass"


def test_measures(spark):
    g = _graph(
        spark,
        HEAD + "k:a rdfs:subClassOf k:b . k:b rdfs:subClassOf k:c . k:d rdfs:subClassOf k:b . k:x rdfs:subClassOf k:y . k:y rdfs:subClassOf k:x .",
    )
    h = evaluate.hierarchy(g, BASE).first()
    assert (h["max_depth"], h["mean_depth"], h["mean_children"]) == (2, 1.8, 1.25)
    pairs = lambda rows: evaluate.kappa(spark.createDataFrame(rows, "first string, second string")).first()
    assert pairs([("a", "a"), ("b", "b")])["kappa"] == 1.0
    assert pairs([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")])["kappa"] == 0.0
    assert pairs([])["kappa"] is None and pairs([("a", "a")])["kappa"] is None
    cover = evaluate.coverage(_graph(spark, CORE), BASE).first()
    assert cover["entities"] == 1 and cover["with_label"] == 100.0 and cover["obligations_with_bearer"] is None


def test_diagrams(spark):
    g = _graph(spark, HEAD + 'k:a rdfs:subClassOf k:b ; rdfs:label "A"@en . k:h rdfs:subClassOf k:b ; k:curationStatus "hand-authored" .')
    text = report.dot("h", report.hierarchy_lines(g, BASE, core_only=True))
    assert '"b" -> "h"' in text and '1 more' in text and '"a"' not in text


def test_depth_beyond_a_hundred_rounds(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(102)], "child string, parent string").coalesce(1)
    assert evaluate.depths(edges).agg({"depth": "max"}).first()[0] == 102


def test_depths_of_diamonds_and_cycles(spark):
    """Against the definition; a ladder of diamonds has more paths than could be held."""

    def true(pairs):
        parents = {}
        for c, p in pairs:
            parents.setdefault(c, []).append(p)
        depth = lambda n, seen: 0 if n in seen or n not in parents else 1 + max(depth(p, seen | {n}) for p in parents[n])
        return {n: depth(n, frozenset()) for n in parents}

    got = lambda pairs: {r["node"]: r["depth"] for r in evaluate.depths(spark.createDataFrame(pairs, "child string, parent string").coalesce(1)).collect()}
    odd = [
        ("a", "b"),
        ("b", "c"),
        ("c", "a"),
        ("c", "top"),
        ("top", "over"),
        ("x", "a"),
        ("x", "leaf"),
        ("self", "self"),
        ("y", "self"),
        ("z", "top"),
    ]
    assert got(odd) == true(odd)
    ladder = [(f"{i}{side}", f"{i + 1}{other}") for i in range(25) for side in "lr" for other in "lr"]
    assert got(ladder) == {f"{i}{side}": 25 - i for i in range(25) for side in "lr"}
    assert evaluate.depths(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_long_chains_of_blank_nodes_are_told_apart(spark):
    chain = lambda n, end: _graph(spark, HEAD + " ".join(f"_:n{i} k:next _:n{i + 1} ." for i in range(n)) + f' _:n{n} k:name "{end}" . k:a k:p _:n0 .')
    assert build.isomorphic(chain(14, "x"), chain(14, "x")) and not build.isomorphic(chain(14, "x"), chain(14, "y"))
    two = HEAD + " ".join(f"k:a k:p _:{x}0 . _:{x}0 k:q _:{x}1 . _:{x}1 k:q _:{x}2 . _:{x}2 k:name \"{x}\" ." for x in "mn")
    assert build.isomorphic(_graph(spark, two), _graph(spark, two.replace("_:m", "_:o")))


def test_rdf_xml_is_written_and_read(spark, tmp_path):
    text = HEAD + 'k:a k:p "x < y & \\"z\\"\\r\\n é"@en, "1"^^<http://www.w3.org/2001/XMLSchema#int>, "" ; a k:C ; k:q [ k:r ( k:b "c" "c" ) ] . _:n k:t k:a . <http://o.org/x?a=1&b=2> <http://o.org/v/has-part.1> _:n .'
    g = _graph(spark, text)
    rdf.write_rdf_xml(g, str(tmp_path / "g.owl"))
    assert build.isomorphic(rdf.read_graph(spark, str(tmp_path / "g.owl")), g)
    for bad in ("k:a <http://o.org/v/1> k:b .", 'k:a k:p "\\u0001" .'):
        with pytest.raises(ValueError):
            rdf.write_rdf_xml(_graph(spark, HEAD + bad), str(tmp_path / "bad.owl"))
    rdf.write_rdf_xml(g.where("false"), str(tmp_path / "none.owl"))
    assert rdf.read_graph(spark, str(tmp_path / "none.owl")).count() == 0


def test_engines_and_pictures(spark, tmp_path, monkeypatch):
    import shutil

    monkeypatch.setattr(shutil, "which", lambda _: None)
    assert reason.choose_engine() == reason.choose_engine("rl") == "rl"
    with pytest.raises(RuntimeError):
        reason.choose_engine("robot")
    with pytest.raises(ValueError):
        reason.choose_engine("other")
    with pytest.raises(RuntimeError):
        report.render_png("digraph g {}", str(tmp_path / "g.png"))
    tool = tmp_path / "dot"
    tool.write_text('#!/bin/sh\ncp "$4" "$3"\n')
    tool.chmod(0o755)
    monkeypatch.setattr(shutil, "which", lambda _: str(tool))
    assert reason.choose_engine() == "robot" and reason.choose_engine("rl") == "rl"
    report.render_png("digraph g {}", str(tmp_path / "pics" / "g.png"))
    assert (tmp_path / "pics" / "g.png").read_text() == "digraph g {}"


def test_a_property_that_makes_axioms(spark):
    """A subproperty of subClassOf gives classes, whose members follow in the next pass."""
    g = _graph(
        spark,
        HEAD + "k:kindOf rdfs:subPropertyOf rdfs:subClassOf . k:A k:kindOf k:B . k:B rdfs:subClassOf k:C . k:x a k:A . k:Z owl:unionOf ( k:C k:D ) .",
    )
    assert {("x", "type", "B"), ("x", "type", "C"), ("x", "type", "Z"), ("A", "subClassOf", "C")} <= _rows(reason.closure(g))


def test_optional_variables_that_are_unbound(spark):
    g = _graph(spark, HEAD + 'k:a k:p k:x . k:b k:p k:y . k:a k:q "1" . k:c k:r "1" . k:d k:r "2" .')
    text = f"PREFIX k: <{BASE}> SELECT ?s ?v ?z WHERE {{ ?s k:p ?o . OPTIONAL {{ ?s k:q ?v }} OPTIONAL {{ ?z k:r ?v }} }} ORDER BY ?s ?v"
    assert [(r["s"][-1], r["v"], r["z"][-1]) for r in sparql.select(g, text).collect()] == [("a", "1", "c"), ("b", "1", "c"), ("b", "2", "d")]

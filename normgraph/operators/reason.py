"""OWL 2 RL closure of a triples table, and the checks that read it.

Axioms are closed first, on their own. Then rounds are semi-naive: what a round has found is joined with the axioms, and with all that is known only by the rules
that take two facts; new facts are appended as a table of their own, nothing is written twice. Instances meet axioms only through equi-joins; axioms (the
terminology) are small beside them and broadcast if their counted size allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import forget, join_sized, sized, stash
from ..schemas import OWL, RDF, RDFS

TYPE, SUB, EQ = RDF + "type", RDFS + "subClassOf", OWL + "equivalentClass"
NOTHING = OWL + "Nothing"


def _p(g: DataFrame, p: str, s: str, o: str) -> DataFrame:
    return g.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def lists(g: DataFrame, p: str, head: str = "s", item: str = "item") -> DataFrame:
    """head, item, n: the members of the RDF list that `head p list` names, with the list's length."""
    first, rest = _p(g, RDF + "first", "node", item), _p(g, RDF + "rest", "node", "next")
    cells = stash(first.join(rest, "node"), "cells")
    at = _p(g, p, head, "node")
    found = None
    while at.limit(1).count():
        here = at.join(cells, "node")
        items = here.select(head, item)
        found = items if found is None else found.unionByName(items)
        at = stash(here.where(F.col("next") != RDF + "nil").select(head, F.col("next").alias("node")), "list")
    if found is None:
        found = at.withColumn(item, F.lit("")).select(head, item)
    found = stash(found.distinct(), "lists")
    return found.join(found.groupBy(head).agg(F.count("*").alias("n")), head)


_COLUMNS = ["s", "p", "o", "o_kind", "o_lang", "o_dt"]


def _triples(df: DataFrame, s: str, p: str, o: str) -> DataFrame:
    kind = F.when(F.startswith(o, F.lit("_:")), "bnode").otherwise("iri")
    return df.select(
        F.col(s).alias("s"),
        F.lit(p).alias("p"),
        F.col(o).alias("o"),
        kind.alias("o_kind"),
        F.lit("").alias("o_lang"),
        F.lit("").alias("o_dt"),
    )


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _above(known: DataFrame) -> DataFrame:
    """c, d: each class and every other that stands above it, by subclass axioms and equivalence either way. By doubling."""
    equal = _p(known, EQ, "c", "d")
    out = stash(
        _p(known, SUB, "c", "d").unionByName(equal).unionByName(
            equal.select(F.col("d").alias("c"), F.col("c").alias("d"))
        ).where("c <> d").distinct(),
        "above",
    )
    n = out.count()
    while n:
        side = sized(out.select(F.col("c").alias("d"), F.col("d").alias("e")))
        new = stash(out.unionByName(out.join(side, "d").select("c", F.col("e").alias("d")).where("c <> d")).distinct(), "above")
        forget(out)
        out, before, n = new, n, new.count()
        if n == before:
            break
    return out


def _close_facts(known: DataFrame, sub: DataFrame, there: set[str], most_rounds: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The types (x, c) and the other facts (triples) that follow from known, in tables of their own, those of known first."""
    axioms = known.where(
        F.col("p").isin(
            *(RDFS + x for x in ("domain", "range", "subPropertyOf")),
            *(OWL + x for x in ("inverseOf", "onProperty", "someValuesFrom", "intersectionOf", "unionOf")),
            RDF + "first",
            RDF + "rest",
        )
    )
    axioms = stash(axioms, "axioms")
    fixed = lambda df: sized(stash(df, "axioms"))  # noqa: E731  each round joins them, none makes them anew
    inter, union = (fixed(lists(axioms, OWL + p, "c")) if OWL + p in there else None for p in ("intersectionOf", "unionOf"))
    some = fixed(
        _p(axioms, OWL + "onProperty", "c", "prop").join(_p(axioms, OWL + "someValuesFrom", "c", "filler"), "c")
    ) if OWL + "someValuesFrom" in there else None
    domain, range_, subprop = (fixed(_p(axioms, RDFS + x, "prop", "to")) if RDFS + x in there else None for x in ("domain", "range", "subPropertyOf"))
    inverse = _p(axioms, OWL + "inverseOf", "prop", "to")
    inverse = fixed(
        inverse.unionByName(inverse.select(F.col("to").alias("prop"), F.col("prop").alias("to"))).distinct()
    ) if OWL + "inverseOf" in there else None
    sub = sized(sub)
    types, facts = [stash(_p(known, TYPE, "x", "c"), "types")], [known.where(F.col("p") != TYPE)]
    new_types, new_facts = types[0], facts[0]
    for _ in range(most_rounds):
        named = new_facts.where("p NOT LIKE 'http://www.w3.org/%'").withColumnRenamed("p", "prop")
        nodes = named.where("o_kind <> 'literal'")
        found, made = [new_types.join(sub, "c").select("x", F.col("d").alias("c"))], []  # members of subclasses and equivalents
        if inter is not None:
            found.append(new_types.join(inter, "c").select("x", F.col("item").alias("c")))
            near = new_types.withColumnRenamed("c", "item").join(inter, "item").select("x", "c").distinct()  # who may have got the last part
            parts = near.join(inter, "c").join(_all(types).withColumnRenamed("c", "item"), ["x", "item"])
            found.append(parts.groupBy("x", "c", "n").agg(F.count_distinct("item").alias("k")).where("k = n").select("x", "c"))
        if union is not None:
            found.append(new_types.withColumnRenamed("c", "item").join(union, "item").select("x", "c"))
        if some is not None:
            edges = lambda df: df.where("o_kind <> 'literal'").select(F.col("s").alias("x"), F.col("p").alias("prop"), F.col("o").alias("y")).join(some, "prop")
            filler = lambda df: df.select(F.col("x").alias("y"), F.col("c").alias("filler"))
            fresh = edges(new_facts)
            found += [
                fresh.join(filler(_all(types)), ["y", "filler"]).select("x", "c"),
                fresh.where(F.col("filler") == OWL + "Thing").select("x", "c"),
            ]
            if len(facts) > 1 or new_types is not types[0]:  # new edges have met all types already
                found.append(edges(_all(facts)).join(filler(new_types), ["y", "filler"]).select("x", "c"))
        if domain is not None:
            found.append(named.join(domain, "prop").select(F.col("s").alias("x"), F.col("to").alias("c")))
        if range_ is not None:
            found.append(nodes.join(range_, "prop").select(F.col("o").alias("x"), F.col("to").alias("c")))
        if subprop is not None:
            made.append(named.join(subprop, "prop").select("s", F.col("to").alias("p"), "o", "o_kind", "o_lang", "o_dt"))
        if inverse is not None:
            kind = F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("iri")
            made.append(
                nodes.join(inverse, "prop").select(
                    F.col("o").alias("s"),
                    F.col("to").alias("p"),
                    F.col("s").alias("o"),
                    kind.alias("o_kind"),
                    F.lit("").alias("o_lang"),
                    F.lit("").alias("o_dt"),
                )
            )
        new_types = stash(_all(found).distinct().join(_all(types), ["x", "c"], "left_anti"), "types")
        more = new_types.limit(1).count()
        if more:
            types.append(new_types)
        if made:
            new_facts = stash(_all(made).distinct().join(_all(facts), _COLUMNS, "left_anti"), "facts")
            if new_facts.limit(1).count():
                facts.append(new_facts)
                more = 1
            else:
                new_facts = new_facts.where("false")
        else:
            new_facts = new_facts.where("false")
        if not more:
            return types, facts
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def closure(graph: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """s, p, o, o_kind, o_lang, o_dt of the graph and all that follows by the rules for subclasses, equivalence, intersections, existential restrictions,
    unions, domains, ranges, subproperties and inverses. Literals take part in no rule but domains and subproperties. A graph that has no fixpoint
    after most_rounds is an error."""
    known = stash(graph.select(*_COLUMNS).distinct(), "closure")
    while True:
        there = {r["p"] for r in known.where("p LIKE 'http://www.w3.org/%'").select("p").distinct().collect()}  # the vocabularies' terms
        sub = _above(known)
        types, facts = _close_facts(known, sub, there, most_rounds)
        derived = [_triples(x, "x", TYPE, "c") for x in types[1:]] + facts[1:] + [
            _triples(sub, "c", SUB, "d").join(known.where(F.col("p") == SUB), _COLUMNS, "left_anti")
        ]
        if not any(
            x.where(
                F.col("p").isin(SUB, EQ, RDFS + "domain", RDFS + "range", RDFS + "subPropertyOf") | (F.col("p") == OWL + "inverseOf")
            ).limit(1).count() for x in facts[1:]
        ):
            return _all([known, *derived])
        known = stash(_all([known, *derived]).distinct(), "closure")  # a property has made axioms: once more


def superclasses(graph: DataFrame) -> DataFrame:
    """c, d: every class with itself and all that stand above it."""
    sub = stash(_p(graph, SUB, "c", "d").distinct(), "subclass")
    out = stash(sub.select("c").union(sub.select("d")).distinct().select("c", F.col("c").alias("d")).unionByName(sub).distinct(), "above")
    while True:
        new = stash(out.join(out.select(F.col("c").alias("d"), F.col("d").alias("e")), "d").select("c", F.col("e").alias("d")).distinct(), "above")
        if new.count() == out.count():
            return new
        out = new


def clashes(graph: DataFrame) -> DataFrame:
    """x, c, d: members of two classes that are disjoint, by disjointWith or AllDisjointClasses."""
    pairs = _p(graph, OWL + "disjointWith", "c", "d")
    members = lists(graph, OWL + "members", "axiom").select("axiom", "item")
    pairs = pairs.unionByName(
        members.select("axiom", F.col("item").alias("c")).join(
            members.select("axiom", F.col("item").alias("d")),
            "axiom",
        ).where("c < d").select("c", "d")
    ).distinct()
    types = _p(graph, TYPE, "x", "c")
    return join_sized(types, pairs, "c").join(types.select("x", F.col("c").alias("d")), ["x", "d"]).select("x", "c", "d").distinct()


def check_parse(graph: DataFrame) -> DataFrame:
    return graph.agg(F.count("*").alias("n")).select(
        F.lit("parse").alias("check"),
        F.when(F.col("n") > 0, "pass").otherwise("fail").alias("status"),
        F.concat("n", F.lit(" triples")).alias("detail"),
    )


def check_profile(graph: DataFrame) -> DataFrame:
    """Properties in use that are declared nowhere, external vocabularies aside."""
    declared = graph.where((F.col("p") == TYPE) & F.col("o").rlike("Property$")).select(F.col("s").alias("p"))
    loose = graph.where("p NOT LIKE 'http://www.w3.org/%' AND p NOT LIKE 'http://purl.org/%'").select("p").distinct().join(declared, "p", "left_anti")
    return _result("profile", loose, "p", "undeclared properties")


def _result(check: str, problems: DataFrame, column: str, what: str) -> DataFrame:
    """One row; the first 20 problems are named."""
    few = problems.agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, 20), ", ").alias("names"))
    return few.select(
        F.lit(check).alias("check"),
        F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"),
        F.when(F.col("n") == 0, "none found").otherwise(F.concat("n", F.lit(f" {what}: "), "names")).alias("detail"),
    )


def check_consistency(closed: DataFrame) -> DataFrame:
    """Members and equivalents of owl:Nothing, itself aside, and members of disjoint classes."""
    nothing = closed.where(F.col("p").isin(TYPE, EQ) & (F.col("o") == NOTHING) & (F.col("s") != NOTHING)).select(F.col("s").alias("x"))
    return _result("consistency", nothing.unionByName(clashes(closed).select("x")).distinct(), "x", "contradictions")


def check_classification(closed: DataFrame, expected: DataFrame, risk: list[str]) -> DataFrame:
    """expected: individual, classes (array; empty: none of the risk classes)."""
    types = _p(closed, TYPE, "individual", "c").join(superclasses(closed), "c", "left").select(
        "individual",
        F.coalesce("d", "c").alias("c"),
    ).where(F.col("c").isin(risk)).distinct()
    seen = expected.join(types, "individual", "left").groupBy("individual", "classes").agg(F.array_sort(F.collect_set("c")).alias("seen"))
    wrong = seen.where((F.size(F.array_except("classes", "seen")) > 0) | ((F.size("classes") == 0) & (F.size("seen") > 0)))
    return _result("classification", wrong, "individual", "individuals in the wrong classes")


def quality_report(graph: DataFrame, base: str) -> DataFrame:
    """level, rule, subject: equivalent named classes, and classes and properties without definition (WARN), classes without superclass (INFO)."""
    named = lambda c: ~F.startswith(c, F.lit("_:"))
    classes = graph.where((F.col("p") == TYPE) & (F.col("o") == OWL + "Class") & F.startswith("s", F.lit(base))).select("s").distinct()
    have = lambda p: graph.where(F.col("p").isin(p)).select("s").distinct()
    rows = lambda df, level, rule: df.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.col("s").alias("subject"))
    kinds = [OWL + k for k in ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty")]
    entities = graph.where((F.col("p") == TYPE) & F.col("o").isin(kinds) & F.startswith("s", F.lit(base))).select("s").distinct()
    equal = graph.where((F.col("p") == EQ) & named("s") & named("o")).select("s")
    return rows(equal, "WARN", "equivalent_pair").unionByName(
        rows(entities.join(have(["http://www.w3.org/2004/02/skos/core#definition"]), "s", "left_anti"), "WARN", "missing_definition")
    ).unionByName(rows(classes.join(have([SUB, EQ]), "s", "left_anti"), "INFO", "missing_superclass"))


def check_report(graph: DataFrame, base: str) -> DataFrame:
    n = quality_report(graph, base).agg(*(F.count_if(F.col("level") == x).alias(x) for x in ("ERROR", "WARN", "INFO")))
    return n.select(
        F.lit("report").alias("check"),
        F.when(F.col("ERROR") == 0, "pass").otherwise("fail").alias("status"),
        F.concat("ERROR", F.lit(" errors, "), "WARN", F.lit(" warnings, "), "INFO", F.lit(" info")).alias("detail"),
    )


def choose_engine(wanted: str = "auto") -> str:
    """"robot" if a DL reasoner's command line is on PATH and wanted is "auto" or "robot", else "rl", the closure of this module."""
    import shutil

    if wanted not in ("auto", "robot", "rl"):
        raise ValueError(f"no engine {wanted!r}")
    found = shutil.which("robot") is not None
    if wanted == "robot" and not found:
        raise RuntimeError("robot is not on PATH")
    return "robot" if found and wanted != "rl" else "rl"


def reason(graph: DataFrame, engine: str = "auto", work: str | None = None, reasoner: str = "hermit") -> DataFrame:
    """The closed graph. With the engine "robot" the graph is written to the folder work (the driver's own), classified by the DL reasoner in a process
    of its own and read back; a graph that it refuses is an error. A terminology fits one process, facts at scale do not: the engine "rl" is for those."""
    if choose_engine(engine) == "rl":
        return closure(graph)
    import subprocess

    from ..sources.rdf import read_graph, write_turtle

    if not work:
        raise ValueError("the engine robot needs a folder to work in")
    write_turtle(graph, f"{work}/combined.ttl", {})
    axes = "SubClass EquivalentClass ClassAssertion"
    done = subprocess.run(
        [
            "robot",
            "reason",
            "--reasoner",
            reasoner,
            "--axiom-generators",
            axes,
            "--input",
            f"{work}/combined.ttl",
            "--output",
            f"{work}/reasoned.owl",
        ],
        capture_output=True,
        text=True,
    )
    if done.returncode:
        raise RuntimeError(f"the reasoner refused the graph: {(done.stdout + done.stderr).strip()[:2000]}")
    return combine(graph, read_graph(graph.sparkSession, f"{work}/reasoned.owl"))


def combine(*graphs: DataFrame) -> DataFrame:
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates(["s", "p", "o", "o_kind", "o_lang", "o_dt"])


def validate(
    graph: DataFrame,
    examples: DataFrame,
    expected: DataFrame,
    risk: list[str],
    base: str,
    shacl: DataFrame,
    engine: str = "auto",
    work: str | None = None,
) -> DataFrame:
    """check, status, detail of all checks. shacl: of shacl.check(); engine and work: of reason()."""
    closed = stash(reason(combine(graph, examples), engine, work), "closed")
    out = check_parse(graph)
    for df in (check_profile(graph), check_consistency(closed), check_classification(closed, expected, risk), shacl, check_report(graph, base)):
        out = out.unionByName(df)
    return out

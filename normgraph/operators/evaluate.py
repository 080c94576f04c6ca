"""Measures of the graph and of the pipeline that made it."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percentage
from ..plans import sparql
from ..plans.tables import forget, join_sized, stash
from ..schemas import DCTERMS, OWL, RDF, RDFS, SKOS
from .build import counts as size_counts

# What a verdict suggests and what an action amounts to.
VERDICT_MEANS = {"supported": "keep", "partially": "change", "unsupported": "drop"}
ACTION_MEANS = {"accept": "keep", "edit": "change", "merge": "change", "reject": "drop"}

__all__ = ["size_counts"]


def kappa(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """One row: n, agreement (percent), kappa (3 decimals; null if there are no pairs or chance alone agrees wholly). The pairs are counted by
    kind first; what follows is a row for each pair of labels."""
    cells = pairs.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    expected = rows.join(columns, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra").cast("double") * F.col("cb")), F.lit(0.0)).alias("e"))
    observed = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("o"),
    )
    both = observed.crossJoin(F.broadcast(expected))
    n = F.nullif("n", F.lit(0)).cast("double")
    pe, po = F.col("e") / (n * n), F.col("o") / n
    return both.select("n", percentage(F.col("o"), F.col("n")).alias("agreement"), F.when(pe < 1, F.bround((po - pe) / (1 - pe), 3)).alias("kappa"))


def _means(table: dict[str, str], x: Column) -> Column:
    return F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x]


def agreement(state: DataFrame) -> DataFrame:
    """Of the critic's verdicts, as logged, with the reviewer's actions; rows without a counterpart do not count."""
    pairs = state.select(_means(VERDICT_MEANS, F.col("critic_verdict")).alias("first"), _means(ACTION_MEANS, F.col("action")).alias("second"))
    return kappa(pairs.where("first IS NOT NULL AND second IS NOT NULL"))


def depths(edges: DataFrame) -> DataFrame:
    """node, depth: the longest chain of parents of each child of edges (child, parent); a chain that comes back to a node that it has passed
    ends there.

    Round k keeps the nodes, each once, that have a chain of k parents, so a hierarchy takes as many rounds as it is deep and no path is held. What is left
    when a round loses no node leads into a cycle; only there paths are followed, and they end where they leave it."""
    e = stash(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    level, found, made = stash(e.select(F.col("child").alias("node")).distinct(), "level"), [], []
    size = level.count()
    for k in itertools.count(1):
        made.append(level)
        above = stash(e.join(level.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node")).distinct(), "level")
        left = above.count()
        found.append(level.join(above, "node", "left_anti").withColumn("depth", F.lit(k)))
        if left == 0 or left == size:
            break
        level, size = above, left
    done = found[0]
    for df in found[1:]:
        done = done.unionByName(df)
    done = stash(done, "depths")
    if left:
        done = stash(done.unionByName(_cyclic(e, above, done)), "depths")
    forget(*made, above)
    return done


def _cyclic(e: DataFrame, nodes: DataFrame, done: DataFrame) -> DataFrame:
    """node, depth of the nodes whose chains lead into a cycle. done: the depths of the others."""
    inner = stash(e.join(nodes.withColumnRenamed("node", "child"), "child"), "cyclic")
    here = inner.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
    out = inner.join(
        nodes.withColumnRenamed("node", "parent"),
        "parent",
        "left_anti",
    ).join(done.withColumnRenamed("node", "parent"), "parent", "left").groupBy(F.col("child").alias("at")).agg((F.max(F.coalesce("depth", F.lit(0))) + 1).alias("more"))
    level = stash(here.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.array("child").alias("path")), "chains")
    best = out.select(F.col("at").alias("node"), F.col("more").alias("depth")).unionByName(level.select("node", F.lit(1).alias("depth")))
    for k in itertools.count(2):
        open_ones = level.where(~F.array_contains("path", F.col("at")))
        best = best.unionByName(open_ones.join(out, "at").select("node", (F.col("more") + k - 1).alias("depth")))
        level = stash(
            open_ones.join(here, F.col("at") == F.col("child")).select(
                "node",
                F.col("parent").alias("at"),
                F.array_append("path", F.col("child")).alias("path"),
            ).distinct(),
            "chains",
        )
        if not level.limit(1).count():
            break
        best = best.unionByName(level.select("node", F.lit(k).alias("depth")))
    return best.groupBy("node").agg(F.max("depth").alias("depth"))


def hierarchy(graph: DataFrame, base: str) -> DataFrame:
    """One row: max_depth, mean_depth (of children), mean_children of parents; the child is in the namespace, the parent any IRI."""
    edges = graph.where(
        (F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") == "iri") & F.startswith("s", F.lit(base))
    ).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    d = depths(edges).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.bround(F.avg("depth"), 2).alias("mean_depth"))
    return d.crossJoin(F.broadcast(edges.groupBy("parent").agg(F.count("*").alias("k")).agg(F.bround(F.avg("k"), 2).alias("mean_children"))))


def axiom_counts(graph: DataFrame) -> DataFrame:
    """One row: axioms, logical_axioms, classes, individuals, as an OWL measure has them: a declaration, an annotation, an assertion or a class
    axiom of a named subject is an axiom, and all but declarations and annotations are logical. Triples of blank nodes are parts of axioms, but for
    the members that AllDisjointClasses names. What a property that is declared nowhere asserts is an annotation; Dublin Core's are
    annotations however declared; what is said of an ontology itself is no axiom."""
    kinds = {
        k: [OWL + x for x in names] for k, names in (
            ("entity", ("Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual")),
            ("relation", ("ObjectProperty", "DatatypeProperty")),
        )
    }
    is_type, named = F.col("p") == RDF + "type", ~F.startswith("s", F.lit("_:"))
    relations = graph.where(
        is_type & F.col("o").isin(kinds["relation"]) & ~F.startswith("s", F.lit(DCTERMS))
    ).select(F.col("s").alias("p"), F.lit(True).alias("_relation")).distinct()
    headers = graph.where(is_type & (F.col("o") == OWL + "Ontology")).select("s").distinct()
    marked = join_sized(join_sized(graph, headers, "s", "left_anti"), relations, "p", "left")
    declaration = named & is_type & F.col("o").isin(kinds["entity"])
    whole = named & (
        (is_type & ~F.startswith("o", F.lit(OWL))) | F.col("p").isin(
            *(RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range")),
            *(OWL + x for x in ("equivalentClass", "disjointWith", "inverseOf", "equivalentProperty", "sameAs", "differentFrom", "hasKey")),
        )
    )
    logical = F.coalesce(
        whole | (named & F.col("_relation")) | (F.col("p") == OWL + "members") | (
            named & is_type & F.col("o").rlike("#(Functional|InverseFunctional|Transitive|Symmetric|Asymmetric|Reflexive|Irreflexive)Property$")
        ),
        F.lit(False),
    )
    annotation = named & ~is_type & ~logical
    n = lambda test: F.count_if(test)
    each = lambda k: F.count_distinct(F.when(declaration & (F.col("o") == OWL + k), F.col("s")))
    return marked.agg(
        n(declaration | logical | annotation).alias("axioms"),
        n(logical).alias("logical_axioms"),
        each("Class").alias("classes"),
        each("NamedIndividual").alias("individuals"),
    )


def coverage(graph: DataFrame, base: str) -> DataFrame:
    """Shares of the entities that carry each annotation, in one pass over their triples."""
    p, have = F.col("p"), lambda prop: F.max((F.col("p") == prop).cast("int"))
    per = graph.groupBy("s").agg(
        have(base + "curationStatus").alias("entity"),
        F.max(((p == base + "curationStatus") & (F.col("o") == "hand-authored")).cast("int")).alias("by_hand"),
        F.max(((p == RDF + "type") & (F.col("o") == base + "Obligation")).cast("int")).alias("obligation"),
        *(have(x).alias(n) for n, x in (("label", RDFS + "label"), ("definition", SKOS + "definition"), ("ref", base + "articleRef"), ("quote", base + "sourceQuote"), ("eli", base + "hasLegalSource"), ("bearer", base + "obligationOf"))),
    )
    made = (F.col("entity") == 1) & (F.col("by_hand") == 0)
    n = lambda *tests: F.count_if(tests[0] if len(tests) == 1 else tests[0] & (tests[1] == 1))
    one = lambda c: F.col(c) == 1
    share = lambda of, c: percentage(n(of, F.col(c)), n(of))
    return per.agg(
        n(one("entity")).alias("entities"),
        *(share(one("entity"), c).alias(a) for a, c in (("with_label", "label"), ("with_definition", "definition"), ("with_article_ref", "ref"))),
        n(made).alias("generated_entities"),
        share(made, "quote").alias("generated_with_source_quote"),
        share(made, "eli").alias("generated_with_eli_link"),
        share(one("obligation"), "bearer").alias("obligations_with_bearer"),
    )


def reuse(core: DataFrame, alignments: DataFrame, base: str) -> DataFrame:
    classes = core.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Class") & F.startswith("s", F.lit(base))).select("s").distinct()
    mapped = alignments.where(F.col("p").isin(SKOS + "closeMatch", SKOS + "exactMatch", SKOS + "relatedMatch", RDFS + "subClassOf")).select("s")
    return classes.agg(F.count("*").alias("core_classes")).crossJoin(classes.intersect(mapped).agg(F.count("*").alias("aligned"))).withColumn(
        "aligned_percent",
        percentage(F.col("aligned"), F.col("core_classes")),
    )


def questions(texts: dict[str, str], asserted: DataFrame, reasoned: DataFrame, reasoning: set[str]) -> DataFrame:
    """question, n: the rows that each SPARQL text gives, over the reasoned graph for those named in `reasoning`."""
    out = None
    for name, text in sorted(texts.items()):
        n = sparql.select(reasoned if name in reasoning else asserted, text).agg(F.count("*").alias("n")).select(F.lit(name).alias("question"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def answered(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("n") > 0).alias("answered"),
    ).withColumn("answered_percent", percentage(F.col("answered"), F.col("questions")))


def read_questions(folder: str) -> dict[str, str]:
    """The .rq files of a folder by name."""
    from pathlib import Path

    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.rq"))}


def funnel(extracted: DataFrame, rejected: DataFrame, verified: DataFrame, curated: DataFrame, state: DataFrame) -> DataFrame:
    """One row of counts and rates from extraction to curation."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    v = verified.agg(
        F.count("*").alias("verified_records"),
        F.count_if(F.col("grounding_method") == "exact").alias("exact"),
        *(
            F.count_if(F.col("critic_verdict").eqNullSafe(F.lit(x))).alias(f"verdict_{x or 'none'}") for x in (
                "supported",
                "partially",
                "unsupported",
                None,
            )
        ),
    )
    s = state.agg(F.count("*").alias("decided"), *(F.count_if(F.col("action") == x).alias(f"{x}s") for x in ("accept", "edit", "reject", "merge")))
    out = n(extracted, "extracted_records").crossJoin(
        n(rejected, "grounding_rejected")
    ).crossJoin(v).crossJoin(n(curated, "curated_entities")).crossJoin(s).crossJoin(agreement(state).drop("n"))
    return out.withColumns(
        {
            "grounding_pass_percent": percentage(F.col("extracted_records") - F.col("grounding_rejected"), F.col("extracted_records")),
            "exact_quote_percent": percentage(F.col("exact"), F.col("verified_records")),
            "unchanged_percent": percentage(F.col("accepts"), F.col("decided")),
        }
    ).drop("exact")


def by_type(curated: DataFrame) -> DataFrame:
    return curated.groupBy("entity_type").agg(F.count("*").alias("n"))


def gold_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Number of gold files; what they hold is not measured."""
    import os

    files = [f for _, _, names in os.walk(folder) for f in names if not f.startswith(".")]
    return spark.range(1).select(F.lit(len(files)).alias("files"), F.lit("annotated" if files else "not available").alias("note"))


def with_validation(metrics: DataFrame, checks: DataFrame | None) -> DataFrame:
    """metrics with the checks' results as JSON, or a note that there are none."""
    if checks is None:
        return metrics.withColumn("validation", F.lit("not available"))
    return metrics.crossJoin(checks.agg(F.to_json(F.array_sort(F.collect_list(F.struct("check", "status", "detail")))).alias("validation")))

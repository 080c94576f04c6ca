"""Curated entities to triples: IRI minting, reference resolution, the generated graph and its merge with others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import camel_case
from ..plans.tables import forget, join_sized, sized, stash
from ..schemas import BASE, BEARER_ALIASES, DCTERMS, OWL, PROV, RDF, RDFS, SKOS, SYSTEM_ALIASES, TYPE_MAP

KEY = ["s", "p", "o", "o_kind", "o_lang", "o_dt"]
ARTICLE_PART = r"^(Art\. \d+|Annex [IVXLC]+)"


def iri(p: str | Column, o: Column) -> Column:
    return F.struct(
        (F.lit(p) if isinstance(p, str) else p).alias("p"),
        o.alias("o"),
        F.lit("iri").alias("o_kind"),
        F.lit("").alias("o_lang"),
        F.lit("").alias("o_dt"),
    )


def literal(p: str, o: Column, lang: str = "", dt: str = "") -> Column:
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit(lang).alias("o_lang"), F.lit(dt).alias("o_dt"))


def explode_triples(df: DataFrame, subject: Column, *pairs: Column) -> DataFrame:
    """A triple of the subject for each pair (iri() or literal()); those without object, or null, are left out."""
    return df.select(
        subject.alias("s"),
        F.explode(F.array_compact(F.array(*pairs))).alias("t"),
    ).select("s", "t.*").where("s IS NOT NULL AND o IS NOT NULL")


def virtual_triples(df: DataFrame, subject: Column, *pairs: Column) -> DataFrame:
    """The triples of explode_triples() as a union with a branch for each pair, whose predicate is a constant: a pattern with that predicate folds all other branches
    away and reads the columns of its own from df alone. For a df that is cheap to read again, such as files."""
    out = None
    for pair in pairs:
        one = df.select(subject.alias("s"), pair.alias("t")).select("s", "t.*").where("s IS NOT NULL AND o IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def core_terms(core: DataFrame) -> DataFrame:
    """iri of each class and property that the core graph declares."""
    kinds = [OWL + k for k in ("Class", "ObjectProperty", "AnnotationProperty", "DatatypeProperty")]
    return core.where((F.col("p") == RDF + "type") & F.col("o").isin(kinds) & (F.col("s") != "")).select(F.col("s").alias("iri")).distinct()


def core_labels(core: DataFrame) -> DataFrame:
    """label (lower case), iri of the core terms; of several with a label the last by IRI."""
    return core.where(F.col("p") == RDFS + "label").join(
        core_terms(core),
        F.col("s") == F.col("iri"),
        "left_semi",
    ).groupBy(F.lower("o").alias("label")).agg(F.max("s").alias("iri"))


def mint(entities: DataFrame, core: DataFrame, base: str = BASE) -> DataFrame:
    """id, iri of each entity (id, term, ord): a core term of that label, unless the name is a core term of its own; the core term of that name; else
    the camel-cased name, with _2, _3, ... for later entities of one name, in order. Names never contain "_", so a rank is all it takes.
    Many entities of one name are ranked in one window, which spills; their number is that of one word's spellings."""
    e = entities.select("id", "term", "ord").withColumn("name", F.concat(F.lit(base), camel_case(F.col("term"))))
    terms, labels = core_terms(core), core_labels(core)
    e = join_sized(e, terms.select(F.col("iri").alias("name"), F.lit(True).alias("is_core")), "name", "left")
    e = join_sized(e.withColumn("label", F.lower(F.trim("term"))), labels.withColumnRenamed("iri", "labelled"), "label", "left")
    e = e.withColumn("core", F.when(F.col("is_core"), F.col("name")).otherwise(F.col("labelled")))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    own = e.where("core IS NULL").withColumn("iri", F.when(nth > 1, F.concat("name", F.lit("_"), nth.cast("string"))).otherwise(F.col("name")))
    return own.select("id", "iri", F.lit(False).alias("in_core")).unionByName(
        e.where("core IS NOT NULL").select("id", F.col("core").alias("iri"), F.lit(True).alias("in_core"))
    )


def resolve(entities: DataFrame, column: str, types: tuple[str, ...], aliases: dict[str, str], base: str = BASE) -> DataFrame:
    """Adds `resolved`, the IRI that the column's value names: the first curated entity of the types with that term, else an alias, else null."""
    known = entities.where(F.col("entity_type").isin(*types)).groupBy(
        F.lower(F.trim("term")).alias("_value")
    ).agg(F.min_by("iri", "ord").alias("_entity"))
    value = F.lower(F.trim(column))
    table = F.create_map(*(F.lit(x) for k, v in aliases.items() for x in (k, base + v)))
    out = join_sized(entities.withColumn("_value", value), known, "_value", "left")
    return out.withColumn("resolved", F.coalesce("_entity", table[F.col("_value")])).drop("_value", "_entity")


def run_id(entities: DataFrame) -> DataFrame:
    """One row: 12 digits of the digest of all entities, in order. Digests of ranges of the order are combined, so no task holds all of them."""
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in entities.columns if c != "ord")), {"ignoreNullFields": "false"}), 256)
    parts = entities.select("ord", row.alias("h")).groupBy(F.floor(F.col("ord") / 10_000).alias("part"))
    parts = parts.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("ord", "h"))), lambda x: x["h"])), 256).alias("h"))
    return parts.agg(
        F.substring(
            F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256),
            1,
            12,
        ).alias("run_id")
    )


def provenance(entities: DataFrame, base: str = BASE, source: str = "", title: str = "pipeline run") -> DataFrame:
    run = run_id(entities).withColumn("run", F.concat(F.lit(f"{base}run_"), "run_id"))
    own = explode_triples(
        run,
        F.col("run"),
        iri(RDF + "type", F.lit(PROV + "Activity")),
        literal(RDFS + "label", F.concat(F.lit(f"{title} "), "run_id"), "en"),
        iri(DCTERMS + "source", F.lit(source or None).cast("string")),
    )
    models = entities.where("model <> ''").select("model").distinct().crossJoin(F.broadcast(run))
    return own.unionByName(
        explode_triples(models, F.col("run"), literal(DCTERMS + "description", F.concat(F.lit("extraction and verification model: "), "model"), "en"))
    )


def entity_triples(entities: DataFrame, base: str = BASE) -> DataFrame:
    """entities: CURATED columns with iri, in_core, ord, run. A row's graph, without the links to bearers and systems."""
    e = entities.where(F.col("entity_type").isin(*TYPE_MAP))
    kind = F.create_map(*(F.lit(x) for k, (v, _) in TYPE_MAP.items() for x in (k, v)))[F.col("entity_type")]
    parent = F.create_map(*(F.lit(x) for k, (_, v) in TYPE_MAP.items() for x in (k, base + v)))[F.col("entity_type")]
    role = F.create_map(*(F.lit(x) for k, v in BEARER_ALIASES.items() for x in (k, base + v)))[F.lower(F.trim("term"))]
    new, cls = ~F.col("in_core"), kind == "class"
    one = explode_triples(
        e,
        F.col("iri"),
        F.when(new & cls, iri(RDF + "type", F.lit(OWL + "Class"))),
        F.when(new & cls, iri(RDFS + "subClassOf", parent)),
        F.when(new & cls & (F.col("entity_type") == "Actor") & role.isNotNull(), iri(OWL + "equivalentClass", role)),
        F.when(new & ~cls, iri(RDF + "type", parent)),
        F.when(new & ~cls, iri(RDF + "type", F.lit(OWL + "NamedIndividual"))),
        F.when(new, literal(RDFS + "label", F.coalesce(F.nullif("label", F.lit("")), "term"), "en")),
        F.when(new, literal(SKOS + "definition", F.col("definition"), "en")),
        F.when(new, literal(base + "curationStatus", F.col("curation_status"))),
        iri(PROV + "wasGeneratedBy", F.col("run")),
    )
    refs = e.select("iri", F.explode("article_refs").alias("ref"))
    sources = e.select("iri", F.explode("sources").alias("x")).select("iri", "x.*").withColumn("eli", F.nullif("eli_uri", F.lit("")))
    part = F.nullif(F.regexp_extract("article_ref", ARTICLE_PART, 1), F.lit(""))
    out = one.unionByName(explode_triples(refs, F.col("iri"), literal(base + "articleRef", F.col("ref"))))
    out = out.unionByName(
        explode_triples(sources, F.col("iri"), literal(base + "sourceQuote", F.col("source_quote")), iri(base + "hasLegalSource", F.col("eli")))
    )
    return out.unionByName(
        explode_triples(
            sources,
            F.col("eli"),
            iri(RDF + "type", F.lit(base + "LegalProvision")),
            iri(RDF + "type", F.lit(OWL + "NamedIndividual")),
            literal(RDFS + "label", part, "en"),
        )
    )


def link_triples(entities: DataFrame, base: str = BASE) -> tuple[DataFrame, DataFrame]:
    """obligationOf and appliesToSystem links, their targets as individuals (punning), and warnings (kind, text) of values that name nothing."""
    open_ones = entities.where("NOT in_core")
    out, warnings = None, None
    for column, prop, of, types, aliases in (
        ("bearer", "obligationOf", ("Obligation",), ("Actor", "Authority"), BEARER_ALIASES),
        ("applies_to", "appliesToSystem", ("Obligation", "Requirement"), ("AISystemCategory",), SYSTEM_ALIASES),
    ):
        r = resolve(entities, column, types, aliases, base).join(open_ones.select("id"), "id", "left_semi").where(
            F.col("entity_type").isin(*of) & (F.trim(column) != "")
        )
        t = explode_triples(r, F.col("iri"), iri(base + prop, F.col("resolved"))).unionByName(
            explode_triples(r, F.col("resolved"), iri(RDF + "type", F.lit(OWL + "NamedIndividual")))
        )
        w = r.where("resolved IS NULL").select(F.lit(column).alias("kind"), F.col(column).alias("text")).distinct()
        out, warnings = (t, w) if out is None else (out.unionByName(t), warnings.unionByName(w))
    return out, warnings


def header(spark: SparkSession, ontology: str, title: str, imports: str = "", license: str = "") -> DataFrame:
    one = spark.range(1)
    return explode_triples(
        one,
        F.lit(ontology),
        iri(RDF + "type", F.lit(OWL + "Ontology")),
        literal(DCTERMS + "title", F.lit(title), "en"),
        iri(OWL + "imports", F.lit(imports or None).cast("string")),
        iri(DCTERMS + "license", F.lit(license or None).cast("string")),
    )


def generate(
    entities: DataFrame,
    core: DataFrame,
    base: str = BASE,
    ontology: str = "",
    source: str = "",
    imports: str = "",
    license: str = "",
) -> tuple[DataFrame, DataFrame]:
    """The generated graph of the curated entities (CURATED columns and ord), and the warnings. Unknown types are warned of and left out."""
    run = run_id(entities).select(F.concat(F.lit(f"{base}run_"), "run_id").alias("run"))
    minted = stash(entities.join(mint(entities, core, base), "id").crossJoin(F.broadcast(run)), "minted")
    links, warnings = link_triples(minted.where(F.col("entity_type").isin(*TYPE_MAP)), base)
    graph = header(
        entities.sparkSession,
        ontology or base.rstrip("#/"),
        "generated entities",
        imports,
        license,
    ).unionByName(provenance(entities, base, source)).unionByName(entity_triples(minted, base)).unionByName(links)
    unknown = entities.where(~F.col("entity_type").isin(*TYPE_MAP)).select(
        F.lit("entity_type").alias("kind"),
        F.col("entity_type").alias("text"),
    ).distinct()
    return graph.withColumn("g", F.lit("generated")).dropDuplicates(KEY), warnings.unionByName(unknown)


def merge(*graphs: DataFrame) -> DataFrame:
    """The union as a set, without owl:imports."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.where(F.col("p") != OWL + "imports").dropDuplicates(KEY)


def without(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The graph without the triples of a pattern; null stands for any term."""
    hit = F.lit(True)
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            hit &= F.col(column) == value
    return graph.where(~hit)


def counts(graph: DataFrame) -> DataFrame:
    """Named subjects of each declared kind, and the triples."""
    kind = lambda k: F.count_distinct(F.when((F.col("p") == RDF + "type") & (F.col("o") == OWL + k) & ~F.startswith("s", F.lit("_:")), F.col("s")))
    return graph.agg(
        kind("Class").alias("classes"),
        kind("ObjectProperty").alias("object_properties"),
        kind("DatatypeProperty").alias("datatype_properties"),
        kind("AnnotationProperty").alias("annotation_properties"),
        kind("NamedIndividual").alias("individuals"),
        F.count("*").alias("triples"),
    )


def canonical(graph: DataFrame) -> DataFrame:
    """The graph with its blank nodes named by what surrounds them: each round a node's name becomes a digest of its triples' other
    terms and names, in and out, until a round tells no more nodes apart. Nodes that no number of rounds can tell apart share a name."""
    g = stash(graph.select(*KEY).distinct(), "graph")
    blank = lambda c: F.startswith(c, F.lit("_:"))
    names = g.where(blank("s")).select(F.col("s").alias("n")).union(g.where("o_kind = 'bnode'").select("o")).distinct().withColumn("h", F.lit("_:"))
    names, kinds = stash(names, "names"), 1
    while True:
        s, o = names.select(F.col("n").alias("s"), F.col("h").alias("sh")), names.select(F.col("n").alias("o"), F.col("h").alias("oh"))
        t = g.where(blank("s") | (F.col("o_kind") == "bnode")).join(s, "s", "left").join(o, "o", "left").withColumns(
            {"sn": F.coalesce("sh", "s"), "on": F.coalesce("oh", "o")}
        )
        out = t.where(blank("s")).select(
            F.col("s").alias("n"),
            F.sha2(F.concat_ws("\x01", F.lit("out"), "p", "on", "o_kind", "o_lang", "o_dt"), 256).alias("x"),
        )
        into = t.where("o_kind = 'bnode'").select(F.col("o").alias("n"), F.sha2(F.concat_ws("\x01", F.lit("in"), "p", "sn"), 256).alias("x"))
        seen = out.unionByName(into).groupBy("n").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(names, "n")
        new = stash(seen.select("n", F.concat(F.lit("_:"), F.sha2(F.concat_ws("", F.array("h"), "xs"), 256)).alias("h")), "names")
        forget(names)
        names, found = new, new.select("h").distinct().count()
        if found <= kinds:
            break
        kinds = found
    g = g.join(
        names.select(F.col("n").alias("s"), F.col("h").alias("sh")),
        "s",
        "left",
    ).join(names.select(F.col("n").alias("o"), F.col("h").alias("oh")), "o", "left")
    return g.select(F.coalesce("sh", "s").alias("s"), "p", F.coalesce("oh", "o").alias("o"), "o_kind", "o_lang", "o_dt")


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two graphs are equal but for the names of blank nodes."""
    x, y = stash(canonical(a), "left"), stash(canonical(b), "right")
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()

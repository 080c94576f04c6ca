"""Shape constraints over a triples table, all checked in one aggregate by subject; a result is a row (shape, focus, message)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RDF, RDFS, SKOS


@dataclass
class Property:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    language_in: tuple[str, ...] = ()
    in_values: tuple[str, ...] = ()
    has_value: str | None = None
    message: str = ""


@dataclass
class Shape:
    name: str
    subjects_of: str | None = None
    target_class: str | None = None
    properties: list[Property] = field(default_factory=list)
    #: Alternatives, each a list of properties that have to hold together.
    any_of: list[list[Property]] = field(default_factory=list)
    message: str = ""


def _target(shape: Shape) -> Column:
    """Whether a triple makes its subject a focus node."""
    if shape.subjects_of:
        return F.col("p") == shape.subjects_of
    return (F.col("p") == RDF + "type") & (F.col("o") == shape.target_class)


def targets(graph: DataFrame, shape: Shape) -> DataFrame:
    return graph.where(_target(shape)).select("s").distinct()


def _measures(prop: Property, name: str) -> list[Column]:
    """Of a subject's triples, what the property's tests need."""
    here = F.col("p") == prop.path
    bad = here & ~(
        (F.col("o_kind") == "literal") & F.lower("o_lang").isin([x.lower() for x in prop.language_in])
    ) if prop.language_in else F.lit(False)
    outside = here & ~F.col("o").isin(list(prop.in_values)) if prop.in_values else F.lit(False)
    hit = here & (F.col("o") == F.lit(prop.has_value)) if prop.has_value is not None else F.lit(False)
    return [F.count_if(test).alias(f"{name}_{k}") for k, test in (("n", here), ("languages", bad), ("outside", outside), ("hits", hit))]


def _failures(prop: Property, name: str) -> Column:
    """How many constraints of the property a subject fails; each value of a wrong language or outside the list is one."""
    total = F.lit(0).cast("long")
    if prop.min_count is not None:
        total += (F.col(f"{name}_n") < prop.min_count).cast("long")
    if prop.max_count is not None:
        total += (F.col(f"{name}_n") > prop.max_count).cast("long")
    if prop.language_in:
        total += F.col(f"{name}_languages")
    if prop.in_values:
        total += F.col(f"{name}_outside")
    if prop.has_value is not None:
        total += (F.col(f"{name}_hits") == 0).cast("long")
    return total


def violations(graph: DataFrame, shapes: list[Shape]) -> DataFrame:
    """shape, focus, message: a row for each constraint that a focus node fails. One aggregate by subject of the triples that matter, combined
    before its shuffle, serves all shapes; nothing is joined."""
    columns, results = [], []
    paths = {RDF + "type"} | {s.subjects_of for s in shapes if s.subjects_of}
    for i, shape in enumerate(shapes):
        columns.append(F.max(_target(shape)).alias(f"t{i}"))
        every = [(p, f"s{i}p{j}") for j, p in enumerate(shape.properties)]
        either = [[(p, f"s{i}a{j}b{k}") for k, p in enumerate(group)] for j, group in enumerate(shape.any_of)]
        for prop, name in [*every, *(x for group in either for x in group)]:
            columns += _measures(prop, name)
            paths.add(prop.path)
        result = lambda n, message, shape=shape, i=i: F.struct(F.lit(shape.name).alias("shape"), F.lit(message).alias("message"), F.when(F.col(f"t{i}"), n).otherwise(0).cast("int").alias("k"))
        results += [result(_failures(p, name), p.message) for p, name in every]
        if either:
            none = F.lit(True)
            for group in either:  # who fails every alternative
                failed = F.lit(False)
                for p, name in group:
                    failed |= _failures(p, name) > 0
                none &= failed
            results.append(result(none.cast("long"), shape.message))
    per = graph.where(F.col("p").isin(sorted(paths))).groupBy("s").agg(*columns)
    rows = per.select(F.col("s").alias("focus"), F.explode(F.filter(F.array(*results), lambda r: r["k"] > 0)).alias("r"))
    return rows.select("r.shape", "focus", "r.message", F.explode(F.array_repeat(F.lit(1), F.col("r.k")))).drop("col")


def check(graph: DataFrame, shapes: list[Shape]) -> DataFrame:
    n = violations(graph, shapes).agg(F.count("*").alias("n"))
    return n.select(
        F.lit("shacl").alias("check"),
        F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"),
        F.when(F.col("n") == 0, "conforms").otherwise(F.concat("n", F.lit(" violations"))).alias("detail"),
    )


def completeness_shapes(base: str) -> list[Shape]:
    """What curated entities have to carry: an English label and definition, one legal status, and, unless written by hand, their provenance; obligations a bearer."""
    status = base + "curationStatus"
    return [
        Shape(
            "annotated",
            subjects_of=status,
            properties=[
                Property(RDFS + "label", min_count=1, language_in=("en",), message="an English label is missing"),
                Property(SKOS + "definition", min_count=1, language_in=("en",), message="an English definition is missing"),
                Property(status, min_count=1, max_count=1, in_values=("accepted", "edited", "hand-authored"), message="the status is not one of accepted, edited, hand-authored"),
            ],
        ),
        Shape("traceable", subjects_of=status, any_of=[[Property(status, has_value="hand-authored")], [Property(base + p, min_count=1) for p in ("articleRef", "sourceQuote", "hasLegalSource")]], message="reference, quote or legal source is missing"),
        Shape("obligation", target_class=base + "Obligation", properties=[Property(base + "obligationOf", min_count=1, message="nobody holds the obligation")]),
    ]

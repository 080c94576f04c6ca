"""python -m normgraph.cli [review | status | export]: curation from a terminal; review if no command is given."""

from __future__ import annotations

import argparse
import getpass

from pyspark.sql import SparkSession

from .operators import curate, review
from .schemas import CHUNKS, VERIFIED
from .sources.files import overlay, read_decisions, read_records

DEFAULTS = {"records": "data/verified", "log": "data/curated/decisions", "entities": "data/curated/entities", "chunks": "data/chunks"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="normgraph", description="Review verified records, and curate the entities of the graph.")
    out.add_argument("--config", default="config/pipeline.yaml", help="YAML file whose section curate overlays the paths")
    commands = out.add_subparsers(dest="command")
    one = commands.add_parser("review", help="decide on records, one at a time")
    one.add_argument("--reviewer", default=getpass.getuser())
    one.add_argument("--redo", action="store_true", help="also records that have a decision")
    one.add_argument("--verdict", action="append", help="only records of this verdict: supported, partially, unsupported or none; may be given again")
    commands.add_parser("status", help="progress, and decisions by verdict")
    commands.add_parser("export", help="write the curated entities anew from the whole log")
    return out


def main(args: list[str] | None = None, ask=input, show=print, spark: SparkSession | None = None) -> None:
    chosen = parser().parse_args(args)
    if chosen.command is None:
        chosen = parser().parse_args([*(args or []), "review"])
    paths = overlay(DEFAULTS, chosen.config, "curate")
    spark = spark or SparkSession.builder.appName("normgraph").getOrCreate()
    records = curate.keyed(read_records(spark, paths["records"], VERIFIED))
    if chosen.command == "export":
        entities, orphans = curate.build(records, curate.replay(read_decisions(spark, paths["log"])))
        entities.write.mode("overwrite").json(paths["entities"])
        show(f"{entities.count()} entities in {paths['entities']}, {orphans.count()} merges without a target")
        return
    if chosen.command == "review":
        chunks = spark.read.schema(CHUNKS).option("multiLine", True).json(paths["chunks"]).selectExpr("id AS chunk_id", "text")
        made = review.session(records, paths["log"], chosen.reviewer, ask, show, chunks, chosen.redo, chosen.verdict)
        show("This session: " + (", ".join(f"{n} {a}" for a, n in made.items()) or "nothing"))
    state = curate.replay(read_decisions(spark, paths["log"]))
    orphans = curate.build(records, state)[1]
    for table in (curate.status(records, state, orphans), curate.crosstab(records, state).orderBy("verdict")):
        show(" | ".join(table.columns))
        for r in table.collect():  # a row, and a row a verdict
            show(" | ".join(str(x) for x in r))


if __name__ == "__main__":
    main()

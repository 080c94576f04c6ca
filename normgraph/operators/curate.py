"""Review queue, replay of the decision log, and the curated view that it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import record_id
from ..plans.tables import join_sized, sized, stash
from ..schemas import EDITABLE
from ..sources.files import read_decisions

ACTIONS = ("accept", "edit", "reject", "merge")
#: Distinct records to suggest for up to which they are broadcast.
SUGGESTED_AT_ONCE = 10_000


def keyed(records: DataFrame) -> DataFrame:
    """Records by id; of several with one id the last holds, at the place (`ord`) of the first."""
    refs = F.when(F.size("article_refs") > 0, F.col("article_refs")).otherwise(F.array("article_ref"))
    ids = records.withColumn("id", record_id(*(F.col(c) for c in ("term", "entity_type", "definition", "bearer", "applies_to")), refs))
    found = ids.groupBy("id").agg(F.max_by(F.struct(*records.columns), "seq").alias("r"), F.min("seq").alias("ord"))
    return found.select("id", "r.*", "ord")


def priority(verdict: Column, sources: Column) -> Column:
    """0 not judged somewhere, 1 unsupported somewhere, 2 verdicts differ, 3 partially supported, 4 supported."""
    all_of = F.array_distinct(
        F.array_append(F.coalesce(F.transform(sources, lambda s: s["critic_verdict"]), F.array().cast("array<string>")), verdict)
    )
    none = F.exists(all_of, lambda v: v.isNull())
    return F.when(none, 0).when(F.array_contains(all_of, "unsupported"), 1).when(F.size(all_of) > 1, 2).when(verdict == "partially", 3).otherwise(4)


def queue(records: DataFrame, state: DataFrame, verdict: str | None = None) -> DataFrame:
    """Undecided records, most urgent first; verdict picks one, "none" those without."""
    left = records.join(state.select("id"), "id", "left_anti").withColumn("priority", priority(F.col("critic_verdict"), F.col("sources")))
    if verdict is not None:
        left = left.where(F.col("critic_verdict").isNull() if verdict == "none" else F.col("critic_verdict") == verdict)
    return left.orderBy("priority", "ord")


def replay(decisions: DataFrame, key: str = "id", seq: str = "seq", action: str = "action") -> DataFrame:
    """The decision that holds for each id: the last, and none if that is an undo. `ord` is the place of the first one since the last undo: an
    overwritten decision keeps its place, one made after an undo goes to the end. Aggregates only, combined before the shuffle."""
    undo = F.col(action) == "undo"
    last = decisions.groupBy(key).agg(
        F.max_by(F.struct(*decisions.columns), seq).alias("d"),
        F.coalesce(F.max(F.when(undo, F.col(seq))), F.lit(-1)).alias("_undone"),
    )
    last = last.where(F.col(f"d.{action}") != "undo")
    since = decisions.join(last.select(key, "_undone"), key).where(F.col(seq) > F.col("_undone")).groupBy(key).agg(F.min(seq).alias("ord"))
    return last.select("d.*").join(since, key)


def resolve_merges(state: DataFrame) -> DataFrame:
    """id, final of each merged id: the end of its chain of merge targets, null if that loops. By pointer jumping: a round for each doubling of the
    longest chain; a chain that has not ended after as many doublings as there are ids is a loop."""
    links = stash(state.where("action = 'merge'").select("id", F.col("target").alias("to")), "chains")
    n = links.count()
    rounds, done = 0, n == 0
    while not done:
        far = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        links = stash(
            links.join(far, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")),
            "chains",
        )
        rounds += 1
        done = not links.where("moved").limit(1).count() or 1 << rounds > 2 * n
        links = links.select("id", "to")
    still = links.select(F.col("id").alias("to")).withColumn("loops", F.lit(True))
    return links.join(still, "to", "left").select("id", F.when(F.col("loops").isNull(), F.col("to")).alias("final"))


def build(records: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated entities, and the merged ids that have no entity to go to. records: of keyed(); state: of replay()."""
    decided = state.select("id", "action", "changes", "reviewer", F.col("timestamp").alias("decided_at"), F.col("ord").alias("place"))
    kept = records.join(decided, "id").where("action IN ('accept', 'edit', 'merge')")
    edited = {
        f: F.when(
            F.coalesce((F.col("action") == "edit") & F.map_contains_key("changes", f), F.lit(False)),
            F.col("changes")[f][1],
        ).otherwise(F.col(f)) for f in EDITABLE
    }
    kept = kept.withColumns(edited)
    refs = F.when(F.size("article_refs") > 0, F.col("article_refs")).otherwise(F.array("article_ref"))
    own = F.struct("article_ref", "chunk_id", "eli_uri", "source_quote")
    sources = F.when(
        F.size("sources") > 0,
        F.transform("sources", lambda s: F.struct(s["article_ref"].alias("article_ref"), s["chunk_id"].alias("chunk_id"), s["eli_uri"].alias("eli_uri"), s["source_quote"].alias("source_quote"))),
    ).otherwise(F.array(own))
    kept = stash(
        kept.withColumns(
            {"article_refs": refs, "sources": sources, "curation_status": F.when(F.col("action") == "edit", "edited").otherwise("accepted")}
        ),
        "decided",
    )
    base = kept.where("action <> 'merge'")
    ends = resolve_merges(state)
    folded = kept.where("action = 'merge'").join(ends, "id")
    into = folded.groupBy("final").agg(F.array_sort(F.collect_list(F.struct("place", "id", "article_refs", "sources"))).alias("m"))
    out = base.join(into, base["id"] == into["final"], "left")
    more = F.coalesce("m", F.array().cast(into.schema["m"].dataType))
    out = out.withColumns(
        {
            "article_refs": F.array_distinct(F.concat("article_refs", F.flatten(F.transform(more, lambda x: x["article_refs"])))),
            "sources": F.concat("sources", F.flatten(F.transform(more, lambda x: x["sources"]))),
            "merged_ids": F.transform(more, lambda x: x["id"]),
        }
    )
    columns = [
        "id",
        "term",
        "entity_type",
        "label",
        "definition",
        "bearer",
        "applies_to",
        "article_refs",
        "sources",
        "confidence",
        "critic_verdict",
        "model",
        "curation_status",
        "reviewer",
        "decided_at",
        "merged_ids",
    ]
    entities = out.orderBy("entity_type", F.lower("term"), "place").select(*columns)
    orphans = folded.join(base.select(F.col("id").alias("final")), "final", "left_anti").select("id")
    return entities, orphans


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, changes (field: [old, new]) and the action they amount to: an edit that changes nothing is an accept."""
    both = old.select("id", F.struct(*EDITABLE).alias("o")).join(new.select("id", F.struct(*EDITABLE).alias("n")), "id")
    pairs = F.array_compact(
        F.array(
            *(
                F.when(
                    ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")),
                    F.struct(F.lit(f).alias("k"), F.array(f"o.{f}", f"n.{f}").alias("v")),
                ) for f in EDITABLE
            )
        )
    )
    return both.select("id", F.map_from_entries(pairs).alias("changes")).withColumn(
        "action",
        F.when(F.size("changes") > 0, "edit").otherwise("accept"),
    )


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Adds to the log, a folder of JSON lines. Decisions without seq, a reviewer's session, are numbered on from the log's last, in their order."""
    spark = decisions.sparkSession
    if "seq" not in decisions.columns:
        last = read_decisions(spark, path).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
        decisions = decisions.withColumn("seq", F.lit(last) + place)
    decisions.write.mode("append").json(path)


def export(records: DataFrame, decisions: DataFrame, path: str) -> None:
    """The curated view, rebuilt from the whole log."""
    build(records, replay(decisions))[0].write.mode("overwrite").json(path)


def suggestions(records: DataFrame, of: DataFrame, similarity, k: int = 8) -> DataFrame:
    """The k records most alike each row of `of` (id, unique; term, entity_type): same type first, then by similarity(term, term), then by id.

    `of` is the stated query set, a reviewer's records at hand. Terms are compared once for each type and term, on either side: of the records with one
    type and term the least k + 1 ids stand for all, one more than k as a row is not suggested to itself. Where a type has more than k records, no other type's
    can be among the best, so only the rest is held against all. The distinct rows of `of` are broadcast if their counted size allows."""
    most, rank = k + 1, lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("same_type"), F.desc("score"), "id"))
    rows = records.select("id", "term", "entity_type").where("id IS NOT NULL")
    mine = of.select(F.col("id").alias("of_id"), F.col("term").alias("of_term"), F.col("entity_type").alias("of_type"))
    large = rows.groupBy(F.col("entity_type").alias("of_type")).agg(F.count("*").alias("n")).where(F.col("n") > k)
    asked = stash(mine.select("of_term", "of_type").distinct().join(large, "of_type", "left"), "asked")
    least = F.row_number().over(Window.partitionBy("entity_type", "term").orderBy("id"))
    groups = rows.withColumn("nth", least).where(F.col("nth") <= most).groupBy("entity_type", "term").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # a few small groups would be one task's, and their pairs with it
    groups = groups.repartition(2 * records.sparkSession.sparkContext.defaultParallelism)
    own, rest = asked.where("n IS NOT NULL").drop("n"), asked.where("n IS NULL").drop("n")
    pairs = groups.join(sized(own, SUGGESTED_AT_ONCE), F.col("entity_type") == F.col("of_type"))
    if rest.limit(1).count():
        pairs = pairs.unionByName(groups.crossJoin(sized(rest, SUGGESTED_AT_ONCE)))
    scored = pairs.withColumns(
        {"score": similarity(F.lower("of_term"), F.lower("term")), "same_type": F.col("entity_type") == F.col("of_type"), "id": F.col("ids")[0]}
    )
    best = scored.withColumn("place", rank("of_term", "of_type")).where(F.col("place") <= most).withColumn("id", F.explode("ids"))
    best = best.withColumn("place", rank("of_term", "of_type")).where(F.col("place") <= most).drop("ids", "place")
    best = best.withColumnsRenamed({"of_term": "_term", "of_type": "_type"})
    same = F.col("of_term").eqNullSafe(F.col("_term")) & F.col("of_type").eqNullSafe(F.col("_type"))
    return mine.join(best, same).where("id <> of_id").withColumn("rank", rank("of_id")).where(F.col("rank") <= k).select(
        "of_id",
        "rank",
        "id",
        "term",
        "entity_type",
        "score",
    )


def crosstab(records: DataFrame, state: DataFrame) -> DataFrame:
    """Verdicts by action, undecided included. Decisions on records that are gone do not count."""
    both = records.select("id", F.coalesce("critic_verdict", F.lit("none")).alias("verdict")).join(state.select("id", "action"), "id", "left")
    return both.groupBy("verdict").pivot("action", [*ACTIONS]).agg(F.count(F.lit(1))).na.fill(0).join(
        both.groupBy("verdict").agg(F.count_if(F.col("action").isNull()).alias("undecided")),
        "verdict",
    )


def status(records: DataFrame, state: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: decided, remaining, stale (decisions on records that are gone), orphans."""
    both = records.select("id", F.lit(1).alias("r")).join(state.select("id", F.lit(1).alias("d")), "id", "full")
    counts = both.agg(
        F.count_if(F.col("r").isNotNull() & F.col("d").isNotNull()).alias("decided"),
        F.count_if(F.col("d").isNull()).alias("remaining"),
        F.count_if(F.col("r").isNull()).alias("stale"),
    )
    return counts.crossJoin(orphans.agg(F.count("*").alias("orphans")))


def chunks_of(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, place, chunk_id and the columns of chunks (chunk_id, ...), null if there is none: the chunks that each record (id, chunk_id, sources) cites, each once,
    in the order of its sources."""
    cited = F.array_distinct(F.when(F.size("sources") > 0, F.transform("sources", lambda s: s["chunk_id"])).otherwise(F.array("chunk_id")))
    return join_sized(records.select("id", F.posexplode(cited).alias("place", "chunk_id")), chunks, "chunk_id", "left")


def cards(records: DataFrame) -> DataFrame:
    """id, card: a record as a reviewer reads it, its fields and each source with its verdict."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("none")))
    own = F.struct("article_ref", "source_quote", "critic_verdict", "critic_reason")
    kind = "array<struct<article_ref:string,source_quote:string,critic_verdict:string,critic_reason:string>>"
    sources = F.when(
        F.size("sources") > 0,
        F.transform("sources", lambda s: F.struct(s["article_ref"], s["source_quote"], s["critic_verdict"], s["critic_reason"])).cast(kind),
    ).otherwise(F.array(own).cast(kind))
    refs = F.array_join(F.when(F.size("article_refs") > 0, F.col("article_refs")).otherwise(F.array("article_ref")), ", ")
    of = lambda s: F.concat_ws("\n", F.lit(""), F.concat(F.coalesce(s["article_ref"], F.lit("")), F.lit(" - "), F.coalesce(s["critic_verdict"], F.lit("not judged"))), F.concat(F.lit("> "), s["source_quote"]), F.when(s["critic_reason"] != "", F.concat(F.lit("Critic: "), s["critic_reason"])))
    head = F.concat(F.coalesce("term", F.lit("")), F.lit(" ("), "id", F.lit(", "), F.coalesce("critic_verdict", F.lit("not judged")), F.lit(")"))
    fields = [
        line("Type", F.col("entity_type")),
        line("Label", F.col("label")),
        line("Definition", F.col("definition")),
        line("Bearer", F.col("bearer")),
        line("Applies to", F.col("applies_to")),
        line("Confidence", F.format_string("%.2f", "confidence")),
        line("References", refs),
    ]
    return records.select("id", F.concat_ws("\n", head, *fields, F.array_join(F.transform(sources, of), "\n")).alias("card"))


def now() -> Column:
    """UTC to the second, as log entries have it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX")


def reviewer() -> Column:
    return F.current_user()

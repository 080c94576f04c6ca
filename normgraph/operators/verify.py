"""Grounding of records in their chunk, and merging of near-duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio_column, token_sort_ratio
from ..functions.text import clean, matches_reference, normalise
from ..plans.tables import join_sized, sized, stash

GROUNDING_THRESHOLD, MERGE_THRESHOLD = 95.0, 90.0


def with_chunks(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each record with the text, kind and number of its chunk_file's chunk (chunks: file, text, type, number); nulls where there is none.

    Chunks carry whole texts, so however few rows they are, no count has them broadcast by the driver, and no estimate of Spark's: that is of the size of
    files, in which copies of a text take next to no room."""
    side = chunks.select(
        F.col("file").alias("chunk_file"),
        F.col("text").alias("chunk_text"),
        F.col("type").alias("chunk_type"),
        F.col("number").alias("chunk_number"),
    )
    return records.join(side.hint("merge"), "chunk_file", "left")


def ground(records: DataFrame, threshold: float = GROUNDING_THRESHOLD) -> DataFrame:
    """Adds grounded, grounding_method, grounding_score and grounding_reason to rows of with_chunks().

    A quote that is a substring of the normalised chunk is exact and never reaches the fuzzy score: `when` does not keep
    rows from a Python UDF, so such rows go there with nulls, and each text is read and normalised once. An empty or null quote scores 0. A record
    without a chunk text scores 0 and is not grounded.
    """
    known = records.withColumns(
        {"_q": F.coalesce(normalise(F.col("source_quote")), F.lit("")), "_t": F.coalesce(normalise(F.col("chunk_text")), F.lit(""))}
    )
    absent = F.col("chunk_text").isNull()
    exact = (F.col("_q") != "") & ~absent
    known = known.withColumn("_easy", (F.col("_q") == "") | absent | F.contains("_t", "_q"))
    hard = lambda c: F.when(~F.col("_easy"), F.col(c))
    known = known.withColumn("_ratio", F.bround(partial_ratio_column(hard("_q"), hard("_t")), 1))
    both = known.withColumns(
        {
            "grounding_method": F.when(F.col("_easy"), F.when(exact, "exact")).when(F.col("_ratio") >= threshold, "fuzzy"),
            "grounding_score": F.when(F.col("_easy"), F.when(exact, 100.0).otherwise(0.0)).otherwise(F.col("_ratio")),
        }
    )
    at_home = matches_reference(F.col("article_ref"), F.col("chunk_type"), F.col("chunk_number"))
    why = F.nullif(
        F.concat_ws(
            "; ",
            F.when(absent, "chunk not found").when(F.col("grounding_method").isNull(), "quote not found"),
            F.when(~absent & ~at_home, F.concat(F.lit("reference "), F.coalesce("article_ref", F.lit("")), F.lit(" does not match chunk"))),
        ),
        F.lit(""),
    )
    out = both.withColumn("grounding_reason", why).withColumn("grounded", F.col("grounding_reason").isNull())
    return out.drop("_q", "_t", "_easy", "_ratio", "chunk_text", "chunk_type", "chunk_number")


#: Words of a quote by which texts are looked up; quotes too short for that are held against every text.
KEY_WORDS = 4


def _run_keys(words: Column, k: int) -> Column:
    """Hashes of the runs of k words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))


def occurrences(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """item, id: which of the texts (id, unique; text) hold which quotes (item, quote), both normalised; empty quotes are nowhere.

    A quote's words, but for the first and the last, which it may cut, stand in a text as they are. So the longest run of KEY_WORDS of them, or of as many as
    there are, is looked up by its hash among the runs of all texts, and only the pairs found are compared. Quotes of one or two words have no such run: each text is
    scanned for those, which should be few."""
    q = quotes.select("item", normalise(F.col("quote")).alias("q")).where("q <> ''")
    words, run = F.split("q", " "), lambda a, i, k: F.array_join(F.slice(a, i, k), " ")
    q = q.withColumn("k", F.least(F.lit(KEY_WORDS), F.greatest(F.size(words) - 2, F.lit(0))))
    runs = F.transform(F.sequence(F.lit(2), F.size(words) - F.col("k")), lambda i: F.struct(F.length(run(words, i, F.col("k"))).alias("n"), run(words, i, F.col("k")).alias("x")))
    q = stash(q.withColumn("key", F.when(F.col("k") > 0, F.xxhash64(F.array_max(runs)["x"]))), "quotes")
    sizes = [r["k"] for r in q.select("k").distinct().collect()]  # KEY_WORDS + 1 numbers at most
    t = texts.select("id", normalise(F.col("text")).alias("t"))
    out = t.join(sized(q.where("k = 0")), F.contains("t", "q")).select("item", "id") if 0 in sizes else None
    near = None
    for k in sorted(x for x in sizes if x):
        words_of = t.select("id", F.split("t", " ").alias("w")).where(F.size("w") >= k)
        keys = F.array_distinct(_run_keys(F.col("w"), k))
        found = join_sized(
            words_of.select("id", F.explode(keys).alias("key")),
            q.where(F.col("k") == k).select("item", "key"),
            "key",
        ).select("id", "item")
        near = found if near is None else near.unionByName(found)
    if near is not None:
        pairs = join_sized(stash(near, "pairs"), q.select("item", "q"), "item")
        hit = join_sized(texts.select("id", "text"), pairs, "id").where(F.contains(normalise(F.col("text")), F.col("q"))).select("item", "id")
        out = hit if out is None else out.unionByName(hit)
    return texts.sparkSession.createDataFrame([], "item long, id long") if out is None else out


def route(grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with null verdict; written first, so that no model call sees a rejected row."""
    kept = stash(grounded, "grounded")
    rejected = kept.where("NOT grounded").withColumns({"critic_verdict": F.lit(None).cast("string"), "critic_reason": F.lit(None).cast("string")})
    return kept.where("grounded"), rejected


def _letters(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each term has the letters of each of 64 kinds, blanks as token_sort_ratio() leaves them, and its length then."""
    counts, sizes = np.zeros((len(terms), 64), np.int32), np.zeros(len(terms), np.int64)
    for i, t in enumerate(terms):
        points = np.frombuffer(" ".join(t.split()).encode("utf-32-le", "surrogatepass"), "<u4")
        counts[i], sizes[i] = np.bincount(points & 63, minlength=64), len(points)
    return counts, sizes


def leader_groups(records: DataFrame, block: list[str], term: str, order: str, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Adds `leader`, the order value of the group's first record: in order, each record joins the first group of its block whose first
    record's term is alike (token sort ratio of the threshold or more), or opens one.

    Records of one term always join one group, so only a block's distinct terms, at their first places, meet in a task; there a term is compared only with the
    leaders whose letters could make it alike."""
    if threshold == 100:
        # alike is the same tokens then, whatever their order: such records are one group each, and no two terms need be compared
        tokens = F.array_join(F.array_sort(F.split(clean(F.coalesce(F.col(term), F.lit(""))), " ")), " ")
        return records.withColumn("leader", F.min(order).over(Window.partitionBy(*block, tokens)).cast("long"))
    terms = records.groupBy(*block, term).agg(F.min(order).alias("_first"))

    def lead(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_first", ignore_index=True)
        terms = [t or "" for t in part[term]]
        letters, sizes = _letters(terms)
        leaders = np.empty(len(terms), np.int64)  # rows of the leaders so far, in order
        held = np.empty_like(letters)
        n, found = 0, np.empty(len(terms), np.int64)
        for i, t in enumerate(terms):
            # letters in common, in whatever order, bound the similarity from above
            common = np.minimum(held[:n], letters[i]).sum(1)
            some = np.flatnonzero(200 * common >= threshold * (sizes[leaders[:n]] + sizes[i]))
            hit = next((int(leaders[k]) for k in some if token_sort_ratio(terms[leaders[k]], t) >= threshold), None)
            if hit is None:
                leaders[n], held[n] = i, letters[i]
                n, hit = n + 1, i
            found[i] = hit
        return part.assign(leader=part["_first"].to_numpy()[found])[[*block, term, "leader"]]

    schema = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in [*block, term]) + ", leader long"
    groups = terms.groupBy(*block).applyInPandas(lead, schema)
    on = None
    for c in [*block, term]:
        same = records[c].eqNullSafe(groups[c])
        on = same if on is None else on & same
    return records.join(groups, on).select(*(records[c] for c in records.columns), groups["leader"])


def verdict_rank(x: Column) -> Column:
    return F.when(x == "supported", 0).when(x == "partially", 1).when(x == "unsupported", 2).otherwise(3)


def deduplicate(records: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Merges records of one type and bearer with alike terms. The best (verdict, then confidence, then seq) stands for its group and keeps
    its own article_ref; article_refs (distinct) and sources are in the order of seq; merged_count counts the group. Ordered by the first seq."""
    keyed = records.withColumns(
        {"_bearer": F.lower(normalise(F.coalesce("bearer", F.lit("")))), "_term": F.lower(normalise(F.coalesce("term", F.lit(""))))}
    )
    led = leader_groups(keyed, ["entity_type", "_bearer"], "_term", "seq", threshold)
    best = F.min_by(F.struct(*records.columns), F.struct(verdict_rank(F.col("critic_verdict")), -F.col("confidence"), "seq"))
    source = F.struct("seq", F.struct("article_ref", "chunk_id", "eli_uri", "source_quote", "critic_verdict", "critic_reason").alias("source"))
    merged = led.groupBy("entity_type", "_bearer", "leader").agg(
        best.alias("r"),
        F.array_sort(F.collect_list(source)).alias("all"),
        F.count("*").cast("int").alias("merged_count"),
    )
    sources = F.transform("all", lambda x: x["source"])
    return merged.select(
        "r.*",
        F.array_distinct(F.transform(sources, lambda x: x["article_ref"])).alias("article_refs"),
        sources.alias("sources"),
        "merged_count",
        F.col("leader").alias("first_seq"),
    ).orderBy("first_seq")


def verdict_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("critic_verdict").agg(F.count("*").alias("n"))

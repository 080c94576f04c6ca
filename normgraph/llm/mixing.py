"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the mix is the point frac(i * golden ratio), which falls in one source's interval of the cumulative targets; so any
stretch of slots holds the sources in their shares. The r-th slot of a source takes block r of the source's stream: its
documents in a pseudo-random order, laid end to end, cut into blocks of equal words, and read again from the start when used up.
A source's last block is cut to its target, and slots beyond it are left out; blocks that no slot has reached follow at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, read, stash

WEIGHTS, SHARE, EPOCHS, BLOCK = (3, 1, 2), 1.5, 2, 2048
WORD = r"[^\x20\x09-\x0D]+"
_ALL_BEFORE = (Window.unboundedPreceding, 0)
_CHUNK = 1 << 16
RANGE_ROWS = 50_000
_PHI = 0.6180339887498949


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """row (unique), doc_id, source, size in words and the place in the source's pseudo-random order."""
    place = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place.alias("place"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target: weights go to the sources by code point, null last; together the targets are share times
    all words; none is above epochs times its source's size, the excess going to the others by weight.

    Sources in the order of limit / weight: those that reach their limit are the first ones. A row for each source is all that meets in one task.
    """
    hundredths = round(share * 100)
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"),
    )
    s = s.withColumn("ratio", epochs * F.col("source_size") / F.col("weight"))
    # words left, in hundredths, and weight left, from this source on
    left = hundredths * F.sum("source_size").over(Window.partitionBy()) - 100 * epochs * (
        F.sum("source_size").over(by_ratio.rowsBetween(*_ALL_BEFORE)) - F.col("source_size")
    )
    s = s.withColumns({"left": left, "heavy": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("free", 100 * epochs * F.col("source_size") * F.col("heavy") > F.col("left") * F.col("weight"))
    first = F.min_by(
        F.when(F.col("free"), F.struct("left", "heavy")),
        F.when(F.col("free"), F.struct("ratio", F.col("source").isNull(), "source")),
    ).over(Window.partitionBy())
    s = s.withColumn("first", first)
    level = F.col("first.left") * F.col("weight") / (100 * F.col("first.heavy"))
    return s.select("source", "source_size", F.when(F.col("free"), level).otherwise((epochs * F.col("source_size")).cast("double")).alias("target"))


def placed(sizes: DataFrame) -> DataFrame:
    """sizes with `before`: the words of the source before the document in its order. Sums of ranges of the order come first, 4096 or as many as hold
    RANGE_ROWS documents each, so that no task orders a whole source."""
    digits = max(3, math.ceil(math.log(max(sizes.count(), 1) / RANGE_ROWS, 16)))
    part = F.conv(F.substring("place", 1, digits), 16, 10).cast("long")
    s = sizes.withColumn("part", part)
    sums = s.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sums = sums.withColumn(
        "part_before",
        F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(*_ALL_BEFORE)) - F.col("part_size"),
    )
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size", "row").rowsBetween(*_ALL_BEFORE)
    s = s.withColumn("in_part", F.sum("size").over(inside) - F.col("size"))
    sums = sums.select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), "part_before")
    s = s.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("part") == F.col("s_part")))
    return s.withColumn("before", F.col("part_before") + F.col("in_part")).select("row", "doc_id", "source", "size", "before")


def schedule(spark: SparkSession, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, block: the order in which the sources' blocks are read."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    g = goals.where("target >= 1").withColumn("blocks", F.ceil(F.floor("target") / block))
    g = g.withColumn("high", F.sum("target").over(by_name.rowsBetween(*_ALL_BEFORE)) / F.sum("target").over(Window.partitionBy()))
    g = g.withColumns({"low": F.coalesce(F.lag("high").over(by_name), F.lit(0.0)), "last": F.lead("high").over(by_name).isNull()})
    g = stash(g.withColumn("high", F.when(F.col("last"), 2.0).otherwise(F.col("high"))), "goals")
    total, count = g.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    cells = max(1, 4 * count)
    point = F.lit(_PHI) * F.pmod("id", F.lit(1 << 20)) + F.lit((_PHI * (1 << 20)) % 1) * F.shiftright("id", 20)
    slots = spark.range(total).withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * cells))
    spread = g.withColumn(
        "cell",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))),
    )
    dealt = slots.join(spread, "cell").where("point >= low AND point < high").select(F.col("id").alias("slot"), "source", "blocks")
    # ranks of each source's slots, by counts of stretches of slots
    dealt = dealt.withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select(
        F.col("source").alias("c_source"),
        F.col("chunk").alias("c_chunk"),
        (F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(*_ALL_BEFORE)) - F.col("n")).alias("earlier"),
    )
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(
        counts,
        F.col("source").eqNullSafe(F.col("c_source")) & (F.col("chunk") == F.col("c_chunk")),
    )
    ranked = ranked.withColumn("block", F.col("earlier") + F.col("nth"))
    reached = dealt.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("r_source"), "n")
    short = g.join(reached, F.col("source").eqNullSafe(F.col("r_source")), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    short = short.select("source", F.explode(F.sequence(F.col("n"), F.col("blocks") - 1)).alias("block"))
    # few: of each source, what the points' discrepancy leaves
    late = short.withColumn("slot", F.lit(total) + F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last(), "block")) - 1)
    return ranked.where("block < blocks").select("slot", "source", "block").unionByName(late.select("slot", "source", "block"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    block: int = BLOCK,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source; more columns are ignored): the sizes with their targets, the pieces, and the slots.

    Pieces: slot, source, block, row, doc_id, epoch (0 for the first reading) and the words [from_word, to_word) that the
    slot takes of the document. Sorted by slot, epoch and place they are the mix. A null text has no words and is never taken; a null source is
    a source of its own, rows with one doc_id are documents of their own, an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    sizes = stash(sized(docs, seed), "sizes", narrow=True)
    goals = targets(sizes, weights, share, epochs)
    slots = schedule(spark, goals, block)
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    known = placed(sizes).join(g, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    known = stash(known, "placed")
    forget(sizes)
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    end = F.least(start + F.col("size"), F.floor("target"))
    p = known.where("size > 0").withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(epochs)))))
    p = p.withColumns({"start": start, "end": end}).where("start < end")
    p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    at = F.col("block") * block
    p = p.withColumns({"from_word": F.greatest(at, F.col("start")) - F.col("start"), "to_word": F.least(at + block, F.col("end")) - F.col("start")})
    named = slots.select("slot", F.col("source").alias("s_source"), F.col("block").alias("s_block"))
    pieces = p.join(named, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    return known, pieces.select("slot", "source", "block", "row", "doc_id", "epoch", "from_word", "to_word", "start"), slots


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """row, doc_id, size, source_size, target, taken of each document."""
    known, pieces, _ = mix(docs, **options)
    sums = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return known.join(sums, "row", "left").select(
        "row",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, a row for each reading of a document that the mix takes; a reading that stops early keeps its words
    up to there, joined by blanks, and n_chars (if docs has it) follows."""
    _, pieces, _ = mix(docs, **options)
    reads = pieces.groupBy("row", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).cast("int").alias("taken"))
    out = docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("row")).join(reads, "row")
    # epochs of a document are read in order, so only the last one can be cut, at its end
    words = F.filter(F.split("d.text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = F.when(
        F.col("taken") < F.regexp_count("d.text", F.lit(WORD)),
        F.array_join(F.slice(words, 1, F.col("taken")), " "),
    ).otherwise(F.col("d.text"))
    out = out.withColumn("cut", cut)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return out.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("d")[c].alias(c) for c in docs.columns))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(read(spark, sf_dir, "documents")).drop("row")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(150 * sum(source_size) OVER () - 200 * (sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size) AS BIGINT) AS remaining,
      CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS heavy,
      row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth FROM r),
f AS (SELECT *, 200 * source_size * heavy > remaining * weight AS is_free FROM l),
c AS (SELECT remaining, heavy FROM f WHERE is_free ORDER BY nth LIMIT 1),
t AS (SELECT f.source, source_size, CASE WHEN is_free THEN CAST(c.remaining * weight AS DOUBLE) / (100 * c.heavy) ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM f LEFT JOIN c ON true),
p AS (SELECT d.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(before + size, floor(target)) - before) + greatest(0, least(source_size + before + size, floor(target)) - source_size - before) AS BIGINT) AS taken
FROM p
"""

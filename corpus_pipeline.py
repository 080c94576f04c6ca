"""From raw documents to packed token sequences: quality rules, one document of each group of near copies, repeated
passages out, sources mixed to their targets, and packing. Each stage's result is written and read again by the next.

Every stage but the last returns the columns of documents. A null text counts as empty: the rules reject it, as they do texts of under 20 words.
Rows are told apart by their place and not by doc_id, so repeated rows and null doc_ids are documents of their own: the join keeps one of equal
or near-equal texts, that of the smallest doc_id (null last), of ties the first row. Repeated passages are judged on the join's result, and what is
left of a text may be empty, which the mix never takes. Very long texts are read whole by every stage. Null sources are a source of their own.
More columns of documents, whatever their names, are carried through to the packing, whose columns are those of packing.pack(). An empty table, or one of
which nothing is kept, gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from normgraph.llm import jaccard_join, mixing, packing, quality_rules, repeats
from normgraph.llm.common import read, stash

#: Bytes of a repeated passage that goes, shorter than op8's: one of over fifty words.
PASSAGE_BYTES = repeats.PASSAGE

#: No SQL expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target are the labelled good ones among them."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest doc_id."""
    return jaccard_join.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_BYTES or more that occur more than once."""
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document that the mix takes."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", good), ("ngram_jaccard_join", distinct), ("suffix_dedup", unrepeated), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

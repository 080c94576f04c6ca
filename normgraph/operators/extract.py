"""Model calls behind pluggable functions, with a response cache, schema checks and fault isolation.

An extractor takes (chunk_id, text) and returns a list of dicts; a critic takes (text, record) and returns a dict. The defaults are rule-based and
deterministic: they stand in where no model is at hand."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..plans.tables import stash
from ..schemas import ENTITY_TYPES, VERDICTS
from ..sources.files import cache_hits, cache_misses

ENTITY = "term string, entity_type string, label string, definition string, article_ref string, source_quote string, bearer string, applies_to string, confidence double"
_FIELDS = [x.split()[0] for x in ENTITY.split(", ")]
Extractor = Callable[[str, str], list[dict]]
Critic = Callable[[str, dict], dict]


def rule_extractor(chunk_id: str, text: str) -> list[dict]:
    """An obligation for each line "[ref] ... shall ..."."""
    out = []
    for ref, body in re.findall(r"^\s*\[([^\]]+)\] (.+)$", text or "", re.M):
        if m := re.search(r"\b(\w+(?: \w+)?) shall (\w+(?: \w+){0,5})", body):
            quote = body[m.start() : m.end()]
            home = ref if ref.startswith("Annex") else f"Art. {ref}"
            out.append(
                {
                    "term": m[2],
                    "entity_type": "Obligation",
                    "label": m[2],
                    "definition": body,
                    "article_ref": home,
                    "source_quote": quote,
                    "bearer": m[1],
                    "applies_to": None,
                    "confidence": 0.9,
                }
            )
    return out


def rule_critic(text: str, record: dict) -> dict:
    """Supported if the chunk holds the quote, partially if it holds the term, else unsupported."""
    if (record.get("source_quote") or "\0") in text:
        return {"verdict": "supported", "reason": "the quote is there"}
    if (record.get("term") or "\0").lower() in text.lower():
        return {"verdict": "partially", "reason": "the term is there"}
    return {"verdict": "unsupported", "reason": "neither quote nor term is there"}


def valid(df: DataFrame) -> DataFrame:
    """Adds `valid`: all required fields are there and the type is one of the closed list."""
    required = [c for c in _FIELDS if c not in ("bearer", "applies_to")]
    test = F.col("entity_type").isin(*ENTITY_TYPES)
    for c in required:
        test &= F.col(c).isNotNull()
    return df.withColumn("valid", F.coalesce(test, F.lit(False)))


def parse_answers(df: DataFrame, column: str = "answer") -> DataFrame:
    """Rows of a model's JSON answers (an array of entities), with `valid`; unreadable JSON gives none."""
    kind = "array<struct<" + ENTITY.replace(" ", ":").replace(",:", ",") + ">>"
    return valid(
        df.select("*", F.explode(F.from_json(column, kind, {"mode": "PERMISSIVE"})).alias("e")).select(*(c for c in df.columns if c != column), "e.*")
    )


def _call(extractor: Extractor):
    """chunk_id, cache_key, ok, error, answer: a failed chunk is a row of its own and stops nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, key, text in zip(batch["chunk_id"], batch["cache_key"], batch["text"], strict=True):
                try:
                    rows.append((chunk, key, True, None, json.dumps(extractor(chunk, text), ensure_ascii=False)))
                except Exception as e:  # the model's failure, whatever it is, belongs to this chunk
                    rows.append((chunk, key, False, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["chunk_id", "cache_key", "ok", "error", "answer"])

    return run


def extract(
    chunks: DataFrame,
    cache: DataFrame | None = None,
    extractor: Extractor = rule_extractor,
    model: str = "rules",
    think: bool = False,
    options: dict | None = None,
    prompt: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with provenance, the answers to add to the cache (cache_key, answer), and counts by chunk (chunk_id, n, error).

    chunks: chunk_id, chunk_file, eli_uri, text (rendered). Cached answers are not asked for again; the rest are asked once and written."""
    keyed = stash(chunks.withColumn("cache_key", cache_key(F.col("text"), model, think, options or {}, prompt)), "keyed")
    ask = keyed if cache is None else cache_misses(keyed, cache)
    fresh = stash(
        ask.select("chunk_id", "cache_key", "text").mapInPandas(
            _call(extractor),
            "chunk_id string, cache_key string, ok boolean, error string, answer string",
        ),
        "answers",
    )
    answers = fresh.select("chunk_id", "ok", "error", "answer")
    if cache is not None:
        answers = answers.unionByName(
            cache_hits(keyed, cache).select("chunk_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), "answer")
        )
    answers = answers.join(keyed.select("chunk_id", "chunk_file", "eli_uri", "cache_key"), "chunk_id")
    records = parse_answers(answers.where("ok").drop("ok", "error")).where("valid").drop("valid").withColumn("model", F.lit(model))
    counts = answers.join(
        records.groupBy("chunk_id").agg(F.count("*").alias("n")),
        "chunk_id",
        "left",
    ).select("chunk_id", F.coalesce("n", F.lit(0)).alias("n"), "error")
    return records, fresh.where("ok").select("cache_key", "answer"), counts


def critique(
    records: DataFrame,
    cache: DataFrame | None = None,
    critic: Critic = rule_critic,
    model: str = "rules",
    think: bool = False,
    options: dict | None = None,
    prompt: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Records (ENTITY columns, seq, text) with critic_verdict and critic_reason, and the answers to add to the cache. A failed call, or a verdict
    outside the closed list, leaves the verdict null and the reason says why. Rows of a chunk are asked one after the other, so a model can reuse the prompt's start."""
    record = F.struct(*_FIELDS)
    keyed = stash(records.withColumn("cache_key", cache_key(F.col("text"), model, think, options or {}, prompt, record)), "keyed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                fields = {k: None if row[k] is None or row[k] != row[k] else row[k] for k in _FIELDS}
                try:
                    got = critic(row["text"], fields)
                    if got.get("verdict") not in VERDICTS:
                        raise ValueError(f"verdict {got.get('verdict')!r}")
                    rows.append((row["cache_key"], got["verdict"], got.get("reason")))
                except Exception as e:  # as above
                    rows.append((row["cache_key"], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["cache_key", "critic_verdict", "critic_reason"])

    ask = keyed if cache is None else cache_misses(keyed, cache)
    ask = ask.dropDuplicates(["cache_key"])
    if "chunk_id" in records.columns:
        ask = ask.repartition("chunk_id").sortWithinPartitions("chunk_id", "seq")
    fresh = stash(
        ask.select("cache_key", "text", *_FIELDS).mapInPandas(run, "cache_key string, critic_verdict string, critic_reason string"),
        "verdicts",
    )
    known = fresh if cache is None else fresh.unionByName(cache.select(fresh.columns))
    return keyed.join(known, "cache_key", "left"), fresh.where("critic_verdict IS NOT NULL")

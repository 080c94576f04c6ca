"""Token counts of sections by offset mapping.

A document is encoded once, whole. Each token's span follows from the byte lengths of the ids before it; the spans are
interval-joined, by binary search as both lists are sorted, to the spans of the document's fields or lines. A token that
crosses a boundary is allocated by a rule: "first" gives it to the section of its first byte, "last" to that of its
last byte, "most" to the one that holds most of its bytes (on a tie the earlier), "split" shares it by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import read, rows

RULES = ("first", "last", "most", "split")


def allocate(n_bytes: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that touch it also touch another. n_bytes: of the tokens, in order;
    bounds: ascending byte offsets, section k is bounds[k] to bounds[k + 1] and together they cover all tokens."""
    k = len(bounds) - 1
    end = np.cumsum(n_bytes)
    start = end - n_bytes
    low = np.searchsorted(bounds, start, "right") - 1
    high = np.searchsorted(bounds, end - 1, "right") - 1
    crossing = np.flatnonzero(low != high)
    touched = np.zeros(k, np.int64)
    shares = [(s, t, min(end[t], bounds[s + 1]) - max(start[t], bounds[s])) for t in crossing for s in range(low[t], high[t] + 1)]
    for s, _, n in shares:
        touched[s] += n > 0
    if rule == "first":
        return np.bincount(low, minlength=k).astype(float), touched
    if rule == "last":
        return np.bincount(high, minlength=k).astype(float), touched
    whole = np.bincount(np.delete(low, crossing), minlength=k).astype(float)
    best: dict[int, tuple[int, int]] = {}
    for s, t, n in shares:
        if rule == "split":
            whole[s] += n / n_bytes[t]
        elif n > best.get(t, (0, 0))[0]:
            best[t] = n, s
    for _, s in best.values():
        whole[s] += 1
    return whole, touched


_SCHEMA = "section int, field string, start_char long, n_chars long, n_tokens double, n_crossing long"


def attribute_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    fields: tuple[str, ...] = ("text",),
    by: str = "line",
    rule: str = "first",
    separator: str = "\n\n",
    vocabulary: str | None = None,
) -> DataFrame:
    """A row for each section: key, section (from 0), field, start_char and n_chars in the document, n_tokens, n_crossing.

    The document is the fields, joined by separator. by "field" makes each field a section, "line" each line of each field;
    a line break and a separator belong to the section before them, so the sections' tokens add up to the document's.
    A null field is empty. An empty field is one section of no token; so every row of docs gives one section at least. Rows with
    the same key each give their own sections. An empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES or by not in ("line", "field"):
        raise ValueError(f"rule is one of {RULES}, by is line or field")
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        keys: list = []
        parts: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) if c else np.empty(0) for c in (list(x) for x in zip(*parts, strict=True))] if parts else [np.empty(0)] * 6
            section, field, start, chars, tokens, crossing = columns
            names = pa.array([fields[int(i)] for i in field], pa.string())
            out = [
                pa.array(keys, arrow_kind),
                pa.array(section.astype(np.int32)),
                names,
                pa.array(start.astype(np.int64)),
                pa.array(chars.astype(np.int64)),
                pa.array(tokens.astype(float)),
                pa.array(crossing.astype(np.int64)),
            ]
            keys.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(out, names=[key, "section", "field", "start_char", "n_chars", "n_tokens", "n_crossing"])

        arrow_kind = None
        for batch in batches:
            arrow_kind = batch.schema.field(key).type
            for name, *texts in rows([batch], key, *fields):
                texts = [(x or "") + (separator if i < len(fields) - 1 else "") for i, x in enumerate(texts)]
                whole = "".join(texts)
                data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
                cuts, owner, at = [0], [], 0
                for i, x in enumerate(texts):
                    size = len(x.encode("utf-8", "surrogatepass"))
                    if by == "line":
                        inner = np.flatnonzero(data[at : at + size - (len(separator) if i < len(fields) - 1 else 0)] == 10) + 1 + at
                        cuts += [c for c in inner.tolist() if c < at + size]
                    at += size
                    cuts.append(at)
                    owner += [i] * (len(cuts) - 1 - len(owner))
                bounds = np.array(cuts, np.int64)
                position = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                k = len(bounds) - 1
                if len(data):
                    tokens, crossing = allocate(bpe.n_bytes[bpe.encode(whole)], bounds, rule)
                else:
                    tokens, crossing = np.zeros(k), np.zeros(k, np.int64)
                keys.extend([name] * k)
                parts.append((np.arange(k), np.array(owner), position[:-1], np.diff(position), tokens, crossing))
                if len(keys) >= 8000:
                    yield flush()
            if keys:
                yield flush()

    return docs.select(key, *fields).mapInArrow(run, f"{key} {kind.simpleString()}, {_SCHEMA}")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    out = attribute_tokens(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "section", "start_char", "n_chars", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")

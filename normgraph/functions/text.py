"""Text functions as column expressions; JSON that is hashed byte for byte comes from an Arrow UDF."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic quotes and what they become.
QUOTES = ("‘’‚“”„", "'''\"\"\"")
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean(x: Column) -> Column:
    """Runs of white space, no-break spaces included, become one blank; none at the ends."""
    return F.trim(F.regexp_replace(x, _SPACE, " "))


def normalise(x: Column) -> Column:
    return clean(F.translate(x, *QUOTES))


def camel_case(x: Column) -> Column:
    """ASCII letter and digit runs, the first letter of each in upper case and the rest kept; "Unnamed" if there are none."""
    words = F.filter(F.split(x, "[^0-9A-Za-z]+"), lambda w: w != "")
    return F.coalesce(
        F.nullif(
            F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), ""),
            F.lit(""),
        ),
        F.lit("Unnamed"),
    )


def local_name(iri: Column) -> Column:
    return F.element_at(F.split(iri, "#"), -1)


def shorten(x: Column, limit: int = 46) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 1)), F.lit("…"))).otherwise(x)


def percentage(part: Column, whole: Column) -> Column:
    """One decimal, ties to even; null of nothing."""
    return F.bround(100 * part / F.nullif(whole, F.lit(0)), 1)


def matches_reference(ref: Column, kind: Column, number: Column) -> Column:
    """Whether a reference such as "Art. 5(1)" names the article or annex of that number: the number ends there or a "(" follows."""
    head = F.concat(F.when(kind == "article", "Art. ").otherwise("Annex "), number)
    stripped = F.trim(ref)
    return F.coalesce((stripped == head) | F.startswith(stripped, F.concat(head, F.lit("("))), F.lit(False))


@F.pandas_udf(StringType())
def _record_key(fields: pd.DataFrame) -> pd.Series:
    def one(row: dict) -> str:
        values = {k: None if v is None or v != v else v for k, v in row.items() if k != "article_refs"}
        return json.dumps(values | {"article_refs": sorted(row["article_refs"])}, ensure_ascii=False, sort_keys=True)

    return pd.Series([one(r) for r in fields.to_dict("records")], dtype=object)


def record_id(term: Column, entity_type: Column, definition: Column, bearer: Column, applies_to: Column, article_refs: Column) -> Column:
    """12 hex digits that depend on what a reviewer judges, and not on label or provenance."""
    fields = F.struct(
        term.alias("term"),
        entity_type.alias("entity_type"),
        definition.alias("definition"),
        bearer.alias("bearer"),
        applies_to.alias("applies_to"),
        article_refs.alias("article_refs"),
    )
    return F.substring(F.sha2(_record_key(fields), 256), 1, 12)


def cache_key(text: Column, model: str, think: bool, options: dict, prompt: str, record: Column | None = None) -> Column:
    """Digest of all that decides a model's answer: its settings, the prompt, the text and, for the critic, the record's fields."""

    @F.pandas_udf(StringType())
    def key(texts: pd.Series, records: pd.Series) -> pd.Series:
        def one(t: str, r: str | None) -> str:
            parts = [model, think, options, prompt, t] + ([json.loads(r)] if r is not None else [])
            return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

        return pd.Series([one(t, r) for t, r in zip(texts, records, strict=True)], dtype=object)

    # to_json drops nulls unless told not to
    return key(text, F.lit(None).cast("string") if record is None else F.to_json(record, {"ignoreNullFields": "false"}))

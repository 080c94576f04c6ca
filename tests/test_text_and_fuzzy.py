import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normgraph.functions import fuzzy
from normgraph.functions.text import cache_key, camel_case, clean, local_name, matches_reference, normalise, percentage, record_id, shorten


def _one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_white_space_and_quotes(spark):
    assert _one(spark, clean(F.col("a")), a=" a  b\n\tc\x1c ") == "a b c"
    assert _one(spark, normalise(F.col("a")), a="‘a’ “b” „c‚") == "'a' \"b\" \"c'"


def test_camel_case_keeps_inner_capitals(spark):
    cases = {"high-risk AI system": "HighRiskAISystem", "ai office": "AiOffice", "...": "Unnamed", "": "Unnamed", "x9 y": "X9Y"}
    for term, name in cases.items():
        assert _one(spark, camel_case(F.col("a")), a=term) == name


def test_labels(spark):
    assert _one(spark, local_name(F.col("a")), a="https://x.org/#Name") == "Name"
    assert _one(spark, shorten(F.col("a")), a="a" * 46) == "a" * 46
    assert _one(spark, shorten(F.col("a")), a="b" * 44 + " cc") == "b" * 44 + "…"


def test_percentage_rounds_ties_to_even(spark):
    assert _one(spark, percentage(F.col("a"), F.col("b")), a=1, b=4) == 25.0
    assert _one(spark, percentage(F.col("a"), F.col("b")), a=1, b=400) == 0.2
    assert _one(spark, percentage(F.col("a"), F.col("b")), a=0, b=0) is None


def test_a_reference_belongs_to_its_chunk(spark):
    cases = [
        ("Art. 5(1)", "article", "5", True),
        ("Art. 50(1)", "article", "5", False),
        ("Art. 5", "article", "5", True),
        ("Annex III(3)", "annex", "III", True),
        ("Annex II(3)", "annex", "III", False),
        ("Annex III", "annex", "II", False),
    ]
    for ref, kind, number, hit in cases:
        assert _one(spark, matches_reference(F.col("r"), F.col("k"), F.col("n")), r=ref, k=kind, n=number) is hit


def test_ids_are_digests_of_sorted_json(spark):
    row = spark.createDataFrame(
        [("té\"rm", "Actor", "d\n\x01", None, None, ["b", "a"])],
        "t string, e string, d string, b string, a string, r array<string>",
    )
    got = row.select(record_id(*(F.col(c) for c in "tedbar")).alias("x")).first()["x"]
    text = json.dumps(
        {"term": "té\"rm", "entity_type": "Actor", "definition": "d\n\x01", "bearer": None, "applies_to": None, "article_refs": ["a", "b"]},
        ensure_ascii=False,
        sort_keys=True,
    )
    assert got == hashlib.sha256(text.encode()).hexdigest()[:12]
    key = row.select(cache_key(F.col("t"), "m", False, {"b": 1, "a": 2}, "p").alias("x")).first()["x"]
    assert key == hashlib.sha256(json.dumps(["m", False, {"b": 1, "a": 2}, "p", "té\"rm"], ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=18))
def test_similarity_against_the_definition(a, b):
    if a or b:
        assert abs(fuzzy.ratio(a, b) - 200 * _lcs(a, b) / (len(a) + len(b))) < 1e-9
    short, long = sorted((a, b), key=len)
    if short:
        n = len(short)
        windows = [long[max(0, e - n) : e] for e in range(1, len(long) + n)]
        best = max(200 * _lcs(short, w) / (n + len(w)) for w in windows)
        if len(a) == len(b):
            best = max(best, max(200 * _lcs(w, long) / (n + len(w)) for w in (short[max(0, e - n) : e] for e in range(1, 2 * n))))
        assert abs(fuzzy.partial_ratio(a, b) - best) < 1e-9


def test_token_order_does_not_matter():
    assert fuzzy.token_sort_ratio("risk management system", "system risk management") == 100


@settings(max_examples=60, deadline=None)
@given(st.text("abc é", min_size=1, max_size=12), st.text("abcd é", min_size=13, max_size=60))
def test_long_texts_score_as_short_ones(a, b):
    if a not in b:
        assert abs(fuzzy._partial_long(a, b) - fuzzy.partial_ratio(a, b)) < 1e-9

"""Quality by a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on labelled rows; every path from a root to a node is a rule, a conjunction
of bounds. A logistic model with a lasso penalty weighs the rules and drops most. What is left is compiled into one Spark
column expression over the statistics' columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, bounded_sample, first_picked, held_out, labelled, read, rows
from .stats import FEATURES, features

SAMPLE, MODULUS, HELD_OUT, THRESHOLD = 20_000, 4, 2, 0.7
TREES, DEPTH, CUTS, LASSO = 40, 3, 32, 1e-3

#: A bound: feature, whether the value has to be above, and the value.
Bound = tuple[int, bool, float]


@dataclass
class Ensemble:
    rules: list[tuple[Bound, ...]]
    weights: list[float]
    offset: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.offset)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score, over columns named as FEATURES."""
        z = F.lit(float(self.offset))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            bounds = [F.col(FEATURES[f]) > F.lit(v) if above else F.col(FEATURES[f]) <= F.lit(v) for f, above, v in rule]
            whole = bounds[0]
            for b in bounds[1:]:
                whole &= b
            z += F.when(whole, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, v in rule:
        out &= (x[:, f] > v) if above else (x[:, f] <= v)
    return out


def grow(
    x: np.ndarray,
    cuts: list[np.ndarray],
    binned: np.ndarray,
    residual: np.ndarray,
    depth: int,
) -> list[tuple[tuple[Bound, ...], np.ndarray, bool]]:
    """Nodes of a least-squares tree, without its root: the path, the rows, whether it is a leaf."""
    least = max(5, len(x) // 500)

    def split(rows_in: np.ndarray, path: tuple[Bound, ...], left: int) -> list:
        best = (1e-9, 0, 0)
        r = residual[rows_in]
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            b = binned[rows_in, f]
            n = np.cumsum(np.bincount(b, minlength=len(cuts[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(b, r, len(cuts[f]) + 1))[:-1]
            m = len(rows_in) - n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((n >= least) & (m >= least), s**2 / n + (r.sum() - s) ** 2 / m - r.sum() ** 2 / len(r), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = float(gain[k]), f, k
        gain, f, k = best
        if gain <= 1e-9:
            return []
        above = binned[rows_in, f] > k
        out = []
        for side in (False, True):
            part, to = rows_in[above == side], path + ((f, side, float(cuts[f][k])),)
            inner = split(part, to, left - 1) if left > 1 and len(part) >= 2 * least else []
            out += [(to, part, not inner), *inner]
        return out

    return split(np.arange(len(x)), (), depth)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset by accelerated proximal gradient steps."""
    n, k = x.shape
    design = np.hstack([x, np.ones((n, 1), x.dtype)])
    u = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        u = design.T @ (design @ u)
        u /= np.linalg.norm(u) or 1
    step = 4 * n / max(1e-9, float(np.linalg.norm(design @ u) ** 2)) * 0.95
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        g = design.T @ (1 / (1 + np.exp(-np.clip(design @ v, -30, 30))) - y) / n
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_next * (new - w), new, t_next
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO) -> Ensemble:
    """Rules from trees boosted on half of the rows each, weighed by lasso on all."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], base)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, CUTS) / CUTS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    rng, z, rules = np.random.default_rng(11), np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        some = rng.random(len(y)) < 0.5
        part = np.flatnonzero(some)
        if len(part) < 20:
            part = np.arange(len(y))
        for path, inside, leaf in grow(x[part], cuts, binned[part], (y - p)[part], depth):
            key = tuple(sorted(path))
            rules.setdefault(key, None)
            if leaf:
                rows_in = part[inside]
                z[holds(path, x)] += 0.3 * (y - p)[rows_in].sum() / max(1e-6, (p * (1 - p))[rows_in].sum())
        z = np.clip(z, -20, 20)
    names = list(rules)
    if not names:
        return Ensemble([], [], base)
    design = np.stack([holds(r, x) for r in names], 1).astype(np.float32)
    weights, offset = lasso_logistic(design, y, penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble([names[i] for i in used], [float(weights[i]) for i in used], offset)


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the statistics of text."""
    kinds = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(c) for c in keep] + [(f, pa.float64()) for f in FEATURES])
            out = Sink(schema)
            for *kept, text in rows([batch], *keep, "text"):
                out.add(*kept, *features(text))
            yield out.take()

    columns = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + [f"{f} double" for f in FEATURES])
    return docs.select(*keep, "text").mapInArrow(run, columns)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fits on `sample` labelled rows at most, picked by a hash of doc_id and text. A label of 1 or more is good, any other is not."""
    rows_in = bounded_sample(labelled(docs, labels, "quality", MODULUS, HELD_OUT), sample, "doc_id", "text")
    got = first_picked(with_features(rows_in.withColumn("y", (F.col("y") >= 1).cast("int")), "pick", "y"), sample, "y").toArrow()
    x = np.stack([got[f].to_numpy() for f in FEATURES], 1) if len(got) else np.empty((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy().astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text; more columns are ignored).

    The score depends on the text alone; a null text scores as an empty one. Rows whose crc32(doc_id) mod 4 is 2 are held out of
    training; of several labels of a document the largest holds. Without labels, or with one kind only, every document gets
    the labels' smoothed share. An empty table gives no rows."""
    model = train(docs, labels, sample)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(MODULUS, HELD_OUT).alias("held_out"), "text")
    out = with_features(base, "doc_id", "held_out").select("doc_id", "held_out", model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

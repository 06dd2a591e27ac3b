"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in tasks. Trees are fitted on a bounded sample of
labelled rows, with features cut into quantile bins, and flattened into arrays; scoring
walks all trees of a batch at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import hash_share, label_fold, lean_batches

#: Rows of labelled documents that the trees are fitted on, at most about.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 80, 4, 64, 0.15, 4.0, 1.0
#: Labelled rows with this remainder are held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SEED = 11

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"$%#*&@^~+=<>\\",
    "bracket": b"()[]{}",
    "dash": b"-_/",
    "quote": b"\"'`",
}
_MEMBERS = np.zeros((len(_CLASSES) + 1, 256))
for _row, _chars in enumerate(_CLASSES.values()):
    _MEMBERS[_row, list(_chars)] = 1
_MEMBERS[-1, 128:] = 1

FEATURES = (
    *(f"share_{name}" for name in _CLASSES),
    "share_high",
    "log_bytes",
    "entropy",
    "log_words",
    "word_length",
    "word_spread",
    "longest_word",
    "distinct_words",
    "repeated_next",
    "top_word",
    "log_lines",
    "line_length",
    "repeated_lines",
    "short_lines",
    "closed_lines",
)


def statistics(text: bytes) -> np.ndarray:
    """The features of one whole UTF-8 text; zeros for an empty one."""
    n = len(text)
    out = np.zeros(len(FEATURES), np.float32)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = len(_MEMBERS)
    out[:classes] = _MEMBERS @ counts / n
    share = counts[counts > 0] / n
    words = text.split()
    rest = [np.log1p(n), -float(share @ np.log2(share)), np.log1p(len(words))]
    if words:
        lengths = np.fromiter(map(len, words), np.float64, len(words))
        tally = Counter(words)
        rest += [
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(tally) / len(words),
            sum(map(eq, words, words[1:])) / len(words),
            tally.most_common(1)[0][1] / len(words),
        ]
    else:
        rest += [0.0] * 6
    lines = [x for x in text.split(b"\n") if x]
    if lines:
        sizes = np.fromiter(map(len, lines), np.float64, len(lines))
        closed = sum(x[-1] in b".!?:\"" for x in lines)
        rest += [
            np.log1p(len(lines)),
            np.log1p(sizes.mean()),
            1 - len(set(lines)) / len(lines),
            float((sizes < 30).mean()),
            closed / len(lines),
        ]
    else:
        rest += [0.0] * 5
    out[classes:] = rest
    return out


def statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.to_pylist()], np.float32).reshape(
        -1, len(FEATURES)
    )


@dataclass
class Forest:
    """Complete trees as arrays: inner nodes by level, then leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # go right above it
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return total
        inner = self.feature.shape[1]
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        while at[0, 0] < inner:
            right = x[rows, self.feature[trees, at]] > self.limit[trees, at]
            at = 2 * at + 1 + right
        return total + self.leaf[trees, at - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    rate: float = RATE,
) -> Forest:
    """Logistic boosting on binned features; a constant where the labels have one value."""
    inner = 2**depth - 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    empty = Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return empty
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
    margin = np.full(n, base)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = (at - first) * bins
            gain = np.zeros((nodes, width, bins))
            for f in range(width):
                cell = place + binned[:, f]
                g = np.bincount(cell, grad, nodes * bins).reshape(nodes, bins).cumsum(1)
                h = np.bincount(cell, hess, nodes * bins).reshape(nodes, bins).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                won = (
                    g**2 / (h + SHRINK)
                    + (all_g - g) ** 2 / (all_h - h + SHRINK)
                    - all_g**2 / (all_h + SHRINK)
                )
                allowed = (h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT)
                allowed[:, len(edges[f]) :] = False
                gain[:, f] = np.where(allowed, won, 0.0)
            for node in range(nodes):
                f, b = np.unravel_index(int(gain[node].argmax()), gain[node].shape)
                if gain[node, f, b] > 1e-9:
                    feature[first + node], limit[first + node] = f, edges[f][b]
            right = x[np.arange(n), feature[at]] > limit[at]
            at = 2 * at + 1 + right
        leaf_at = at - inner
        g = np.bincount(leaf_at, grad, inner + 1)
        h = np.bincount(leaf_at, hess, inner + 1)
        leaf = -rate * g / (h + SHRINK)
        margin += leaf[leaf_at]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Forest(base, np.array(features), np.array(limits), np.array(leaves))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    rows: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents outside of the held-out fold.

    Rows are chosen by a hash of the id, so none is preferred. A document with conflicting
    labels counts with their mean, rounded.
    """
    usable = labels.where(label_fold(doc_id, folds) != held_out).where(f"{label} is not null")
    n = usable.count()
    chosen = (
        usable.where(hash_share(doc_id, SEED, rows / max(1, n)))
        .groupBy(F.col(doc_id).alias("labelled_id"))
        .agg(F.round(F.avg(label)).cast("int").alias("label"))
    )
    # About ``rows`` ids: a bounded side.
    return docs.select(F.col(doc_id).alias("labelled_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "labelled_id"
    ).select("text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Trees fitted on a bounded sample of the labelled rows that are not held out."""
    lean_batches(docs.sparkSession)

    def measure(batches):
        for batch in batches:
            x = statistics_of(batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], ["x", "y"]
            )

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, fit_rows)
    found = sample.select(F.col("text").cast("binary"), "label").mapInArrow(
        measure, "x array<float>, y int"
    )
    rows = found.toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    y = np.array(rows.column("y").to_pylist(), np.float64)
    # Tasks end in any order; the fit must not depend on it.
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)
    return fit_forest(x[order].astype(np.float64), y[order])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    fit_rows: int = FIT_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of each row of ``docs``.

    The score is the chance of label 1. Null and empty texts are scored like a text whose
    statistics are all zero. A null id is not held out; repeated rows give repeated rows.
    Without labels, or with one value of them, all scores are that of the label share.
    """
    forest = fit_quality(docs, labels, fit_rows)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(statistics_of(texts).astype(np.float64)), pa.float64())

    scored = docs.select(
        F.col(doc_id),
        F.coalesce(label_fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score(F.col(text).cast("binary")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

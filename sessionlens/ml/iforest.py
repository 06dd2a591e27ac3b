"""Isolation forest: trees from small hashed subsamples, scored where the rows are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.expressions import hash_rank
from sessionlens.schema import FEATURE_COLUMNS

# Library defaults of the detector, and the settings of its runs.
TREES = 100
SAMPLE_ROWS = 256
CONTAMINATION = 0.2
SEED = 53

_EULER = 0.5772156649015329
_NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, length double"
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + _EULER) - 2.0 * (m - 1.0) / m, out)


def _grow(sample: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Node rows (node, feature, threshold, left, right, length) of one tree."""
    nodes: list[tuple] = [()]
    todo = [(0, sample, 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            length = depth + float(average_path(len(rows)))
            nodes[node] = (node, -1, 0.0, -1, -1, length)
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (node, feature, threshold, left, right, 0.0)
        todo.append((left, rows[goes_left], depth + 1))
        todo.append((right, rows[~goes_left], depth + 1))
    return nodes


def subsamples(
    rows: DataFrame, key: str, columns: list[str], trees: int, sample_rows: int, seed: int
) -> DataFrame:
    """``sample_rows`` rows for every tree, at most trees * sample_rows in total.

    One rule for every size: a filter on the key's hash leaves a pool of about as many
    rows as the trees want together, or all rows of a smaller table, and every tree
    draws from the pool by a hash of its own. Nothing is sorted over the table.
    """
    want = trees * sample_rows
    # The pool's size varies by about the root of it; it must not fall short of a sample.
    share = min(1.0, (want + 8 * want**0.5) / max(1, rows.count()))
    pool = rows.select(
        hash_rank(F.col(key), seed).alias("_rank"), *[F.col(c).cast("double") for c in columns]
    ).where(F.col("_rank") <= F.lit(int(share * (1 << 60))))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = W.partitionBy("tree").orderBy(F.xxhash64("_rank", "tree", F.lit(seed)), "_rank")
    return (
        drawn.withColumn("_pos", F.row_number().over(order))
        .where(F.col("_pos") <= sample_rows)
        .select("tree", "_pos", *columns)
    )


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: node arrays of all trees, bounded by the parameters."""

    columns: tuple[str, ...]
    nodes: pd.DataFrame
    sample_rows: int

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        key: str = "session_id",
        columns: list[str] = FEATURE_COLUMNS,
        trees: int = TREES,
        sample_rows: int = SAMPLE_ROWS,
        seed: int = SEED,
    ) -> IsolationForest:
        names = list(columns)
        size = min(sample_rows, rows.limit(sample_rows).count())
        limit = int(np.ceil(np.log2(max(size, 2))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            sample = pdf.sort_values("_pos")[names].to_numpy(float)
            rng = np.random.default_rng([seed, tree])
            nodes = _grow(sample, rng, limit)
            out = pd.DataFrame(
                nodes, columns=["node", "feature", "threshold", "left", "right", "length"]
            )
            out.insert(0, "tree", tree)
            return out

        sampled = subsamples(rows, key, names, trees, sample_rows, seed)
        grown = sampled.groupBy("tree").applyInPandas(build, _NODE_SCHEMA).toPandas()
        if grown.empty:
            raise ValueError("cannot fit a forest on no rows")
        nodes = grown.sort_values(["tree", "node"]).reset_index(drop=True)
        return cls(tuple(names), nodes, size)

    def score(self, rows: DataFrame, into: str = "score") -> DataFrame:
        """Add the anomaly score 2^(-mean path / expected path), near 1 = odd."""
        spark = rows.sparkSession
        starts = self.nodes.groupby("tree", sort=True).size().cumsum()
        first = np.concatenate([[0], starts.to_numpy()[:-1]]).astype(np.int64)
        offset = np.repeat(first, np.diff(np.concatenate([[0], starts.to_numpy()])))
        packed = spark.sparkContext.broadcast(
            {
                "first": first,
                "feature": self.nodes["feature"].to_numpy(np.int64),
                "threshold": self.nodes["threshold"].to_numpy(float),
                "left": self.nodes["left"].to_numpy(np.int64) + offset,
                "right": self.nodes["right"].to_numpy(np.int64) + offset,
                "length": self.nodes["length"].to_numpy(float),
            }
        )
        expected = float(average_path(self.sample_rows)) or 1.0

        @F.pandas_udf("double")
        def path_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            t = packed.value
            for batch in batches:
                x = np.column_stack([c.to_numpy(float) for c in batch])
                at = np.arange(len(x))
                total = np.zeros(len(x))
                for root in t["first"]:
                    node = np.full(len(x), root)
                    feature = t["feature"][node]
                    while (feature >= 0).any():
                        inner = feature >= 0
                        value = x[at, np.where(inner, feature, 0)]
                        step = np.where(value <= t["threshold"][node], t["left"][node], t["right"][node])
                        node = np.where(inner, step, node)
                        feature = t["feature"][node]
                    total += t["length"][node]
                yield pd.Series(np.power(2.0, -(total / len(t["first"])) / expected))

        values = [F.col(c).cast("double") for c in self.columns]
        return rows.withColumn(into, path_score(*values))


"""Autoencoder 9-5-2-5-9, trained by weight averaging over partitions.

Each round is one Spark job: every shard runs Adam over its own rows in small
batches, starting from the shared weights, and the results are averaged by rows
seen. Only the weights and optimiser state move: 394 numbers per shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.ml.scaler import StandardScaler
from sessionlens.schema import FEATURE_COLUMNS

#: Parts of the training rows whose weights are averaged; part of the model's definition.
SHARDS = 8
# Layer widths, passes, batch size and optimiser settings.
LAYERS = (9, 5, 2, 5, 9)
EPOCHS = 120
BATCH = 32
LEARNING_RATE, BETA1, BETA2, ADAM_EPSILON = 0.001, 0.9, 0.999, 1e-7


def initial_weights(layers: tuple[int, ...], seed: int) -> np.ndarray:
    """Uniform (Glorot) weights and zero biases as one flat vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(layers, layers[1:]):
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _unpack(flat: np.ndarray, layers: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        out.append((w, flat[at : at + b]))
        at += b
    return out


def _forward(x: np.ndarray, weights: list, output: str) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    acts = [x]
    for i, (w, b) in enumerate(weights):
        z = acts[-1] @ w + b
        if i < len(weights) - 1:
            acts.append(np.maximum(z, 0.0))
        else:
            acts.append(1.0 / (1.0 + np.exp(-z)) if output == "sigmoid" else z)
    return acts


def gradient(flat: np.ndarray, x: np.ndarray, layers: tuple[int, ...], output: str) -> np.ndarray:
    """Gradient of the mean squared reconstruction error of a batch."""
    weights = _unpack(flat, layers)
    acts = _forward(x, weights, output)
    delta = 2.0 * (acts[-1] - x) / x.size
    if output == "sigmoid":
        delta = delta * acts[-1] * (1.0 - acts[-1])
    grads = []
    for i in reversed(range(len(weights))):
        grads = [(acts[i].T @ delta).ravel(), delta.sum(axis=0)] + grads
        if i:
            delta = (delta @ weights[i][0].T) * (acts[i] > 0)
    return np.concatenate(grads)


@dataclass(frozen=True)
class Autoencoder:
    weights: np.ndarray
    scaler: StandardScaler
    layers: tuple[int, ...] = LAYERS
    output: str = "sigmoid"

    @classmethod
    def fit(
        cls,
        rows: DataFrame,
        columns: list[str] = FEATURE_COLUMNS,
        key: str = "session_id",
        epochs: int = EPOCHS,
        shards: int = SHARDS,
        seed: int = 42,
        output: str = "sigmoid",
    ) -> Autoencoder:
        """Train on the given (normal) rows.

        The shards must be equal in every run for equal weights: rows go to a
        shard by key hash and are ordered inside it, so equal ``shards`` give equal
        weights on any cluster. At scale give about one shard per executor core.
        """
        scaler = StandardScaler.fit(rows, columns)
        layers = (len(columns), *LAYERS[1:-1], len(columns))
        shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
        vectors = (
            rows.select(
                shard.alias("shard"),
                F.xxhash64(key, F.lit(seed)).alias("_order"),
                scaler.vector().alias("x"),
            )
            .repartitionById(shards, F.col("shard"))
            .sortWithinPartitions("_order")
            .select("shard", "x")
            .persist()
        )
        size = len(initial_weights(layers, seed))
        flat = initial_weights(layers, seed)
        moments = np.zeros(2 * size)
        step = 0.0
        try:
            for _ in range(epochs):
                flat, moments, step = _round(vectors, flat, moments, step, layers, output)
        finally:
            vectors.unpersist()
        return cls(flat, scaler, layers, output)

    def reconstruct(self, rows: DataFrame, into: str = "reconstruction") -> DataFrame:
        """Add the scaled row (``scaled``) and its reconstruction, as arrays."""
        flat, layers, output = self.weights, self.layers, self.output

        @F.pandas_udf("array<double>")
        def rebuild(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights = _unpack(flat, layers)
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(batch.to_numpy())
                yield pd.Series(list(_forward(x, weights, output)[-1]))

        scaled = rows.withColumn("scaled", self.scaler.vector())
        return scaled.withColumn(into, rebuild("scaled"))


def _round(vectors: DataFrame, flat, moments, step, layers, output):
    """One pass of every shard over its rows, then the row-weighted average.

    One state per shard reaches the driver, in shard order for equal sums every run.
    """
    size = len(flat)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m, v = flat.copy(), moments[:size].copy(), moments[size:].copy()
        t, seen, shard = step, 0, -1
        left = np.empty((0, layers[0]))

        def update(x: np.ndarray) -> None:
            nonlocal w, m, v, t
            g = gradient(w, x, layers, output)
            t += 1
            m = BETA1 * m + (1 - BETA1) * g
            v = BETA2 * v + (1 - BETA2) * g * g
            w = w - LEARNING_RATE * (m / (1 - BETA1**t)) / (
                np.sqrt(v / (1 - BETA2**t)) + ADAM_EPSILON
            )

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.concatenate([left, np.stack(pdf["x"].to_numpy())])
            seen, shard = seen + len(pdf), int(pdf["shard"].iloc[0])
            full = len(x) - len(x) % BATCH
            for at in range(0, full, BATCH):
                update(x[at : at + BATCH])
            left = x[full:]
        if len(left):
            update(left)
        if seen:
            state = np.concatenate([w, m, v, [t]])
            yield pd.DataFrame({"shard": [shard], "rows": [float(seen)], "state": [state]})

    trained = vectors.mapInPandas(train, "shard int, rows double, state array<double>")
    shards = trained.toPandas().sort_values("shard")
    states = np.stack(shards["state"].to_numpy())
    merged = np.average(states, axis=0, weights=shards["rows"].to_numpy())
    return merged[:size], merged[size : 3 * size], float(merged[-1])

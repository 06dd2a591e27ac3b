"""Toxicity by class-conditional Kneser-Ney models of character sequences.

Two models of order ORDER over the lower-cased characters, each folded to one byte (ASCII
to itself, others to 128 and the code point modulo 128), one of toxic and one of ordinary
texts, share one backoff distribution: the continuation counts of both classes
together. An expression that neither class has seen then says nothing, and a rare one
speaks with the discounted part of its counts only. The log-likelihood difference of a
text per character and its spread, the means over its most toxic words, and the number and
share of words above fixed levels go into a logistic calibration.

Counts are gathered from all labelled rows but those held out and those kept for the
calibration; they are grouped, joined and smoothed as Spark tables. What scoring needs, a
difference for each seen sequence and each seen context, is folded into two hash tables of
fixed size, which is what bounds the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import free_name, hash_share, label_fold, lean_batches, stored

ORDER = 4
#: Characters of the shared backoff distributions, below them a uniform one.
BACKOFF = (3, 2, 1)
#: Numbers of most toxic words whose means are features.
TOPS = (1, 3, 8)
#: Differences of a word that are counted as features, and those whose share is one.
LEVELS, SHARES = (2.0, 3.0, 4.0), (2.0, 3.0)
#: Entries of the tables of sequences and of contexts, as powers of two (24 MB together).
SEQUENCE_BITS, CONTEXT_BITS = 22, 21
#: Labelled rows with this remainder are held out.
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Of the other labelled rows one in CALIBRATE is for the calibration, and this many at
#: most; all others are counted.
CALIBRATE, CALIBRATION_ROWS = 4, 10_000
#: Labelled ids sent to every executor at most (16 bytes each), so that the texts stay
#: where they are; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Sequences counted at a time in a task, and characters scored at a time.
BUFFER, CHUNK = 1 << 22, 1 << 20
SEED = 23
N_FEATURES = 3 + len(TOPS) + len(LEVELS) + len(SHARES)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def sequences(text: bytes) -> np.ndarray:
    """The ORDER bytes up to each byte of a prepared text as one number, latest byte lowest."""
    padded = np.frombuffer(b"\0" * (ORDER - 1) + text, np.uint8).astype(np.uint64)
    n = len(text)
    out = np.zeros(n, np.uint64)
    for back in range(ORDER):
        out |= padded[ORDER - 1 - back : ORDER - 1 - back + n] << np.uint64(8 * back)
    return out


def slot(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = keys * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)


#: ASCII characters other than letters and digits count as blanks.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def prepared(text: str | None) -> bytes:
    """Lower-case words with single blanks around them, one byte for each character."""
    words = (text or "").lower().encode().translate(_WORDS).split()
    if not words:
        return b""
    found = b" ".join([b"", *words, b""])
    if found.isascii():
        return found
    points = np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points, 128 + points % 128).astype(np.uint8).tobytes()


def count_sequences(rows: DataFrame) -> DataFrame:
    """(key, toxic, ordinary): counts of every character sequence of (text, label) rows."""

    def count(batches):
        waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}
        held = 0

        def settled():
            parts = []
            for label, keys in waiting.items():
                if keys:
                    values, n = np.unique(np.concatenate(keys), return_counts=True)
                    zero = np.zeros(len(n), np.int64)
                    parts.append((values.view(np.int64), *((n, zero) if label else (zero, n))))
                    keys.clear()
            return [
                pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(t.astype(np.int64)), pa.array(o.astype(np.int64))],
                    ["key", "toxic", "ordinary"],
                )
                for k, t, o in parts
            ]

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = sequences(prepared(text))
                waiting[label].append(keys)
                held += len(keys)
                if held >= BUFFER:
                    yield from settled()
                    held = 0
        yield from settled()

    found = rows.select("text", "label").mapInArrow(count, "key bigint, toxic bigint, ordinary bigint")
    return found.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _tail(key: str, size: int) -> F.Column:
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _discount(counts: DataFrame, column: str) -> float:
    """n1 / (n1 + 2 n2), kept off the ends."""
    ones, twos = counts.agg(
        F.count(F.when(F.col(column) == 1, 1)), F.count(F.when(F.col(column) == 2, 1))
    ).first()
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def shared_backoff(counts: DataFrame) -> DataFrame:
    """(key, p) of each seen sequence of BACKOFF[0] characters, from both classes together.

    A sequence counts once for each distinct longer sequence that it ends; each level is
    interpolated with the next, the last with a uniform distribution.
    """
    levels, above = [], counts.select("key")
    for size in BACKOFF:
        above = stored(
            above.groupBy(_tail("key", size).alias("key")).agg(F.count("*").alias("n")), f"seen{size}"
        )
        levels.append(above)
    lower = None
    for size, level in reversed(list(zip(BACKOFF, levels))):
        discount = _discount(level, "n")
        context = F.shiftrightunsigned("key", 8)
        totals = level.groupBy(context.alias("context")).agg(
            F.sum("n").alias("all"), F.count("*").alias("kinds")
        )
        rows = level.withColumn("context", context).join(totals, "context")
        if lower is None:
            below = F.lit(1.0 / 256)
        else:
            size_below = BACKOFF[BACKOFF.index(size) + 1]
            rows = rows.withColumn("short", _tail("key", size_below)).join(
                lower.select(F.col("key").alias("short"), F.col("p").alias("below")), "short"
            )
            below = F.col("below")
        p = (F.col("n") - discount + discount * F.col("kinds") * below) / F.col("all")
        lower = rows.select("key", p.alias("p"))
    return lower


@dataclass
class Model:
    sequence: np.ndarray  # log-likelihood difference, nan where not seen
    context: np.ndarray  # the same for an unseen character after a seen context
    weights: np.ndarray

    def differences(self, text: bytes) -> np.ndarray:
        keys = sequences(text)
        found = self.sequence[slot(keys, SEQUENCE_BITS)]
        unseen = np.flatnonzero(np.isnan(found))
        found[unseen] = self.context[slot(keys[unseen] >> np.uint64(8), CONTEXT_BITS)]
        return found

    def features(self, text: bytes) -> tuple[float, ...]:
        """Mean and spread per character, best words, words above levels, log of the length.

        A word has the sum of its differences, the blank before it included.
        """
        n = len(text)
        if not n:
            return (0.0,) * N_FEATURES
        total, squares, open_word = 0.0, 0.0, 0.0
        best, words = np.zeros(0), 0
        above = {level: 0 for level in (*LEVELS, *SHARES)}
        for at in range(0, n, CHUNK):
            # The bytes before a chunk give its first sequences their contexts.
            before = min(at, ORDER - 1)
            chunk = text[at - before : at + CHUNK]
            part = self.differences(chunk)[before:].astype(np.float64)
            total += part.sum()
            squares += part @ part
            blanks = np.flatnonzero(np.frombuffer(chunk, np.uint8)[before:] == 32)
            if not len(blanks):
                open_word += part.sum()
                continue
            sums = np.add.reduceat(part, blanks)
            closed = np.concatenate([[open_word + part[: blanks[0]].sum()], sums[:-1]])
            if not at:
                closed = closed[1:]  # a text begins with a blank: no word before it
            open_word = sums[-1]
            words += len(closed)
            for level in above:
                above[level] += int((closed > level).sum())
            best = np.sort(np.concatenate([best, closed]))[-max(TOPS) :]
        mean = total / n
        spread = max(0.0, squares / n - mean * mean) ** 0.5
        return (
            mean,
            spread,
            *(float(best[-k:].sum() / k) for k in TOPS),
            *(float(np.log1p(above[level])) for level in LEVELS),
            *(above[level] / max(1, words) for level in SHARES),
            float(np.log1p(n)),
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(_expanded(x) @ self.weights, -30, 30)))


def _expanded(x: np.ndarray) -> np.ndarray:
    scale = np.array([10.0, 1.0] + [1.0] * len(TOPS + LEVELS) + [10.0] * len(SHARES) + [0.1])
    return np.concatenate([np.ones((len(x), 1)), x * scale], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps with a small ridge, halved while they do harm; none without both labels."""
    if not len(y) or y.min() == y.max():
        return np.zeros(0)
    z = _expanded(x)

    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float((np.logaddexp(0, margin) - y * margin).sum() + ridge / 2 * (w @ w))

    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w
        )
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        now = loss(w)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _folded(rows: DataFrame, bits: int) -> np.ndarray:
    """Rows (key, value, weight) as a table of weighted means, nan where empty."""

    def place(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot(keys, bits).astype(np.int32)), batch.column(1), batch.column(2)],
                ["at", "value", "weight"],
            )

    placed = rows.select("key", F.col("value") * F.col("weight"), F.col("weight").cast("double")).mapInArrow(
        place, "at int, value double, weight double"
    )
    means = placed.groupBy("at").agg((F.sum("value") / F.sum("weight")).cast("float").alias("value")).toArrow()
    out = np.full(1 << bits, np.nan, np.float32)
    out[means.column("at").to_numpy()] = means.column("value").to_numpy()
    return out


def fit_tables(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Differences by sequence and by context, from the smoothed models of both classes."""
    context = F.shiftrightunsigned("key", 8)
    backoff = shared_backoff(counts)
    totals = counts.groupBy(context.alias("context")).agg(
        *(
            f
            for c in ("toxic", "ordinary")
            for f in (F.sum(c).alias(f"{c}_all"), F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds"))
        )
    )
    discounts = {c: _discount(counts, c) for c in ("toxic", "ordinary")}

    def left(c: str) -> F.Column:
        """Share of the context's mass that goes to the backoff; all where never seen."""
        kept = discounts[c] * F.col(f"{c}_kinds") / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, kept).otherwise(F.lit(1.0))

    def likely(c: str) -> F.Column:
        own = F.greatest(F.col(c) - discounts[c], F.lit(0.0)) / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, own).otherwise(F.lit(0.0)) + left(c) * F.col("p")

    rows = (
        counts.withColumn("context", context)
        .withColumn("short", _tail("key", BACKOFF[0]))
        .join(totals, "context")
        .join(backoff.select(F.col("key").alias("short"), "p"), "short")
    )
    by_sequence = rows.select(
        "key",
        (F.log(likely("toxic")) - F.log(likely("ordinary"))).alias("value"),
        (F.col("toxic") + F.col("ordinary")).alias("weight"),
    )
    by_context = totals.select(
        F.col("context").alias("key"),
        (F.log(left("toxic")) - F.log(left("ordinary"))).alias("value"),
        (F.col("toxic_all") + F.col("ordinary_all")).alias("weight"),
    )
    return _folded(by_sequence, SEQUENCE_BITS), np.nan_to_num(_folded(by_context, CONTEXT_BITS))


def calibration_ids(usable: DataFrame) -> DataFrame:
    """Rows of ``usable`` for the calibration: one in CALIBRATE, CALIBRATION_ROWS at most."""
    # By hash first, so that the one sorted list stays short whatever the number of labels;
    # a fifth more than needed, and never rounded to none.
    share = min(1 / CALIBRATE, max(1.2 * CALIBRATION_ROWS / max(1, usable.count()), 1 / (1 << 20)))
    return (
        usable.where(hash_share("labelled_id", SEED, share))
        .orderBy(F.xxhash64("labelled_id", F.lit(SEED + 1)), "labelled_id")
        .limit(CALIBRATION_ROWS)
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model from all labelled rows that are not held out."""
    lean_batches(docs.sparkSession)
    usable = (
        labels.where(label_fold(doc_id, FOLDS) != HELD_OUT)
        .where("toxic is not null")
        .groupBy(F.col(doc_id).alias("labelled_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = F.broadcast(calibration_ids(usable))
    labelled = docs.select(F.col(doc_id).alias("labelled_id"), F.col(text).alias("text"))
    counted = usable.join(chosen.select("labelled_id"), "labelled_id", "left_anti")
    if counted.count() <= BROADCAST_LABELS:
        counted = F.broadcast(counted)
    counts = stored(count_sequences(labelled.join(counted, "labelled_id")), "counts")
    model = Model(*fit_tables(counts), np.zeros(0))

    # Arrays alone are sent: executors need not have this module.
    spread = docs.sparkSession.sparkContext.broadcast((model.sequence, model.context))

    def measure(batches):
        own = Model(*spread.value, np.zeros(0))
        for batch in batches:
            x = [own.features(prepared(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"]
            )

    rows = (
        labelled.join(chosen, "labelled_id")
        .select("text", "label")
        .mapInArrow(measure, "x array<double>, y int")
        .toArrow()
    )
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)
    y = np.array(rows.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)
    model.weights = fit_logistic(x[order], y[order])
    spread.unpersist()
    return model


def toxicity_column(model: Model, docs: DataFrame, text: str = "text") -> F.Column:
    spread = docs.sparkSession.sparkContext.broadcast((model.sequence, model.context))
    weights = model.weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = Model(*spread.value, weights)
        found = [own.features(prepared(t)) for t in texts.to_pylist()]
        return pa.array(own.score(np.array(found).reshape(-1, N_FEATURES)), pa.float64())

    return score(F.col(text))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) of each row of ``docs``.

    The score is the chance of label 1. Null and empty texts are scored by the calibration
    with no difference at all. A null id is not held out; repeated rows give repeated
    rows. Without both labels all scores are zero.
    """
    model = fit_toxicity(docs, labels, doc_id, text)
    scored = docs.select(
        F.col(doc_id),
        F.coalesce(label_fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        toxicity_column(model, docs, text).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = fit_toxicity(docs, labels, doc_id, text)
    mark = free_name(docs, "toxicity")
    scored = docs.withColumn(mark, toxicity_column(model, docs, text))
    return scored.where(F.col(mark) < threshold).drop(mark)

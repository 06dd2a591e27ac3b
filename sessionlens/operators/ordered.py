"""Per-key ordered scans that do not need a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts every row of a key in one
task. Here each key's time line is cut into slots of ``chunk_seconds``; rows are
scanned per (key, slot), and what must cross a slot border is carried by a
summary with one row per (key, slot). The rows are shuffled once, by (key, slot),
and the summary joins back on that same partitioning.

The summary is scanned in two levels as well: slots within blocks of ``BLOCK_SLOTS``, then
one row per (key, block). So however a key's rows lie, a task sees the rows of one slot, the
slots of one block, or a key's blocks, of which a century has less than thirteen thousand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.functions.expressions import time_bucket

CHUNK, BLOCK = "_chunk", "_block"

#: Slots are narrow, so that a key with 10,000 events a second has 600,000 rows in one.
SLOT_SECONDS = 60.0
BLOCK_SLOTS = 4096


def ordered_scan(
    df: DataFrame,
    key: str,
    ts: str = "timestamp",
    tiebreak: Sequence[str] = ("event_id",),
    chunk_seconds: float = SLOT_SECONDS,
    carry: dict[str, Column] | None = None,
    starts: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Number each key's rows by (ts, tiebreak) and look one row back.

    Adds ``row_number`` (from 1), ``key_rows``, ``prev_<ts>`` and, for every entry
    ``name: expression`` of ``carry``, ``prev_<name>``. Rows need a key and a
    timestamp; validation quarantines the others before this point.

    ``starts`` is a condition over ``ts`` and the ``prev_`` columns that opens a new
    run; it adds ``run`` (from 0) and ``run_row`` (from 1).

    With ``weight`` a row counts as that many, and a number is that of its last one. Only the
    first row of a key may weigh more than one.
    """
    carry = {ts: F.col(ts), **(carry or {})}
    rows = df.withColumn(CHUNK, time_bucket(F.col(ts), chunk_seconds))
    in_chunk = W.partitionBy(key, CHUNK).orderBy(ts, *tiebreak)
    local = rows.withColumns(
        {"_row": _numbered(weight, in_chunk), "_first_row": F.row_number().over(in_chunk) == 1}
        | {f"prev_{n}": F.lag(e).over(in_chunk) for n, e in carry.items()}
    )
    if starts is None:
        chunks = _summary(rows, key, ts, F.struct(F.col(ts), *tiebreak), carry, weight)
    else:
        upto = in_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)
        opens = F.coalesce(starts, F.lit(False)) & ~F.col("_first_row")
        local = local.withColumn("_opens", opens).withColumns(
            {
                "_run": F.sum(F.col("_opens").cast("long")).over(upto),
                "_start": F.max(F.when(F.col("_opens"), F.col("_row"))).over(upto),
            }
        )
        chunks = _summary(
            local,
            key,
            ts,
            F.col("_row"),
            carry,
            weight,
            F.max("_run").alias("_opened"),
            F.max("_start").alias("_last_start"),
        )

    carried = scan_slots(chunks, key, ts, list(carry), starts)
    joined = local.alias("l").join(carried.alias("c"), [key, CHUNK])
    first = F.col("_first_row")
    number = F.col("_before") + F.col("_row")
    out = [
        *[F.col(f"l.{c}").alias(c) for c in df.columns if c != key],
        number.alias("row_number"),
        "key_rows",
        *[
            F.when(first, F.col(f"c.prev_{n}")).otherwise(F.col(f"l.prev_{n}")).alias(f"prev_{n}")
            for n in carry
        ],
    ]
    if starts is not None:
        start = F.coalesce(F.col("_before") + F.col("_start"), F.col("_run_start"))
        out += [
            (F.col("_runs_before") + F.col("_run")).alias("run"),
            (number - start + 1).alias("run_row"),
        ]
    return joined.select(key, *out)


def _numbered(weight: Column | None, order: W) -> Column:
    if weight is None:
        return F.row_number().over(order)
    return F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))


def _summary(
    rows: DataFrame,
    key: str,
    ts: str,
    order: Column,
    carry: dict[str, Column],
    weight: Column | None,
    *extra: Column,
) -> DataFrame:
    """Per (key, slot): size, first time, and the values of the last row."""
    return rows.groupBy(key, CHUNK).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"),
        F.min(ts).alias("_first"),
        *[
            (F.max(ts) if n == ts else F.max_by(e, order)).alias(f"_last_{n}")
            for n, e in carry.items()
        ],
        *extra,
    )


def blocked(slots: DataFrame) -> DataFrame:
    """Add the block of each slot."""
    return slots.withColumn(BLOCK, F.floor(F.col(CHUNK) / F.lit(BLOCK_SLOTS)))


def scan_slots(
    slots: DataFrame, key: str, ts: str, names: Sequence[str], starts: Column | None = None
) -> DataFrame:
    """What every slot needs to know about the slots of its key before it.

    ``slots`` has per (key, slot) the rows ``_n``, the first time ``_first`` and the last
    row's values ``_last_<name>``; with ``starts`` also the runs ``_opened`` inside it and
    the row ``_last_start`` that opened the last one. The result has the rows ``_before``,
    ``key_rows``, ``prev_<name>`` and, with ``starts``, ``_runs_before``, the number of the
    run that the first row belongs to, and ``_run_start``, that run's first row.
    """
    in_block = W.partitionBy(key, BLOCK).orderBy(CHUNK)
    local = _scanned(
        blocked(slots).withColumnRenamed("_first", ts), in_block, names, starts
    )
    # Only what the slots need as well, so that both levels read one exchange.
    totals = [F.sum("_n").alias("_n")]
    totals += [F.max_by(f"_last_{n}", CHUNK).alias(f"_last_{n}") for n in names]
    if starts is not None:
        totals += [
            F.min(ts).alias(ts),
            F.sum(F.col("_opened") + F.col("_border")).alias("_opened"),
            F.max("_latest").alias("_last_start"),
        ]
    blocks = _scanned(
        local.groupBy(key, BLOCK).agg(*totals), W.partitionBy(key).orderBy(BLOCK), names, starts
    ).withColumn("key_rows", F.sum("_n").over(W.partitionBy(key)))
    joined = local.alias("s").join(blocks.alias("b"), [key, BLOCK])
    before = F.col("b._before") + F.col("s._before")
    out = [
        key,
        CHUNK,
        before.alias("_before"),
        "key_rows",
        *[
            F.when(F.col("s._place") == 1, F.col(f"b.prev_{n}"))
            .otherwise(F.col(f"s.prev_{n}"))
            .alias(f"prev_{n}")
            for n in names
        ],
    ]
    if starts is not None:
        since = F.coalesce(F.col("b._before") + F.col("s._since"), F.col("b._since"), F.lit(1))
        out += [
            (F.col("b._runs") + F.col("s._runs")).alias("_runs_before"),
            since.alias("_run_start"),
        ]
    return joined.select(*out)


def _scanned(parts: DataFrame, order: W, names: Sequence[str], starts: Column | None) -> DataFrame:
    """One level of the scan: parts of a key in order, each a slot or a block of slots.

    Positions count from the first row of the window's partition; a border before its first
    part is left to the level above.
    """
    before = order.rowsBetween(W.unboundedPreceding, -1)
    scanned = parts.withColumns(
        {"_place": F.row_number().over(order)}
        | {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}
        | {f"prev_{n}": F.lag(f"_last_{n}").over(order) for n in names}
    )
    if starts is None:
        return scanned
    border = F.coalesce(starts, F.lit(False)) & (F.col("_place") > 1)
    scanned = scanned.withColumn("_border", border.cast("long"))
    at_border = F.when(F.col("_border") == 1, F.col("_before") + 1)
    scanned = scanned.withColumn(
        "_latest", F.coalesce(F.col("_before") + F.col("_last_start"), at_border)
    )
    opened = F.coalesce(F.sum(F.col("_opened") + F.col("_border")).over(before), F.lit(0))
    return scanned.withColumns(
        {
            "_runs": opened + F.col("_border"),
            "_since": F.coalesce(at_border, F.max("_latest").over(before)),
        }
    )


def last_before(slots: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """(key, slot, ``into``): the newest ``value`` that is not null in the slots before."""
    rows = (W.unboundedPreceding, -1)
    in_block = W.partitionBy(key, BLOCK).orderBy(CHUNK).rowsBetween(*rows)
    local = blocked(slots).withColumn("_near", F.last(value, ignorenulls=True).over(in_block))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(CHUNK)))
    blocks = local.groupBy(key, BLOCK).agg(newest.alias("_newest_of_block"))
    upto = W.partitionBy(key).orderBy(BLOCK).rowsBetween(*rows)
    far = blocks.select(
        key, BLOCK, F.last("_newest_of_block", ignorenulls=True).over(upto).alias("_far")
    )
    return local.join(far, [key, BLOCK]).select(
        key, CHUNK, F.coalesce("_near", "_far").alias(into)
    )

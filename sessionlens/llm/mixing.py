"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents. With a share w of the targets, the j-th block
of a source (from 1) is released at slot floor((j-1) / w) and due at slot ceil(j / w). At
each slot the released block with the earliest deadline goes next. After any number t of
slots every source has had its weight times t blocks, to within less than one block.

Targets are taken as whole numbers, so releases and deadlines are exact, and one rule holds
at every size. What earliest deadline first does from a slot on depends only on the blocks
each source has had by then. The driver therefore keeps these counts at the start of every
segment of the schedule, and tasks write the segments out. A source that has run out leaves
its slots empty; nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionlens.llm.common import free_name

#: Documents in a block.
BLOCK_DOCS = 8
#: Least documents numbered together; from its square on it is the root of their number,
#: so that neither a cell nor the list of a hot source's cells gets long.
CELL_DOCS = 256
#: Sources beyond this need coarser names: their weights are held on the driver.
MAX_SOURCES = 100_000
#: Blocks of a segment at least, and for each source: the counts that the driver keeps come
#: to an eighth of a byte a block at most.
SEGMENT_BLOCKS = 1 << 17
SEGMENT_BLOCKS_PER_SOURCE = 64
#: Places sent to every executor at most, about 100 bytes each; more are joined by a shuffle.
BROADCAST_PLACES = 1_000_000
#: Places in one batch from a task.
BATCH_PLACES = 1 << 14
#: The largest target as a whole number; the others are in proportion to it.
FINE = 1 << 40
#: Default target weights are the square roots of the sources' sizes.
SEED = 17


def whole_parts(shares: list[float]) -> list[int]:
    """Targets as whole numbers in proportion; 0 stays 0, any other target is 1 at least."""
    top = max(shares, default=0)
    return [max(1, math.floor(FINE * (s / top) + 0.5)) if s else 0 for s in shares]


def edf(
    parts: list[int], blocks: list[int], done: list[int], slot: int
) -> Iterator[tuple[int, int, int]]:
    """(source, turn, slot) of the blocks from ``slot`` on, earliest deadline first.

    ``done`` holds the blocks each source has had before and is kept up to date. Sources with
    a target of 0 take no part.
    """
    whole = sum(parts)
    waiting = [
        (done[i] * whole // c, i) for i, c in enumerate(parts) if c and done[i] < blocks[i]
    ]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * whole // parts[i]), i))
        _, i = heapq.heappop(ready)
        turn = done[i]
        done[i] = turn + 1
        if done[i] < blocks[i]:
            heapq.heappush(waiting, (done[i] * whole // parts[i], i))
        yield i, turn, slot
        slot += 1


def segment_starts(
    parts: list[int], blocks: list[int], length: int
) -> Iterator[tuple[int, list[int]]]:
    """Slot and blocks had by each source at the start of every ``length`` blocks."""
    left = sum(b for b, c in zip(blocks, parts) if c)
    done, slot = [0] * len(parts), 0
    while left > 0:
        yield slot, list(done)
        left -= length
        if left > 0:
            for _, _, slot in islice(edf(parts, blocks, done, slot), length):
                pass
            slot += 1


def leftover_starts(
    parts: list[int], blocks: list[int], length: int
) -> Iterator[tuple[int, int, int, int]]:
    """(slot, source, turn, blocks) of the sources with a target of 0, by runs of ``length``.

    They come one after another, from the last deadline of all others on.
    """
    whole = sum(parts)
    slot = max((-(-b * whole // c) for b, c in zip(blocks, parts) if c), default=0)
    for i, c in enumerate(parts):
        for turn in range(0, 0 if c else blocks[i], length):
            n = min(length, blocks[i] - turn)
            yield slot, i, turn, n
            slot += n


def schedule(
    docs: DataFrame,
    names: list[str],
    shares: list[float],
    blocks: list[int],
    key: str,
    turn: str,
    slot: str,
    segment_blocks: int = SEGMENT_BLOCKS,
) -> DataFrame:
    """The place of every block: rows of source name, turn and slot, written out by segments.

    No sources give no rows.
    """
    parts = whole_parts(shares)
    length = max(segment_blocks, SEGMENT_BLOCKS_PER_SOURCE * len(names))
    segments = [(at, -1, 0, length, done) for at, done in segment_starts(parts, blocks, length)]
    segments += [(*run, []) for run in leftover_starts(parts, blocks, length)]
    columns = ("at", "source", "turn", "n", "done")
    listed = pa.table(
        [
            pa.array([s[j] for s in segments], pa.int64() if j < 4 else pa.list_(pa.int64()))
            for j in range(5)
        ],
        names=columns,
    )
    schema = f"`{key}` string, `{turn}` long, `{slot}` long"

    def places(at: int, source: int, first: int, n: int, done: list[int]) -> Iterator[tuple]:
        if source >= 0:
            return ((source, first + j, at + j) for j in range(n))
        return islice(edf(parts, blocks, [int(d) for d in done], at), n)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = places(*(int(v) for v in row[:4]), row[4])
                while part := list(islice(found, BATCH_PLACES)):
                    source, turns, slots = np.array(part, np.int64).T
                    yield pd.DataFrame({key: [names[i] for i in source], turn: turns, slot: slots})

    rows = docs.sparkSession.createDataFrame(
        listed, "at long, source long, turn long, n long, done array<long>"
    )
    return rows.repartition(max(1, len(segments))).mapInPandas(write, schema)


def _source_key(source: str) -> F.Column:
    """A non-null name for every source; a null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def mix_slots(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    doc_id: str = "doc_id",
    source: str = "source",
    block_docs: int = BLOCK_DOCS,
    cell_docs: int = CELL_DOCS,
    segment_blocks: int = SEGMENT_BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with the columns ``mix_block``, ``mix_slot`` and ``mix_seq``.

    ``mix_block`` numbers a source's blocks from 0, ``mix_slot`` is the place of the block
    in the mixture and ``mix_seq`` that of the document in its block. Inside a source,
    documents are shuffled by a hash of their id and their other columns of text or whole
    numbers. ``weights`` are target weights by source (missing sources, and those with a
    target of 0, come after all others); by default they are the square roots of the
    sources' document counts. Null sources form one source; repeated rows and null ids are
    rows like others. An empty table gives an empty table. Input columns with the names of
    the new ones are kept, and the new ones get an underscore before them.
    """
    key, order, cell, rank = (
        free_name(docs, n) for n in ("mix_key", "mix_order", "mix_cell", "mix_rank")
    )
    first = free_name(docs, "mix_first")
    out_block, out_slot, out_seq = (
        free_name(docs, n) for n in ("mix_block", "mix_slot", "mix_seq")
    )
    named = docs.withColumn(key, _source_key(source))
    counts = {
        r[key]: r["n"]
        for r in named.groupBy(key).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    }
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by coarser names")
    if weights is None:
        shares = {k: math.sqrt(n) for k, n in counts.items()}
    else:
        given = {("n" if k is None else f"s{k}"): w for k, w in weights.items()}
        shares = {k: max(0.0, given.get(k, 0.0)) for k in counts}
        if counts and not sum(shares.values()):
            raise ValueError("no source of the table has a target weight")
    names = sorted(shares)
    blocks = [-(-counts[k] // block_docs) for k in names]
    table = schedule(
        docs, names, [shares[k] for k in names], blocks, key, out_block, out_slot, segment_blocks
    )
    if sum(blocks) <= BROADCAST_PLACES:
        table = F.broadcast(table)

    rows = sum(counts.values())
    cells = max(1, -(-rows // max(cell_docs, math.isqrt(rows))))
    text_id = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    ties = [
        F.col(f"`{c}`")
        for c, kind in docs.dtypes
        if c not in (doc_id, source) and kind in ("string", "bigint", "int")
    ]
    # Rows that share an id, or have none, differ by the hash of their other columns.
    hashed = [F.lit(f"{seed}:"), text_id] + ([F.lit(":"), F.xxhash64(*ties)] if ties else [])
    named = named.withColumn(order, F.md5(F.concat(*hashed).cast("binary")))
    # Cells are ranges of the hash, so their number does not change the order.
    head = F.conv(F.substring(order, 1, 6), 16, 10).cast("long")
    named = named.withColumn(cell, F.floor(head * cells / (1 << 24)))
    starts = (
        named.groupBy(key, cell)
        .agg(F.count("*").alias(first))
        .withColumn(
            first,
            F.sum(first).over(W.partitionBy(key).orderBy(cell)) - F.col(first),
        )
    )
    inside = W.partitionBy(key, cell).orderBy(order, doc_id, *ties)
    numbered = (
        named.withColumn(rank, F.row_number().over(inside) - 1)
        .join(starts, [key, cell])
        .withColumn(rank, F.col(rank) + F.col(first))
        .withColumn(out_block, F.floor(F.col(rank) / block_docs))
        .withColumn(out_seq, F.col(rank) % block_docs)
        .join(table, [key, out_block])
    )
    return numbered.select(*(F.col(f"`{c}`") for c in docs.columns), out_block, out_slot, out_seq)


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """``mix_slots`` with the rows in the order of the mixture, over all partitions."""
    mixed = mix_slots(docs, **options)
    block, slot, seq = mixed.columns[-3:]
    return mixed.orderBy(slot, seq)


ORACLE = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
sizes AS (SELECT k, count(*) AS n FROM keyed GROUP BY k),
parts AS (
  SELECT k, (n + {BLOCK_DOCS} - 1) // {BLOCK_DOCS} AS b,
         CAST(greatest(1, floor({FINE} * (sqrt(n) / (SELECT max(sqrt(n)) FROM sizes)) + 0.5))
              AS HUGEINT) AS c,
         row_number() OVER (ORDER BY k) AS i
  FROM sizes),
whole AS (
  SELECT list(c ORDER BY i) AS cs, list(b ORDER BY i) AS bs, CAST(sum(c) AS HUGEINT) AS d
  FROM parts),
steps AS (
  SELECT CAST(-1 AS HUGEINT) AS t, CAST(0 AS BIGINT) AS pick,
         list_transform(cs, lambda x: CAST(0 AS HUGEINT)) AS done, cs, bs, d
  FROM whole WHERE d IS NOT NULL
  UNION ALL
  SELECT t, p, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), cs, bs, d
  FROM (
    SELECT t, done, cs, bs, d, CAST(list_min(list_transform(cs, lambda c, i:
        CASE WHEN done[i] < bs[i] AND (done[i] * d) // c <= t
        THEN (((done[i] + 1) * d + c - 1) // c) * 1000000 + i END)) % 1000000 AS BIGINT) AS p
    FROM (
      SELECT done, cs, bs, d, greatest(t + 1, list_min(list_transform(cs, lambda c, i:
          CASE WHEN done[i] < bs[i] THEN (done[i] * d) // c END))) AS t
      FROM steps
      WHERE list_sum(done) < list_sum(bs)) released) picked),
places AS (
  SELECT CAST(t AS BIGINT) AS slot, pick AS i,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn
  FROM steps WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS r
  FROM keyed)
SELECT doc_id, source, r // {BLOCK_DOCS} AS mix_block, p.slot AS mix_slot, r % {BLOCK_DOCS} AS mix_seq
FROM ranked JOIN parts n USING (k)
JOIN places p ON p.i = n.i AND p.turn = r // {BLOCK_DOCS}
"""

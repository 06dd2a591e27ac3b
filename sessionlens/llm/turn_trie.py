"""The prefix trie of conversations, built by shards of sorted turn sequences.

A turn is the digest of its role and text, a conversation the sequence of its turns. All
sequences are cut into shards by range, ordered by (sequence, id), so that copies of one
conversation spread over shards as well. Within a shard the sequences become padded matrices
of turn ids, some columns at a time; numpy's lexsort orders them, and the masks of columns
that differ from the row before, OR-accumulated from left to right, mark where nodes start.
At each depth ``reduceat`` sums between those marks.

Every quantity of a node is a sum over its rows once each node is counted at its first row
and each leaf at its last one. For that a shard also sees the last sequence before it and the
first one after it. A node that goes on in a neighbouring shard is open: its parts, at most
two a depth and shard, are recombined by a key of its sequence. All others are whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionlens.llm.common import lean_batches, stored

#: Bytes of a turn's digest.
DIGEST = 16
#: Columns of a matrix held at a time.
COLUMNS = 64
#: Turns of a shard, on average.
SHARD_TURNS = 500_000
#: Ids joined into one string for a hash that goes on in the next shard.
ID_CHUNK = 65_536

_PARTS = (
    "key binary, parent_key binary, open boolean, shard int, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ends array<string>"
)


def turn_digest(role: Column, text: Column) -> Column:
    """Sixteen bytes that stand for (role, text); the length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def conversation_turns(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: its (digest, UTF-8 bytes of the text) in order of ``turn``.

    A null turn comes first, a null role or text counts as empty, ties go by digest, and
    repeated rows are turns of their own. Rows without a conversation id belong to none.
    Only digests are shuffled; a conversation is one row of 24 bytes a turn.
    """
    said_by, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    narrow = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            turn_digest(said_by, said).alias("digest"),
            F.octet_length(said).cast("long").alias("bytes"),
        ).alias("_turn"),
    )
    return narrow.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list("_turn")),
            lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")),
        ).alias("turns")
    )


def branch_conversations(convs: DataFrame, family: int = 5, most_shared: int = 9) -> DataFrame:
    """Rebuild each conversation c so that it begins like the first one of its family.

    Its first h turns are those of conversation c - c % ``family`` (all if that has fewer,
    none if it is absent), the rest its own after its first h; h is the unsigned crc32 of
    the decimal id, modulo ``most_shared``. A family is at most ``family`` rows.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int")
    head = F.slice("turns", 1, most_shared - 1)
    in_family = W.partitionBy("_first")
    with_head = convs.withColumn("_first", first).withColumn(
        "_head",
        F.first(F.when(F.col("conv_id") == F.col("_first"), head), ignorenulls=True).over(in_family),
    )
    own = F.slice(F.col("turns"), shared + 1, F.size("turns"))
    return with_head.select(
        "conv_id",
        F.concat(F.coalesce(F.slice("_head", F.lit(1), shared), F.slice("turns", 1, 0)), own).alias("turns"),
    )


def build_trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the prefix trie of conversations (``conv_id``, ``turns``).

    A node is a distinct sequence of first turns, the root the empty one. Per node:
    ``conv_id``, its smallest member; ``depth``; ``parent_conv_id``, the smallest member of
    its parent (root: null); ``n_convs``, the conversations that begin with it;
    ``n_children``; ``n_leaves``, nodes without children in its subtree, itself included;
    ``saved_tokens``, over its subtree the sum of each node's further members times the bytes
    of its last text; ``ends_sha256``, the SHA-256 of its members that end there, decimal,
    ascending, comma-joined. Ids must be distinct. A conversation without turns is a member
    of the root only; no conversations, no nodes. Without ``shards`` their number follows
    the turns.
    """
    spark = convs.sparkSession
    lean_batches(spark)
    rows = stored(
        convs.select(
            "conv_id",
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
            F.transform("turns", lambda t: t["bytes"]).alias("sizes"),
        ),
        "sequences",
    )
    if shards is None:
        total = rows.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_TURNS)
    sharded = stored(
        rows.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id()),
        "shards",
    )
    # One row per shard, whatever the number of conversations.
    edges = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    by_shard = W.orderBy("shard")
    near = edges.select(
        "shard",
        F.lag("last").over(by_shard).alias("before"),
        F.lead("first").over(by_shard).alias("after"),
    )
    neighbours = near.select("shard", F.explode(F.array(
        F.struct(F.lit(-1).alias("place"), F.col("before").alias("path")),
        F.struct(F.lit(1).alias("place"), F.col("after").alias("path")),
    )).alias("n")).where("n.path is not null").select(
        "shard",
        F.col("n.place").alias("place"),
        F.lit(None).cast("long").alias("conv_id"),
        F.col("n.path").alias("path"),
        F.lit(None).cast("array<bigint>").alias("sizes"),
    )
    seen = sharded.select("shard", F.lit(0).alias("place"), "conv_id", "path", "sizes")
    parts = stored(
        seen.unionByName(neighbours).groupBy("shard").applyInArrow(_shard_nodes, _PARTS), "nodes"
    )
    return _recombined(parts)


def _recombined(parts: DataFrame) -> DataFrame:
    """Whole nodes as they are, the parts of open ones by key; parents' ids where they were open."""
    result = (
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
    opened = parts.where("open")
    merged = opened.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    ends = _hashed_ends(opened.select("key", "shard", F.posexplode("ends").alias("at", "ids")))
    ids = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole_open = (
        merged.join(ends, "key", "left")
        .join(ids, "parent_key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    )
    # Children of an open node ask for its id within their shard: as many rows as the shard has.
    here = opened.select("shard", F.col("key").alias("parent_key")).distinct().join(ids, "parent_key")
    closed = parts.where("not open")
    told = closed.where("parent_key is not null").drop("parent_conv_id").join(here, ["shard", "parent_key"])
    return (
        closed.where("parent_key is null").select(*result)
        .unionByName(told.select(*result))
        .unionByName(whole_open.select(*result))
    )


def _hashed_ends(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each key's chunks of ids in order; a task reads them one batch at a time."""

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if state:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    ordered = chunks.repartition("key").sortWithinPartitions("key", "shard", "at")
    return ordered.select("key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


class _Sequences:
    """Turn ids and sizes of a shard's rows as flat arrays, read out as padded matrices."""

    def __init__(self, paths: list[bytes], sizes: list):
        self.length = np.array([len(p) // DIGEST for p in paths], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        halves = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
        by = np.lexsort((halves[:, 1], halves[:, 0]))
        new = (halves[by][1:] != halves[by][:-1]).any(axis=1)
        self.turn = np.zeros(len(by) + 1, np.int64)  # the last one stands for no turn
        self.turn[by] = np.concatenate([[0], np.cumsum(new)])[: len(by)] + 1
        self.size = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in sizes]])

    def matrix(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Turn ids of columns ``start`` on, 0 where a row has ended."""
        at = start + np.arange(COLUMNS)
        place = self.first[rows][:, None] + at
        there = at < self.length[rows][:, None]
        return self.turn[np.where(there, place, len(self.turn) - 1)]

    def order(self, ids: np.ndarray) -> np.ndarray:
        """Rows by (sequence, id): blocks of columns from the last, each by lexsort."""
        rank = np.zeros(len(ids), np.int64)
        longest = int(self.length.max(initial=0))
        for start in reversed(range(0, longest, COLUMNS)):
            rows = np.flatnonzero(self.length > start)
            block = np.column_stack([self.matrix(rows, start), rank[rows]])
            by = np.lexsort(block.T[::-1])
            block = block[by]
            new = (block[1:] != block[:-1]).any(axis=1)
            rank[:] = 0
            rank[rows[by]] = 1 + np.concatenate([[0], np.cumsum(new)])
        return np.lexsort((ids, rank))


def _shard_nodes(shard: pa.Table) -> pa.Table:
    """All nodes of a shard; those that go on in a neighbouring one are marked open."""
    number = shard.column("shard")[0].as_py()
    place = shard.column("place").to_numpy()
    paths, sizes = shard.column("path").to_pylist(), shard.column("sizes").to_pylist()
    ids = shard.column("conv_id").fill_null(0).to_numpy()
    seq = _Sequences(paths, [np.zeros(len(p) // DIGEST, np.int64) if s is None else s for p, s in zip(paths, sizes)])
    # The neighbours' rows sort first and last already; among equal sequences the mark decides.
    order = seq.order(np.where(place == 0, ids, np.where(place < 0, np.iinfo(np.int64).min, np.iinfo(np.int64).max)))
    before, after = bool((place < 0).any()), bool((place > 0).any())
    length = seq.length[order]
    common = _shared_with_previous(seq, order)
    own = np.arange(len(order))[before : len(order) - after]
    # A leaf is counted at its last row: the next row has other turns or does not exist.
    follows = np.concatenate([common[1:], [-1]])
    leaf = (follows < length)[own].astype(np.int64)
    conv, paths = ids[order][own], [paths[i] for i in order[own]]
    length, common, first = length[own], common[own], seq.first[order][own]
    shared_before = int(common[0]) if before else -1
    shared_after = int(follows[own[-1]]) if after else -1

    nodes = _Nodes(number, conv, paths[0], paths[-1], shared_before, shared_after)
    # From the deepest turns up: bytes below, and those counted at the node's first row.
    said, once = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    below = np.zeros(len(own), np.int64)
    by_length = np.argsort(length, kind="stable")
    edge = len(own)
    for depth in range(int(length.max(initial=0)), -1, -1):
        while edge and length[by_length[edge - 1]] >= depth:
            edge -= 1
        rows = np.sort(by_length[edge:]) if edge else np.arange(len(own))
        starts_here = common[rows] < depth
        if depth:
            size = seq.size[first[rows] + depth - 1]
            said[rows] += size
            once[rows] += np.where(starts_here, size, 0)
        else:
            starts_here[:] = False
            starts_here[0] = not before
        runs = np.flatnonzero(np.concatenate([[True], starts_here[1:]]))
        nodes.add(
            depth,
            rows,
            runs,
            n_convs=np.diff(np.concatenate([runs, [len(rows)]])),
            conv_id=np.minimum.reduceat(conv[rows], runs),
            n_children=np.add.reduceat(below[rows], runs),
            n_leaves=np.add.reduceat(leaf[rows], runs),
            saved_tokens=np.add.reduceat(said[rows] - once[rows], runs),
            ends=length[rows] == depth,
        )
        below[rows] = starts_here  # the rows of the next depth hold all of these
    return nodes.table()


def _shared_with_previous(seq: _Sequences, order: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the row before it; -1 for the first row.

    Change masks of the columns, OR-accumulated from left to right, are true from the first
    difference on.
    """
    length = seq.length[order]
    shared = np.zeros(len(order), np.int64)
    open_rows = np.arange(1, len(order))
    start = 0
    while len(open_rows):
        here, above = seq.matrix(order[open_rows], start), seq.matrix(order[open_rows - 1], start)
        changed = np.logical_or.accumulate((here != above) | (here == 0), axis=1)
        same = (~changed).sum(axis=1)
        shared[open_rows] += same
        start += COLUMNS
        open_rows = open_rows[(same == COLUMNS) & (length[open_rows] > start)]
    shared[:1] = -1
    return shared


class _Nodes:
    """Collects a shard's nodes by depth, deepest first."""

    def __init__(self, shard, conv, first_path, last_path, shared_before, shared_after):
        self.shard, self.conv = shard, conv
        self.shared_before, self.shared_after = shared_before, shared_after
        # Keys of open nodes: only prefixes of the first and the last row can be open.
        self.key_before = _prefix_keys(first_path, shared_before)
        self.key_after = _prefix_keys(last_path, shared_after)
        self.parts: list[dict] = []

    def add(self, depth, rows, runs, ends, **sums):
        n = len(runs)
        is_open = np.zeros(n, bool)
        keys = [None] * n
        if depth <= self.shared_before:
            is_open[0], keys[0] = True, self.key_before[depth]
        if depth <= self.shared_after:
            is_open[-1], keys[-1] = True, self.key_after[depth]
        run_of = np.repeat(np.arange(n), sums["n_convs"])
        digests, chunks = [_EMPTY] * n, [None] * n
        ending = np.flatnonzero(ends)
        for part in np.split(ending, np.flatnonzero(np.diff(run_of[ending])) + 1) if len(ending) else []:
            run = run_of[part[0]]
            members = self.conv[rows[part]]
            texts = [
                ",".join(map(str, members[i : i + ID_CHUNK].tolist())) for i in range(0, len(members), ID_CHUNK)
            ]
            if is_open[run]:
                chunks[run] = texts
            else:
                digests[run] = hashlib.sha256(",".join(texts).encode()).hexdigest()
        self.parts.append(
            {
                "depth": np.full(n, depth),
                "open": is_open,
                "key": keys,
                "ends_sha256": digests,
                "ends": chunks,
                "first_row": rows[runs],
                **sums,
            }
        )

    def table(self) -> pa.Table:
        # Parts go from deep to shallow, so the next one holds the parents.
        for at, part in enumerate(self.parts):
            if at + 1 == len(self.parts):
                part["parent_conv_id"] = part["parent_key"] = [None]
                continue
            above = self.parts[at + 1]
            parent = np.searchsorted(above["first_row"], part["first_row"], "right") - 1
            part["parent_conv_id"] = [
                None if above["open"][p] else int(above["conv_id"][p]) for p in parent
            ]
            part["parent_key"] = [above["key"][p] for p in parent]
        columns = {
            name: [x for part in reversed(self.parts) for x in (part[name].tolist() if isinstance(part[name], np.ndarray) else part[name])]
            for name in (
                "key", "parent_key", "open", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                "n_leaves", "saved_tokens", "ends_sha256", "ends",
            )
        }
        kinds = {
            "key": pa.binary(), "parent_key": pa.binary(), "open": pa.bool_(), "shard": pa.int32(),
            "ends_sha256": pa.string(), "ends": pa.list_(pa.string()),
        }
        columns["shard"] = [self.shard] * len(columns["depth"])
        names = [c.split()[0] for c in _PARTS.split(", ")]
        return pa.table({c: pa.array(columns[c], kinds.get(c, pa.int64())) for c in names})


_EMPTY = hashlib.sha256(b"").hexdigest()


def _prefix_keys(path: bytes, deepest: int) -> list[bytes]:
    """Keys of the prefixes of 0 to ``deepest`` turns: the depth and the SHA-256 so far."""
    keys, state = [], hashlib.sha256()
    for depth in range(deepest + 1):
        if depth:
            state.update(path[(depth - 1) * DIGEST : depth * DIGEST])
        keys.append(depth.to_bytes(8, "big") + state.digest())
    return keys


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of a turn table (see the functions above)."""
    return build_trie(branch_conversations(conversation_turns(turns)), shards)

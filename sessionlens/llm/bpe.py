"""Byte-level BPE encoding and decoding as reductions over a tree.

Encoded byte strings form a monoid: two encodings are joined into the encoding of both
strings together. A pre-token is halved down to short leaves, which are merged directly, and
the halves are joined on the way up. A join re-encodes a window around the border and widens
it until both its edges are settled.

Two neighbouring tokens are settled when encoding their bytes together gives back these two.
A sequence whose neighbours are all settled is the encoding of its bytes: merges go by lowest
rank, leftmost first, and the first merge over some border would happen in the two tokens at
that border alone as well. So a window with settled edges leaves the tokens outside as they
are, and a document is the concatenation of its pre-tokens, whose borders nothing crosses.
Decoding concatenates the bytes of tokens up a tree of halves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from sessionlens.llm.common import free_name, lean_batches
from sessionlens.llm.vocabulary import PATTERN, RANKS, WordIds, parse_ranks, read_bytes

#: Bytes that a leaf of the tree holds at most.
LEAF = 16
#: Bytes up to which neighbours are scanned rather than kept in a heap.
SHORT = 64
#: Token pairs remembered by a task; beyond that its memory starts anew, which changes no
#: result.
REMEMBERED = 400_000
#: Tokens that a leaf of the decoding tree holds at most.
DECODE_LEAF = 4096


class MergeTree:
    """Encoder of byte strings under the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks = ranks
        self.leaf = max(1, leaf)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._settled: dict[tuple[int, int], bool] = {}
        self._never = len(self.tokens)
        self._byte_ids = [ranks[bytes([b])] for b in range(256)]
        self._pair_ranks = [
            [ranks.get(bytes([a, b]), self._never) for b in range(256)] for a in range(256)
        ]

    def word(self, word: str) -> list[int]:
        """Ids of a pre-token. One that is itself a token is that token."""
        data = word.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode(data)

    def encode(self, data: bytes) -> list[int]:
        """Encode both halves and join them."""
        if len(data) <= self.leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides together, from the encodings of each."""
        if not left or not right:
            return left or right
        if self.settled(left[-1], right[0]):
            return left + right
        wide_left = wide_right = 1
        while True:
            window = self.merge(self.decode(left[-wide_left:] + right[:wide_right]))
            open_left = wide_left < len(left) and not self.settled(left[-wide_left - 1], window[0])
            open_right = wide_right < len(right) and not self.settled(window[-1], right[wide_right])
            if not (open_left or open_right):
                return left[:-wide_left] + window + right[wide_right:]
            if open_left:
                wide_left = min(2 * wide_left, len(left))
            if open_right:
                wide_right = min(2 * wide_right, len(right))

    def settled(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        known = self._settled.get((a, b))
        if known is None:
            known = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
            if len(self._settled) >= REMEMBERED:
                self._settled.clear()
            self._settled[a, b] = known
        return known

    def merge(self, data: bytes) -> list[int]:
        """Merge directly: the neighbours with the lowest rank first, the leftmost of equals."""
        if len(data) > SHORT:
            return self._merge_wide(data)
        rank_of, never, pair_ranks = self.ranks.get, self._never, self._pair_ranks
        ids = [self._byte_ids[b] for b in data]
        pairs = [pair_ranks[a][b] for a, b in zip(data, data[1:])]
        cuts = list(range(len(data) + 1))
        while pairs:
            lowest = min(pairs)
            if lowest == never:
                break
            # The rank of the merged bytes is the new token.
            i = pairs.index(lowest)
            ids[i] = lowest
            del pairs[i], cuts[i + 1], ids[i + 1]
            if i < len(pairs):
                pairs[i] = rank_of(data[cuts[i] : cuts[i + 2]], never)
            if i:
                pairs[i - 1] = rank_of(data[cuts[i - 1] : cuts[i + 1]], never)
        return ids

    def _merge_wide(self, data: bytes) -> list[int]:
        """The same for wide windows, in n log n: a linked list of parts and a heap of neighbours."""
        n = len(data)
        rank_of = self.ranks.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = rank_of(data[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, start, stop = heapq.heappop(heap)
            middle = end[start]
            # Stale entries name a part that is gone or has grown since.
            if not start < middle < stop or end[middle] != stop:
                continue
            end[start], end[middle] = stop, -1
            if stop < n:
                before[stop] = start
                rank = rank_of(data[start : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, start, end[stop]))
            left = before[start]
            if left >= 0:
                rank = rank_of(data[left:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a token sequence, concatenated up a tree of halves."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def decode_each(self, ids: list[int], sizes: list[int]) -> list[bytes]:
        """Bytes of sequences that lie one after another in ``ids``."""
        out, at = [], 0
        for size in sizes:
            out.append(self.decode(ids[at : at + size]))
            at += size
        return out


def encode_texts(
    docs: DataFrame,
    text: str = "text",
    into: str = "ids",
    vocabulary: str = RANKS,
    pattern: str = PATTERN,
    decoded: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Add the token ids (array of int) of each whole text; all other columns stay.

    Without ``keep_text`` the text itself does not come back.

    With ``decoded`` a column of that name holds the bytes that the ids decode to, made in
    the same pass from the ids alone.

    Every match of ``pattern`` is encoded by itself, without special tokens: their strings
    are plain text. Null and empty texts have no ids. Repeated rows and null ids stay rows of
    their own; the new column gets underscores before it where its name is taken. Nothing
    is shuffled. A long text is cut into pre-tokens a part at a time.
    """
    lean_batches(docs.sparkSession)
    into = free_name(docs, into)
    back = free_name(docs, decoded) if decoded else None
    kept = [c for c in docs.columns if keep_text or c != text]
    ranks = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def encode(batches):
        tree = MergeTree(parse_ranks(ranks.value))
        words = WordIds(lambda new: [tree.word(w) for w in new], pattern)
        for batch in batches:
            ids, sizes = words.ids([t or "" for t in batch.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            columns, names = [*[batch.column(c) for c in kept], found], [*kept, into]
            if back:
                columns.append(pa.array(tree.decode_each(ids.tolist(), sizes.tolist()), pa.binary()))
                names.append(back)
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [*[docs.schema[c] for c in kept], StructField(into, ArrayType(IntegerType(), True))]
    if back:
        fields.append(StructField(back, BinaryType()))
    return docs.mapInArrow(encode, StructType(fields))


def decode_ids(
    rows: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str = RANKS
) -> DataFrame:
    """Replace a column of token ids by the bytes they stand for (binary).

    Null and empty lists give no bytes. An id outside the vocabulary is an error. All other
    columns stay; the new one gets underscores before it where its name is taken.
    """
    lean_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != ids]
    into = free_name(rows.select(*others), into)
    ranks = rows.sparkSession.sparkContext.broadcast(read_bytes(vocabulary))

    def decode(batches):
        tree = MergeTree(parse_ranks(ranks.value))
        for batch in batches:
            column = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            found = tree.decode_each(column.flatten().to_pylist(), sizes)
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], [*others, into])

    schema = StructType([*rows.select(*others).schema, StructField(into, BinaryType())])
    return rows.mapInArrow(decode, schema)


def token_digests(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = RANKS
) -> DataFrame:
    """(id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``) of each row.

    The ids are encoded, then decoded again from the ids alone. Null and empty texts have no
    tokens and the hash of nothing twice; repeated rows and null ids give rows of their own.
    """
    narrow = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    encoded = encode_texts(narrow, "_text", "ids", vocabulary, decoded="decoded", keep_text=False)
    return encoded.select(
        F.col("_id").alias(doc_id),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

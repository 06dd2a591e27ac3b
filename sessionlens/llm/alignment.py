"""Alignment of two tokenizers over inverted pair bitmaps.

Both tokenizers cut the same bytes. Where tokens of both end at one offset, the text falls
into groups, and every token of one tokenizer is linked with every token of the other in its
group. The corpus statistics of an id pair live in an inverted index: documents are numbered
within blocks, and a row (block, pair, plane) holds a compressed bitmap of documents.

Plane 0 has the documents that hold the pair linked; plane k has those in whose further
links, their number less one, the bit k - 1 is set. So the documents of a pair are the
population count of plane 0, and its links are the counts of all planes weighted by powers
of two. A bitmap is a list of its non-zero 16-bit words, each with its place, and partial
bitmaps are OR-merged word by word. For scores, the postings of a block meet the counts of
their pairs, and each bitmap gives its pair's count back to its documents.

A pair has at most one row a plane in each block, however many documents hold it, so no
pair is a hot key.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from sessionlens.llm.common import BATCH_ROWS, lean_batches, stored
from sessionlens.llm.vocabulary import (
    BYTE_MODEL,
    PATTERN,
    PIECE_MODEL,
    WordIds,
    byte_level_tokens,
    read_bytes,
)

#: Documents of a block: their numbers fill 16 bits.
BLOCK_DOCS = 1 << 16
#: (document, pair) entries after which a block ends with the batch at hand.
BLOCK_ENTRIES = 3_000_000
#: Token pairs expanded at a time.
SLICE = 2_000_000
#: Groups with more links than this are expanded from distinct ids and their numbers.
WIDE_GROUP = 64
# Fixed value: the character that stands for a space in sentence pieces.
SPACE = "\u2581"
#: Sixteen documents a word of a bitmap.
WORD_BITS = 16

_STAGED = (
    "block long, ord int, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "a int, b int, plane int, n_docs long, words binary"
)


class ByteTokenizer:
    """Byte-level BPE from a model file, without special tokens."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model.decode())
        self.model.encode_special_tokens = True
        self.bytes = byte_level_tokens(model)
        # Pre-tokens are independent of each other.
        self.words = WordIds(self._encode, PATTERN)
        self._lossy = False

    def _encode(self, words: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        of = self.bytes.__getitem__
        self._lossy |= any(b"".join(map(of, i)) != w.encode() for w, i in zip(words, ids))
        return ids

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; none at all where they do not give it back byte for byte."""
        flat, sizes = self.words.ids(texts)
        found = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        if self._lossy:
            found = [_checked(ids, text, self.bytes) for ids, text in zip(found, texts)]
        return found


def _checked(ids: np.ndarray, text: str, table: list[bytes]) -> np.ndarray | None:
    joined = b"".join(map(table.__getitem__, ids.tolist()))
    return ids if joined == text.encode() else None


class PieceTokenizer:
    """Sentence pieces of whole texts from a model file, which puts a space before them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of a text; none at all where they do not give it back byte for byte."""
        ids = self.model.encode(text, num_threads=1)
        joined = b"".join(map(self.bytes.__getitem__, ids))
        return np.array(ids, np.int64) if joined == b" " + text.encode() else None


class Aligner:
    """Groups, links and pair entries of batches of texts."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.len_a = np.array([len(t) for t in a.bytes], np.int64)
        self.len_b = np.array([len(t) for t in b.bytes], np.int64)
        # Ids as text, once with the mark that goes on within a group and once with its end.
        self.text = np.concatenate(
            [_decimals(len(n), mark) for n, mark in ((a.bytes, ","), (a.bytes, "|"), (b.bytes, ","), (b.bytes, ";"))]
        )
        self.text_sizes = (self.text != 0).sum(axis=1)

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both tokenizers; none where one of them does not give the text back."""
        none = np.empty(0, np.int64)
        found = []
        for text, a in zip(texts, self.a.ids([" " + t if t else "" for t in texts])):
            b = self.b.ids(text) if text and a is not None else None
            found.append((none, none) if b is None else (a, b))
        return found

    def align(self, texts: list[str | None], digest: bool) -> tuple[dict, np.ndarray, np.ndarray]:
        """Columns of the documents, and keys and link counts of their (pair, document) entries.

        A key is the pair (a times the size of B, plus b) times ``BLOCK_DOCS``, plus the
        document's number in the batch.
        """
        pairs = self.tokens(texts)
        n_a = np.array([len(a) for a, _ in pairs], np.int64)
        n_b = np.array([len(b) for _, b in pairs], np.int64)
        a = np.concatenate([np.empty(0, np.int64), *[a for a, _ in pairs]])
        b = np.concatenate([np.empty(0, np.int64), *[b for _, b in pairs]])
        del pairs
        # Offsets run on from text to text, and each text's last tokens end together.
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.minimum(np.searchsorted(end_a, end_b), max(len(end_a) - 1, 0))
        common = end_b[end_a[at] == end_b] if len(end_a) else end_b
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        in_a = np.bincount(group_a, minlength=len(common))
        in_b = np.bincount(group_b, minlength=len(common))
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        first_a = np.concatenate([[0], np.cumsum(in_a)])
        first_b = np.concatenate([[0], np.cumsum(in_b)])
        doc_of_group = doc_a[first_a[:-1]]
        n_groups = np.bincount(doc_of_group, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc_of_group, in_a * in_b)

        columns = {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": n_groups,
            "n_links": n_links,
            "groups": self._groups(a, b, group_a, group_b, first_a, first_b, n_a + n_b, digest),
        }
        wide = in_a * in_b > WIDE_GROUP
        keys, counts = _entries(
            _weighted(a, group_a, wide), _weighted(b, group_b, wide), doc_of_group, len(self.b.bytes)
        )
        return columns, keys, counts

    def _groups(self, a, b, group_a, group_b, first_a, first_b, sizes, digest) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``, or the hash of that; '' without."""
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        ends_a = np.zeros(len(a), bool)
        ends_a[first_a[1:] - 1] = True
        ends_b = np.zeros(len(b), bool)
        ends_b[first_b[1:] - 1] = True
        codes = np.empty(len(a) + len(b), np.int64)
        # Before a token stand those of its own side and the other side's of earlier groups.
        codes[np.arange(len(a)) + first_b[group_a]] = a + size_a * ends_a
        codes[np.arange(len(b)) + first_a[group_b + 1]] = b + 2 * size_a + size_b * ends_b
        out, start = [], 0
        for size in sizes.tolist():
            part = self.text[codes[start : start + size]].ravel()
            joined = part[part != 0].tobytes()[:-1]
            start += size
            if not size:
                out.append("")
            else:
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return out


def _decimals(n: int, mark: str) -> np.ndarray:
    """The numbers below ``n`` as decimal text and a mark, padded with zero bytes."""
    width = len(str(n)) + 1
    return np.frombuffer(
        b"".join(f"{i}{mark}".encode().ljust(max(width, 8), b"\0") for i in range(n)), np.uint8
    ).reshape(n, -1)


def _weighted(ids: np.ndarray, groups: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, groups, numbers) by group; ids repeated in a wide group become one."""
    ones = np.ones(len(ids), np.int64)
    in_wide = wide[groups]
    if not in_wide.any():
        return ids, groups, ones
    size = int(ids.max()) + 1
    distinct, numbers = np.unique(groups[in_wide] * size + ids[in_wide], return_counts=True)
    ids = np.concatenate([ids[~in_wide], distinct % size])
    groups = np.concatenate([groups[~in_wide], distinct // size])
    numbers = np.concatenate([ones[~in_wide], numbers])
    order = np.argsort(groups, kind="stable")
    return ids[order], groups[order], numbers[order]


def _entries(a, b, doc_of_group: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (pair, document) with their links, from both sides by group."""
    (ids_a, group_a, number_a), (ids_b, group_b, number_b) = a, b
    in_b = np.bincount(group_b, minlength=len(doc_of_group))
    first_b = np.concatenate([[0], np.cumsum(in_b)])
    partners = in_b[group_a]
    upto = np.cumsum(partners)
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = 0
    while start < len(ids_a):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + SLICE, "right")))
        reps = partners[start:stop]
        left = np.repeat(np.arange(start, stop), reps)
        right = np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
        right += first_b[group_a[left]]
        pair = ids_a[left] * size_b + ids_b[right]
        key = pair * BLOCK_DOCS + doc_of_group[group_a[left]]
        part = _summed(key, number_a[left] * number_b[right])
        keys.append(part[0])
        counts.append(part[1])
        start = stop
    if len(keys) == 2:
        return keys[1], counts[1]
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def bitmap_planes(keys: np.ndarray, counts: np.ndarray, size_b: int) -> dict[str, pa.Array]:
    """Rows (a, b, plane) with the compressed bitmaps of a block's sorted entries."""
    out = {"a": [], "b": [], "plane": [], "n_docs": [], "words": []}
    more = counts - 1
    plane = 0
    while True:
        chosen = keys if plane == 0 else keys[(more >> (plane - 1)) & 1 == 1]
        if plane and not (more >> (plane - 1)).any():
            break
        if len(chosen):
            # A word has the key of its pair and place; its documents' bits are OR-merged.
            place = chosen // WORD_BITS
            starts = _starts(place)
            bits = np.bitwise_or.reduceat(np.uint32(1) << (chosen % WORD_BITS).astype(np.uint32), starts)
            place = place[starts]
            pair = place // (BLOCK_DOCS // WORD_BITS)
            words = (place % (BLOCK_DOCS // WORD_BITS)).astype(np.uint32) << 16 | bits
            rows = _starts(pair)
            offsets = np.concatenate([rows, [len(words)]]).astype(np.int32) * 4
            pair = pair[rows]
            out["a"].append(pair // size_b)
            out["b"].append(pair % size_b)
            out["plane"].append(np.full(len(rows), plane))
            out["n_docs"].append(np.add.reduceat(np.bitwise_count(bits).astype(np.int64), rows))
            out["words"].append(
                pa.Array.from_buffers(
                    pa.binary(),
                    len(rows),
                    [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.astype("<u4").tobytes())],
                )
            )
        plane += 1
    if not out["a"]:
        return {}
    return {
        **{c: pa.array(np.concatenate(out[c]), pa.int32()) for c in ("a", "b", "plane")},
        "n_docs": pa.array(np.concatenate(out["n_docs"]), pa.int64()),
        "words": pa.concat_arrays(out["words"]),
    }


def index_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    byte_model: str = BYTE_MODEL,
    piece_model: str = PIECE_MODEL,
    digest: bool = False,
) -> DataFrame:
    """Aligned documents and their postings, written to the shared folder and read back.

    A row with ``plane`` null is a document: its id as ``doc``, ``block`` and number ``ord``
    there, token, group and link counts, and its groups as text (their SHA-256 with ``digest``). Any other
    row is a posting. A task numbers its own documents; a block ends after
    ``BLOCK_ENTRIES`` entries, so what a task holds does not grow with the table. One
    document's distinct pairs are held together.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    models = spark.sparkContext.broadcast((read_bytes(byte_model), read_bytes(piece_model)))
    plain = spark.createDataFrame([], _STAGED).schema
    staged = StructType([*plain, StructField("doc", docs.schema[doc_id].dataType)])

    def index(batches):
        aligner = Aligner(ByteTokenizer(models.value[0]), PieceTokenizer(models.value[1]))
        size_b = len(aligner.b.bytes)
        arrow = {f.name: to_arrow_type(f.dataType) for f in staged}
        block = TaskContext.get().partitionId() << 24
        numbered, held, entries = 0, [], 0

        def rows(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    columns[f.name].cast(arrow[f.name])
                    if f.name in columns
                    else pa.nulls(n, arrow[f.name])
                    for f in staged
                ],
                staged.names,
            )

        def postings():
            keys, counts = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(keys)
            columns = bitmap_planes(keys[order], counts[order], size_b)
            if columns:
                n = len(columns["a"])
                yield rows(n, {**columns, "block": pa.array(np.full(n, block), pa.int64())})

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                n = part.num_rows
                if numbered + n > BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield from postings()
                    block, numbered, held, entries = block + 1, 0, [], 0
                columns, keys, counts = aligner.align(part.column(1).to_pylist(), digest)
                held.append((keys + numbered, counts))
                entries += len(keys)
                yield rows(
                    n,
                    {
                        "doc": part.column(0),
                        "block": pa.array(np.full(n, block), pa.int64()),
                        "ord": pa.array(np.arange(numbered, numbered + n), pa.int32()),
                        **{c: pa.array(v) for c, v in columns.items()},
                    },
                )
                numbered += n
        if held:
            yield from postings()

    return stored(docs.select(doc_id, text).mapInArrow(index, staged), "alignment")


def pair_counts(index: DataFrame) -> DataFrame:
    """(a, b, ``n_docs``, ``n_links``) of every linked id pair, from the planes' counts."""
    weight = F.when(F.col("plane") == 0, 1).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return (
        index.where("plane is not null")
        .groupBy("a", "b")
        .agg(
            F.sum(F.when(F.col("plane") == 0, F.col("n_docs"))).alias("n_docs"),
            F.sum(F.col("n_docs") * weight).alias("n_links"),
        )
    )


def align_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    byte_model: str = BYTE_MODEL,
    piece_model: str = PIECE_MODEL,
    digest: bool = False,
) -> DataFrame:
    """One row per document: counts, ``n_best`` and ``count_sum`` over its links, its groups.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` in the order of the text, or its SHA-256 in
    ``groups_sha256`` with ``digest``. A pair's count is the number of rows of ``docs`` that
    hold it linked; a link is best when no pair of its A id has a greater count, ties
    included. Texts that are null or empty, or that a tokenizer does not give back byte for
    byte, have zeros and ''. Repeated rows and null ids are documents of their own; other
    columns are left out. An empty table gives an empty one.
    """
    index = index_texts(docs, doc_id, text, byte_model, piece_model, digest)
    postings = index.where("plane is not null").select("block", "a", "b", "plane", "words")
    counts = pair_counts(index).select("a", "b", F.col("n_docs").alias("_count"))
    # At most one row for each id of A, whatever the corpus.
    most = counts.groupBy("a").agg(F.max("_count").alias("_most"))
    scored = postings.join(counts.join(F.broadcast(most), "a"), ["a", "b"]).select(
        "block", "plane", "words", "_count", (F.col("_count") == F.col("_most")).alias("_best")
    )
    scores = scored.groupBy("block").applyInArrow(
        _give_back, "block long, ord int, n_best long, count_sum long"
    )
    groups = "groups_sha256" if digest else "groups"
    found = index.where("plane is null").select(
        "doc", "block", "ord", "n_a", "n_b", "n_groups", "n_links", F.col("groups").alias(groups)
    )
    return found.join(scores, ["block", "ord"], "left").select(
        F.col("doc").alias(doc_id),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        groups,
    )


def _give_back(postings: pa.Table) -> pa.Table:
    """Sums over a block's bitmaps by document: links that are best, and counts of links."""
    column = postings.combine_chunks().column
    words = column("words").to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
    coded = np.frombuffer(b"".join(words), "<u4")
    plane = np.asarray(column("plane"))
    weight = np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
    count = np.asarray(column("_count")) * weight
    best = np.asarray(column("_best")) * weight
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = (coded >> 16).astype(np.int64) * WORD_BITS
    n_best = np.zeros(BLOCK_DOCS, np.int64)
    count_sum = np.zeros(BLOCK_DOCS, np.int64)
    for bit in range(WORD_BITS):
        there = np.flatnonzero(coded >> bit & 1)
        doc, of = place[there] + bit, row[there]
        np.add.at(n_best, doc, best[of])
        np.add.at(count_sum, doc, count[of])
    seen = np.flatnonzero(count_sum)
    block = column("block")[0].as_py()
    return pa.table(
        {
            "block": pa.array(np.full(len(seen), block), pa.int64()),
            "ord": pa.array(seen, pa.int32()),
            "n_best": pa.array(n_best[seen], pa.int64()),
            "count_sum": pa.array(count_sum[seen], pa.int64()),
        }
    )

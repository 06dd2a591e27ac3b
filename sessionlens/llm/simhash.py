"""SimHash near duplicates by meet-in-the-middle ball hashing.

A fingerprint stands for the ball of all words within half the maximum distance of it. Two
fingerprints within the maximum distance share at least one such variant, and two that
share one are within the maximum distance, so variants that collide are exactly the links.

The shuffle is on variants, grouped by their leading bits: one row (prefix, fingerprint)
carries all variants of the fingerprint with that prefix, which the receiving task writes
out and sorts. Few leading bits suffice, so a fingerprint becomes tens of rows instead of
2,081. A prefix that many fingerprints start with is split by further bits, so no task
gets an unbounded group. A group hands on a forest (a node and its smallest linked id),
never all pairs, and the forests are joined into components by rounds of large and small
stars over distinct links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import free_name, lean_batches, stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints that share a group's prefix, on average; more bits are used beyond that.
GROUP_TARGET = 512
#: A prefix with more fingerprints than this is split by STEP_BITS further bits.
GROUP_LIMIT = 8192
STEP_BITS = 8
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text, unsigned; zero for a text without words.

    ``bytes.lower`` and ``bytes.split`` change and split at ASCII characters only.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, n)
    body = b" ".join(words)
    size = min(shingle_words, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hash_of, seed = xxhash.xxh64_intdigest, SEED
    first, last = starts[: n - size + 1].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = np.array(
            [hash_of(body[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])],
            np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = ones * 2 > len(first)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str, shingle_words: int = SHINGLE_WORDS) -> F.Column:
    """The fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t or b"", shingle_words) for t in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return prints(F.col(text).cast("binary"))


def flips(bits: int, most: int, shift: int = 0) -> list[np.ndarray]:
    """Masks with 0..most set bits among ``bits`` places above ``shift``, by their count."""
    return [
        np.array(
            [sum(1 << (p + shift) for p in places) for places in combinations(range(bits), k)],
            np.uint64,
        )
        for k in range(most + 1)
    ]


def _key(prefix: np.ndarray, bits: int) -> np.ndarray:
    """Prefix and its length in one long: a marker bit stands above the prefix."""
    return (prefix | np.uint64(1 << bits)).view(np.int64)


def spread_rows(
    prints: np.ndarray, radius: int, levels: list[int], hot: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every group that holds a variant of a fingerprint.

    A variant belongs to the first level at which its prefix is not hot. ``levels`` are
    prefix lengths; ``hot`` the sorted hot prefixes of all levels but the last.
    """
    rows_out, keys_out = [], []
    rows = np.arange(len(prints))
    heads = np.zeros(len(prints), np.uint64)
    used = np.zeros(len(prints), np.int64)
    done = 0
    for level, bits in enumerate(levels):
        width = bits - done
        own = (prints >> np.uint64(64 - bits)) & np.uint64((1 << width) - 1)
        masks = flips(width, radius)
        grown = []
        for spent in range(radius + 1):
            at = np.flatnonzero(used == spent)
            for more in range(radius + 1 - spent):
                m = masks[more]
                if not len(at) or not len(m):
                    continue
                part = np.repeat(at, len(m))
                tail = own[rows[part]] ^ np.tile(m, len(at))
                grown.append(
                    (rows[part], (heads[part] << np.uint64(width)) | tail, used[part] + more)
                )
        if not grown:
            break
        rows, heads, used = (np.concatenate(x) for x in zip(*grown))
        done = bits
        inside = (
            np.isin(heads, hot[level]) if level < len(hot) else np.zeros(len(heads), bool)
        )
        rows_out.append(rows[~inside])
        keys_out.append(_key(heads[~inside], bits))
        rows, heads, used = rows[inside], heads[inside], used[inside]
    return np.concatenate(rows_out), np.concatenate(keys_out)


def group_forest(key: int, prints: np.ndarray, ids: np.ndarray, radius: int, most: int) -> tuple:
    """(id, smallest linked id) of the fingerprints of one group that collide in it."""
    bits = int(key).bit_length() - 1
    low = 64 - bits
    prefix = int(key) - (1 << bits)
    order = np.argsort(ids, kind="stable")
    prints, ids = prints[order], ids[order]
    apart = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(prefix)) if bits else np.zeros(len(prints), np.int64)
    tails = prints & np.uint64((1 << low) - 1)
    masks = flips(low, radius)
    values, nodes = [], []
    for spent in range(radius + 1):
        at = np.flatnonzero(apart == spent)
        every = np.concatenate(masks[: radius + 1 - spent])
        values.append((tails[at][:, None] ^ every[None, :]).ravel())
        nodes.append(np.repeat(at, len(every)))
    value, node = np.concatenate(values), np.concatenate(nodes)
    order = np.argsort(value)
    value, node = value[order], node[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    a, b = node[same], node[same + 1]
    pairs = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
    a, b = pairs // max(1, len(ids)), pairs % max(1, len(ids))
    close = np.bitwise_count(prints[a] ^ prints[b]) <= most
    a, b = a[close], b[close]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _hot_prefixes(reps: DataFrame, bits: int, limit: int) -> np.ndarray:
    """Prefixes that more than ``limit`` fingerprints start with: at most rows / limit."""
    head = F.shiftrightunsigned("fingerprint", 64 - bits)
    found = reps.groupBy(head.alias("head")).count().where(F.col("count") > limit)
    return np.sort(np.array([r["head"] for r in found.collect()], np.int64).view(np.uint64))


def ball_links(
    reps: DataFrame,
    max_bits: int = MAX_BITS,
    group_target: int = GROUP_TARGET,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Links (node, root) that connect all fingerprints within ``max_bits`` of each other.

    ``reps`` has distinct fingerprints and a distinct id for each.
    """
    if max_bits % 2 or max_bits < 0:
        raise ValueError("the two half balls need an even maximum distance")
    radius = max_bits // 2
    n = reps.count()
    bits = int(min(32, max(4, np.ceil(np.log2(max(1, n) / group_target)))))
    levels, hot = [bits], []
    while levels[-1] + STEP_BITS <= 56:
        found = _hot_prefixes(reps, levels[-1], group_limit)
        if not len(found):
            break
        hot.append(found)
        levels.append(levels[-1] + STEP_BITS)

    def spread(batches):
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy().view(np.uint64)
            ids = batch.column("id").to_numpy()
            rows, keys = spread_rows(prints, radius, levels, hot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(prints[rows].view(np.int64)), pa.array(ids[rows])],
                ["key", "fingerprint", "id"],
            )

    def collide(key, group):
        node, root = group_forest(
            key[0].as_py(),
            group.column("fingerprint").to_numpy().view(np.uint64),
            group.column("id").to_numpy(),
            radius,
            max_bits,
        )
        return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})

    rows = reps.select("fingerprint", "id").mapInArrow(
        spread, "key bigint, fingerprint bigint, id bigint"
    )
    return rows.groupBy("key").applyInArrow(collide, "node bigint, root bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id each linked node reaches; roots have no row.

    Rounds of large and small stars. A round joins on both ends of the links and keeps
    them distinct; it never holds a component in one task.
    """
    def state_of(links: DataFrame) -> tuple:
        mark = F.xxhash64("node", "root").cast("decimal(38,0)")
        return tuple(links.agg(F.count("*"), F.sum(mark)).first())

    now = stored(links.select("node", "root").distinct(), "links")
    state = state_of(now)
    while state[0]:
        both = now.union(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least("node", F.min("root")).alias("least"))
        # Large star: larger neighbours of a node move to the least one around it.
        large = (
            both.where(F.col("root") > F.col("node"))
            .join(least, "node")
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
            .distinct()
        )
        # Small star: a node and its smaller neighbours move to the least of those.
        lowest = large.groupBy("node").agg(F.min("root").alias("least"))
        small = (
            large.join(lowest, "node")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("node").alias("node"), F.col("least").alias("root")),
                        F.struct(F.col("root").alias("node"), F.col("least").alias("root")),
                    )
                ).alias("link")
            )
            .select("link.*")
            .where("node <> root")
            .distinct()
        )
        now = stored(small, "links")
        before, state = state, state_of(now)
        if state == before:
            break
    return now


def _linked(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fingerprint, ``root``, component_id) of every distinct fingerprint.

    The nodes are the fingerprints themselves, so that a repeated or missing id neither joins
    nor parts them; a component's ids are looked up once its fingerprints are known.
    """
    reps = stored(
        prints.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "fingerprints"
    )
    nodes = reps.select("fingerprint", F.col("fingerprint").alias("id"))
    found = components(ball_links(nodes, max_bits))
    rooted = reps.join(found, reps["fingerprint"] == found["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least_id"
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Fingerprint and component of each row of ``docs``.

    Columns: the id, ``fingerprint`` (16 lower-case hex digits) and ``component_id``, the
    smallest id reached over links of at most ``max_bits`` differing bits. Null and empty
    texts have fingerprint zero. Texts of rows with a null id link like any others; the
    component is null where nobody in it has an id. Rows of one id with different texts are
    in the component of their own text. Repeated rows give repeated rows. Other columns are
    left out.
    """
    prints = _prints(docs, doc_id, text, shingle_words)
    return prints.join(_linked(prints, max_bits), "fingerprint").select(
        F.col("id").alias(doc_id),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _prints(docs: DataFrame, doc_id: str, text: str, shingle_words: int) -> DataFrame:
    """(id, ``text_hash``, fingerprint) of each row, computed once."""
    lean_batches(docs.sparkSession)
    return stored(
        docs.select(
            F.col(doc_id).cast("long").alias("id"),
            F.xxhash64(text).alias("text_hash"),
            fingerprint_column(text, shingle_words).alias("fingerprint"),
        ),
        "prints",
    )


def keep_one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates; all columns are kept.

    It is the row with the smallest id, of several texts with that id the one with the
    smallest hash; rows without an id come last, but a component of such rows alone keeps one
    as well. So every text has a survivor within its component, whatever the ids. Null and
    empty texts are one component. Rows equal in id and text give one.
    """
    prints = _prints(docs, doc_id, text, shingle_words)
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
    keepers = (
        prints.join(_linked(prints, max_bits), "fingerprint")
        .groupBy("root")
        .agg(F.min(order).alias("kept"))
    )
    mine, hashed = free_name(docs, "kept_id"), free_name(docs, "kept_hash")
    keepers = keepers.select(
        F.col("kept.id").alias(mine), F.col("kept.text_hash").alias(hashed)
    )
    same = docs[doc_id].cast("long").eqNullSafe(F.col(mine)) & (F.xxhash64(docs[text]) == F.col(hashed))
    kept = docs.join(keepers, same, "left_semi")
    return kept.withColumn(hashed, F.xxhash64(text)).dropDuplicates([doc_id, hashed]).drop(hashed)

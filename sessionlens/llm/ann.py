"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are scaled to length one, so the largest cosine is the smallest distance, and
rotated by a random orthogonal matrix: the first t of D rotated dimensions then estimate a
distance, with a known error. Centroids fitted on a bounded sample cut the rows into
lists. A query probes the lists that are expected to hold nearly all of the rows it is
after, and in each list the rotated candidates are read in column blocks: after each block
a hypothesis test on the partial distances abandons the candidates that are too far to be
among the nearest. What survives is compared in double precision on the original vectors.

The distance to beat comes first from the query's neighbours in the sample. They are rows
of the table too, so they fill up an answer that would otherwise run short; the lists find
the others, in a table of any size.

Equal vectors are indexed once with their smallest ids, enough to fill any answer. Lists are
cut into chunks of rows and of queries, so that no task holds a large list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sessionlens.llm.common import hash_share, lean_batches, stored

NEAREST = 5
#: Rows that centroids are fitted on and queries look at first: a share of the distinct
#: vectors, within these, so that a small table is searched by its lists as a large one is.
SAMPLE_SHARE, LEAST_SAMPLE, SAMPLE_ROWS = 1 / 8, 128, 8192
#: Lists: the square root of the rows, within these.
LEAST_LISTS, MOST_LISTS = 8, 4096
ROUNDS = 8
#: Columns read between two tests, and the tests' strictness (in standard errors).
COLUMNS, STRICT = 16, 2.5
#: Share of the expected nearer rows that the probed lists hold together.
PROBED_SHARE = 0.998
#: Rows and queries of a chunk.
CHUNK_ROWS, CHUNK_QUERIES = 8192, 1024
SEED = 31


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    agree: np.ndarray  # mean cosine of the sample's members with their centroid, by list
    share: np.ndarray  # share of the sample in the list
    sample: np.ndarray  # unit vectors


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, exact, so that tiny and huge components neither vanish nor overflow."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    return np.ldexp(x, -np.frexp(top)[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_index(sample: np.ndarray, rows: int) -> Index:
    """Rotation, spherical centroids and list figures from unit vectors in a fixed order."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    rotation = q * np.sign(np.diag(r))
    lists = int(min(MOST_LISTS, max(LEAST_LISTS, round(rows**0.5)), len(sample)))
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centroids)
    nearest = (sample @ centroids.T).argmax(axis=1)
    cosines = (sample * centroids[nearest]).sum(axis=1)
    counts = np.bincount(nearest, minlength=lists)
    # One pseudo member with the mean cosine keeps the figures of a small list honest.
    agree = (np.bincount(nearest, cosines, minlength=lists) + cosines.mean()) / (counts + 1)
    return Index(rotation, centroids, agree, (counts + 1) / (len(sample) + lists), sample)


def list_of(index: Index, x: np.ndarray) -> np.ndarray:
    return (x @ index.centroids.T).argmax(axis=1).astype(np.int32)


def probed(
    index: Index, queries: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(queries x lists: probed or not, squared distance to beat, sample hits).

    Queries are unit vectors. The hits are the rows (query, place in the sample) of each
    query's k nearest of the sample.

    A member agrees with its centroid by some cosine and points elsewhere in a direction
    the query does not know, so its cosine with the query varies about the product of both
    cosines with standard error sin * sin / sqrt(D). That gives the expected number of
    members nearer than the distance to beat; lists are taken from the most promising on
    until they hold PROBED_SHARE of all.
    """
    near = queries @ index.sample.T
    size = min(k, near.shape[1])
    hits = np.argpartition(-near, size - 1, axis=1)[:, :size]
    asked = np.repeat(np.arange(len(queries)), size)
    if size == k:
        beat = 2 - 2 * np.take_along_axis(near, hits, axis=1).min(axis=1)
    else:
        beat = np.full(len(queries), 4.0)
    beat = np.maximum(beat, 0) + 1e-9
    cosines = np.clip(queries @ index.centroids.T, -1, 1)
    agree = np.clip(index.agree, -1, 1)[None, :]
    error = np.sqrt((1 - cosines**2) * (1 - agree**2) / queries.shape[1]) + 1e-6
    z = (cosines * agree - (1 - beat[:, None] / 2)) / error
    # A short form of the normal distribution function.
    chance = 1 / (1 + np.exp(np.clip(-1.5976 * z - 0.07056 * z**3, -600, 600)))
    expected = chance * index.share[None, :]
    order = np.argsort(-expected, axis=1)
    ranked = np.take_along_axis(expected, order, axis=1)
    before = np.cumsum(ranked, axis=1) - ranked
    chosen = np.zeros(expected.shape, bool)
    np.put_along_axis(chosen, order, before < PROBED_SHARE * ranked.sum(axis=1, keepdims=True), axis=1)
    chosen[np.arange(len(queries)), cosines.argmax(axis=1)] = True
    return chosen, beat, (asked, hits.ravel())


def scan(
    rotated: np.ndarray, queries: np.ndarray, beat: np.ndarray, k: int
) -> list[np.ndarray]:
    """For each rotated query the candidates that no test abandoned.

    After t of D columns the partial distance times D / t estimates the whole one with a
    relative error of about sqrt(2 / t) under a random rotation; beyond STRICT / sqrt(2)
    of those a candidate is dropped. The k-th best of what remains lowers the bar.
    """
    dim = rotated.shape[1]
    out = []
    for q, bar in zip(queries, beat):
        alive = np.arange(len(rotated))
        partial = np.zeros(len(rotated))
        for at in range(0, dim, COLUMNS):
            block = rotated[alive, at : at + COLUMNS] - q[at : at + COLUMNS]
            partial = partial + np.einsum("ij,ij->i", block, block)
            done = min(dim, at + COLUMNS)
            if done < dim:
                allowed = bar * (done / dim) * (1 + STRICT / np.sqrt(done)) ** 2
                keep = partial <= allowed + 1e-9
            else:
                if len(partial) > k:
                    bar = min(bar, np.partition(partial, k - 1)[k - 1])
                keep = partial <= bar + 1e-6
            alive, partial = alive[keep], partial[keep]
        out.append(alive)
    return out


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for equal rows wherever they stand."""
    a, b = scaled(a), scaled(b)
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable_vectors(rows: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(id, vector) of rows that take part, and the vectors' length.

    Null ids and vectors, zero vectors and those with null or non-finite components take no
    part, and neither do those of another length than the most common one (the larger of
    equally common ones): a cosine between them is not defined.
    """
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    good = good.where("id is not null and vector is not null").where(
        finite & F.exists("vector", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dim = sizes["size"] if sizes else 0
    return good.where(F.size("vector") == dim), dim


def nearest_neighbours(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_every: int = 50,
    k: int = NEAREST,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows
    but the query's own, copies of it included. Ranks go by cosine, ties to the smaller
    id. A query with fewer than k candidates gets them all: so few rows are all in the sample,
    which answers whatever the tests abandon. Rows
    without a usable vector take no part; an empty table gives no rows. Rows that repeat an
    id count once for each different vector.
    """
    spark = rows.sparkSession
    lean_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    good, dim = usable_vectors(rows, vec_id, embedding)
    if not dim:
        return spark.createDataFrame([], schema)

    # The k + 1 smallest ids of equal vectors: one of them may be the query itself. The rank
    # limit is applied before the shuffle too, so a very common vector sends few rows.
    first = W.partitionBy("vector").orderBy("id")
    ids = (
        good.distinct()
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    distinct = stored(ids, "vectors")
    n = distinct.count()
    chosen = (
        distinct.withColumn("id", F.col("ids")[0])
        .where(hash_share("id", SEED, min(sample_rows, max(LEAST_SAMPLE, n * SAMPLE_SHARE)) / max(1, n)))
        .orderBy("id", "vector")
        .toArrow()
    )
    if not chosen.num_rows:
        chosen = distinct.limit(1).toArrow()
    originals = _vectors(chosen.column("vector"), dim)
    index = fit_index(unit(originals), n)
    sample_ids = spark.sparkContext.broadcast((originals, chosen.column("ids").to_pylist()))
    parts = spark.sparkContext.broadcast(
        (index.rotation, index.centroids, index.agree, index.share, index.sample)
    )

    def place(batches):
        own = Index(*parts.value)
        for batch in batches:
            x = unit(_vectors(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vector"), batch.column("ids"), pa.array(list_of(own, x))],
                ["vector", "ids", "list"],
            )

    listed = stored(
        distinct.select("vector", "ids").mapInArrow(place, "vector array<double>, ids array<long>, list int"),
        "listed",
    )

    def probe(batches):
        own = Index(*parts.value)
        seen, seen_ids = sample_ids.value
        names = ["query", "vector", "list", "beat", "ids", "score"]
        for batch in batches:
            vectors = _vectors(batch.column("vector"), dim)
            which, beat, (asked, hits) = probed(own, unit(vectors), k + 1)
            row, number = np.nonzero(which)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query").take(pa.array(row)),
                    batch.column("vector").take(pa.array(row)),
                    pa.array(number.astype(np.int32)),
                    pa.array(beat[row]),
                    pa.nulls(len(row), pa.list_(pa.int64())),
                    pa.nulls(len(row), pa.float64()),
                ],
                names,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query").take(pa.array(asked)),
                    pa.nulls(len(asked), pa.list_(pa.float64())),
                    pa.nulls(len(asked), pa.int32()),
                    pa.nulls(len(asked), pa.float64()),
                    pa.array([seen_ids[i] for i in hits], pa.list_(pa.int64())),
                    pa.array(cosine(vectors[asked], seen[hits])),
                ],
                names,
            )

    # Queries with equal vectors are searched once, under their smallest id.
    queries = good.where(F.col("id") % query_every == 0).distinct()
    by_vector = queries.groupBy("vector").agg(F.min("id").alias("query"))
    members = stored(queries.join(by_vector, "vector").select("id", "query"), "queries")
    asked = stored(
        by_vector.select("query", "vector").mapInArrow(
            probe,
            "query long, vector array<double>, list int, beat double, ids array<long>, score double",
        ),
        "probes",
    )
    probes = asked.where("list is not null").select("query", "vector", "list", "beat")
    from_sample = asked.where("list is null").select("query", "ids", "score")

    # Chunks of rows by chunks of queries: as many as the list's counts ask for.
    counts = (
        listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("row_chunks"))
        .join(
            probes.groupBy("list").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("query_chunks")),
            "list",
        )
    )
    # A row for each list: MOST_LISTS at most.
    counts = F.broadcast(stored(counts, "chunks"))
    row_chunk = F.pmod(F.xxhash64("ids"), F.col("row_chunks")).cast("int")
    query_chunk = F.pmod(F.xxhash64("query"), F.col("query_chunks")).cast("int")
    rows_side = listed.join(counts, "list").select(
        "list",
        row_chunk.alias("row_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)).alias("query_chunk"),
        "vector",
        "ids",
    )
    query_side = probes.join(counts, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)).alias("row_chunk"),
        query_chunk.alias("query_chunk"),
        "vector",
        "query",
        "beat",
    )

    def search(held, asked):
        empty = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not held.num_rows or not asked.num_rows:
            return empty.empty_table()
        rotation = parts.value[0]
        x, q = _vectors(held.column("vector"), dim), _vectors(asked.column("vector"), dim)
        found = scan(unit(x) @ rotation, unit(q) @ rotation, asked.column("beat").to_numpy(), k + 1)
        row = np.concatenate(found)
        query = np.repeat(np.arange(len(q)), [len(f) for f in found])
        score = cosine(q[query], x[row])
        # The best k + 1 of the chunk for each query, with all that tie with the last.
        order = np.lexsort((-score, query))
        row, query, score = row[order], query[order], score[order]
        starts = np.searchsorted(query, np.arange(len(q)))
        last = np.minimum(starts + k, np.append(starts[1:], len(query)) - 1)
        keep = score >= score[last[query]] if len(score) else np.zeros(0, bool)
        ids = held.column("ids").combine_chunks().take(pa.array(row[keep]))
        return pa.table(
            [asked.column("query").combine_chunks().take(pa.array(query[keep])), ids, pa.array(score[keep])],
            schema=empty,
        )

    keys = ["list", "row_chunk", "query_chunk"]
    found = (
        rows_side.groupBy(*keys)
        .cogroup(query_side.groupBy(*keys))
        .applyInArrow(search, "query long, ids array<long>, score double")
    )
    # Exact over what was found: each vector's k + 1 smallest ids fill any answer.
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = (
        found.union(from_sample)
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .distinct()
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k + 1)
    )
    own = W.partitionBy("query_id").orderBy("place")
    return (
        members.withColumnRenamed("id", "query_id")
        .join(top, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

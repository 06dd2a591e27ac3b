"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask is a fixed pattern of token positions; the positions it leaves out may differ. Every
place of a document and of a benchmark item is hashed under the masks, equal hashes join,
and around each hit the two token sequences are compared along the same diagonal. A
document overlaps an item where a window of WINDOW tokens differs in at most SUBSTITUTIONS
of them. Any such window contains a hit: of 13 tokens with two replaced, the first mask
finds five matching ones wherever the replacements are. Where the masks cannot promise that
for a short item, its tokens are dealt over one more mask than it may have replacements, so
that one of these holds none of them.

A small benchmark's seeds go to every executor. Seeds of a large one meet those of the
documents by a shuffle of a few numbers for each place; only the hits fetch their document's
tokens, whose texts are shuffled once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import free_name

WINDOW, SUBSTITUTIONS = 13, 2
#: Positions that count. The first is enough alone; the second adds places with more
#: replaced tokens near each other to the hits of a window.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
#: Seeds of the benchmark that are sent to every executor at most, about 400 bytes each;
#: more are joined by a shuffle.
BROADCAST_SEEDS = 100_000
#: What separates tokens; letters are compared in lower case.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens_of(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits; none for null."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.array_remove(words, "")


def _span(masks: tuple) -> int:
    return max(m[-1] for m in masks) + 1


def permitted(size: int, window: int, substitutions: int) -> int:
    """Replaced tokens that an item of ``size`` tokens may have."""
    return min(size, window) * substitutions // window


def _covered(size: int, wrong: int, masks: tuple) -> bool:
    """Whether some mask hits an item wherever ``wrong`` of its tokens are replaced."""
    seeds = [{at + p for p in m} for at in range(size - _span(masks) + 1) for m in masks]
    return all(any(seed.isdisjoint(w) for seed in seeds) for w in combinations(range(size), wrong))


def short_masks(window: int, substitutions: int, masks: tuple) -> dict[int, list[tuple]]:
    """Masks of their own, by size, for items below the window that ``masks`` may miss."""
    out = {}
    for size in range(1, window):
        wrong = permitted(size, window, substitutions)
        if not _covered(size, wrong, masks):
            out[size] = [tuple(range(part, size, wrong + 1)) for part in range(wrong + 1)]
    return out


def _shape(mask: tuple) -> tuple:
    """The mask moved to begin at 0, so that it fits where a text ends inside the item."""
    return tuple(p - mask[0] for p in mask)


def _seed(tokens: str, at: F.Column, mask: tuple, number: int) -> F.Column:
    return F.xxhash64(F.lit(number), *(F.get(tokens, at + p) for p in mask))


def _short_places(items: DataFrame, tokens: str, short: dict[int, list[tuple]], numbers: dict[tuple, int]) -> DataFrame:
    """``items`` of the sizes in ``short``, with ``at`` and ``seed`` for each mask of theirs."""
    found = F.lit(None)
    for size, own in short.items():
        pairs = [
            F.struct(F.lit(m[0]).alias("at"), _seed(tokens, F.lit(m[0]), _shape(m), numbers[_shape(m)]).alias("seed"))
            for m in own
        ]
        found = F.when(F.size(tokens) == size, F.array(*pairs)).otherwise(found)
    return items.withColumn("place", F.explode(found)).select(*items.columns, "place.at", "place.seed")


def _places(
    rows: DataFrame, tokens: str, masks: tuple, numbers: dict[tuple, int] | None = None
) -> DataFrame:
    """``rows`` for every place ``at`` and mask, with its ``seed``.

    Tokens are read from the array by position, so nothing but the place and the seed is
    made for a row until the join finds a hit. ``numbers`` has further masks of other spans.
    """
    numbers = numbers or {}
    span = _span(masks)
    last = F.size(tokens) - F.lit(min([span, *(m[-1] + 1 for m in numbers)]))
    # An empty list of places, not a filter: a filter would cut the text twice.
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    rows = rows.withColumn("at", F.explode(places))
    seeds = [_seed(tokens, F.col("at"), m, i) for i, m in enumerate(masks)]
    if numbers:
        # Outside of a text a mask has no seed: a hash would leave the missing tokens out.
        left = F.size(tokens) - F.col("at")
        seeds = [F.when(left >= span, seed) for seed in seeds]
        seeds += [F.when(left > m[-1], _seed(tokens, F.col("at"), m, i)) for m, i in numbers.items()]
    return rows.withColumn("seed", F.explode(F.array(*seeds)))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS,
    masks: tuple = MASKS,
    broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """One row for each document and item that overlap.

    Columns: the document's id, ``doc_hash`` (of its text, to tell rows with equal or null
    ids apart), the item's id, ``n_places`` (alignments that overlap) and ``best_match``
    (equal tokens of the best window). An item shorter than the window is compared whole,
    with proportionally fewer replacements, and one of up to six tokens with none. Null and
    empty texts overlap nothing. Repeated document or item rows count once. A long text or a
    word that it repeats costs a seed for each of its places; more than ``broadcast_seeds``
    seeds of the benchmark change the way of the join, not its result.
    """
    span = _span(masks)
    # Tokens that can share a window with a seed, by their distance from its start.
    around = range(min(span - window, -substitutions), window)
    items = benchmark.select(
        F.col(item_id).alias("item"), tokens_of(F.col(item_text)).alias("item_tokens")
    ).distinct()
    size = F.size("item_tokens")
    reach = F.least(F.lit(window), size)
    # Masks of the short sizes that occur: the others would cost seeds of every document.
    short = short_masks(window, substitutions, masks)
    sizes = items.where(size.isin([*short])).select(size).distinct().collect() if short else []
    short = {n: short[n] for n in sorted(r[0] for r in sizes)}
    shapes = sorted({_shape(m) for own in short.values() for m in own})
    numbers = {m: len(masks) + i for i, m in enumerate(shapes)}
    item_places = _places(items.where(~size.isin([*short])) if short else items, "item_tokens", masks)
    if short:
        item_places = item_places.unionByName(_short_places(items, "item_tokens", short, numbers))
    item_seeds = item_places.select(
        "item",
        "seed",
        F.col("at").alias("item_at"),
        (reach - F.floor(reach * F.lit(substitutions) / F.lit(window))).cast("int").alias("needed"),
        *(F.get("item_tokens", F.col("at") + k).alias(f"t{k - around[0]}") for k in around),
    )
    few = item_seeds.count() <= broadcast_seeds
    texts = docs.select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("doc_hash"),
        F.col(text).alias("doc_text"),
    )
    if not few:
        # Repeated rows would meet each other's hits below.
        texts = texts.dropDuplicates(["doc", "doc_hash"])
    doc_tokens = texts.select("doc", "doc_hash", tokens_of(F.col("doc_text")).alias("doc_tokens"))
    doc_places = _places(doc_tokens, "doc_tokens", masks, numbers)
    if few:
        hits = doc_places.join(F.broadcast(item_seeds), "seed")
    else:
        narrow = doc_places.select("doc", "doc_hash", "at", "seed").join(item_seeds, "seed")
        held = doc_tokens.select(
            F.col("doc").alias("held_doc"), F.col("doc_hash").alias("held_hash"), "doc_tokens"
        )
        same = F.col("doc").eqNullSafe(F.col("held_doc")) & (F.col("doc_hash") == F.col("held_hash"))
        hits = narrow.join(held, same)
    # Positions outside of either text never match, so a window that hangs over an end has
    # no more matches than the one moved inside, and short items need no case of their own.
    # Matches are bits of one number: few operations for a row keep the compiled loop short.
    equal = sum(
        (
            F.when(F.get("doc_tokens", F.col("at") + k) == F.col(f"t{k - around[0]}"), 1 << (k - around[0])).otherwise(0)
            for k in around
        ),
        F.lit(0),
    )
    windows = [
        F.bit_count(F.col("equal").bitwiseAND(F.lit(((1 << window) - 1) << s)))
        for s in range(len(around) - window + 1)
    ]
    # Diagonals first: their partial maxima leave a row for each document and item.
    places = (
        hits.withColumn("diagonal", F.col("at") - F.col("item_at"))
        .withColumn("equal", equal)
        .groupBy("doc", "doc_hash", "item", "diagonal")
        .agg(F.max(F.greatest(*windows)).alias("best"), F.max("needed").alias("needed"))
        .where("best >= needed")
    )
    return (
        places.groupBy("doc", "doc_hash", "item")
        .agg(F.count("*").alias("n_places"), F.max("best").alias("best_match"))
        .select(
            F.col("doc").alias(doc_id),
            "doc_hash",
            F.col("item").alias(item_id),
            "n_places",
            "best_match",
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object
) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns.

    Rows with null or empty texts stay, repeated rows and rows with equal or null ids are
    judged each by its own text, and an empty table or benchmark takes nothing away. Columns
    of any name are kept as they are.
    """
    theirs, theirs_hash, mine = (
        free_name(docs, n) for n in ("found_id", "found_hash", "own_hash")
    )
    found = (
        find_overlaps(docs, benchmark, doc_id, text, **options)
        .select(F.col(doc_id).alias(theirs), F.col("doc_hash").alias(theirs_hash))
        .distinct()
    )
    marked = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = (F.col(mine) == F.col(theirs_hash)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(theirs))
    return marked.join(found, same, "left_anti").drop(mine)


ORACLE = rf"""
WITH items AS (
  SELECT DISTINCT item_id, list_filter(
    string_split_regex(lower(coalesce(text, '')), '{SEPARATOR}'), lambda x: x <> '') AS toks
  FROM benchmark),
docs AS (
  SELECT doc_id, list_filter(
    string_split_regex(lower(coalesce(text, '')), '{SEPARATOR}'), lambda x: x <> '') AS toks
  FROM documents),
item_seeds AS (
  SELECT item_id, toks, i, [toks[i], toks[i+1], toks[i+3], toks[i+6], toks[i+7]] AS seed
  FROM items, unnest(range(1, len(toks) - 6)) AS u(i) WHERE len(toks) >= 8),
doc_seeds AS (
  SELECT doc_id, toks, i, [toks[i], toks[i+1], toks[i+3], toks[i+6], toks[i+7]] AS seed
  FROM docs, unnest(range(1, len(toks) - 6)) AS u(i) WHERE len(toks) >= 8),
diagonals AS (
  SELECT DISTINCT d.doc_id, b.item_id, d.i - b.i AS shift, b.toks AS bt, d.toks AS dt
  FROM doc_seeds d JOIN item_seeds b USING (seed)),
matched AS (
  SELECT doc_id, item_id, shift, least({WINDOW}, len(bt)) AS reach,
    list_transform(range(1, len(bt) + 1), lambda j:
      CASE WHEN j + shift >= 1 AND bt[j] = dt[j + shift] THEN 1 ELSE 0 END) AS m
  FROM diagonals),
best AS (
  SELECT doc_id, item_id, shift, reach, list_max(list_transform(
    range(1, len(m) - reach + 2), lambda s: list_sum(m[s : s + reach - 1]))) AS best
  FROM matched)
SELECT doc_id, item_id, count(*) AS n_places, CAST(max(best) AS INTEGER) AS best_match
FROM best WHERE best >= reach - (reach * {SUBSTITUTIONS}) // {WINDOW}
GROUP BY doc_id, item_id
"""

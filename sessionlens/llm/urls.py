"""URL filter: host and path rules, then a Bloom filter cascade over listed keys.

The first level of the cascade encodes the listed keys and is asked for all other keys of
the corpus; those it takes for listed are encoded by the second level, which is asked for
the listed keys, and so on until a level has no false positive. A key's answer is the
level at which it first fails, so over the key universe membership is exact and needs no
join. Everything here is DataFrame functions: levels are built by grouped ORs of 64-bit
words and probed through a constant array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import free_name, stored

# The rules of the production filter, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Bits of one level at most (16 MB as a constant); longer lists are cut into shards.
MAX_LEVEL_BITS = 1 << 27
#: False positive rate of levels after the first.
LATER_RATE = 0.5
SEED = 7919


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]
    salt: int

    def holds(self, key: F.Column) -> F.Column:
        """Whether all of a key's bits are set."""
        if not self.words:
            return F.lit(False)
        # The text becomes one constant array when the plan is optimised.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        said = F.lit(True)
        for place in self.places(key):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            bit = F.call_function(
                "shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")
            )
            said = said & (bit.bitwiseAND(F.lit(1)) == 1)
        return said

    def places(self, key: F.Column) -> list[F.Column]:
        return [
            F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(self.bits))
            for i in range(self.hashes)
        ]


def build_level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key``: its words are gathered by grouped ORs."""
    if not n:
        return Level(64, 1, [], salt)
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
    empty = Level(bits, hashes, [], salt)
    place = F.explode(F.array(*empty.places(F.col("key"))))
    word = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int")
    )
    rows = (
        keys.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("at"))
        .agg(F.bit_or(word).alias("word"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["at"]] = r["word"]
    return Level(bits, hashes, words, salt)


@dataclass
class Cascade:
    """Levels by shard of the key space; one shard unless the list is very long."""

    shards: list[list[Level]]

    def shard(self, key: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(len(self.shards)))

    def lists(self, key: F.Column) -> F.Column:
        """Whether a key of the universe is listed; never null for a non-null key."""
        answer = F.lit(False)
        for number, levels in enumerate(self.shards):
            said = F.lit(len(levels) % 2 == 1)
            for i in range(len(levels) - 1, -1, -1):
                # Failing an odd level (from 1) means not listed, an even one listed.
                said = F.when(levels[i].holds(key), said).otherwise(F.lit(i % 2 == 1))
            answer = said if len(self.shards) == 1 else F.when(
                self.shard(key) == number, said
            ).otherwise(answer)
        return answer


def build_cascade(
    universe: DataFrame, listed: DataFrame, max_level_bits: int = MAX_LEVEL_BITS
) -> Cascade:
    """The cascade of the column ``key`` of ``listed`` over that of ``universe``.

    Null keys are left out; repeated keys count once. Listed keys that the universe lacks
    are encoded too. An empty list gives a cascade that lists nothing.
    """
    keys = (
        universe.select("key", F.lit(0).alias("mark"))
        .unionByName(listed.select("key", F.lit(1).alias("mark")))
        .where("key is not null")
        .groupBy("key")
        .agg(F.max("mark").alias("mark"))
    )
    keys = stored(keys, "keys")
    totals = {r["mark"]: r["count"] for r in keys.groupBy("mark").count().collect()}
    members, others = totals.get(1, 0), totals.get(0, 0)
    # The usual sizing: the first level leaves about as many others as there are members.
    rate = min(LATER_RATE, max(1e-9, members / max(1, others) / math.sqrt(2)))
    need = members * math.log2(1 / rate) / math.log(2) if members else 0
    cascade = Cascade([[] for _ in range(max(1, math.ceil(need * 1.1 / max_level_bits)))])
    for number, levels in enumerate(cascade.shards):
        own = keys
        if len(cascade.shards) > 1:
            own = keys.where(cascade.shard(F.col("key")) == number)
        sides = {1: own.where("mark = 1"), 0: own.where("mark = 0")}
        side, n = 1, sides[1].count()
        while n:
            level = build_level(sides[side], n, rate if not levels else LATER_RATE, len(levels) + 1)
            levels.append(level)
            side = 1 - side
            # Only what this level takes for its own goes on.
            sides[side] = sides[side].where(level.holds(F.col("key")))
            n = sides[side].count()
    return cascade


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(at > 0, F.lit(False))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_columns(
    host: F.Column, path: F.Column, rules: tuple = RULES
) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def page_key(host: F.Column, path: F.Column) -> F.Column:
    return F.concat(host, path)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: tuple = RULES,
    url: str = "url",
    max_level_bits: int = MAX_LEVEL_BITS,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    ``listed`` has a column ``key`` of blocked host-and-path keys. The longest rule that
    fits decides; without one a listed key is blocked and any other allowed. Null urls and
    urls without ``://`` have an empty host and path. Rows are neither dropped nor merged.
    Columns of ``pages`` that have these names are replaced.
    """
    new = {n: free_name(pages, f"url_{n}") for n in ("host", "path", "key")}
    host, path = split_url(F.col(url))
    split = pages.withColumn(new["host"], host).withColumn(new["path"], path)
    split = split.withColumn(new["key"], page_key(F.col(new["host"]), F.col(new["path"])))
    cascade = build_cascade(split.select(F.col(new["key"]).alias("key")), listed, max_level_bits)
    rule, verdict = rule_columns(F.col(new["host"]), F.col(new["path"]), rules)
    on_list = cascade.lists(F.col(new["key"]))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "listed")]
    return split.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col(new["host"]).alias("host"),
        F.col(new["path"]).alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, F.when(on_list, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        on_list.alias("listed"),
    )


def toxic_page_keys(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Keys of pages whose number, the last in the path, is a document labelled toxic."""
    host, path = split_url(F.col(url))
    numbered = pages.select(page_key(host, path).alias("key"), path.alias("path")).select(
        "key", F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1).alias("number")
    )
    numbered = numbered.where("number <> ''").select("key", F.col("number").cast("long").alias("id"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    return numbered.join(toxic, "id").select("key").distinct()


ORACLE = """
WITH split AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split),
listed AS (
  SELECT DISTINCT host || path AS key FROM parts
  WHERE try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT)
        IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(verdict, h, p) AS (VALUES %s),
fits AS (
  SELECT page_id, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, f.rule,
       coalesce(f.verdict, CASE WHEN l.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       l.key IS NOT NULL AS listed
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (page_id)
LEFT JOIN listed l ON l.key = host || path
""" % ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

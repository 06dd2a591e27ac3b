"""Column expressions shared by the operators. All but ``computed_once`` stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionlens.schema import DEFAULT_URL, EVENT_TYPES

MICROS = 1_000_000

EVENT_TYPE = "event_type"


def is_type(name: str) -> Column:
    return F.col(EVENT_TYPE) == name


def is_pageview() -> Column:
    return is_type("pageview")


def is_success_payment() -> Column:
    return is_type("payment") & (F.col("status") == "success")


def is_exit() -> Column:
    """A page view whose url mentions the exit page; null-safe."""
    return F.coalesce(is_pageview() & F.col("url").contains("exit"), F.lit(False))


def exact_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` with microseconds kept."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS))


def whole_seconds(start: Column, end: Column) -> Column:
    """Seconds between the two instants, each cut to a whole second first."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def time_bucket(ts: Column, seconds: float) -> Column:
    """Index of the ``seconds``-wide slot of the time line that holds ``ts``."""
    width = F.lit(int(seconds * MICROS))
    micros = F.unix_micros(ts)
    return F.call_function("div", micros - F.pmod(micros, width), width)


def page_key() -> Column:
    """What counts as a visited page: a page view's url or a viewed product's id.

    A page view without a url is one of the default url. The two kinds share one name
    space on purpose: equal strings count once.
    """
    return F.when(is_pageview(), F.coalesce(F.col("url"), F.lit(DEFAULT_URL))).when(
        is_type("product_view"), F.col("product_id")
    )


def type_bit() -> Column:
    """One bit per known event type, so distinct types are ``bit_or`` + ``bit_count``.

    Bit 0 stands for any type outside the list.
    """
    known = F.array(*[F.lit(t) for t in EVENT_TYPES])
    position = F.array_position(known, F.col(EVENT_TYPE)).cast("int")
    return F.call_function("shiftleft", F.lit(1), position)


def ip_subnet(ip: Column) -> Column:
    """First three octets of an IPv4 address."""
    return F.substring_index(ip, ".", 3)


def kv_key(session_id: Column) -> Column:
    return F.concat(F.lit("session:"), session_id)


def computed_once(struct: Column) -> Column:
    """The fields of a struct as columns of a select, computed once for each row.

    A filter on plain fields moves below the select and computes the whole struct again for
    every field it names; it cannot move below this. For costly structs, such as parsed text.
    """
    return F.inline(F.array(struct))


def hash_rank(key: Column, seed: int) -> Column:
    """A 60-bit number from the md5 of key and seed: a repeatable random order."""
    digest = F.md5(F.concat_ws("#", key, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

Three fixed patterns give the base spans. The battery looks at every other token of 20
or more characters, infers its encoding (the smallest alphabet that holds all of its
characters; a token that none holds is cut, see ``pieces``) and asks how well it agrees with uniform random symbols of that alphabet:

* a chi-squared test of symbol counts, and one of the character classes,
* a runs test of symbols above and below the middle of the alphabet,
* a lag-one serial correlation test of symbol values.

The p-values are combined by Stouffer's rule. Random tokens have uniform combined
p-values, ordinary tokens pile up near zero. False discoveries are controlled for each
encoding and band of lengths, because a short token cannot show much structure: the
upper half of the p-values tells how many random tokens there are, and a band's threshold
is the smallest p at which the excess over that line is at most the permitted share.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import free_name, lean_batches

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

TOKEN_LENGTH = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Parts of a token around its inner '=', padding kept, and pieces of such a part.
PART = re.compile(r"[^=]+(?:=+\Z)?")
URL_PIECE = re.compile(r"[A-Za-z0-9_-]+=*")
BASE64_PIECE = re.compile(r"[A-Za-z0-9+/]+=*")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets by size; a token belongs to the first that holds all of its symbols.
ENCODINGS = (
    ("digits", DIGITS),
    ("hex_lower", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36_lower", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", UPPER + LOWER + DIGITS + "-_"),
)
ALPHABETS = [frozenset(symbols) for _, symbols in ENCODINGS]
VALUES = [{c: i for i, c in enumerate(symbols)} for _, symbols in ENCODINGS]
#: A token's band is how many of these its length reaches; p-values are kept in BINS steps.
BANDS = (24, 32, 40, 64, 128, 512)
BINS = 200
#: Permitted share of ordinary tokens among those reported.
FALSE_SHARE = 0.05
#: Spans of these encodings need this many random tokens in their band to be reported.
LEAST_SUPPORT = 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                found.append((m.start(), 1, m.end()))
    # Runs of one character class are maximal, so asking for the length in the pattern
    # finds the same spans as filtering all runs.
    for m in LONG_HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return sorted(found)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _chi_tail(statistic: float, freedom: int) -> float:
    """Chance of a chi-squared value at least this large (cube-root approximation)."""
    if freedom <= 0:
        return 1.0
    spread = 2.0 / (9.0 * freedom)
    return _upper_tail(((max(statistic, 0.0) / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def infer_encoding(token: str) -> int | None:
    """Index in ENCODINGS of the smallest alphabet that holds the token, padding aside."""
    symbols = set(token.rstrip("="))
    return next((i for i, known in enumerate(ALPHABETS) if symbols <= known), None)


def _class_of(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in UPPER else 2 if c in LOWER else 3


def battery(token: str, encoding: int) -> tuple[float, float, float, float]:
    """p-values of symbol counts, character classes, runs and serial correlation."""
    value, size = VALUES[encoding], len(VALUES[encoding])
    body = token.rstrip("=")
    xs = [value[c] for c in body]
    n = len(xs)
    counts = Counter(xs)
    chi = size / n * sum(k * k for k in counts.values()) - n
    p_symbols = _chi_tail(chi, size - 1)

    shares = Counter(_class_of(c) for c in ENCODINGS[encoding][1])
    seen = Counter(_class_of(c) for c in body)
    if len(shares) > 1:
        chi = sum((seen[k] - n * s / size) ** 2 / (n * s / size) for k, s in shares.items())
        p_classes = _chi_tail(chi, len(shares) - 1)
    else:
        p_classes = 1.0

    high = [x * 2 >= size for x in xs]
    ups = sum(high)
    downs = n - ups
    if ups and downs and n > 2:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * ups * downs / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0

    centre = sum(xs) / n
    power = sum((x - centre) ** 2 for x in xs)
    if power > 0:
        lagged = sum((a - centre) * (b - centre) for a, b in zip(xs, xs[1:]))
        p_serial = 2 * _upper_tail(abs((lagged / power * n + 1) / math.sqrt(n)))
    else:
        p_serial = 0.0
    return p_symbols, p_classes, p_runs, min(1.0, p_serial)


def _quantile(p: float) -> float:
    """z with upper tail p, by bisection on the normal tail."""
    p = min(max(p, 1e-12), 1 - 1e-12)
    low, high = -8.0, 8.0
    for _ in range(40):
        mid = (low + high) / 2
        if _upper_tail(mid) > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def randomness(token: str, encoding: int) -> float:
    """Combined p-value of the battery under uniform random symbols."""
    ps = battery(token, encoding)
    if len({_class_of(c) for c in ENCODINGS[encoding][1]}) == 1:
        ps = (ps[0], ps[2], ps[3])
    return _upper_tail(sum(map(_quantile, ps)) / math.sqrt(len(ps)))


def pieces(start: int, token: str) -> list[tuple[int, str]]:
    """(start, piece) of the parts of a token to test, each held by some alphabet.

    A token that no alphabet holds is cut at its inner '=', as in KEY=VALUE. A part that
    still mixes '+' or '/' with '-' or '_' is cut at the first two, which keeps base64_url
    tokens whole, and at the last two, which keeps base64 tokens whole; of the second cut
    only pieces with '+' or '/' are new.
    """
    if infer_encoding(token) is not None:
        return [(start, token)]
    out = []
    for part in PART.finditer(token):
        at, body = start + part.start(), part.group()
        if infer_encoding(body) is not None:
            out.append((at, body))
            continue
        out += [(at + m.start(), m.group()) for m in URL_PIECE.finditer(body)]
        out += [
            (at + m.start(), m.group())
            for m in BASE64_PIECE.finditer(body)
            if "/" in m.group() or "+" in m.group()
        ]
    return out


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, encoding, band, bin) of every long token, or piece of one, that some alphabet holds."""
    if not any(len(w) >= TOKEN_LENGTH for w in text.split()):
        return []
    found = []
    for m in TOKEN.finditer(text):
        for start, token in pieces(m.start(), m.group()):
            if len(token.rstrip("=")) < TOKEN_LENGTH:
                continue
            encoding = infer_encoding(token)
            band = sum(len(token) >= edge for edge in BANDS)
            step = min(BINS - 1, int(randomness(token, encoding) * BINS))
            found.append((start, start + len(token), encoding, band, step))
    return found


def band_thresholds(
    counts: Iterable[tuple[int, int, int, int]], false_share: float = FALSE_SHARE
) -> dict[tuple[int, int], int]:
    """Least reported bin by (encoding, band), from rows (encoding, band, bin, tokens).

    Random tokens fill all bins evenly, so twice the upper half estimates their number.
    A band without tokens in its upper half reports nothing.
    """
    bands: dict[tuple[int, int], list[int]] = {}
    for encoding, band, step, tokens in counts:
        bands.setdefault((encoding, band), [0] * BINS)[step] += tokens
    out = {}
    for key, bins in bands.items():
        random_tokens = 2.0 * sum(bins[BINS // 2 :])
        if random_tokens < LEAST_SUPPORT:
            continue
        above, best = 0, None
        for step in range(BINS - 1, -1, -1):
            above += bins[step]
            expected = random_tokens * (BINS - step) / BINS
            # One token of leeway keeps a band with few tokens from rejecting by chance.
            if above - expected <= false_share * above + 1.0:
                best = step
            elif step < BINS // 2:
                break
        if best is not None:
            out[key] = best
    return out


def spans_of(text: str, thresholds: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """Base spans and the random tokens that no base span holds, by start then kind."""
    base = base_spans(text)
    added = [
        (start, 3, end)
        for start, end, encoding, band, step in candidates(text)
        if step >= thresholds.get((encoding, band), BINS)
        and not any(a <= start and end <= b for a, _, b in base)
    ]
    return sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def measure_bands(docs: DataFrame, text: str = "text") -> dict[tuple[int, int], int]:
    """Thresholds from every long token of the corpus.

    One pass: tokens are counted by (encoding, band, bin), a table of at most
    ``len(ENCODINGS) * (len(BANDS) + 1) * BINS`` rows whatever the corpus.
    """
    lean_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def cells(texts: pa.Array) -> pa.Array:
        return pa.array(
            [
                [(e * (len(BANDS) + 1) + b) * BINS + s for _, _, e, b, s in candidates(t or "")]
                for t in texts.to_pylist()
            ],
            pa.list_(pa.int32()),
        )

    counted = (
        docs.select(F.explode(cells(F.col(text))).alias("cell")).groupBy("cell").count().collect()
    )
    rows = []
    for cell, tokens in counted:
        rest, step = divmod(cell, BINS)
        encoding, band = divmod(rest, len(BANDS) + 1)
        rows.append((encoding, band, step, tokens))
    return band_thresholds(rows)


SCAN_TYPE = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_random:bigint>"


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and spans of the secrets of each document, one row per row of ``docs``.

    Null and empty texts have no spans: zero counts, the hash of an empty list and an
    empty string. Repeated rows and null ids give rows of their own; other columns are
    left out. Offsets count code points and ends are exclusive.
    """
    thresholds = measure_bands(docs, text)

    @F.arrow_udf(SCAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = spans_of(t or "", thresholds)
            base = [s for s in spans if s[1] < 3]
            kinds = Counter(kind for _, kind, _ in spans)
            out.append(
                {
                    "n_assign": kinds[0],
                    "n_access": kinds[1],
                    "n_hex": kinds[2],
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "spans": joined(spans),
                    "n_random": kinds[3],
                }
            )
        longs = [(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")]
        texts_out = [(n, pa.string()) for n in ("base_sha256", "spans")]
        return pa.array(out, pa.struct(longs + texts_out + [("n_random", pa.int64())]))

    found = docs.select(F.col(doc_id), scan(F.col(text)).alias("found"))
    return found.select(doc_id, "found.*")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    if not spans:
        return text
    parts, at = [], 0
    open_start, open_end = None, -1
    for start, _, end in spans:
        if open_start is None or start > open_end:
            if open_start is not None:
                parts += [text[at:open_start], mark]
                at = open_end
            open_start, open_end = start, end
        else:
            open_end = max(open_end, end)
    parts += [text[at:open_start], mark, text[open_end:]]
    return "".join(parts)


def redact_secrets(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]"
) -> DataFrame:
    """All rows and columns of ``docs`` with secrets in the text replaced by ``mark``.

    ``n_chars``, where there is such a column, is counted again for changed texts. A null
    text stays null.
    """
    thresholds = measure_bands(docs, text)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(
            [None if t is None else redact(t, spans_of(t, thresholds), mark) for t in texts.to_pylist()],
            pa.string(),
        )

    new = free_name(docs, "cleaned")
    out = docs.withColumn(new, clean(F.col(text)))
    columns = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col(new).alias(text))
        elif name == n_chars:
            same = F.col(new).eqNullSafe(F.col(text))
            counted = F.char_length(new).cast(docs.schema[name].dataType)
            columns.append(F.when(same, F.col(name)).otherwise(counted).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return out.select(*columns)

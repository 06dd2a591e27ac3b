"""Main text of web pages: a recurrent labeller of text blocks.

A page is cut into blocks, the runs of text between block-level tags. Each block has a
vector: its tag path and the class and id words on it, hashed; its words, hashed; and a few
figures. A bidirectional LSTM in numpy reads the vectors of a page in order and says of
each block whether it is main text.

There are no labels, so the model is fitted on pages made from a bounded sample of the
table's own pages: their blocks, which semantic tags tell apart (``article`` and ``main``
against ``nav``, ``footer`` and the like), are set into layouts drawn from common container
names, with paragraphs of other pages as comments and sidebars.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import hash_share, lean_batches

# Element names of HTML.
RAW = ("script", "style", "template", "iframe", "svg", "textarea")
#: Of these only the tag goes where the page never closes the element.
CLOSED = frozenset(("template", "svg"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: An opening tag of the first kind ends an open element of the second.
ENDS_P = BLOCK - {"button", "caption", "legend", "option", "optgroup", "summary"}
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s>/]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s>/]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

PATH_SIZE, WORD_SIZE, FIGURES = 64, 24, 6
INPUTS = PATH_SIZE + WORD_SIZE + FIGURES
HIDDEN = 16
#: Pages of the sample, layouts made of each, and passes over them.
FIT_PAGES, LAYOUTS, EPOCHS, BATCH, STEP = 240, 4, 4, 32, 0.01
#: Pages labelled together, sorted by their number of blocks first, and blocks, padding
#: included, whose vectors are held at once: a very long page is read in pieces.
TOGETHER, HELD = 64, 8192
SEED = 5

# Tags and names that tell blocks apart in the sample.
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "head", "title", "header", "menu", "dialog"))
OTHER_NAMES = frozenset("ad ads advert sidebar comments comment cookie notice promo menu nav footer banner".split())


@dataclass
class Block:
    path: tuple[str, ...]  # words for each open element, outermost first
    text: str
    linked: int  # characters inside links


def name_words(rest: str) -> list[str]:
    """Lower-case words of class, id and role."""
    out = []
    for m in ATTRIBUTE.finditer(rest):
        for part in (m[1] or m[2] or m[3] or "").split():
            out += [w.lower() for w in NAME_PART.findall(part)]
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; scripts, styles and comments have none."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # (element, its words)
    parts: list[tuple[str, bool]] = []
    links = 0

    def settle() -> None:
        if not parts:
            return
        text = " ".join(references.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(p) for p, inside in parts if inside)
            found.append(Block(tuple(words for _, words in stack), text, linked))
        parts.clear()

    def close(names: tuple[str, ...], until: frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    at, end = 0, len(page)
    unclosed: set[str] = set()
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = m["close"] or m["close2"]
        if name in RAW and not closing:
            if not (m["rest"] or "").endswith("/") and name not in unclosed:
                ended = RAW_END[name].search(page, at)
                if ended:
                    at = ended.end()
                elif name in CLOSED:
                    unclosed.add(name)  # the page is not searched again for each such tag
                else:
                    at = end
            parts.append((" ", links > 0))
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name == "br":
            parts.append((" ", links > 0))
        elif name in BLOCK:
            settle()
            links = 0
            if closing:
                close((name,), frozenset(("html", "body")) - {name})
            elif name not in VOID:
                if name in ENDS_P:
                    close(("p",), frozenset(("div", "article", "section", "td", "li", "body", "main", "blockquote")))
                if name in SIBLINGS:
                    close(SIBLINGS[name], frozenset(("ul", "ol", "table", "dl", "select")))
                words = " ".join([name, *name_words(m["rest"] or m["rest2"] or "")])
                stack.append((name, words))
    settle()
    return found


def _bucket(word: str, size: int) -> tuple[int, float]:
    code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return code % size, 1.0 if (code >> 16) & 1 else -1.0


class Vectors:
    """Block vectors; those of paths and the places of words are kept for the next page."""

    KEPT = 200_000

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            known = np.zeros(PATH_SIZE, np.float32)
            for depth, element in enumerate(reversed(path)):
                tag, *names = element.split(" ")
                marks = [f"<{tag}", *names]
                if depth == 0:
                    marks.append(f"own {tag}")
                for mark in marks:
                    place, sign = _bucket(mark, PATH_SIZE)
                    known[place] += sign
            known = np.clip(known, -2, 2)
            if len(self.paths) > self.KEPT:
                self.paths = {}
            self.paths[path] = known
        return known

    def page(self, blocks: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
        """Vectors of a page's blocks, or of those from ``start`` to before ``stop``."""
        part = blocks[start:stop]
        out = np.zeros((len(part), INPUTS), np.float32)
        if len(self.words) > self.KEPT:
            self.words = {}
        known = self.words
        for i, b in enumerate(part, start):
            row = out[i - start]
            row[:PATH_SIZE] = self.path(b.path)
            words = b.text.split()
            for w in words:
                if w not in known:
                    known[w] = _bucket(w.lower(), WORD_SIZE)
            places = np.array([known[w] for w in words])
            sums = np.bincount(places[:, 0].astype(np.int64), places[:, 1], WORD_SIZE)
            row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = sums / np.sqrt(len(words))
            n = len(b.text)
            row[-FIGURES:] = (
                np.log1p(n) / 4,
                np.log1p(len(words)) / 3,
                min(1.0, b.linked / n),
                sum(map(b.text.count, ".,;:!?")) / len(words),
                i / len(blocks),
                len(b.path) / 8,
            )
        return out


@dataclass
class Labeller:
    """Weights of a bidirectional LSTM; gates in the order input, forget, output, cell."""

    inward: list[np.ndarray]  # inputs x 4 hidden, for each direction
    inner: list[np.ndarray]  # hidden x 4 hidden
    shift: list[np.ndarray]
    last: np.ndarray  # 2 hidden + 1

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        shift = [np.zeros(4 * HIDDEN, np.float32) for _ in range(2)]
        for s in shift:
            s[HIDDEN : 2 * HIDDEN] = 1.0
        return Labeller(
            [rng.normal(0, INPUTS**-0.5, (INPUTS, 4 * HIDDEN)).astype(np.float32) for _ in range(2)],
            [rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for _ in range(2)],
            shift,
            rng.normal(0, 0.2, 2 * HIDDEN + 1).astype(np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.inward, *self.inner, *self.shift, self.last]

    def step(self, d: int, fed: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates, cell input, new cell and its tanh for one block of each page."""
        z = fed + h @ self.inner[d]
        gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        new_c = f * c + i * g
        return i, f, o, g, new_c, np.tanh(new_c)

    def margins(self, pages: list[list[Block]], vectors: Vectors) -> np.ndarray:
        """Margins of pages x blocks alone: of the steps only the state is kept.

        Vectors are made for ``HELD`` blocks at a time, once for each direction where the
        pages are longer.
        """
        length = max(map(len, pages))
        piece = max(1, HELD // len(pages))
        out = np.full((len(pages), length), self.last[-1], np.float32)
        starts = range(0, length, piece)
        x = None
        for d in range(2):
            last = self.last[d * HIDDEN : (d + 1) * HIDDEN]
            h = np.zeros((len(pages), HIDDEN), np.float32)
            c = np.zeros((len(pages), HIDDEN), np.float32)
            for start in starts if d == 0 else reversed(starts):
                if x is None or len(starts) > 1:
                    x, mask = padded([vectors.page(p, start, start + piece) for p in pages])
                fed = (x.reshape(-1, INPUTS) @ self.inward[d] + self.shift[d]).reshape(*mask.shape, 4 * HIDDEN)
                here = range(mask.shape[1])
                for t in here if d == 0 else reversed(here):
                    _, _, o, _, new_c, squashed = self.step(d, fed[:, t], h, c)
                    on = mask[:, t : t + 1]
                    c = on * new_c + (1 - on) * c
                    h = on * (o * squashed) + (1 - on) * h
                    out[:, start + t] += h @ last
        return out

    def run(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Margins of pages x blocks, and what the backward pass needs, for fitting.

        Where ``mask`` is zero the state passes through, so padding changes nothing.
        """
        pages, length, _ = x.shape
        out = np.zeros((pages, length, 2 * HIDDEN), np.float32)
        memory = []
        for d in range(2):
            h = np.zeros((pages, HIDDEN), np.float32)
            c = np.zeros((pages, HIDDEN), np.float32)
            fed = x.reshape(-1, INPUTS) @ self.inward[d] + self.shift[d]
            fed = fed.reshape(pages, length, 4 * HIDDEN)
            steps = []
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                i, f, o, g, new_c, squashed = self.step(d, fed[:, t], h, c)
                on = mask[:, t : t + 1]
                steps.append((t, h, c, i, f, o, g, squashed, on))
                c = on * new_c + (1 - on) * c
                h = on * (o * squashed) + (1 - on) * h
                out[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
            memory.append(steps)
        return out @ self.last[:-1] + self.last[-1], [out, memory]

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean logistic loss, by backpropagation through time."""
        margin, (out, memory) = self.run(x, mask)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * mask / max(1.0, mask.sum())
        d_last = np.append(np.einsum("pt,pth->h", error, out), error.sum()).astype(np.float32)
        d_in, d_inner, d_shift = [], [], []
        for d in range(2):
            back = error[:, :, None] * self.last[d * HIDDEN : (d + 1) * HIDDEN]
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros((len(x), HIDDEN), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            inner = np.zeros_like(self.inner[d])
            for t, h, c, i, f, o, g, squashed, on in reversed(memory[d]):
                dh = dh + back[:, t]
                d_new_h = dh * on
                d_new_c = dc * on + d_new_h * o * (1 - squashed**2)
                dz = np.concatenate(
                    [
                        d_new_c * g * i * (1 - i),
                        d_new_c * c * f * (1 - f),
                        d_new_h * squashed * o * (1 - o),
                        d_new_c * i * (1 - g**2),
                    ],
                    1,
                )
                dz_all[:, t] = dz
                inner += h.T @ dz
                dh = dz @ self.inner[d].T + dh * (1 - on)
                dc = d_new_c * f + dc * (1 - on)
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            d_in.append(x.reshape(-1, INPUTS).T @ flat)
            d_inner.append(inner)
            d_shift.append(flat.sum(0))
        return [*d_in, *d_inner, *d_shift, d_last]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, pages))
    x = np.zeros((len(pages), length, INPUTS), np.float32)
    mask = np.zeros((len(pages), length), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def fit_labeller(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Labeller:
    """Adam on batches of pages (vectors, labels), in an order fixed by the seed."""
    rng = np.random.default_rng(SEED)
    model = Labeller.fresh(rng)
    weights = model.weights()
    means = [np.zeros_like(w) for w in weights]
    squares = [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for at in range(0, len(order), BATCH):
            part = [pages[i] for i in order[at : at + BATCH]]
            x, mask = padded([p for p, _ in part])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, labels) in enumerate(part):
                y[i, : len(labels)] = labels
            step += 1
            for w, g, m, s in zip(weights, model.slopes(x, mask, y), means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def semantic_label(block: Block) -> int | None:
    """1 inside main tags, 0 inside others, None where no tag tells."""
    for element in reversed(block.path):
        tag, *names = element.split(" ")
        if tag in OTHER_TAGS or OTHER_NAMES.intersection(names):
            return 0
        if tag in MAIN_TAGS:
            return 1
    return None


# Container names of common page layouts; the first word is the element.
CONTENT = (
    "article", "main", "article post", "div content", "div article body", "div post content",
    "div entry content", "section story", "div main", "div page content", "div text", "main content",
)
MENUS = ("nav", "div menu", "div nav", "ul navbar", "nav breadcrumb", "div top bar", "div navigation")
HEADS = ("header", "div header", "div masthead", "header site header", "div banner top")
FEET = ("footer", "div footer", "footer site footer", "div copyright", "div bottom")
SIDES = ("aside", "div sidebar", "aside related", "div widget", "div recommended", "div popular posts", "section related")
ADS = ("div ad", "div advert", "div ads banner", "div sponsored", "aside promo", "div advertisement")
NOTICES = ("div cookie notice", "div cookie consent", "div notice", "div alert", "div gdpr banner", "section notice", "dialog")
FORMS = ("form", "form search", "div newsletter", "form subscribe", "div login form", "div signup")
COMMENTS = ("div comments", "section comments", "ol comment list", "div comment", "div discussion", "section responses")
NOTICE_WORDS = (
    "We use cookies to improve this site.", "Accept all", "This page was updated.",
    "Read our privacy policy.", "Your browser is out of date.",
)
FORM_WORDS = ("Search", "Subscribe to our newsletter", "Email address", "Log in", "Submit", "Send")
COMMENT_WORDS = ("Reply", "Comments", "says:", "Great article, thanks!", "Anonymous wrote:")


def layouts(
    main: list[Block], others: list[Block], strangers: list[str], rng: np.random.Generator
) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages made from the main and other blocks of one page and paragraphs of others."""
    pick = lambda options: options[rng.integers(len(options))]
    words = [w for b in others for w in b.text.split()] or ["Home"]
    short = lambda: " ".join(pick(words) for _ in range(rng.integers(1, 5)))
    prose = lambda: pick(strangers) if strangers and rng.random() < 0.7 else short()

    for _ in range(LAYOUTS):
        base = ("html", "body") if rng.random() < 0.8 else ("html", "body", pick(("div wrapper", "div container", "div page", "div")))
        page: list[tuple[Block, int]] = []

        def add(path: tuple[str, ...], text: str, label: int, linked: bool = False) -> None:
            page.append((Block((*base, *path), text, len(text) if linked else 0), label))

        def menu() -> None:
            where = pick(MENUS)
            for _ in range(rng.integers(2, 9)):
                add((where, "ul", "li"), short(), 0, True)

        def part(where: str, texts: list[str], inner: tuple[str, ...] = ("p",)) -> None:
            for text in texts:
                add((where, *inner) if rng.random() < 0.7 else (where,), text, 0)

        before = [menu] if rng.random() < 0.9 else []
        if rng.random() < 0.5:
            before.append(lambda: part(pick(HEADS), [short(), prose()][: rng.integers(1, 3)]))
        extras = [
            (0.5, lambda: part(pick(ADS), [prose()])),
            (0.5, lambda: part(pick(NOTICES), [pick(NOTICE_WORDS), prose()][: rng.integers(1, 3)])),
            (0.4, lambda: part(pick(FORMS), [pick(FORM_WORDS), short()], ("label",))),
            (0.5, lambda: part(pick(SIDES), [prose() for _ in range(rng.integers(1, 4))], ("ul", "li"))),
        ]
        after = []
        for chance, piece in extras:
            if rng.random() < chance:
                (before if rng.random() < 0.5 else after).append(piece)
        if rng.random() < 0.5:
            after.append(
                lambda: part(
                    pick(COMMENTS),
                    [pick(COMMENT_WORDS)] + [prose() for _ in range(rng.integers(1, 5))],
                    pick((("p",), ("li", "p"), ("div comment", "p"), ("div comment body",))),
                )
            )
        if rng.random() < 0.85:
            after.append(lambda: part(pick(FEET), [short() if rng.random() < 0.5 else prose()]))
        page.append((Block(("html", "head", "title"), main[0].text[:60], 0), 0))
        for i in rng.permutation(len(before)):
            before[i]()
        where = (pick(CONTENT),) if rng.random() < 0.9 else ()
        inside = int(rng.integers(len(main))) if rng.random() < 0.6 else -1
        for i, b in enumerate(main):
            own = b.path[-1].split(" ")[0]
            tag = own if own in ("p", "h1", "h2", "h3", "li", "blockquote") else "p"
            add((*where, tag) if rng.random() < 0.95 else where, b.text, 1)
            if i == inside:
                extra = pick((pick(ADS), pick(SIDES), pick(NOTICES)))
                add((*where, extra), prose(), 0)
        order = sorted(range(len(after)), key=lambda _: rng.random())
        for i in order:
            after[i]()
        yield [b for b, _ in page], [label for _, label in page]


def fit_pages(pages: list[str]) -> Labeller:
    """A labeller from raw pages, by the layouts made of them and by the pages themselves."""
    rng = np.random.default_rng(SEED)
    cut = [blocks_of(p) for p in pages]
    told = [[semantic_label(b) for b in blocks] for blocks in cut]
    prose = [
        [b.text for b, label in zip(blocks, labels) if label == 1]
        for blocks, labels in zip(cut, told)
    ]
    vectors, made = Vectors(), []
    for i, (blocks, labels) in enumerate(zip(cut, told)):
        main = [b for b, label in zip(blocks, labels) if label == 1]
        if not main:
            continue
        others = [b for b, label in zip(blocks, labels) if label == 0]
        strangers = prose[(i + 1) % len(cut)] + prose[(i + 7) % len(cut)]
        made.append((vectors.page(blocks), np.array([1.0 if x else 0.0 for x in labels], np.float32)))
        for own, wanted in layouts(main, others, strangers, rng):
            made.append((vectors.page(own), np.array(wanted, np.float32)))
    return fit_labeller(made) if made else Labeller.fresh(rng)


def label_pages(model: Labeller, pages: list[list[Block]], vectors: Vectors) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    kept = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        upto = at + 1
        # The next page is the longest so far, so all others are padded to it.
        while upto < len(order) and upto - at < TOGETHER and (upto + 1 - at) * len(pages[order[upto]]) <= HELD:
            upto += 1
        part = order[at:upto]
        margin = model.margins([pages[i] for i in part], vectors)
        for row, i in enumerate(part):
            kept[i] = margin[row, : len(pages[i])] > 0
        at = upto
    return kept


def main_texts(model: Labeller, pages: list[str | None], vectors: Vectors) -> list[str]:
    cut = [blocks_of(p or "") for p in pages]
    kept = label_pages(model, cut, vectors)
    return [
        "\n".join(b.text for b, keep in zip(blocks, keeps) if keep)
        for blocks, keeps in zip(cut, kept)
    ]


def fit_on(pages: DataFrame, page_id: str = "page_id", html: str = "html", fit_pages_at_most: int = FIT_PAGES) -> Labeller:
    """A labeller from a bounded sample of the pages, chosen by a hash of their id."""
    usable = pages.where(F.col(html).isNotNull()).where(f"`{page_id}` is not null")
    n = usable.count()
    rows = (
        usable.where(hash_share(page_id, SEED, 2 * fit_pages_at_most / max(1, n)))
        .select(page_id, html)
        .orderBy(F.xxhash64(page_id, F.lit(SEED + 1)), page_id, html)
        .limit(fit_pages_at_most)
        .collect()
    )
    return fit_pages([r[1] for r in rows])


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, ``text``, ``n_chars``) of each row of ``pages``.

    The text holds the blocks said to be main text, joined by line ends; it is empty for
    null or empty pages and where no block is. Repeated rows and null ids give rows of
    their own; other columns are left out. If no page of the sample has a semantic main
    element the labeller stays as it was drawn and its texts mean little.
    """
    lean_batches(pages.sparkSession)
    model = fit_on(pages, page_id, html)

    @F.arrow_udf("string")
    def read(found: pa.Array) -> pa.Array:
        return pa.array(main_texts(model, found.to_pylist(), Vectors()), pa.string())

    texts = pages.select(page_id, url, read(F.col(html)).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))

"""Token counts under a unigram model, by dynamic programming on a shared trie.

Pre-tokens are scored by a unigram language model over a byte-level vocabulary: a piece of
rank r has Zipf probability proportional to 1 / (r + 1), and a pre-token is cut into the
pieces with the greatest product. The distinct pre-tokens of a batch form a trie. A node's
forward score depends on the path above it only, so it is computed once for all pre-tokens
with that prefix; the node where a pre-token ends gives its count, which is kept for the
rest of the task.
"""

from __future__ import annotations

import base64
import math
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlens.llm.common import lean_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that goes with the vocabulary.
PRE_TOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Counts kept in a task; beyond that the store starts anew, which changes no result.
KEPT_COUNTS = 400_000
#: Pre-tokens handled at a time in a long text.
CHUNK = 1 << 17


def zipf_scores(vocabulary: str = VOCABULARY) -> dict[bytes, float]:
    """Log probability of each piece; the file has a piece in base64 and its rank a line."""
    ranks = {}
    with open(vocabulary, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            ranks[base64.b64decode(piece)] = int(rank)
    total = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class TrieCounter:
    """Best-path piece counts of pre-tokens, one forward score for each trie node."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        #: Longest piece that ends in each byte: no need to look further back.
        self.reach = [0] * 256
        for piece in scores:
            self.reach[piece[-1]] = max(self.reach[piece[-1]], len(piece))
        if not all(self.reach):
            raise ValueError("the vocabulary must hold every single byte")
        self.counts: dict[str, int] = {}
        self.nodes = 0

    def learn(self, words: set[str]) -> None:
        """Count new pre-tokens.

        In byte order the trie is walked depth first; the stacks hold the scores and piece
        counts of the path, and the part shared with the word before is kept.
        """
        score_of, reach = self.scores.get, self.reach
        best, pieces = [0.0], [0]
        before = b""
        for word, text in sorted((w.encode(), w) for w in words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, count = -math.inf, 0
                for start in range(max(0, end - reach[word[end - 1]]), end):
                    score = score_of(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or (score == top and pieces[start] < count - 1):
                            top, count = score, pieces[start] + 1
                best.append(top)
                pieces.append(count)
            self.nodes += len(word) - shared
            self.counts[text] = pieces[-1]
            before = word

    def count_all(self, texts: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens."""
        new = set().union(*texts) if texts else set()
        if len(self.counts) > KEPT_COUNTS:
            self.counts = {}
        new -= self.counts.keys()
        self.learn(new)
        known = self.counts.__getitem__
        return [sum(map(known, t)) for t in texts]


def count_tokens(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(id, ``n_pretokens``, ``n_tokens``) of each row of ``docs``; whole texts.

    Null and empty texts have no tokens. Repeated rows and null ids give rows of their
    own, other columns are left out. Nothing is shuffled: a task keeps its own trie.
    """
    lean_batches(docs.sparkSession)
    scores = docs.sparkSession.sparkContext.broadcast(zipf_scores(vocabulary))

    def count(batches):
        pattern = regex.compile(PRE_TOKEN)
        counter = TrieCounter(scores.value)
        for batch in batches:
            pre, tokens = [], []
            waiting: list[list[str]] = []
            rows: list[int] = []
            held = 0

            def settle():
                nonlocal held
                for row, n in zip(rows, counter.count_all(waiting)):
                    tokens[row] += n
                waiting.clear()
                rows.clear()
                held = 0

            for row, t in enumerate(batch.column(1).to_pylist()):
                pre.append(0)
                tokens.append(0)
                found = (m.group() for m in pattern.finditer(t or ""))
                while part := list(islice(found, CHUNK)):
                    pre[row] += len(part)
                    waiting.append(part)
                    rows.append(row)
                    held += len(part)
                    if held >= CHUNK:
                        settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64())],
                [doc_id, "n_pretokens", "n_tokens"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        count, f"`{doc_id}` {kind}, n_pretokens bigint, n_tokens bigint"
    )

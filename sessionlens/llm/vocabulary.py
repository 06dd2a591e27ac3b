"""Vocabulary files of public tokenizers, read on the driver and sent to the tasks as bytes."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import regex

FOLDER = "/opt/tokenizers"
RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
BYTE_MODEL = f"{FOLDER}/byte_bpe_50k.json"
PIECE_MODEL = f"{FOLDER}/piece_bpe_32k.model"
# Fixed value: the pattern that cuts a text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a long text that are held at a time.
CHUNK = 1 << 17
#: Distinct pre-tokens remembered by a task; beyond that its memory starts anew, which
#: changes no result.
REMEMBERED = 400_000


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(lines: bytes) -> dict[bytes, int]:
    """Rank of each token; a line holds the token in base64 and its rank."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def byte_of_symbol() -> dict[str, int]:
    """The byte behind each printable symbol of a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, are
    the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(model: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary in JSON; special tokens as they are written."""
    byte = byte_of_symbol()
    parsed = json.loads(model)
    entries = parsed["model"]["vocab"]
    special = {t["id"]: t["content"] for t in parsed.get("added_tokens", [])}
    table = [b""] * (max([*entries.values(), *special]) + 1)
    for symbols, token in entries.items():
        table[token] = bytes(byte[s] for s in symbols) if token not in special else b""
    for token, content in special.items():
        table[token] = content.encode()
    return table


def chunks_of_words(text: str, pattern: regex.Pattern, size: int = CHUNK) -> Iterator[list[str]]:
    """The pre-tokens of a text, some at a time."""
    if len(text) <= size:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, size)):
        yield part


class WordIds:
    """Token ids of texts from those of their pre-tokens, each distinct one encoded once.

    A pre-token is remembered by a number; the ids of all numbers lie in one array, from
    which those of a text are gathered.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pattern: str):
        self.encode = encode
        self.pattern = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._flat = self._start = self._size = np.empty(0, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        sizes = np.zeros(len(texts), np.int64)
        found, words, owners = [np.empty(0, np.int64)], [], []

        def settle():
            numbers = self._numbers(words)
            of_word = self._size[numbers]
            upto = np.cumsum(of_word)
            at = np.arange(upto[-1] if len(upto) else 0)
            at += np.repeat(self._start[numbers] - upto + of_word, of_word)
            found.append(self._flat[at])
            texts_of = np.repeat([t for t, _ in owners], [n for _, n in owners])
            np.add.at(sizes, texts_of, of_word)
            words.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for part in chunks_of_words(text, self.pattern):
                words += part
                owners.append((i, len(part)))
                if len(words) >= CHUNK:
                    settle()
        if words:
            settle()
        return np.concatenate(found), sizes

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self._number)
        if len(self._number) + len(new) > REMEMBERED:
            self._forget()
            new = set(words)
        if new:
            listed = list(new)
            ids = self.encode(listed)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._number.update(zip(listed, range(len(self._number), len(self._number) + len(ids))))
            self._start = np.concatenate([self._start, len(self._flat) + np.cumsum(sizes) - sizes])
            self._size = np.concatenate([self._size, sizes])
            self._flat = np.concatenate([self._flat, np.fromiter(chain.from_iterable(ids), np.int64)])
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

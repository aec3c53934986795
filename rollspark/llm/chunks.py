"""Byte-level BPE of whole texts by chunks that begin at spaces, so that most chunks come from a cache."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken


class _Merge(Exception):
    """A piece that cannot stand alone."""


@lru_cache(4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding_of(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={})


class _Cache(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace():
            raise _Merge
        if len(self) >= self.most:
            self.clear()
        made = self[piece] = self.make(" " + piece)
        return made


class Chunks:
    """Maps a text to the values of its chunks, in order.

    A space before a character that is no white space always begins a match of the pattern, so the text may be cut there
    and each chunk handled alone. ``make`` gives a chunk's value; at most ``most`` values are kept.
    """

    def __init__(self, make, most: int = 300_000):
        self.make, self.cache = make, _Cache(make, most)

    def __call__(self, text: str) -> list:
        head, *rest = text.split(" ")
        try:
            found = [self.cache[p] for p in rest]
        except _Merge:
            return [self.make(c) for c in merged(head, rest)]
        return [self.make(head), *found] if head else found


def merged(head: str, rest: list[str]) -> list[str]:
    out, run = [], [head]
    for p in rest:
        if p and not p[0].isspace():
            out.append(" ".join(run))
            run = ["", p]
        else:
            run.append(p)
    out.append(" ".join(run))
    return [c for c in out if c]


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, whose text stands for one id."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class IdBytes:
    """Ids of whole texts as little-endian unsigned 32-bit chunks; texts are cut at the added tokens first, the leftmost longest."""

    def __init__(self, path: str, added: dict[str, int]):
        encoding = encoding_of(path)
        self.chunks = Chunks(lambda chunk: np.asarray(encoding.encode_ordinary(chunk), "<u4").tobytes())
        self.added = {content: np.asarray([i], "<u4").tobytes() for content, i in added.items()}
        self.split = re.compile("|".join(f"({re.escape(c)})" for c in sorted(added, key=len, reverse=True))).split if added else None

    def __call__(self, text: str) -> list[bytes]:
        if not any(c in text for c in self.added):
            return self.chunks(text)
        out = []
        for part in self.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.chunks(part)
        return out


@lru_cache(4)
def _id_bytes(path: str, added: tuple) -> IdBytes:
    return IdBytes(path, dict(added))


def id_bytes(path: str, added: dict[str, int] | None = None) -> IdBytes:
    return _id_bytes(path, tuple(sorted((added or {}).items())))

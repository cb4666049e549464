"""Byte-level BPE over chunks that no merge and no pre-token crosses.

A chunk begins at the start of a text or at a single space between two characters that
are no white space. The pre-tokenizer pattern takes a space only as the first character of
a pre-token or inside a run of white space, so a pre-token always begins at such a space:
chunks can be tokenized alone, and equal chunks share one cached result.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata

import regex
import tiktoken
from tokenizers import Tokenizer

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADJACENT = re.compile(r"\s\s")
SAFE = re.compile(r"(?<=\S) (?=\S)")
_OLD = unicodedata.ucd_3_2_0


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def settled(text: str) -> bool:
    """All its characters were assigned in Unicode 3.2, so every library has them in the same class."""
    return text.isascii() or all(_OLD.category(c) != "Cn" for c in text)


class ByteBpe:
    """The tokenizer of a tokenizers .json file: byte level, default pattern, no normalizer."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer is asked for")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = _alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with matching rules of their own are not known here")
        self.special = special
        self.special_rx = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = spec["model"]["vocab"]
        self.by_bytes = {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of the merges")
        made = set(order)  # a string that no merge makes is no token of any text, unless it is one byte
        ranks = {b: i for b, i in self.by_bytes.items() if len(b) == 1 or i in made}
        self.merger = tiktoken.Encoding("bytefacts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def pieces(self, text: str) -> list[str | int]:
        """The text cut at special tokens; those come as ids."""
        if self.special_rx is None or not any(s in text for s in self.special):
            return [text]
        return [self.special[x] if x in self.special else x for x in self.special_rx.split(text) if x]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk without special tokens."""
        if not chunk:
            return []
        if settled(chunk):
            return self.merger.encode_ordinary(chunk)
        return self.library.encode(chunk, add_special_tokens=False).ids


def chunks(text: str) -> list[str]:
    """The first chunk as it is, the others without the space they begin with."""
    return SAFE.split(text) if ADJACENT.search(text) else text.split(" ")


class Cache(dict):
    """Of chunks, in two generations: when the young one is full it becomes the old one, whose entries come back
    as they are asked for. So memory is bounded, frequent chunks stay, and results never depend on it."""

    def __init__(self, make, limit: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}

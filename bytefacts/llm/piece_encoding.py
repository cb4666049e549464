"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks the text once: at each position the longest prefix found in the
compiled character map is replaced, else one character is kept, and every normalised byte
records the original bytes it came from. White space becomes U+2581 after the dummy prefix. The
pieces of the normalised text tile it, so each piece projects to a span of original bytes.

No piece of the vocabulary holds U+2581 after another character (checked when the model is
read), so no merge crosses the place before a run of U+2581: such chunks are encoded
alone, and equal chunks share one cached result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from bytefacts.llm import common
from bytefacts.llm.bpe import Cache

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


def proto_fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) pairs of a protocol buffer message."""
    at, out = 0, []

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            out.append((key >> 3, varint()))
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            out.append((key >> 3, raw[at : at + size]))
            at += size
    return out


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :]
        #: Bytes that an entry may begin with.
        self.heads = np.array([bool(self.units) and self._begins(b) for b in range(256)])

    def _begins(self, byte: int) -> bool:
        root = self.units[0]
        node = ((root >> 10) << ((root & 512) >> 6)) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, offset of the replacement) of the longest prefix at `at`; (0, 0) if there is none."""
        found, units = (0, 0), self.units
        if not units:
            return found
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def replacement(self, offset: int) -> bytes:
        return self.replacements[offset : self.replacements.index(0, offset)]


@dataclass
class Normalised:
    text: str
    #: For each normalised byte, and one past the last, the original byte offset it stands at.
    origin: np.ndarray


class Model:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        raw = proto if proto is not None else open(path, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        top = proto_fields(raw)
        spec = dict(proto_fields(next((v for f, v in top if f == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        pieces = [dict(proto_fields(v)) for f, v in top if f == 1]
        names = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, 1) for p in pieces]
        self.cuttable = self.escape and not any(SPACE in s.lstrip(SPACE) for s in names) and not any(k == 4 for k in self.kinds)
        self.identity = not self.map.units and not self.squeeze and self.dummy_prefix and self.cuttable
        self.lone = self.library.piece_to_id(SPACE)
        #: Bytes that a piece takes of the normalised text.
        self.sizes = np.array([1 if k == 6 else len(s.encode()) for s, k in zip(names, self.kinds, strict=True)], dtype=np.int64)
        self.after_space = Cache(lambda word: self.pack(self.chunk(SPACE + word)), 350_000)
        self.runs = Cache(lambda chunk: self.pack(self.chunk(chunk)), 50_000)

    def normalise(self, text: str) -> Normalised:
        """Normalised text with its alignment, as the model's own rules say.

        Only bytes that may begin an entry of the map, and spaces, are looked up; what lies between them stands for itself.
        """
        raw = text.encode()
        mark = SPACE.encode() if self.escape else b" "
        x = np.frombuffer(raw, dtype=np.uint8)
        if not self.squeeze and not self.map.units:  # nothing to look up: each byte stands for itself, each space for its mark
            if not raw:
                return Normalised("", np.zeros(1, dtype=np.int64))
            origin = np.repeat(np.arange(len(x)), np.where(x == 32, len(mark), 1))
            lead = np.zeros(len(mark) * self.dummy_prefix, dtype=np.int64)
            return Normalised((" " * self.dummy_prefix + text).replace(" ", mark.decode()), np.concatenate([lead, origin, [len(raw)]]))
        stops = np.flatnonzero(self.map.heads[x] | (x == 32)).tolist()
        out, origin, at, n, k = bytearray(), [], 0, len(raw), 0
        if self.squeeze:
            while at < n:
                size, value = self._one(raw, at)
                if value != b" ":
                    break
                at += size
        if at == n:
            return Normalised("", np.array([n], dtype=np.int64))
        if self.dummy_prefix:
            out += mark
            origin += [at] * len(mark)
        gap = self.squeeze
        while at < n:
            while k < len(stops) and stops[k] < at:
                k += 1
            stop = stops[k] if k < len(stops) else n
            if stop > at:  # a run without anything to look up
                out += raw[at:stop]
                origin += range(at, stop)
                at, gap = stop, False
                continue
            size, value = self._one(raw, at)
            while gap and value.startswith(b" "):
                value = value[1:]
            if value:
                put = value.replace(b" ", mark)
                out += put
                origin += [at] * len(put)
                gap = self.squeeze and value.endswith(b" ")
            at += size
        end = n
        if self.squeeze:
            while out.endswith(mark):
                end = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        return Normalised(out.decode("utf-8", "replace"), np.array([*origin, end], dtype=np.int64))

    def _one(self, raw: bytes, at: int) -> tuple[int, bytes]:
        size, offset = self.map.longest(raw, at)
        if size:
            return size, self.map.replacement(offset)
        b = raw[at]
        size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return size, raw[at : at + size]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a run of U+2581 and what follows; the library puts the first U+2581 itself."""
        return [self.lone] if chunk == SPACE else self.library.encode(chunk[1:], num_threads=1)

    @staticmethod
    def pack(ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as decimal text, and as little-endian 32-bit numbers."""
        return ",".join(map(str, ids)).encode(), array("I", ids).tobytes()

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(ids as decimal text joined by commas, ids, end of each piece in original bytes): normalised with its alignment, encoded, projected."""
        if not text:
            return b"", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        norm = self.normalise(text)
        if not self.identity:  # the library's own rules for the text as it is; normalised chunks need not be fixed points of them
            ids = np.array(self.library.encode(text, num_threads=1), dtype=np.int64)
            return ",".join(map(str, ids.tolist())).encode(), ids, self.project(norm, ids)
        words = norm.text[1:].split(SPACE)
        if "" in words or SPACE in text:
            got = list(map(self.runs.__getitem__, CHUNK.findall(norm.text)))
        else:
            got = list(map(self.after_space.__getitem__, words))
        said, packed = zip(*got, strict=True)
        ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
        return b",".join(said), ids, self.project(norm, ids)

    def project(self, norm: Normalised, ids: np.ndarray) -> np.ndarray:
        """Where each piece ends in the original bytes: the pieces tile the normalised text."""
        size = len(norm.origin) - 1
        sizes = self.sizes[ids]
        if int(sizes.sum()) != size:  # an unknown piece stands for what no other piece takes; read its surface
            sizes = np.array([len(s.encode()) for s in self.library.encode(norm.text.removeprefix(SPACE), out_type=str)], dtype=np.int64)
        return norm.origin[np.minimum(np.cumsum(sizes), size)]

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """(id, piece, start, end) in original bytes; spans tile the text."""
        _, ids, ends = self.encode(text)
        starts = [0, *ends[:-1].tolist()] if len(ends) else []
        return [(i, self.library.id_to_piece(i), a, b) for i, a, b in zip(ids.tolist(), starts, ends.tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, ends: per text its piece ids and where each piece ends in the UTF-8 bytes of the text.

    Null texts count as empty (no pieces); null ids stay; repeated rows stay; an empty table
    gives an empty one. Whole texts, one pass, no shuffle.
    """

    def kernel(ids: list, texts: list) -> dict:
        m = model(path)
        got = [m.encode(t) for t in texts]
        return {"doc_id": ids, "ids": [x.tolist() for _, x, _ in got], "ends": [e.tolist() for _, _, e in got]}

    return common.map_texts(docs, "doc_id long, ids array<int>, ends array<long>", kernel, id_col, text_col)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, SHA-256 of its ids and of the decoded text, CRC-32 of the piece ends.

    ends_crc32 is over the ends as little-endian 64-bit numbers. Edge cases as in encode_pieces.
    """

    def kernel(ids: list, texts: list) -> dict:
        m = model(path)
        out: dict[str, list] = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ends_crc32": []}
        for t in texts:
            said, pieces, ends = m.encode(t)
            out["n_tokens"].append(len(pieces))
            out["ids_sha256"].append(hashlib.sha256(said).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(m.library.decode(pieces.tolist()).encode() if len(pieces) else b"").hexdigest())
            out["ends_crc32"].append(zlib.crc32(ends.astype("<i8").tobytes()))
        return out

    return common.map_texts(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_crc32 long", kernel, id_col, text_col)


def op1_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Packing along a space-filling curve.

Each text becomes a vector of hashed byte trigrams, projected to three dimensions and placed on a
Hilbert curve. Documents are range-sorted by their key (ties by doc_id and source partition, so copies may fall into several
ranges). Ranges are cut to like numbers of bytes by a sample of about SAMPLE rows for each, so a key is worked out once
for each document; where they are cut decides nothing but the work of a task. Each range is packed on its own: its token stream is cut every CAPACITY tokens, and what is
left at its end is cut into sequences of powers of two, which need no padding. No step needs more than
one sequence in memory besides the text at hand.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.llm import common
from bytefacts.llm.bpe import Cache, byte_bpe, chunks

CAPACITY = 1024
BUCKETS, DIMENSIONS, BITS, SEED = 4096, 3, 16, 11


@functools.cache
def projection() -> np.ndarray:
    r = np.random.default_rng(SEED)
    return np.linalg.qr(r.standard_normal((BUCKETS, DIMENSIONS)))[0]


def vector(raw: bytes) -> np.ndarray:
    """Position of a text in [-1, 1] ** DIMENSIONS."""
    counts = np.zeros(BUCKETS)
    for at in range(0, max(len(raw) - 2, 1), 1 << 20):
        a = np.frombuffer(raw, dtype=np.uint8, count=min(len(raw) - at, (1 << 20) + 2), offset=at).astype(np.uint32)
        if len(a) >= 3:
            h = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
            counts += np.bincount(h, minlength=BUCKETS)
    norm = np.sqrt((counts * counts).sum())
    return counts @ projection() / norm if norm else np.zeros(DIMENSIONS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of cells (rows x dimensions, unsigned, `bits` bits each)."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(n):
            inverts = (x[i] & q) != 0
            t = np.where(inverts, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(inverts, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve_keys(texts: list[str | None]) -> np.ndarray:
    z = np.stack([vector((t or "").encode()) for t in texts]) if texts else np.zeros((0, DIMENSIONS))
    return hilbert(np.clip((z + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)).astype(np.int64)


def curve_key(text: Column) -> Column:
    """The Hilbert key of a text column."""

    def keys(texts: pa.Array) -> pa.Array:
        return pa.array(curve_keys(texts.to_pylist()), type=pa.int64())

    return F.arrow_udf(keys, "long")(text)


#: What documents are sorted by: rows of one id and text still differ in where they were read.
ORDER = ("curve_key", "doc_id", "part")
#: Rows in the sample for each range.
SAMPLE = 100
_PLACE = np.dtype([("key", "<i8"), ("id", "<i8"), ("part", "<i8")])


def _places(key: pa.Array, doc_id: pa.Array, part: pa.Array) -> np.ndarray:
    """Rows of ORDER as they sort: a null id comes first."""
    out = np.empty(len(key), dtype=_PLACE)
    for name, column, none in (("key", key, 0), ("id", doc_id, np.iinfo(np.int64).min), ("part", part, 0)):
        out[name] = column.fill_null(none).to_numpy(zero_copy_only=False)
    return out


def range_ends(docs: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """Where each range of docs (text, doc_id, part) but the last ends, as of _places: about as many bytes in each. Gathers some SAMPLE rows of four numbers for each range."""
    share = min(1.0, SAMPLE * ranges / max(rows, 1))
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + 64  # a row costs something even without text
    sample = docs if share == 1.0 else docs.sample(share, 17)
    seen = sample.withColumn("curve_key", curve_key(F.col("text"))).select(*ORDER, weight.cast("long").alias("weight")).toArrow()
    places = _places(*(seen.column(c).combine_chunks() for c in ORDER))
    order = np.argsort(places, order=_PLACE.names)
    sums = np.cumsum(seen.column("weight").to_numpy()[order])
    return np.unique(places[order][np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges)]) if len(sums) else places


def placed_in(ends: np.ndarray) -> Column:
    """struct(curve_key, range) of rows (text, doc_id, part): both from one call, so a task keeps one worker."""

    def place(texts: pa.Array, doc_id: pa.Array, part: pa.Array) -> pa.Array:
        key = pa.array(curve_keys(texts.to_pylist()), type=pa.int64())
        number = pa.array(np.searchsorted(ends, _places(key, doc_id, part)), type=pa.int32())
        return pa.StructArray.from_arrays([key, number], names=["curve_key", "range"])

    return F.arrow_udf(place, "struct<curve_key:long,range:int>")("text", "doc_id", "part")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.bpe = bpe = byte_bpe(path)
        merge = bpe.chunk_ids
        self.first = Cache(lambda c: array("I", merge(c)).tobytes(), 20_000)
        self.rest = Cache(lambda c: array("I", merge(" " + c)).tobytes())

    def encode(self, text: str) -> bytes:
        out = []
        for x in self.bpe.pieces(text):
            if isinstance(x, int):
                out.append(x.to_bytes(4, "little"))
            else:
                words = chunks(x)
                out.append(self.first[words[0]])
                out.append(b"".join(map(self.rest.__getitem__, words[1:])))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Cuts a stream of documents into sequences; rows are (document, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.base, self.capacity, self.sequence, self.used, self.open = base, capacity, 0, 0, []

    def add(self, document: object, ids: bytes) -> Iterator[tuple]:
        """The rows of the sequences that this document fills."""
        total, at = len(ids) // 4, 0
        view = memoryview(ids)
        while at < total:
            take = min(total - at, self.capacity - self.used)
            self.open.append((document, at, view[4 * at : 4 * (at + take)], total))
            self.used += take
            at += take
            if self.used == self.capacity:
                yield from self._close(self.capacity)

    def finish(self) -> Iterator[tuple]:
        """What is left, in sequences of powers of two."""
        while self.used:
            yield from self._close(1 << (self.used.bit_length() - 1))

    def _close(self, size: int) -> Iterator[tuple]:
        """Emits the first `size` open tokens as one sequence."""
        offset, rest = 0, []
        for document, start, ids, total in self.open:
            n = len(ids) // 4
            take = min(n, size - offset)
            if take:
                yield document, start, take, zlib.crc32(ids[: 4 * take]), total, self.base + self.sequence, offset
                offset += take
            if take < n:
                rest.append((document, start + take, ids[4 * take :], total))
        self.sequence += 1
        self.open, self.used = rest, self.used - size


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most `capacity` tokens (columns FIELDS, all long, and curve_key).

    A document is its ids and then end_id, so a null or empty text is one token. Null ids stay null (all the pieces
    of such rows have a null doc_id); repeated rows are packed each; an empty table gives an empty one; extra columns are
    ignored. A sequence shorter than `capacity` has a power of two of tokens, so nothing is padded.
    """
    spark = docs.sparkSession
    common.ship(spark)
    schema = ", ".join(f"{k} long" for k in (*FIELDS, "curve_key"))
    target = common._arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).encode, Packer(TaskContext.get().partitionId() << 40, capacity)
        end, last_text, last_ids = end_id.to_bytes(4, "little"), None, b""

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            who, *columns = zip(*rows, strict=True)
            doc_ids, keys = zip(*who, strict=True)
            columns = [doc_ids, *columns, keys]
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], schema=target)

        for batch in batches:
            for part in common.slices(batch, "text"):
                rows: list[tuple] = []
                for doc_id, text, key in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "curve_key")), strict=True):
                    if text != last_text or not last_ids:  # copies follow each other along the curve
                        last_text, last_ids = text, encode(text or "") + end
                    rows += packer.add((doc_id, key), last_ids)
                if rows:
                    yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    rows = common.documents(docs, id_col, text_col).withColumn("part", F.spark_partition_id().cast("long"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = range_ends(rows, docs.count(), ranges)
    placed = rows.withColumn("place", placed_in(ends)).select("doc_id", "text", "part", "place.curve_key", "place.range")
    dealt = placed.repartitionById(len(ends) + 1, "range").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

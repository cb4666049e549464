"""Exact top-k inner products by an impact-ordered index, score at a time.

Vectors are hashed into blocks of about BLOCK rows. In a block, each dimension has a posting list cut
into segments by quantised impact (the magnitude of the component); all segments of the block are
processed in descending impact, for a bounded batch of queries at a time, into one accumulator per vector and query. What
a vector can still gain is bounded by the query's length times the length of the vector's components not
processed yet, by the query's largest magnitude times their sum, and by the sum of the query's magnitudes times the
largest impact left. The k-th best lower bound of a query proves which vectors cannot be among its best;
processing stops as soon as rescoring the rest exactly costs less than the levels that are left.

A block's index is built once, in the task that then reads the queries as a stream; neither is gathered whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefacts.llm import common

K, SCALE, EVERY = 5, 256, 50
BLOCK, BATCH, LEVELS = 8192, 512, 24
#: From this share of all components on, a level's segments are added as one matrix product.
DENSE = 0.02
PROBES = 8
#: Scores up to this are rescored in 64-bit integers, others in Python's.
EXACT = float(1 << 62)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


class Index:
    """Posting segments of a block, in descending quantised impact."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.x = vectors
        real = vectors.astype(np.float64)
        size = np.abs(real)
        self.largest = float(size.max(initial=0))
        width = max(1.0, np.ceil((self.largest + 1) / levels))
        level = (size // width).astype(np.int64)
        found = []
        for v in range(int(self.largest // width), -1, -1):
            values = np.where(level == v, real, 0)
            if values.any():
                found.append((values, (v * width)))
        # after each step: largest impact left, length and sum of what is left of each vector, share of components left
        squares, sums, share = np.zeros(len(real)), np.zeros(len(real)), 0.0
        self.steps, most = [], 0.0
        for values, floor in reversed(found):
            here = values != 0
            if here.mean() > DENSE:  # most segments are long: one product adds them all
                segments = values
            else:
                segments = [(d, ids, values[ids, d]) for d in range(values.shape[1]) if len(ids := np.flatnonzero(here[:, d]))]
            self.steps.append((segments, most, np.sqrt(squares), sums, share))
            squares, sums, share, most = squares + (values * values).sum(axis=1), sums + np.abs(values).sum(axis=1), share + here.mean(), floor + width
        self.steps.reverse()
        self.longest = float(np.sqrt(squares.max(initial=0)))
        #: Steps that the batches so far have taken, of all there are.
        self.taken: list[tuple[int, int]] = []

    def candidates(self, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query row, positions of the possible members of its top k); q: queries x dimensions."""
        n, b = len(self.x), len(q)
        if n <= 4 * k or not self.steps:
            yield from ((i, np.arange(n)) for i in range(b))
            return
        weights, acc = q.astype(np.float64), np.zeros((n, b))
        length, total, top = np.sqrt((weights**2).sum(axis=1)), np.abs(weights).sum(axis=1), np.abs(weights).max(axis=1)
        slack = 1e-3 + 1e-12 * self.longest * length  # what double arithmetic may have lost
        for step, (segments, most, rest, sums, share) in enumerate(self.steps):
            if isinstance(segments, np.ndarray):
                acc += segments @ weights.T
            else:
                for d, ids, value in segments:
                    acc[ids] += value[:, None] * weights[:, d]
            last = step == len(self.steps) - 1
            for part in (slice(0, PROBES), slice(None)):  # a few queries tell whether the others are worth the look
                gain = np.minimum(np.minimum(rest[:, None] * length[part], sums[:, None] * top[part]), most * total[part]) + slack[part]
                possible = acc[:, part] + gain >= np.partition(acc[:, part] - gain, n - k, axis=0)[n - k]
                enough = last or possible.mean() < share
                if not enough:
                    break
            if enough:
                self.taken.append((step + 1, len(self.steps)))
                for i in range(b):
                    yield i, np.flatnonzero(possible[:, i])
                return

    def top(self, q: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score): for each query its k best other vectors in the block, ties to smaller ids; scores beyond 64 bits are their nearest end."""
        out = []
        # one more for each row that may be the query's own
        own = int(np.unique(ids, return_counts=True)[1].max(initial=1))
        plain = self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, q.shape[1]) < EXACT
        for i, at in self.candidates(q, min(k + own, len(self.x))):
            at = at[ids[at] != query_ids[i]]
            if plain:
                score = self.x[at] @ q[i]
            else:
                score = np.array([max(-(2**63), min(2**63 - 1, s)) for s in self.x[at].astype(object) @ q[i].astype(object)], dtype=np.int64)
            order = np.lexsort((ids[at], ~score))[:k]
            out += zip([int(query_ids[i])] * len(order), ids[at][order].tolist(), score[order].tolist(), strict=True)
        return out


def _matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists as rows of a matrix, the shorter ones filled with 0, cut at `width`."""
    size, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), max(1, int(size.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    if width is not None:
        out = out[:, :width] if width <= out.shape[1] else np.pad(out, ((0, 0), (0, width - out.shape[1])))
    return out


def search(k: int):
    """Rows (block, kind, vec_id, x), sorted by block and kind: a block's vectors (0) make its index, then its queries (1) pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index, ids, vectors = None, None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            at, kinds, blocks = 0, batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            edges = [*(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for end in edges:
                part, at, first = batch.slice(at, end - at), end, at
                if first == end:
                    continue
                if blocks[first] != block:
                    block, index, ids, vectors = blocks[first], None, None, []
                if kinds[first] == 0:
                    vectors.append(part)
                    continue
                if index is None and vectors:
                    whole = pa.Table.from_batches(vectors).combine_chunks()
                    index, ids, vectors = Index(_matrix(whole.column("x").chunk(0))), whole.column("vec_id").to_numpy(), []
                for low in range(0, part.num_rows if index is not None else 0, BATCH):
                    some = part.slice(low, BATCH)
                    yield batch_of(index.top(_matrix(some.column("x"), index.x.shape[1]), some.column("vec_id").to_numpy(), ids, k))

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `queries` holds, its k best other rows by integer inner product.

    `queries` is a condition on the id column, named vec_id. Vectors that are null, or hold null or non-finite components, take no
    part; rows with a null id neither. Missing components of a shorter vector count as 0. Rows that repeat both id and vector count once.
    Rows with the query's own id are not its candidates. An empty table gives an empty result; extra columns are ignored. Every row is in one
    block, every query goes to all of them: what is shuffled is the table and `blocks` times the queries.
    """
    common.ship(vectors.sparkSession)
    rows = vectors.select(common.column(id_col).cast("long").alias("vec_id"), scaled(common.column(vector_col)).alias("x")).where("vec_id is not null and x is not null").distinct()
    rows = common.cut(rows)
    blocks = max(1, math.ceil(rows.count() / block))  # one number on the driver
    left = rows.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "x")
    right = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "x")
    dealt = left.unionByName(right).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(search(k), "query_id long, vec_id long, score long")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP3_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

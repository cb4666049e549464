"""Quality classifier: an interpolated modified Kneser-Ney model over bytes, trained on trusted text.

N-grams are the ORDER bytes of UTF-8 that end at each byte, as one number, so text of every script is modelled and the
counts grow with the corpus. Documents are dealt, by a hash, to blocks of about BLOCK bytes. A first pass over the blocks
gives each block's distinct n-grams with their counts in trusted documents; sums by n-gram are the sharded counts, and
all lower orders, discounts, context totals and probabilities are aggregates and joins of these tables. The bits are joined to the
n-grams of each block, go back to it, and a second pass over the blocks sums each document's bits. No table of n-grams is
broadcast or gathered.

Trusted documents are those labelled quality = 1. One in HOLD of them, by a hash of the text, is held out of the counts, and each
language's threshold is a quantile of its held-out documents, times MARGIN; a document above it is rejected.

Perplexities of short texts vary by chance, so a document's mean is taken with PRIOR further bytes of its language's
average: a few words alone can't reject it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefacts.llm import common

ORDER = 5
QUANTILE, PRIOR, HOLD = 0.999, 150, 5
#: Held-out documents vary less than all others.
MARGIN = 1.02
#: A language with fewer held-out documents takes the threshold of all of them.
FEWEST = 20
#: Rates of thresholds are told in these steps.
STEP = 1e-4
#: Bytes of text in a block, and at a time in a pass over it.
BLOCK, CHUNK = 24 << 20, 1 << 20
#: Rows of one id go to this many blocks, by their texts.
SALT = 4
_BEFORE = b"\n" * (ORDER - 1)

Stream = Iterator[pa.RecordBatch]


def codes(raws: list[bytes]) -> np.ndarray:
    """The n-gram that ends at each byte of each text, one text after the other; a text begins after line breaks."""
    x = np.frombuffer(b"".join(p for r in raws for p in (_BEFORE, r)), dtype=np.uint8).astype(np.int64)
    if len(x) < ORDER:
        return np.zeros(0, dtype=np.int64)
    out = x[: len(x) - ORDER + 1].copy()
    for k in range(1, ORDER):
        out <<= 8
        out |= x[k : len(x) - ORDER + 1 + k]
    # the n-gram of a text's byte begins ORDER - 1 places before it; those that run on into the next text's line breaks go
    next_ = np.cumsum([len(r) + ORDER - 1 for r in raws])[:-1]
    keep = np.ones(len(out), dtype=bool)
    keep[(next_[:, None] - np.arange(1, ORDER)).ravel()] = False
    return out[keep]


def _chunks(raws: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for r in raws:
        if part and size + len(r) > CHUNK:
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r)
    if part:
        yield part


def counted(trained: list[bytes], others: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all texts, in order, and how often each occurs in those trained on."""
    found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for texts, weight in ((trained, 1), (others, 0)):
        for part in _chunks(texts):
            c, n = np.unique(codes(part), return_counts=True)
            found.append(c)
            times.append(n * weight)
    every, at = np.unique(np.concatenate(found), return_inverse=True)
    return every, np.bincount(at, weights=np.concatenate(times), minlength=len(every)).astype(np.int64)


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _blocks(docs: DataFrame, n: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(block, doc_id, lang, text_hash, packed): each row in one of n blocks, its text compressed."""
    rows = docs.select(common.column(id_col).cast("long").alias("doc_id"), F.coalesce(common.column(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(common.column(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", _row_hash(F.col("text")))
    salt = F.when(F.col("doc_id").isNull(), F.col("text_hash")).otherwise(F.pmod("text_hash", F.lit(SALT)))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", salt), F.lit(n)).alias("block"), "doc_id", "lang", "text_hash", "text")

    def pack(batches: Stream) -> Stream:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in common.slices(batch, "text"):
                packed = pa.array([press.compress(t.as_buffer()) for t in part.column("text").cast(pa.binary())], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], packed], names=["block", "doc_id", "lang", "text_hash", "packed"])

    return rows.mapInArrow(pack, "block long, doc_id long, lang string, text_hash long, packed binary")


def _unpacked(block: pa.Table) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(p.as_buffer()) if len(p.as_buffer()) else b"" for p in block.column("packed")]


def _grams(block: pa.Table, good: pa.Table) -> pa.Table:
    """A block's documents and trusted ids -> (block, code, n)."""
    if not block.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    ids, hashes = block.column("doc_id").to_pylist(), block.column("text_hash").to_pylist()
    trusted = set(good.column("doc_id").to_pylist())
    trained, others = [], []
    for i, h, raw in zip(ids, hashes, _unpacked(block), strict=True):
        (trained if i in trusted and h % HOLD else others).append(raw)
    code, n = counted(trained, others)
    return pa.table({"block": np.full(len(code), block.column("block")[0].as_py()), "code": code, "n": n})


def _bits(block: pa.Table, known: pa.Table) -> pa.Table:
    """A block's documents and the bits of its n-grams -> (doc_id, lang, text_hash, symbols, bits)."""
    code, cost = known.column("code").to_numpy(), known.column("bits").to_numpy()
    order = np.argsort(code)
    code, cost, bits, sizes = code[order], cost[order], [], []
    for part in _chunks(_unpacked(block)):
        n = np.array([len(r) for r in part])
        total = np.concatenate([[0], np.cumsum(cost[np.searchsorted(code, codes(part))], dtype=np.float64)])
        end = np.cumsum(n)
        bits.append(total[end] - total[end - n])
        sizes.append(n)
    return block.select(["doc_id", "lang", "text_hash"]).append_column("symbols", pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64))).append_column("bits", pa.array(np.concatenate([*bits, np.zeros(0)])))


def levels(counts: DataFrame) -> list[DataFrame]:
    """(code, n) of every order from 1 to ORDER, each written once: n-grams asked for, those never seen with n = 0.

    The highest order has counts; lower ones count in how many contexts an n-gram goes on (continuation counts).
    """
    out = [common.cut(counts)]
    for order in range(ORDER - 1, 0, -1):
        out.append(common.cut(out[-1].groupBy((F.col("code") % 256**order).alias("code")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"))))
    return out[::-1]


def discounts(level: DataFrame) -> DataFrame:
    """(d1, d2, d3) of modified Kneser-Ney from counts of counts, as one row; 0 to 3 as an estimate is defined."""
    c = level.agg(*(F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)))
    y = F.when(F.col("c1") + 2 * F.col("c2") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.5)
    d = [F.when(F.col(f"c{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}"), F.lit(0.1)), F.lit(k - 0.1))).otherwise(k / 2).alias(f"d{k}") for k in (1, 2, 3)]
    return c.select(*d)


def probabilities(counts: DataFrame) -> DataFrame:
    """(code, p): the interpolated probability of every n-gram in counts (code, n), which holds the ones asked for too, with n = 0.

    From order 1 up: the discounted share of an n-gram in its context, and the context's back-off weight times the
    probability of the n-gram without its first byte; below order 1 all bytes are alike.
    """
    p = None
    for order, level in enumerate(levels(counts), 1):
        d = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # one row is broadcast
        rows = level.crossJoin(F.broadcast(common.cut(discounts(level)))).select("code", F.shiftright("code", 8).alias("context"), "n", d.alias("d"))
        totals = rows.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("mass"))
        rows = rows.join(totals, "context")
        lower = F.lit(1 / 256)
        if p is not None:
            rest = p.select(F.col("code").alias("rest"), F.col("p").alias("lower"))
            rows, lower = rows.withColumn("rest", F.col("code") % 256 ** (order - 1)).join(rest, "rest"), F.col("lower")
        seen = F.col("total") > 0
        p = common.cut(rows.select("code", F.when(seen, (F.col("n") - F.col("d")) / F.col("total") + F.col("mass") / F.col("total") * lower).otherwise(lower).alias("p")))
    return p


def scores(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", block: int = BLOCK) -> DataFrame:
    """doc_id, lang, text_hash, symbols, bits: per row the bytes of its whole text and their bits under the model of trusted text.

    good: (doc_id), the distinct trusted ids. A null language is 'und'. Texts are dealt to their blocks twice, compressed, and
    the shuffle files of the first pass are removed before the second; in between only n-grams by block are written.
    """
    common.ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(common.column(text_col).cast("string")))).first()[0] or 0
    n = max(1, -(-size // block))
    blocks = _blocks(docs, n, id_col, text_col, lang_col)
    dealt = good.select(F.col("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    dealt = dealt.select(F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n)).alias("block"), "doc_id")
    grams = blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(_grams, "block long, code long, n long")
    with common.stored(grams, "grams") as grams:
        known = probabilities(grams.groupBy("code").agg(F.sum("n").alias("n")))
        # both sides shuffled at any size, as both grow with the corpus
        answers = grams.select("block", "code").hint("merge").join(known, "code").select("block", "code", (-F.log2("p")).cast("float").alias("bits"))
        return common.cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_bits, "doc_id long, lang string, text_hash long, symbols long, bits double"))


def _quantiles(rates: DataFrame, quantile: float, *by: str) -> DataFrame:
    """(by, value, docs): the smallest rate, in steps of STEP, that a share `quantile` of the rows does not exceed; the same however rows are dealt.

    Counts of steps are few whatever the rows (a rate is some bits), so a window over them is small.
    """
    steps = rates.groupBy(*by, F.ceil(F.col("rate") / STEP).alias("step")).agg(F.count("*").alias("n"))
    key = by or (F.lit(0),)
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("step"))
    ranked = steps.select(*by, "step", upto.alias("upto"), F.sum("n").over(Window.partitionBy(*key)).alias("docs"))
    found = ranked.where(F.col("upto") >= F.ceil(F.col("docs") * quantile))
    # aggregated without a key, an empty table has one row of nulls
    return found.groupBy(*by).agg((F.min("step") * STEP).alias("value"), F.max("docs").alias("docs"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, lang, symbols, perplexity (per byte, with the prior), threshold, keep, text_hash.

    Trusted are documents labelled quality = 1, all of them. Null texts count as empty and are kept, as are rows
    without a finite threshold (no trusted document at all); a null language is 'und'; a null id is
    never trusted, but is scored; repeated rows stay, rows of one id are scored by their own texts, repeated or null labels count
    once; extra columns are ignored; an empty table gives an empty one. Where fewer than FEWEST trusted documents are held out, all
    trusted ones set the threshold.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    scored = scores(docs, good, id_col, text_col, lang_col)
    held = F.pmod("text_hash", F.lit(HOLD)) == 0
    # one row for each language; a join on it would deal most documents to one task
    trusted = common.cut(scored.join(good, "doc_id", "left_semi").where("symbols > 0").withColumn("held", held))
    pool = trusted.where("held") if trusted.where("held").count() >= FEWEST else trusted
    means = pool.groupBy("lang").agg(F.sum("bits").alias("bits"), F.sum("symbols").alias("symbols"), F.count("*").alias("docs"))
    overall = means.agg((F.sum("bits") / F.sum("symbols")).alias("all_mean"))
    average = means.crossJoin(F.broadcast(overall)).select("lang", F.when(F.col("docs") >= FEWEST, F.col("bits") / F.col("symbols")).otherwise(F.col("all_mean")).alias("mean"))
    average, overall = common.sized(average), common.sized(overall)

    def rated(rows: DataFrame) -> DataFrame:
        with_mean = rows.join(average, "lang", "left").crossJoin(overall).withColumn("mean", F.coalesce("mean", "all_mean"))
        return with_mean.select("doc_id", "lang", "text_hash", "symbols", ((F.col("bits") + PRIOR * F.col("mean")) / (F.col("symbols") + PRIOR)).alias("rate"))

    sample = rated(pool)
    by_lang = _quantiles(sample, quantile, "lang").select("lang", F.col("value").alias("own"), "docs")
    for_all = _quantiles(sample, quantile).select(F.col("value").alias("for_all"))
    limits = rated(scored).join(common.sized(by_lang), "lang", "left").crossJoin(common.sized(for_all))
    limit = MARGIN * F.when(F.col("docs") >= FEWEST, F.col("own")).otherwise(F.col("for_all"))
    keep = F.col("rate").isNull() | limit.isNull() | (F.col("rate") <= limit)
    return limits.select("doc_id", "lang", "symbols", F.pow(F.lit(2.0), "rate").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), keep.alias("keep"), "text_hash")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that classify keeps, each by its own id, language and text, with all their columns."""
    names = common.fresh_names(docs, 3)
    gone = classify(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col).where("not keep").select("doc_id", "lang", "text_hash").distinct().toDF(*names)
    a, b, c = (common.column(n) for n in names)
    same = common.column(id_col).cast("long").eqNullSafe(a) & (F.coalesce(common.column(lang_col).cast("string"), F.lit("und")) == b) & (_row_hash(common.column(text_col).cast("string")) == c)
    # both sides shuffled at any size, as the set of rejected rows grows with the corpus
    return docs.hint("merge").join(gone, same, "left_anti")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its perplexity, its language's threshold and the decision."""
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")).drop("text_hash")

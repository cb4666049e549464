"""SimHash fingerprints and near-duplicates by pigeonring filtering.

Pigeonring: lay the 64 bits of a fingerprint out as a ring of M segments. If two
fingerprints differ in at most TAU bits, some segment begins a chain such that, for every
length l, the first l segments of the chain differ in at most l * TAU / M bits together.
With TAU = 2 and M = 8 the budgets are 0 0 0 1 1 1 1 2: three segments (24 bits) are
equal, and the next four (32 bits) differ in one bit at most, so one half of these is equal
as well. That gives 16 keys of 40 bits for each fingerprint; two fingerprints that link share
at least one. Pairs that share a key must pass the chain test before the full
Hamming check.

Only distinct fingerprints take part (copies share one), and a key with more than GROUP
of them is never expanded to pairs: its members agree in 40 bits, so two of them link exactly if
flipping at most one of the other 24 bits in each gives the same value. Each member goes to its 25
such values; a value has 25 members at most, which are linked by a star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefacts.llm import common
from bytefacts.llm.components import connected_components

TAU, SEGMENTS, WIDTH = 2, 8, 8
GROUP = 64


def shingles(text: str, words: int) -> list[bytes]:
    """Space-joined runs of `words` words of the text with A-Z in lower case; fewer words make one run."""
    w = text.encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in more than half of the shingles' XXH64; 0 without words."""
    return _fingerprint_of(shingles(text, words), seed)


def _fingerprint_of(found: list[bytes], seed: int = 42) -> int:
    digest, bits, n = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), 0
    for at in range(0, len(found), 65_536):  # bounded memory for very long texts
        part = found[at : at + 65_536]
        raw = np.frombuffer(b"".join([digest(s, seed) for s in part]), dtype=np.uint8).reshape(-1, 8)
        bits += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long). Null texts count as empty: fingerprint 0."""

    def kernel(ids: list, texts: list) -> dict:
        bits = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
        return {"doc_id": ids, "bits": bits}

    return common.map_texts(docs, "doc_id long, bits long", kernel, id_col, text_col)


def rotated(bits: Column, segment: int) -> Column:
    """The ring turned so that `segment` comes first, as a signed long."""
    by = segment * WIDTH
    return bits if by == 0 else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))


def keys(bits: Column) -> Column:
    """The 16 structs (slot, key, rest): 40 equal bits, and the 24 bits which may differ."""
    out = []
    for s in range(SEGMENTS):
        r = rotated(bits, s)
        head, a, b, last = F.shiftrightunsigned(r, 40), F.shiftrightunsigned(r, 24).bitwiseAND(0xFFFF), F.shiftrightunsigned(r, 8).bitwiseAND(0xFFFF), r.bitwiseAND(0xFF)
        for half, (same, other) in enumerate(((a, b), (b, a))):
            out.append(F.struct(F.lit(2 * s + half).alias("slot"), F.shiftleft(head, 16).bitwiseOR(same).alias("key"), F.shiftleft(other, 8).bitwiseOR(last).alias("rest")))
    return F.array(*out)


def budgets(tau: int = TAU, segments: int = SEGMENTS) -> list[int]:
    return [length * tau // segments for length in range(1, segments + 1)]


def chain_passes(x: np.ndarray, tau: int = TAU, segments: int = SEGMENTS) -> np.ndarray:
    """For differences x (rows of uint64 words): does some segment begin a chain within all budgets?"""
    raw = np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(len(x), segments, -1)
    parts = np.bitwise_count(raw).sum(axis=2, dtype=np.int64)
    ring = np.concatenate([parts, parts], axis=1)
    sums = np.concatenate([np.zeros((len(ring), 1), dtype=np.int64), np.cumsum(ring, axis=1)], axis=1)
    limit = np.array(budgets(tau, segments))
    passes = np.zeros(len(ring), dtype=bool)
    for s in range(segments):
        passes |= (sums[:, s + 1 : s + 1 + segments] - sums[:, s : s + 1] <= limit).all(axis=1)
    return passes


def within(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Which rows of a and b (uint64 words) differ in at most tau bits: the chain test first, then all bits of what is left."""
    x = (a ^ b).reshape(len(a), -1)
    out = chain_passes(x, tau)
    out[out] = np.bitwise_count(x[out]).sum(axis=1, dtype=np.int64) <= tau
    return out


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each small group: the pairs that pass the chain test and then the Hamming check."""
    for batch in batches:
        groups = batch.column("members")
        flat, offsets = groups.flatten().to_numpy(zero_copy_only=False).view(np.uint64), groups.offsets.to_numpy() - groups.offsets[0].as_py()
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        sizes = np.diff(offsets)
        for n in np.unique(sizes):
            rows = flat[offsets[:-1][sizes == n][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            for at in range(0, len(rows), 4096):
                a, b = rows[at : at + 4096][:, i].ravel(), rows[at : at + 4096][:, j].ravel()
                keep = within(a, b, TAU)
                left.append(a[keep])
                right.append(b[keep])
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `bits` that keep every link of at most TAU bits connected.

    Pairs of small groups are all there; those of large ones are joined by stars of links through a
    common value, so that components are those of all pairs.
    """
    spread = distinct.select("bits", F.explode(keys(F.col("bits"))).alias("k")).select("bits", "k.slot", "k.key", "k.rest")
    shared = spread.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = common.cut(spread.join(shared, ["slot", "key"]))
    small = rows.where(F.col("n") <= GROUP).groupBy("slot", "key").agg(F.collect_list("bits").alias("members"))
    pairs = small.select("members").mapInArrow(_linked_pairs, "a long, b long")
    flips = F.array(F.lit(0), *(F.lit(1 << i) for i in range(24)))
    values = rows.where(F.col("n") > GROUP).select("bits", "slot", "key", "rest", F.explode(flips).alias("flip"))
    values = values.groupBy("slot", "key", F.col("rest").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_list("bits").alias("members"))
    stars = values.where(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a != b")
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable over links of at most TAU bits).

    One row per row of docs. Null texts count as empty; texts without words have fingerprint 0 and
    link like others. Rows with a null id keep a null id, and link others, but do not name a
    component unless all its ids are null. Repeated rows stay and agree. Extra columns are ignored.
    """
    common.ship(docs.sparkSession)
    prints = common.cut(fingerprints(docs, words, id_col, text_col))
    distinct = common.cut(prints.groupBy("bits").agg(F.min("doc_id").alias("first")))
    joined = connected_components(links(distinct.select("bits")))
    # a component is named after its smallest doc_id, not its smallest fingerprint
    classes = distinct.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    named = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    by_bits = classes.join(named, "component").select("bits", "component_id")
    return prints.join(by_bits, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity of word shingles, for stages that drop them.

#: Bits of a wide fingerprint; the share of its bits that differ estimates the angle between two shingle sets.
WIDE, BANDS, ROWS = 4, 12, 3
#: Fingerprints only filter: this many deviations beyond what is expected at the similarity asked for (small sets spread more).
DEVIATIONS = 6
#: Nodes in a part of a block, and shingles in a part of a class; two parts meet in a task.
PART_NODES, PART_SHINGLES = 4096, 1_000_000

_MIX = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def wide_tau(similarity: float) -> int:
    bits = 64 * WIDE
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p)))


def _hashes(found: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of shingles, in order."""
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), dtype=">u8").astype(np.uint64))


def set_id(hashes: np.ndarray) -> int:
    """The name of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 9)).view(np.int64))


def sketch(text: str, words: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """(wide fingerprint as WIDE words, BANDS keys, set_id, size) of a text's set of shingles, and fingerprint(). Each key mixes ROWS smallest values."""
    every = shingles(text, words)
    found = list(dict.fromkeys(every))
    bits, low = np.zeros(64 * WIDE, dtype=np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 16_384):
        part = found[at : at + 16_384]
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, seed) for s in part for seed in (1, 2)]), dtype=np.uint8).reshape(len(part), -1)
        bits += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        h = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
        for k in range(BANDS * ROWS):
            low[k] = min(low[k], ((h ^ _MIX[0, k]) * _MIX[1, k]).min())
    words_ = np.packbits(2 * bits > len(found)).view(">u8").astype(np.uint64)
    keys_ = np.array([xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], dtype=np.uint64)
    hashes = _hashes(found)
    return words_, keys_, set_id(hashes), len(hashes), _fingerprint_of(every)


_PRINT = [f"p{i}" for i in range(WIDE)]


def forest(n: int, near) -> tuple[list[int], list[int]]:
    """Links that connect 0 .. n - 1 as all links would; near(x, others) tells which of the others link to x.

    Only members that nothing has reached yet are compared, so a group that hangs together costs few rounds.
    """
    left, queue, a, b = np.arange(n), [], [], []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        hit = near(x, left)
        found = left[hit].tolist()
        if found:
            a += [x] * len(found)
            b += found
            queue += found
            left = left[~hit]
    return a, b


def similar(sets: list[np.ndarray], similarity: float):
    """near() for forest: which of the others have at least this Jaccard similarity to set x. Exact, on sets of hashes."""
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    end = np.cumsum(size)
    flag = np.zeros(len(ids), dtype=np.int64)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        hit = np.minimum(size[others], size[x]) >= similarity * np.maximum(size[others], size[x])
        pick = others[hit]
        mine = ids[end[x] - size[x] : end[x]]
        flag[mine] = 1
        for at in range(0, len(pick), 256):
            part = pick[at : at + 256]
            n = size[part]
            first = np.cumsum(n) - n
            every = np.repeat(end[part] - n - first, n) + np.arange(n.sum())
            both = np.diff(np.concatenate([[0], np.cumsum(flag[ids[every]])])[np.append(first, n.sum())])
            # others are in order
            hit[np.searchsorted(others, part)] = both >= similarity * (n + size[x] - both) - 1e-9
        flag[mine] = 0
        return hit

    return near


def _links_of_groups(near_of):
    """Rows (group columns g0 .. g3, node, payload), sorted by group and node -> links (a, b) of a forest of each group's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, load = None, [], []
        left, right = [], []

        def close() -> None:
            if len(nodes) > 1:
                a, b = forest(len(nodes), near_of(load))
                left.extend([nodes[i] for i in a])
                right.extend([nodes[i] for i in b])

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (left, right)], names=["a", "b"])
            left.clear()
            right.clear()
            return out

        for batch in batches:
            groups = zip(*(batch.column(f"g{i}").to_pylist() for i in range(4)), strict=True)
            for g, node, payload in zip(groups, batch.column("node").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if g != group:
                    close()
                    group, nodes, load = g, [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    load.append(payload)
            yield taken()
        close()
        yield taken()

    return run


def _close_prints(tau: int):
    """near() of payloads that are wide fingerprints: at most tau bits differ."""

    def near_of(load: list[bytes]):
        p = np.frombuffer(b"".join(load), dtype=np.uint64).reshape(len(load), WIDE)
        return lambda x, others: np.bitwise_count(p[others] ^ p[x]).sum(axis=1, dtype=np.int64) <= tau

    return near_of


def _similar_sets(similarity: float):
    """near() of payloads that are shingle sets."""
    return lambda load: similar([np.frombuffer(x, dtype=np.uint64) for x in load], similarity)


def _meetings(rows: DataFrame, group: list[str], parts: str) -> DataFrame:
    """Rows of each group of `parts` parts dealt so that every two parts meet: g0, g1 (the group), g2, g3 (the two parts), node, payload."""
    own, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col(parts)), F.col("other")
    g = [F.col(c).cast("long").alias(f"g{i}") for i, c in enumerate([*group, group[0]][:2])]
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
    dealt = dealt.select(*g, F.least("own", other).alias("g2"), F.greatest("own", other).alias("g3"), "node", "payload")
    at = ["g0", "g1", "g2", "g3"]
    return dealt.repartition(*at).sortWithinPartitions(*at, "node")


def fingerprint_links(carriers: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of carriers (bits, node), by pigeonring as of links(): nodes of one fingerprint, or of two that differ in
    at most TAU bits, hang together. Each fingerprint stands for its nodes by the smallest of them."""
    first = common.cut(carriers.groupBy("bits").agg(F.min("node").alias("first")))
    pairs = links(first.select("bits")).join(first.toDF("a", "left"), "a").join(first.toDF("b", "right"), "b")
    same = carriers.join(first, "bits").where("node != first")
    return pairs.select(F.col("left").alias("a"), F.col("right").alias("b")).union(same.select("first", "node"))


def candidate_classes(nodes: DataFrame, carriers: DataFrame, tau: int) -> DataFrame:
    """(node, class) of nodes that hang together by links: those of fingerprint_links(carriers), and those between nodes (node, prints, bands)
    that share a key and are within tau bits."""
    rows = nodes.select("node", F.col("prints").alias("payload"), F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "key"]).withColumn("parts", F.ceil(F.col("n") / PART_NODES))
    links_ = _meetings(rows, ["band", "key"], "parts").mapInArrow(_links_of_groups(_close_prints(tau)), "a long, b long")
    return connected_components(fingerprint_links(carriers).union(links_)).select("node", F.col("component").alias("class"))


def _row_hash(text: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42)).view(np.int64))


def _classified(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, text_hash, component (a number of its group of near copies)."""
    common.ship(docs.sparkSession)

    def kernel(ids: list, texts: list) -> dict:
        made = [sketch(t, words) for t in texts]
        columns = {"prints": [p.tobytes() for p, *_ in made], "bands": [k.view(np.int64).tolist() for _, k, *_ in made], "node": [m[2] for m in made], "size": [m[3] for m in made], "bits": np.array([m[4] for m in made], dtype=np.uint64).view(np.int64)}
        return {"doc_id": ids, "text_hash": [_row_hash(t) for t in texts]} | columns

    made = common.cut(common.map_texts(docs, "doc_id long, text_hash long, prints binary, bands array<long>, node long, size long, bits long", kernel, id_col, text_col))
    firsts = (F.first(c).alias(c) for c in ("prints", "bands", "size"))
    nodes = common.cut(made.groupBy("node").agg(F.min(_row_key()).alias("row"), *firsts))
    carriers = made.select("bits", "node").distinct()
    classes = common.cut(nodes.join(candidate_classes(nodes, carriers, wide_tau(similarity)), "node").select("row", "node", "class", "size"))
    parts = classes.groupBy("class").agg(F.ceil(F.sum("size") / PART_SHINGLES).cast("long").alias("parts"))
    members = classes.join(parts, "class").select("row.*", F.col("node").alias("__node"), F.col("class").alias("__class"), F.greatest("parts", F.lit(1)).alias("__parts"))
    # texts of class members only, one for each node; both sides shuffled at any size, as members grow with the corpus
    texts = common.documents(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
    texts = texts.select(_row_key().alias("row"), "text").select("row.*", "text").hint("merge").join(members, ROW).select("text", "__node", "__class", "__parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = pa.array([_hashes(shingles(t, words)).tobytes() for t in part.column("text").to_pylist()], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("__class"), part.column("__parts"), part.column("__node"), found], names=["class", "parts", "node", "payload"])

    rows = texts.mapInArrow(sets, "class long, parts long, node long, payload binary")
    links_ = _meetings(rows, ["class"], "parts").mapInArrow(_links_of_groups(_similar_sets(similarity)), "a long, b long")
    joined = connected_components(links_).withColumnRenamed("node", "__node")
    return made.join(joined, F.col("node") == F.col("__node"), "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


#: What tells rows apart: the id (0 for null, which comes after all others), and the text.
ROW = ["no_id", "id", "text_hash"]


def _row_key() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per row of docs: rows linked by shingle sets of at least `similarity`, by exact Jaccard similarity.

    Equal sets are one node. Candidates come first by this module's method, as in near_duplicates: 64-bit fingerprints of the shingles
    at most TAU bits apart, by pigeonring keys, chain test and Hamming check; each such link is followed by the exact check.
    Most fingerprints of this similarity differ in more bits than keys of equal segments reach, so documents meet as well if one of
    BANDS keys of ROWS smallest shingle values each is the same (a pair of similarity 0.8 meets but for one in 5,000).
    All nodes of such a block are compared by fingerprints of 256 bits, with a wide
    margin; what these leave together is a class, and within a class links are decided by the sets themselves.
    Large blocks and classes are dealt in parts, every two of which meet in a task: none is gathered, and no pair is left out.
    Rows, not ids, are linked: rows of one id may have other texts and other components. Rows with a null id take part; a component is
    named after its smallest id, null if it has none. Null texts count as empty, texts without words are copies of each
    other; repeated rows stay, extra columns are ignored, an empty table gives an empty one.
    """
    rows = _classified(docs, words, similarity, id_col, text_col)
    first = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first, "component").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component one row stays, one of the smallest id (a null id only where there is no other).

    Rows are told apart by id and text, so a row goes for its own text only. All columns stay, whatever their names and types.
    """
    rows = _classified(docs, words, similarity, id_col, text_col)
    stay = common.cut(rows.groupBy("component").agg(F.min(_row_key()).alias("row")).select("row.*"))
    names = common.fresh_names(docs, len(ROW))
    doc_id, text = common.column(id_col).cast("long"), F.coalesce(common.column(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip(names, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(text)), strict=True)))
    # both sides shuffled at any size, as what stays grows with the corpus; repeated rows meet where the join has put them
    return keyed.hint("merge").join(stay.toDF(*names), names, "left_semi").dropDuplicates(names).select([common.column(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))

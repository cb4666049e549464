import random

import numpy as np
import xxhash

from bytefacts.llm.components import connected_components
from bytefacts.llm.simhash import GROUP, budgets, chain_passes, fingerprint, first_of_each, keys, links, near_copies, near_duplicates, shingles
from pyspark.sql import functions as F

from .helpers import edge_docs, edge_rows, got, no_docs, words


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, tau=2):
    """Component of each value, as the smallest position; by brute force."""
    up = list(range(len(values)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= tau):
            a, b = find(i), find(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def test_fingerprint_and_shingles():
    r = random.Random(3)
    for t in ["", "One", "One TWO", "ÀB c D"] + [words(r, n) for n in (3, 4, 50)]:
        assert fingerprint(t) == plain_fingerprint(t)
    assert shingles("A b c d", 3) == [b"a b c", b"b c d"]


def test_every_close_pair_passes_and_shares_a_key(spark):
    assert budgets() == [0, 0, 0, 1, 1, 1, 1, 2]
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    assert chain_passes(np.array(flips, dtype=np.uint64)).all()
    three = np.array([1 << 60 | 1 << 30 | 1 << 3], dtype=np.uint64)
    assert not chain_passes(three).any()
    base = 0x0123456789ABCDEF
    signed = [(int(np.uint64(base ^ f).astype(np.int64)),) for f in flips]
    rows = spark.createDataFrame(signed, "bits long").select("bits", F.transform(keys(F.col("bits")), lambda k: F.struct(k["slot"], k["key"])).alias("k")).collect()
    own = {tuple(k) for r in rows if r.bits == base for k in r.k}
    assert all(own & {tuple(k) for k in r.k} for r in rows)


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    out = dict(got(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_links_of_large_and_small_groups_equal_brute_force(spark):
    """A ball of thousands of fingerprints around one, and scattered pairs."""
    r = random.Random(4)
    center = r.getrandbits(64)
    values = {center ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(700)}
    for _ in range(200):
        x = r.getrandbits(64)
        values |= {x, x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64), x ^ 7 << r.randrange(60)}
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    assert len(values) > 10 * GROUP
    frame = spark.createDataFrame([(v,) for v in signed], "bits long")
    got_ = dict(got(connected_components(links(frame))))
    want = classes(values)
    mine = [got_.get(s, s) for s in signed]
    pairs = {}
    for a, b in zip(want, mine, strict=True):
        assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs)


def test_near_duplicates_of_edge_cases(spark):
    rows = edge_rows()
    prints = [plain_fingerprint(t or "") for _, t, *_ in rows]
    part = classes(prints)
    want = []
    for (i, *_), f, c in zip(rows, prints, part, strict=True):
        ids = [rows[k][0] for k in range(len(rows)) if part[k] == c and rows[k][0] is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    assert got(near_duplicates(edge_docs(spark))) == sorted(want, key=repr)
    assert got(near_duplicates(no_docs(spark))) == []


def test_near_copies_leave_one_of_each_group(spark):
    r = random.Random(6)
    rows, base = [], words(r, 300)
    for i in range(120):  # near copies: one of 300 words changed; more than GROUP of them
        w = base.split(" ")
        w[r.randrange(300)] = f"changed{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, words(r, 200)) for i in range(60)]
    rows += [(2000, rows[130][1]), (2001, None), (2002, ""), (None, "kept"), (3000, "twice"), (3000, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes_ = {i: c for i, c in near_copies(docs).collect()}
    assert {classes_[i] for i in range(120)} == {0}
    assert all(classes_[1000 + i] == 1000 + i for i in range(60))
    left = sorted((r.doc_id for r in first_of_each(docs).collect()), key=repr)
    assert left == sorted([0, *(1000 + i for i in range(60)), 2001, None, 3000], key=repr)
    assert classes_[None] is None
    assert got(first_of_each(no_docs(spark))) == []


def jaccard_classes(texts, similarity=0.8, n=5):
    """Component of each text, as the smallest position, by exact similarity of all pairs."""
    sets = [set(shingles(t, n)) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def template_docs(r, documents, shared, own):
    """Documents of one shared passage and words of their own, each with a near copy of itself."""
    passage, out = words(r, shared), []
    for i in range(documents):
        w = [f"{x}{i}" for x in words(r, own).split(" ")]
        out.append(passage + " " + " ".join(w))
        w[len(w) // 2 :: 8] = ["changed"] * len(w[len(w) // 2 :: 8])  # similarity 0.802
        out.append(passage + " " + " ".join(w))
    return out


def test_near_copies_in_a_block_of_many_documents_are_all_found(spark):
    """Pairs of near copies among hundreds of documents with one template; every two documents share half their shingles."""
    texts = template_docs(random.Random(11), 300, 130, 65)
    want = jaccard_classes(texts)
    assert sum(w != i for i, w in enumerate(want)) == 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got_ = dict(near_copies(docs).collect())
    assert [got_[i] for i in range(len(texts))] == want


def test_parts_of_large_blocks_and_classes_all_meet(spark, monkeypatch):
    from bytefacts.llm import simhash

    monkeypatch.setattr(simhash, "PART_NODES", 16)
    monkeypatch.setattr(simhash, "PART_SHINGLES", 4_000)
    texts = template_docs(random.Random(12), 60, 130, 65)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got_ = dict(near_copies(docs).collect())
    assert [got_[i] for i in range(len(texts))] == jaccard_classes(texts)


def test_links_of_near_copies_are_exact_similarity(spark):
    """Families around the limit: texts of 300 words of which all but a share are of one template; no chains below 0.8."""
    r, texts = random.Random(13), []
    for own in (30, 45, 60, 75):
        base = words(r, 300).split(" ")
        for i in range(40):
            texts.append(" ".join(base[: 300 - own] + [f"{x}{i}" for x in words(r, own).split(" ")]))
    want = jaccard_classes(texts)
    assert len(set(want)) == 1 + 3 * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got_ = dict(near_copies(docs).collect())
    assert [got_[i] for i in range(len(texts))] == want


def test_rows_are_dropped_for_their_own_texts(spark):
    """Repeated ids with other texts, null ids, repeated rows, and columns of clashing names and any type, against all pairs."""
    a, b, c = "text a of some words here", "another text b of other words", "and c is again something else"
    schema = "doc_id long, text string, `a.b` array<map<string,int>>, __drop string, own_0 int, text_hash long, id int, node struct<x:map<string,int>>"
    rest = ([{"k": 1}], "x", 1, 2, 3, ({"y": 1},))
    rows = [(3, b), (7, a), (7, b), (9, a), (7, a), (None, c), (None, c), (None, a), (11, c), (12, None), (None, ""), (-5, "lone text that has no copy at all")]
    docs = spark.createDataFrame([(*x, *rest) for x in rows], schema).repartition(3)
    left = first_of_each(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert sorted((x.doc_id, x.text) for x in left.collect()) == [(-5, rows[-1][1]), (3, b), (7, a), (11, c), (12, None)]
    only = first_of_each(docs.where("doc_id is null")).collect()
    assert sorted(x.text for x in only) == ["", c, a]
    assert got(near_copies(docs)) == sorted([(3, 3), (7, 7), (7, 3), (9, 7), (7, 7), (None, 11), (None, 11), (None, 7), (11, 11), (12, 12), (None, 12), (-5, -5)], key=repr)


def test_near_copies_meet_by_fingerprints_too(spark):
    """Texts of one repeated phrase, similarity 0.805 and equal fingerprints, chosen so that no two share a key of smallest values: only pigeonring finds them."""
    from bytefacts.llm.simhash import sketch

    r, phrase = random.Random(31), " ".join(f"core{i}" for i in range(7))
    tail = words(r, 150)
    texts = [" ".join([phrase] * 60 + [tail] + [f"own{i}x{k}" for k in range(19)]) for i in (53, 632)]
    texts += [words(r, 100), words(r, 100)]
    mine, other = (sketch(t, 5)[1] for t in texts[:2])
    assert not (mine == other).any() and jaccard_classes(texts) == [0, 0, 2, 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(near_copies(docs).collect()) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert sorted(x.doc_id for x in first_of_each(docs).collect()) == [0, 2, 3]


def test_recall_against_all_pairs(spark):
    """A mix of groups, chains of copies and unrelated texts in both small and large blocks: exactly what all pairs give."""
    r, texts = random.Random(21), []
    for _ in range(40):
        base = words(r, r.choice([8, 30, 90, 300])).split(" ")
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 3])):
                w[r.randrange(len(w))] = f"n{r.randrange(99)}"
            texts.append(" ".join(w))
    texts += ["", "one", "one two three four", "one two three four five"]
    want = jaccard_classes(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got_ = dict(near_copies(docs).collect())
    assert [got_[i] for i in range(len(texts))] == want
    left = {x.doc_id for x in first_of_each(docs).collect()}
    assert left == set(want)

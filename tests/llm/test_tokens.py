import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bytefacts.llm.bpe import ByteBpe, settled
from bytefacts.llm.packing import CAPACITY, Packer, curve_key, hilbert, pack, placed_in, range_ends
from bytefacts.llm.piece_encoding import CharacterMap, Model, encode_pieces, model, piece_digests, proto_fields
from bytefacts.llm.token_counts import Counter, token_counts, whole_tokens

from .helpers import edge_docs, edge_rows, got, no_docs

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n=1500, letters="ab ▁\n\té日<>s'1.　\x85‍٣"):
    r = random.Random(1)
    return ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_counts_equal_the_library_on_odd_texts(library):
    counter = Counter(BPE)
    texts = odd_texts() + ["don't  we'll", "<|endoftext|>", "a<|endoftext|>\n", "\U0003d000 newer than most", "𐕀a b"]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_are_one_token(library):
    proven = whole_tokens(ByteBpe(BPE))
    assert len(proven) > 45_000 and " the" in proven
    sample = sorted(proven)[::97]
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sample)
    assert not settled("\U0003d000")


def test_a_string_that_no_merge_reaches_is_not_whole(tmp_path):
    """A vocabulary with a string whose merges lead past it: the library makes two tokens of it, and so does the count."""
    import json

    spec = json.loads(open(BPE, encoding="utf-8").read())
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    top = max(vocab.values()) + 1
    vocab["qzxqzx"] = top  # no merge ends in it
    at = tmp_path / "odd.json"
    at.write_text(json.dumps(spec | {"model": spec["model"] | {"vocab": vocab, "merges": merges}}), encoding="utf-8")
    bpe = ByteBpe(str(at))
    n = len(bpe.library.encode("qzxqzx", add_special_tokens=False).ids)
    assert n > 1 and "qzxqzx" not in whole_tokens(bpe)
    for t in ("qzxqzx", "a qzxqzx", "qzxqzxqzxqzx 1"):
        assert Counter(str(at)).count(t) == len(bpe.library.encode(t, add_special_tokens=False).ids) == len(bpe.chunk_ids(t))


def test_token_counts_of_edge_cases(spark, library):
    rows = edge_rows()
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in rows), key=repr)
    assert got(token_counts(edge_docs(spark), BPE)) == want
    assert got(token_counts(no_docs(spark), BPE)) == []


def test_pieces_equal_the_library():
    lib, m = sentencepiece.SentencePieceProcessor(model_file=PIECES), model(PIECES)
    for t in odd_texts() + ["", " ", "  ", " a", "a ", "<s>", "▁"]:
        said, ids, ends = m.encode(t)
        assert ids.tolist() == lib.encode(t), repr(t)
        assert said.decode() == ",".join(map(str, ids.tolist()))
        if t:
            assert ends[-1] == len(t.encode()) and (np.diff(ends) >= 0).all()


def test_spans_are_the_pieces_of_the_original_text():
    raw = "Hello  wörld ▁x".encode()
    for _, piece, a, b in model(PIECES).spans(raw.decode()):
        if not piece.startswith("<0x"):
            assert raw[a:b].decode().replace(" ", "▁").endswith(piece.lstrip("▁"))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_normaliser_follows_compiled_maps(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    m = Model.__new__(Model)
    spec = dict(proto_fields(next(v for f, v in proto_fields(lib.serialized_model_proto()) if f == 3)))
    m.map, m.dummy_prefix, m.squeeze, m.escape = CharacterMap(spec[2]), True, True, True
    for t in odd_texts(400, "ab ＡＢ①ﬁ㍿ｶﾞé \n") + ["", " ", "  x  "]:
        norm = m.normalise(t)
        assert norm.text == lib.normalize(t)
        assert len(norm.origin) == len(norm.text.encode()) + 1 and (np.diff(norm.origin) >= 0).all()


def test_piece_digests_of_edge_cases(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t, *_ in edge_rows():
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((lib.decode(ids) if ids else "").encode()).hexdigest()))
    assert got(piece_digests(edge_docs(spark), PIECES).drop("ends_crc32")) == sorted(want, key=repr)
    assert got(piece_digests(no_docs(spark), PIECES)) == []
    row = encode_pieces(edge_docs(spark).where("doc_id = 5"), PIECES).first()
    assert row.ends[-1] == 7 and len(row.ends) == len(row.ids)


def test_ranges_hold_like_numbers_of_bytes(spark):
    """Half of the rows are copies with one id and text, and long texts lie together: no range is far above its share."""
    r = random.Random(4)
    rows = [(7, "the same text again and again " * 8)] * 2000 + [(i, "".join(r.choice("ab cd") for _ in range(r.choice([40, 40, 4000])))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed = docs.withColumn("part", F.spark_partition_id().cast("long"))
    ends = range_ends(placed, len(rows), 6)
    told = placed.withColumn("place", placed_in(ends)).select("*", "place.*")
    bytes_ = [x.n for x in told.groupBy("range").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert len(bytes_) == 6 and max(bytes_) < 1.8 * sum(bytes_) / 6
    assert told.where("range > 5").count() == 0 and len(range_ends(placed.limit(0), 0, 6)) == 0
    assert told.where(F.col("curve_key") != curve_key(F.col("text"))).count() == 0
    assert [x.range for x in told.orderBy("curve_key", "doc_id", "part").collect()] == sorted(x.range for x in told.collect())


def test_every_place_of_a_normalised_text_has_its_origin():
    m = model(PIECES)
    for t in odd_texts(300) + [" ", "a", "日 本"]:
        norm, raw = m.normalise(t), t.encode()
        if t:
            want = [0, 0, 0, *(i for i, b in enumerate(raw) for _ in range(3 if b == 32 else 1)), len(raw)]
            assert norm.origin.tolist() == want and norm.text == "▁" + t.replace(" ", "▁")


def test_hilbert_visits_every_cell_once_and_moves_one_step():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    order = cells[np.argsort(hilbert(cells, 3))]
    assert sorted(hilbert(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packer_pads_nothing():
    packer, r = Packer(0), random.Random(2)
    rows, total = [], 0
    for i in range(50):
        n = r.randrange(1, 3000)
        total += n
        rows += packer.add(i, np.arange(n, dtype="<u4").tobytes())
    rows += packer.finish()
    sizes = {}
    for _, _, length, _, _, sequence, offset in rows:
        assert sizes.get(sequence, 0) == offset
        sizes[sequence] = offset + length
    assert sum(sizes.values()) == total
    assert all(s == CAPACITY or s & (s - 1) == 0 for s in sizes.values())


def test_packing_of_edge_cases(spark, library):
    rows = edge_rows()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    made = pack(edge_docs(spark), BPE).collect()
    assert sum(r.length for r in made) == sum(len(x) for v in ids.values() for x in v)
    for r in made:
        x = ids[r.doc_id][0]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    ends = {}
    for r in sorted(made, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= CAPACITY
    assert got(pack(no_docs(spark), BPE)) == []

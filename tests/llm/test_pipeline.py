import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from bytefacts.llm.pii import base_spans, merged, model_spans, redacted, trained
from bytefacts.llm.simhash import _row_hash

from .helpers import words
from .test_quality import plain_decisions
from .test_simhash import jaccard_classes

BPE = public_tokenizers.path("byte_bpe_50k.json")


def row_hash(text):
    return _row_hash(text or "")


def tables(spark, at, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if 900 <= (r[0] or 0) < 950 else 1, 0) for r in rows if r[0] is not None and r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")


def test_stages_decide_as_they_should(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, words(r, 80), "en", "a", 1) for i in range(400)]
    rows += [(900 + i, " ".join(w.upper() + "!!" for w in words(r, 80).split()), "en", "a", 1) for i in range(20)]
    rows += [(600, rows[3][1], "en", "b", 1), (601, rows[4][1] + " end", "en", "b", 1), (602, words(r, 40) + " mail me.x@mail.example.com now", "en", "b", 1), (603, None, None, None, None)]
    tables(spark, tmp_path, rows)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = {x.doc_id for x in seen["quality"].collect()}
    assert not kept & set(range(900, 920)) and len(kept & set(range(400))) >= 398
    kept = {x.doc_id for x in seen["near_duplicates"].collect()}
    assert not kept & {600, 601} and {3, 4, 602, 603} <= kept
    text = {x.doc_id: x for x in seen["private_data"].collect()}
    assert "[EMAIL]" in text[602].text and "@" not in text[602].text and text[602].n_chars == len(text[602].text) and text[603].text is None
    assert {x.doc_id for x in seen["packing"].collect()} == kept
    again = {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect() if x.start == 0}
    assert again == {tuple(x) for x in seen["packing"].select("doc_id", "start", "ids_crc32").collect() if x.start == 0}


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_whole_pipeline_equals_a_plain_one(spark, tmp_path):
    """Every stage by plain Python (dictionaries, all pairs, the network text by text, the tokenizer's own library), repeated and null ids and clashing columns included."""
    r = random.Random(19)
    base = [words(r, 60) for _ in range(150)]
    texts = base + [" ".join(w + "#$" for w in t.split()) for t in base[:12]] + [t + " end" for t in base[20:30]] + [base[40] + " write a.b@mail.example.com or 10.0.0.1 now", "", None]
    rows = [(i, t, "en" if i % 4 else None, "s", 1) for i, t in enumerate(texts)]
    rows += [(5, base[7], "en", "s", 1), (5, " ".join(w + "#$#" for w in base[9].split()), "en", "s", 1), (None, words(r, 50), None, None, None), (None, base[30], "en", "x", 2), rows[60], rows[60]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, __drop string"
    spark.createDataFrame([(*x, 1, "d") for x in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    good = set(range(40, 140))
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = [x for x, (_, _, keep) in zip(rows, plain_decisions([x[:3] for x in rows], good), strict=True) if keep]
    assert len(rows) - len(left) >= 12
    group = jaccard_classes([t or "" for _, t, *_ in left])
    first = {}
    for x, g in zip(left, group, strict=True):
        key = (x[0] is None, x[0] or 0, row_hash(x[1]))
        first[g] = min(first.get(g, (key, x)), (key, x), key=lambda k: k[0])
    kept = [x for _, x in first.values()]
    clean = [(i, None if t is None else redacted(t, merged(base_spans(t), model_spans([t], trained())[0]))) for i, t, *_ in kept]
    library = Tokenizer.from_file(BPE)
    want = sorted(((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")) for i, t in clean), key=lambda x: (str(x[0]), len(x[1]), x[1].tolist()))

    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x.length for x in made) == sum(len(ids) for _, ids in want)
    whole = sorted((str(x.doc_id), x.length, x.ids_crc32) for x in made if x.start == 0 and x.length == x.doc_tokens)
    sums = sorted((str(i), len(ids), zlib.crc32(ids.tobytes())) for i, ids in want)
    assert len(whole) >= 0.8 * len(sums) and not Counter(whole) - Counter(sums)
    assert Counter((str(x.doc_id), x.doc_tokens) for x in made if x.start == 0) == Counter(x[:2] for x in sums)
    stage = corpus_pipeline.private_data(spark, spark.createDataFrame([(*x, 1, "d") for x in kept], schema), str(tmp_path))
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__drop"] and sorted(((x.doc_id, x.text) for x in stage.collect()), key=str) == sorted(clean, key=str)

import math
import random
from collections import Counter, defaultdict

import xxhash

from bytefacts.llm.quality import ORDER, classify, codes, counted, kept, scores

from .helpers import edge_docs, edge_rows, got, no_docs, words


def grams(text):
    x = b"\n" * (ORDER - 1) + text.encode()
    return [x[i : i + ORDER] for i in range(len(x) - ORDER + 1)]


def plain_model(texts):
    """Modified Kneser-Ney by dictionaries: {n-gram: -log2 p} as a function."""
    levels = {ORDER: dict(Counter(g for t in texts for g in grams(t)))}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = dict(Counter(g[1:] for g in levels[n + 1]))
    rules = {}
    for n, c in levels.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
        d = [min(max(j - (j + 1) * y * k[j + 1] / k[j], 0.1), j - 0.1) if k[j] else j / 2 for j in (1, 2, 3)]
        total, mass = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1]
        rules[n] = (c, d, total, mass)

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, mass = rules[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        v = c.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p(g[1:])

    return lambda g: -math.log2(p(g))


def text_hash(text):
    return xxhash.xxh64_intdigest((text or "").encode(), 42)


def plain_scores(rows, good):
    """(doc_id, symbols, bits) by dictionaries: trained on trusted rows that are not held out."""
    trained = [t or "" for i, t in rows if i in good and (text_hash(t) - (1 << 64) * (text_hash(t) >> 63)) % 5]
    cost = plain_model(trained)
    return [(i, len((t or "").encode()), sum(map(cost, grams(t or "")))) for i, t in rows]


def same(found, want):
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=repr), sorted(want, key=repr), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4 * (1 + b[2]), (a, b)


SCRIPTS = ["слово за слово и снова дело", "λόγος και πάλι λόγος", "日本語の文章です。日本語", "한국어 문장 한국어", "كلمة بعد كلمة"]


def test_codes():
    for texts in (["abc", "", "de", ""], [""], ["", ""], ["Aé\n日"], []):
        want = [int.from_bytes(g, "big") for t in texts for g in grams(t)]
        assert codes([t.encode() for t in texts]).tolist() == want
    code, n = counted([b"aaaa", b"ab"], [b"zz", b"a"])
    want = Counter(int.from_bytes(g, "big") for t in ("aaaa", "ab") for g in grams(t))
    assert dict(zip(code.tolist(), n.tolist(), strict=True)) == want | {int.from_bytes(g, "big"): 0 for g in grams("zz")}


def test_scores_equal_dictionaries_in_every_script_and_blocking(spark):
    r = random.Random(1)
    rows = [(i, words(r, 30)) for i in range(40)] + [(100 + i, " ".join(r.choices(s.split(), k=6))) for i, s in enumerate(SCRIPTS * 4)]
    rows += [(200, "Aé 12,\n!"), (201, None), (202, ""), (None, "no id"), (3, "another text of id 3"), (3, rows[3][1])]
    good = {i for i, _ in rows if i is not None and i % 2 == 0} | {101, 3}
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in good], "doc_id long")
    want = plain_scores(rows, good)
    for block in (1 << 20, 500):
        same([(x.doc_id, x.symbols, x.bits) for x in scores(docs, ids, block=block).collect()], want)
    assert {x.text_hash & (1 << 64) - 1 for x in scores(docs, ids).collect()} == {text_hash(t) for _, t in rows}


def test_decisions_equal_the_definition(spark):
    r = random.Random(2)
    rows = [(i, words(r, 60), "en" if i % 3 else None) for i in range(300)] + [(400 + i, " ".join(r.choices(SCRIPTS[0].split(), k=40)), "ru") for i in range(150)]
    rows += [(1000 + i, " ".join(w + r.choice(["###", "$$$"]) for w in words(r, 60).split()), "en") for i in range(40)]
    rows += [(2000 + i, "".join(r.choices("ъѣѳщ#", k=200)), "ru") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {*range(200), *range(400, 540)}
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(5, 1, 0), (None, 1, 0), (1000, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in classify(docs, labels).collect()}
    assert len(out) == len(rows)
    assert not any(out[i].keep for i in out if i >= 1000)
    assert sum(out[i].keep for i in out if i < 1000) >= 0.98 * 450
    for (i, _, _), (rate, limit, keep) in zip(rows, plain_decisions(rows, good), strict=True):
        x = out[i]
        assert abs(math.log2(x.perplexity) - rate) < 1e-3 and abs(math.log2(x.threshold) - limit) < 1e-3
        assert x.keep == keep or abs(rate - limit) < 1e-3


def plain_decisions(rows, good):
    """(rate, limit, keep) of each row (id, text, lang) by plain arithmetic; 0.999 quantiles of under 1,000 rows are their largest."""
    scored = plain_scores([x[:2] for x in rows], good)
    lang, empty = [x or "und" for _, _, x in rows], [not t for _, t, _ in rows]
    trusted = [k for k, (i, _, _) in enumerate(rows) if i in good and not empty[k]]
    held = [k for k in trusted if (text_hash(rows[k][1]) - (1 << 64) * (text_hash(rows[k][1]) >> 63)) % 5 == 0]
    pool, by = held if len(held) >= 20 else trusted, defaultdict(list)
    for k in pool:
        by[lang[k]].append(k)
    mean = lambda ks: sum(scored[k][2] for k in ks) / sum(scored[k][1] for k in ks)
    own = lambda k: by[lang[k]] if len(by[lang[k]]) >= 20 else pool
    rate = [(scored[k][2] + 150 * mean(own(k))) / (scored[k][1] + 150) for k in range(len(rows))]
    limit = [1.02 * max(rate[j] for j in own(k)) for k in range(len(rows))]
    return [(r, m, r <= m) for r, m in zip(rate, limit, strict=True)]


def test_rows_of_one_id_are_decided_by_their_own_texts(spark):
    r = random.Random(3)
    schema = "doc_id long, text string, lang string, `a.b` int, __drop string, own_0 map<string,int>"
    rows = [(i, words(r, 60), "en", i, "x", {"k": i}) for i in range(120)]
    junk = [" ".join(w + "#$#" for w in words(r, 60).split()) for _ in range(3)]
    rows += [(5, junk[0], "en", 1, None, None), (None, junk[1], None, 2, None, None), (None, words(r, 60), None, 3, None, None), (6, None, "en", 4, None, None), (6, junk[2], "en", 5, None, None)]
    rows += rows[7:8]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1) for i in range(10, 110)], "doc_id long, quality int")
    left = kept(docs, labels)
    assert left.columns == docs.columns
    assert got(left) == sorted((x for x in map(tuple, docs.collect()) if x[1] not in junk), key=repr)


def test_edge_cases(spark):
    labels = spark.createDataFrame([(8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    docs = edge_docs(spark)
    out = classify(docs, labels)
    assert out.count() == docs.count()
    assert out.where("doc_id in (0, 1) and not keep").count() == 0
    assert got(classify(no_docs(spark), labels)) == [] and got(kept(no_docs(spark), labels)) == []
    untaught = classify(docs, labels.limit(0))
    assert untaught.count() == docs.count() and untaught.where("not keep").count() == 0
    assert kept(docs, labels.limit(0)).count() == len(edge_rows())

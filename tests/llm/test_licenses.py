import random
import re
import time

from bytefacts.llm.license_rules import HAND
from bytefacts.llm.licenses import STEMS, rules, scan_licenses

from .helpers import edge_docs, edge_rows, got, no_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_rules_are_hundreds_by_hand_and_gated():
    table = rules()
    assert len(HAND) > 200 and len({r.pattern for r in table}) > 280 and all(0 <= r.priority < 4 and 0 < r.confidence <= 1 for r in table)
    for r in table:
        needed = re.sub(r"\((?:[^()]|\([^()]*\))*\)(?:\?|\{0)", "", r.pattern)  # without what may be missing
        assert any(s in needed for s in STEMS), r
        assert re.search(r.keyword.split(" ")[0], r.pattern), r


def plain(text):
    """(labels, score) by a loop over all rules and all pairs of detections."""
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    norm, found = " " + " ".join(w) + " ", []
    for r in rules():
        if f" {r.keyword}" in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, -(start + m[0].count(" ") + 1), r.priority, r.label, r.confidence))
    kept = []
    for d in sorted(found):
        if not any(k[0] <= d[0] and k[1] <= d[1] and k[2] <= d[2] for k in kept):
            kept.append(d)
    labels = {k[3] for k in kept} | {label for _, label in base_places(w)}
    return ",".join(sorted(labels)), max([k[4] for k in kept] + [0.8] * bool(base_places(w)), default=0.0)


def base_places(w):
    return [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]


def example(r, pattern):
    """A text that the pattern matches: choices are made at random."""
    while (m := re.search(r"\(\?:([^()]*)\)(\?|\{(\d),(\d+)\})?", pattern)) or (m := re.search(r"\(([^()?]*)\)(\?|\{(\d),(\d+)\})?", pattern)):
        times = 1 if not m[2] else r.randint(0, 1) if m[2] == "?" else r.randint(int(m[3]), int(m[4]))
        pattern = pattern[: m.start()] + "".join(r.choice(m[1].split("|")) for _ in range(times)) + pattern[m.end() :]
    pattern = re.sub(r"\[\^ \]\+", lambda _: r.choice(["foo", "bar1", "mit"]), pattern)
    pattern = re.sub(r"\[([a-z0-9-]+)\]", lambda m: r.choice(m[1].replace("1-4", "1234").replace("-", "")), pattern)
    return re.sub(r"(.)\?", lambda m: r.choice([m[1], ""]), pattern)


def test_labels_and_scores_equal_a_loop_over_all_rules(spark):
    r, texts = random.Random(4), []
    table = rules()
    for k in range(500):
        parts = [example(r, r.choice(table).pattern) for _ in range(r.randint(1, 4))]
        parts += [r.choice(["license", "the MIT License", "gnu", "version 2", "creative commons", "or later", "é license"]) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        glue = r.choice([" ", ", ", "\n", "  -- "])
        texts.append(glue.join(p.title() if r.random() < 0.2 else p for p in parts))
    texts += [example(r, x.pattern) for x in table]
    got_ = {x.doc_id: (x.labels, x.score) for x in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()}
    for i, t in enumerate(texts):
        assert got_[i] == plain(t), t
    assert sum(bool(labels) for labels, _ in got_.values()) > 0.95 * len(texts)


def test_many_places_take_linear_time(spark):
    docs = spark.createDataFrame([(n, "mit license " * n) for n in (10, 8_000, 64_000)], "doc_id long, text string")
    began = time.time()
    out = {x.doc_id: x for x in scan_licenses(docs).collect()}
    assert time.time() - began < 60
    assert all((x.n_base, x.first_word, x.last_word, x.labels) == (n, 0, 2 * n - 2, "mit") for n, x in out.items())


def test_detections(spark):
    cases = {
        "Licensed under the MIT License. MIT  license!": ("mit", "mit"),
        "SPDX-License-Identifier: GPL-3.0-only": ("", "gpl-3.0"),
        "under the GNU General Public License, version 3": ("gpl", "gpl,gpl-3.0"),
        "the GNU Lesser General Public License version 2.1": ("gpl", "gpl,lgpl-2.1"),
        "Apache License, Version 2.0": ("apache", "apache,apache-2.0"),
        "Licensed under CC BY-NC 4.0.": ("", "cc-by-nc-4.0"),
        "Creative Commons Attribution ShareAlike 3.0 International": ("", "cc-by-sa-3.0"),
        "All rights reserved": ("", "proprietary"),
        "permit licenses": ("", ""),
        "summit license": ("", ""),
        "mit license" + " x" * 40_000 + " mit license": ("mit", "mit"),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in scan_licenses(docs).collect():
        text, want = list(cases.items())[r.doc_id]
        assert (r.base_labels, r.labels) == want, text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_a_contained_detection_is_suppressed(spark):
    docs = spark.createDataFrame([(1, "available under the Mozilla Public License version 2.0")], "doc_id long, text string")
    assert scan_licenses(docs).first().labels == "mpl-2.0"  # not the bare name within it


def test_edge_cases(spark):
    want = sorted(((i, *base(t or "")) for i, t, *_ in edge_rows()), key=repr)
    assert got(scan_licenses(edge_docs(spark)).drop("labels", "score")) == want
    assert got(scan_licenses(no_docs(spark))) == []
    assert "Python" not in scan_licenses(edge_docs(spark))._jdf.queryExecution().toString()

import hashlib
import random
import re

import numpy as np

from bytefacts.llm.pii import KINDS, RIM, TAGS, WINDOW, BiLstmCrf, allowed, base_spans, blended, luhn, merged, model_spans, pii_spans, redact, redacted, symbols, synthetic, trained, window_starts, written

from .helpers import edge_docs, edge_rows, got, no_docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    r = random.Random(3)
    texts = ["".join(r.choice("a1.@-+ 2%b(5é") for _ in range(60)) for _ in range(4000)]
    texts += ["x@y.z-._q@d.e", "4111 1111-1111 1111", "+1 (437) 555-0689", "256.1.1.1 001.2.3.4 1.2.3.4.5.6", "a@b@c.d", "+12 ...... 345678901)"]
    for t in texts:
        assert base_spans(t) == plain(t), t
    assert base_spans("a" * 200_000 + "@") == [] and base_spans("1" * 200_000) == []


def test_gradient_equals_differences():
    net = BiLstmCrf(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts = synthetic(2, 5)
    ids = np.stack([np.resize(symbols(t), 20) for t, _ in texts])
    y = np.zeros((2, 20), dtype=np.int64)
    y[0, 3:6] = [1, 2, 2]
    _, grad = net.gradient(ids, y)
    r = np.random.default_rng(1)
    for k in ("e", "o", "ob", "x", "x", "h", "h", "c", "c", "t"):
        at = tuple(r.integers(0, n) for n in net.w[k].shape) if k != "e" else (int(ids[0, 4]), 1)
        at = (0, 1) if k == "t" else at
        keep, eps = net.w[k][at], 1e-3
        net.w[k][at] = keep + eps
        up = net.gradient(ids, y)[0]
        net.w[k][at] = keep - eps
        down = net.gradient(ids, y)[0]
        net.w[k][at] = keep
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 2e-3 + 0.02 * abs(grad[k][at]), k


def test_held_out_accuracy():
    data = synthetic(300, 1234)
    found = model_spans([t for t, _ in data], trained())
    right = sum(len(set(s) & set(g)) for (_, s), g in zip(data, found, strict=True))
    assert right >= 0.75 * sum(len(s) for _, s in data)
    assert right >= 0.75 * sum(map(len, found))


def test_windows_are_reconciled_across_their_borders():
    for shift in range(0, 140, 7):
        text = "the ing ion " * 12 + "x" * shift + " +1 (437) 555-0689 " + "era st le " * 20
        spans = [s for s in model_spans([text], trained())[0] if s[0] == "phone"]
        assert [text[a:b] for _, a, b in spans] == ["+1 (437) 555-0689"], shift
    assert model_spans(["no digit here " * 50, ""], trained()) == [[], []]


def test_merging_and_redaction():
    base = [("email", 0, 5), ("card", 8, 12)]
    assert merged(base, [("phone", 4, 9), ("ip", 20, 27)]) == [("email", 0, 5), ("ip", 20, 27), ("card", 8, 12)]
    assert redacted("0123456789abc", [("email", 2, 5), ("ip", 4, 8)]) == "01[EMAIL]89abc"
    assert redacted("", []) == ""


def test_edge_cases(spark):
    for r in pii_spans(edge_docs(spark)).collect():
        texts = {t for i, t, *_ in edge_rows() if i == r.doc_id}
        base = base_spans(texts.pop() or "")
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(written(base).split(",")) - {""} <= set(r.spans.split(","))
    assert got(pii_spans(no_docs(spark))) == []
    out = redact(edge_docs(spark))
    assert out.columns == edge_docs(spark).columns and out.count() == len(edge_rows())
    assert out.where("text is null").count() == 1
    one = spark.createDataFrame([(1, "mail a.b@mail1.example.com now", 7)], "doc_id long, text string, extra int")
    assert redact(one).first() == (1, "mail [EMAIL] now", 7)


def test_disguised_addresses_without_a_digit_are_read(spark):
    text = "the ing ion write to jane.doe [at] example [dot] org for more ou la ve"
    assert [(k, text[a:b]) for k, a, b in model_spans([text], trained())[0]] == [("email", "jane.doe [at] example [dot] org")]
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert redact(one).first().text == "the ing ion write to [EMAIL] for more ou la ve"
    bare = [(t, s) for t, spans in synthetic(600, 4321) for s in spans if not re.search("[0-9@]", t[s[1] : s[2]])]
    assert len(bare) > 20
    assert sum(s in model_spans([t], trained())[0] for t, s in bare) >= 0.7 * len(bare)


def whole(em, net):
    """Best tag sequence over all places, one by one, with 0 before and after."""
    tr = np.where(allowed(), net.w["t"], np.float32(-1e4))
    score, back = tr[0] + em[0], []
    for e in em[1:]:
        back.append((score[:, None] + tr).argmax(axis=0))
        score = (score[:, None] + tr).max(axis=0) + e
    tags = [int((score + tr[:, 0]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return np.array(tags[::-1])


def test_reading_equals_training_form():
    ids = np.stack([np.resize(symbols(t), 128) for t, _ in synthetic(20, 77)])
    em = trained().emissions(ids)
    assert np.allclose(trained().read(ids), em[:, :, 1:] - em[:, :, :1], atol=1e-3)


def test_reading_by_the_graph_equals_plain_reading(monkeypatch):
    """Other weights than the trained ones, biases of every gate among them; batches of other shapes; without onnxruntime it is read by numpy."""
    from bytefacts.llm import lstm_graph

    r = np.random.default_rng(5)
    net = BiLstmCrf(3)
    net.w = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.w.items()}
    for batch, n in ((1, 1), (3, 17), (40, WINDOW)):
        ids = r.integers(0, len(net.w["e"]), (batch, n))
        em = net.emissions(ids)
        want = em[:, :, 1:] - em[:, :, :1]
        states = lstm_graph.reader(net.w)(np.ascontiguousarray(ids.T))
        assert states.shape == (n, 2, batch, net.w["h"].shape[1])
        assert np.allclose(net.read(ids), want, atol=1e-4) and np.allclose(net.read_plain(ids), want, atol=1e-4)
    monkeypatch.setattr(lstm_graph, "reader", lambda w: None)
    assert np.array_equal(net.read(ids), net.read_plain(ids))


def test_the_graph_steps_all_windows_and_both_directions_at_once():
    """No operator that works row by row; states equal a plain loop's, those of the second direction from the last place to the first."""
    from bytefacts.llm import lstm_graph

    r = np.random.default_rng(9)
    net = BiLstmCrf(4)
    net.w = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in net.w.items()}
    model, hidden = lstm_graph.graph(net.w), net.w["h"].shape[1]
    assert b"LSTM" not in model and [model.count(op) for op in (b"Scan", b"MatMul", b"Gather")] == [1, 4, 4]
    ids = r.integers(0, len(net.w["e"]), (600, 40))
    states = lstm_graph.reader(net.w)(np.ascontiguousarray(ids.T))
    for d, seen in enumerate((ids, ids[:, ::-1])):
        h = c = np.zeros((len(ids), hidden))
        for t in range(ids.shape[1]):
            i, f, o, u = np.split(net.w["e"][seen[:, t]] @ net.w["x"][d] + net.w["c"][d] + h @ net.w["h"][d], 4, axis=1)
            c = c / (1 + np.exp(-f)) + np.tanh(u) / (1 + np.exp(-i))
            h = np.tanh(c) / (1 + np.exp(-o))
            assert np.allclose(states[t, d], h, atol=1e-4)


def test_spans_are_those_of_one_sequence_over_the_whole_text():
    net = trained()
    r = random.Random(11)
    texts = ["".join(t + " " for t, _ in synthetic(n, 500 + n)) for n in (1, 2, 3, 5, 9, 20)] + ["a", "+1 (437) 555-0689", "x" * WINDOW, "y@" * 300, "".join(r.choice("0123456789.@- []at") for _ in range(1500))]
    em = blended(texts, net)
    for text, e, found in zip(texts, em, model_spans([*texts, "", texts[0]], net)[:-2], strict=True):
        starts, total, weight = window_starts(len(text)), np.zeros((len(text), TAGS)), np.zeros((len(text), 1))
        assert starts[0] == 0 and starts[-1] == max(0, len(text) - WINDOW) and max(np.diff(starts), default=0) <= WINDOW
        for a in starts:
            size = min(WINDOW, len(text) - a)
            ids = np.zeros((1, WINDOW), dtype=np.int64)
            ids[0, :size] = symbols(text[a : a + size])
            weighed = net.emissions(ids)[:size, 0] * RIM[:size, None]
            total[a : a + size] += weighed
            weight[a : a + size, 0] += RIM[:size]
        total /= weight
        assert np.allclose(e.T, total[:, 1:] - total[:, :1], atol=1e-3)
        tags = whole(total, net)
        want, at = [], 0
        while at < len(tags):
            end = at + 1
            while tags[at] % 2 and end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            if tags[at] % 2:
                want.append((KINDS[tags[at] // 2], at, end))
            at = end
        assert found == [s for s in want if s[0] != "card" or luhn(re.sub("[^0-9]", "", text[s[1] : s[2]]))]


def test_redaction_of_many_spans_is_linear():
    base = [("email", 10 * i, 10 * i + 5) for i in range(60_000)]
    more = [("ip", 10 * i + 6, 10 * i + 9) for i in range(60_000)] + [("ip", 3, 12)]
    assert merged(base, more) == base + more[:-1]

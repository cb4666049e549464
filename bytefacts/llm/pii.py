"""Personal data: fixed patterns, and a character BiLSTM with a CRF, trained here from labelled spans.

The base patterns run over every whole text. The network reads overlapping windows, all of them: disguised
addresses need hold neither a digit nor an at-sign. Windows are reconciled globally: where they overlap, their emissions
are weighed by the distance from their rims, and one tag sequence is decoded for the whole text under
constraints (a span opens with B, goes on with I of its kind). Places where that sequence is proven to lie outside
spans are left out of the search, which stays exact.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from bytefacts.llm import common, lstm_graph

KINDS = ("email", "ip", "card", "phone")
#: Runs are taken whole (possessive) and kept only if what must follow does, which finds the leftmost matches in linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as in KINDS, then by start; code points, end exclusive."""
    if not TRIGGER.search(text):
        return []
    out: list[Span] = []
    if "@" in text:
        out += [("email", *m.span()) for m in EMAIL.finditer(text) if m[1]]
    out += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# The network. Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k goes on with it.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, EMBED = 16, 12
#: Windows that texts are read in, and those that are trained on.
WINDOW, STRIDE, LESSON = 256, 216, 128
TRAIN_WINDOWS, EPOCHS, BATCH = 3200, 8, 32
_CLASSES = "abcdefghijklmnopqrstuvwxyz0123456789 \n.,:;!?@+-_()[]/\\'\"=#*|<>&$%"
SYMBOLS = len(_CLASSES) + 4


@functools.cache
def _table() -> np.ndarray:
    """Symbol of each code point below 256: letters by themselves in either case, digits as one class each."""
    t = np.full(256, SYMBOLS - 1, dtype=np.int64)
    for i, c in enumerate(_CLASSES):
        t[ord(c)] = i + 1
        t[ord(c.upper())] = i + 1
    return t


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.where(points < 256, _table()[np.minimum(points, 255)], SYMBOLS - 2)


def synthetic(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """n labelled windows: invented words with personal data in common and in disguised forms."""
    r = np.random.default_rng(seed)
    syllables = "the ing ion er an re en le de ou la st ve ch un ti os ca mi ro ba".split()
    foreign = "é ñ ü ß ç ä ö ó í å ø ł ж к о л а н и т е р ν α ι σ ה ל م ن あ の 日 本 語 国 한 글".split()
    onsets, vowels, codas = "b c ch d f g h j k l m n p qu r s sch t tr v w x y z".split() + [""], "a e i o u ea ie ou y".split(), "n r s t nd nt m l st ck x".split() + [""] * 6

    def ascii_word() -> str:
        if r.random() < 0.5:
            return "".join(r.choice(syllables, r.integers(1, 5)))
        return "".join(str(r.choice(part)) for _ in range(r.integers(1, 5)) for part in (onsets, vowels, codas))

    def word() -> str:
        """Now and then with letters of other scripts."""
        if r.random() < abroad:
            return "".join(r.choice(syllables if r.random() < mixed else foreign, r.integers(1, 6)))
        return ascii_word()

    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def card() -> str:
        d = str(r.integers(3, 7)) + digits(14)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        sep = r.choice(["", "", " ", "-", ".", "/", "_"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def item(kind: str) -> str:
        if kind == "email":
            at, dot = [("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), ("(at)", ".")][r.integers(6)]
            tail = "" if at in ("@", " @ ") or r.random() < 0.7 else digits(2)
            return f"{ascii_word()}{r.choice(['', '.', '_'])}{ascii_word()}{tail}{at}{ascii_word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'example' + dot + 'com'])}"
        if kind == "ip":
            return r.choice([".", ".", ".", " . ", "[.]"]).join(str(x) for x in r.integers(0, 256, 4))
        if kind == "card":
            return card()
        return r.choice([f"+{r.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{r.integers(20, 99)} {digits(3)} {digits(7)}", f"+{r.integers(20, 99)}{digits(9)}"])

    def harmless() -> str:
        return r.choice([digits(int(r.integers(1, 6))), f"{r.integers(1, 10)}.{r.integers(0, 10)}", f"version {r.integers(1, 9)}.{r.integers(0, 9)}.{r.integers(0, 9)}", f"{r.integers(1900, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", f"{digits(2)}:{digits(2)}", f'token = "{"".join(r.choice(list("0123456789abcdef"), 40))}"', f"#{digits(7)}", f"{digits(9)}", f"@{word()}", f"{r.integers(1, 99)} %", *(word() + str(r.choice(list("!#$%&*|.=-"))) * int(r.integers(1, 5)) for _ in range(4)), f"({word()})", f"[{word()}]", f"({r.choice(['at', 'dot'])} {word()})", f"{word()}_{word()}", f"{word()}.{word()}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        abroad, mixed, again = r.choice([0, 0.2, 0.7]), r.choice([0, 0.5, 0.9]), r.random() < 0.1
        shout = r.choice([0, 0.05, 0.9], p=[0.7, 0.2, 0.1])
        while len(text) < LESSON:
            p = r.random()
            if again and text:  # one word over and over
                put = last
            elif p < 0.09:
                kind = str(r.choice(KINDS))
                put = item(kind)
                if len(text) + len(put) <= LESSON:
                    spans.append((kind, len(text), len(text) + len(put)))
            elif p < 0.2:
                put = harmless()
            else:
                put = word()
                put = put.upper() if r.random() < shout else put.capitalize() if r.random() < 0.15 else put
            last = str(put)
            text += last + str(r.choice([" ", " ", " ", " ", ", ", ". ", "\n", "*** ", "!! ", " | "]))
        start = int(r.integers(0, 3))
        text = text[start : start + (LESSON if r.random() < 0.7 else int(r.integers(1, LESSON)))]
        out.append((text, [(k, a - start, b - start) for k, a, b in spans if a >= start and b - start <= len(text)]))
    return out


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    y = np.zeros(len(text), dtype=np.int64)
    for k, a, b in spans:
        y[a:b] = 2 + 2 * KINDS.index(k)
        y[a] -= 1
    return y


def allowed() -> np.ndarray:
    """allowed[i, j]: tag j may follow tag i. A span begins after 0 and goes on with its own kind."""
    ok = np.zeros((TAGS, TAGS), dtype=bool)
    ok[0, 1::2] = ok[:, 0] = True
    for k in range(len(KINDS)):
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLstmCrf:
    """Weights by name; float32. Gates in the order input, forget, output, candidate; x, h and c hold both directions."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        forget = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w = {"e": g(SYMBOLS, EMBED) * np.float32(np.sqrt(SYMBOLS / EMBED)), "x": g(2, EMBED, 4 * HIDDEN), "h": g(2, HIDDEN, 4 * HIDDEN), "c": np.stack([forget, forget])}
        self.w |= {"o": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: batch x time -> time x batch x TAGS. Both directions step together, the second over the reversed text."""
        b, n = ids.shape
        x = self.w["e"][np.stack([ids.T, ids.T[::-1]])]
        pre = (x.reshape(2, n * b, -1) @ self.w["x"] + self.w["c"][:, None]).reshape(2, n, b, -1)
        h = c = np.zeros((2, b, HIDDEN), np.float32)
        out, tape = np.empty((2, n, b, HIDDEN), pre.dtype), []
        for t in range(n):
            z = pre[:, t] + h @ self.w["h"]
            s = _sigmoid(z[..., : 3 * HIDDEN])
            i, f, o, u = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], np.tanh(z[..., 3 * HIDDEN :])
            c0, h0 = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                tape.append((i, f, o, u, c0, h0, tc))
        both = np.concatenate([out[0], out[1, ::-1]], axis=2)
        em = both @ self.w["o"] + self.w["ob"]
        return (em, (x, both, tape)) if keep else em

    def read(self, ids: np.ndarray) -> np.ndarray:
        """emissions() less that of tag 0, as time x batch x TAGS - 1, for reading only: by onnxruntime, or by numpy where that is not installed."""
        states = lstm_graph.reader(self.w)
        if states is None:
            return self.read_plain(ids)
        y, out = states(np.ascontiguousarray(ids.T)), self.w["o"][:, 1:] - self.w["o"][:, :1]
        em = y[:, 0] @ out[:HIDDEN]
        em += (y[:, 1] @ out[HIDDEN:])[::-1]
        em += self.w["ob"][1:] - self.w["ob"][0]
        return em

    def read_plain(self, ids: np.ndarray) -> np.ndarray:
        """read() by numpy.

        Inputs of each symbol are worked out once, gates lie in planes, sigmoids are (1 + tanh of half) / 2, with the
        halves of the output gate left to the weights: h here is twice the state.
        """
        b, n = ids.shape
        steps = np.ascontiguousarray(ids.T)
        half = np.array([0.5, 0.5, 0.5, 1], np.float32)[:, None, None]
        planes = lambda m: np.ascontiguousarray(m.reshape(2, -1, 4, HIDDEN).transpose(0, 2, 1, 3) * half, dtype=np.float32)
        ahead, behind = planes(self.w["e"] @ self.w["x"] + self.w["c"][:, None])
        wh, out = planes(self.w["h"] / 2), (self.w["o"][:, 1:] - self.w["o"][:, :1]) / 2
        h = _states(n, b)
        h[:, 0] = 0
        c, tc = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
        z, pre = np.empty((2, 4, b, HIDDEN), np.float32), np.empty((2, 4, b, HIDDEN), np.float32)
        gates, i, f, o, u = z[:, :3], z[:, 0], z[:, 1], z[:, 2], z[:, 3]
        for t in range(n):
            ahead.take(steps[t], 1, pre[0], "clip")
            behind.take(steps[n - 1 - t], 1, pre[1], "clip")
            np.matmul(h[:, None, t], wh, out=z)
            np.add(z, pre, z)
            np.tanh(z, z)
            np.add(gates, 1, gates)
            np.multiply(c, f, c)
            np.multiply(i, u, tc)
            np.add(c, tc, c)
            np.multiply(c, 0.5, c)
            np.tanh(c, tc)
            np.multiply(tc, o, h[:, t + 1])
        first, second = h[0, 1:].reshape(n * b, -1) @ out[:HIDDEN], h[1, 1:].reshape(n * b, -1) @ out[HIDDEN:]
        em = first.reshape(n, b, -1)
        em += second.reshape(n, b, -1)[::-1]
        em += self.w["ob"][1:] - self.w["ob"][0]
        return em

    def _back(self, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        wh, (_, n, b, _) = self.w["h"].transpose(0, 2, 1), x.shape
        dh = dc = np.zeros((2, b, HIDDEN), np.float32)
        dz = np.empty((2, n, b, 4 * HIDDEN), x.dtype)
        for t in reversed(range(n)):
            i, f, o, u, c0, _, tc = tape[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[:, t] = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=2)
            dh, dc = dz[:, t] @ wh, dc * f
        flat = dz.reshape(2, n * b, -1)
        grad["x"] = x.reshape(2, n * b, -1).transpose(0, 2, 1) @ flat
        grad["h"] = np.stack([p[5] for p in tape], axis=1).reshape(2, n * b, -1).transpose(0, 2, 1) @ flat
        grad["c"] = flat.sum(axis=1)
        return (flat @ self.w["x"].transpose(0, 2, 1)).reshape(x.shape)

    def gradient(self, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (batch x time) under the CRF, and its gradient."""
        em, (x, both, tape) = self.emissions(ids, keep=True)
        n, b, _ = em.shape
        tr = np.where(allowed(), self.w["t"], np.float32(-30))
        alpha = np.empty_like(em)
        alpha[0] = em[0]
        for t in range(1, n):
            alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + tr, 1)
        logz = _lse(alpha[-1], 1)
        beta = np.zeros_like(em[0])
        demit, dtr = np.empty_like(em), np.zeros_like(tr)
        demit[-1] = np.exp(alpha[-1] - logz[:, None])
        for t in range(n - 1, 0, -1):
            right = em[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + tr + right[:, None, :] - logz[:, None, None])
            dtr += pair.sum(axis=0)
            beta = _lse(tr + right[:, None, :], 2)
            demit[t - 1] = np.exp(alpha[t - 1] + beta - logz[:, None])
        rows, yt = np.arange(b), y.T
        gold = np.zeros(b, np.float32)
        for t in range(n):
            gold += em[t, rows, yt[t]]
            demit[t, rows, yt[t]] -= 1
            if t:
                gold += tr[yt[t - 1], yt[t]]
                np.add.at(dtr, (yt[t - 1], yt[t]), -1)
        demit /= b
        grad = {"t": np.where(allowed(), dtr / b, 0).astype(np.float32), "o": both.reshape(n * b, -1).T @ demit.reshape(n * b, -1), "ob": demit.sum(axis=(0, 1))}
        dboth = demit @ self.w["o"].T
        dx = self._back(x, tape, np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]]), grad)
        dx = dx[0] + dx[1, ::-1]
        grad["e"] = np.zeros_like(self.w["e"])
        np.add.at(grad["e"], ids.T, dx)
        return float((logz - gold).mean()), grad

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Best tag sequences (time x batch) for emissions."""
        tr = np.where(allowed(), self.w["t"], np.float32(-1e4))
        n, b, _ = em.shape
        score, back = em[0], np.empty((n, b, TAGS), np.int8)
        for t in range(1, n):
            all_ = score[:, :, None] + tr
            back[t] = all_.argmax(axis=1)
            score = em[t] + all_.max(axis=1)
        best = np.empty((n, b), np.int64)
        best[-1] = score.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            best[t - 1] = back[t][np.arange(b), best[t]]
        return best


@functools.lru_cache(maxsize=1)
def _states(n: int, b: int) -> np.ndarray:
    """Room for the states of read_plain(), used again for the next windows."""
    return np.empty((2, n + 1, b, HIDDEN), np.float32)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


@functools.cache
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = 7) -> BiLstmCrf:
    """The network fitted by Adam to `windows` labelled windows; the same weights for the same arguments."""
    net, data = BiLstmCrf(seed), synthetic(windows, seed)
    ids = np.stack([_padded(symbols(t), LESSON) for t, _ in data])
    tags = np.stack([_padded(tags_of(t, s), LESSON) for t, s in data])
    r, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    total = epochs * -(-windows // BATCH)
    for _ in range(epochs):
        order = r.permutation(windows)
        for at in range(0, windows, BATCH):
            pick, step = order[at : at + BATCH], step + 1
            _, grad = net.gradient(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = 0.02 * (1 - step / (total + 1))
            for k, g in grad.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _padded(x: np.ndarray, n: int) -> np.ndarray:
    return np.pad(x, (0, n - len(x)))


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of n code points begin: STRIDE apart, the last one at its end."""
    return [*range(0, max(n - WINDOW, 0), STRIDE), max(n - WINDOW, 0)] if n else []


#: Where windows overlap, each counts by how far the place is from its rim.
RIM = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def blended(texts: list[str], net: BiLstmCrf, block: int = 512) -> list[np.ndarray]:
    """Emissions of each whole text less that of tag 0 (TAGS - 1 x code points): those of its windows, weighed by RIM where they overlap."""
    first = np.cumsum([0, *map(len, texts)])
    ids = np.append(symbols("".join(texts)), np.zeros(WINDOW, dtype=np.int64))
    total, weight = np.zeros((TAGS - 1, first[-1]), np.float32), np.zeros(first[-1], np.float32)
    views = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    jobs = [(first[i] + a, min(WINDOW, len(t))) for i, t in enumerate(texts) for a in window_starts(len(t))]
    for at in range(0, len(jobs), block):
        part = jobs[at : at + block]
        seen = views[[a for a, _ in part]]
        for row, (_, n) in zip(seen, part, strict=True):
            row[n:] = 0
        em = net.read(seen)
        em *= RIM[:, None, None]
        em = np.ascontiguousarray(em.transpose(1, 2, 0))
        for (a, n), e in zip(part, em, strict=True):
            total[:, a : a + n] += e[:, :n]
            weight[a : a + n] += RIM[:n]
    total /= np.maximum(weight, 1)
    return [total[:, a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def undecided(gain: np.ndarray, tr: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (end exclusive) outside which the best tag sequence of the whole text is proven to be 0; gain as of blended.

    Spans are runs of one kind with 0 before and after, so what a run adds to a sequence of 0 is a start, a sum of what its places
    add, and an end. Where no run of any kind through a place adds anything, the best sequence has 0 there.
    """
    first, inner = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
    begin, more, end = tr[0, first] - tr[0, 0], np.maximum(tr[first, inner], tr[inner, inner]) - tr[0, 0], np.maximum(tr[first, 0], tr[inner, 0]) - tr[0, 0]
    open_ = np.zeros(gain.shape[1], dtype=bool)
    for k in range(len(KINDS)):
        on = np.cumsum(gain[2 * k + 1] + more[k], dtype=np.float64)
        start = gain[2 * k] - on
        np.maximum.accumulate(start, out=start)
        np.maximum.accumulate(on[::-1], out=on[::-1])
        start += on
        open_ |= start >= -1e-3 - begin[k] - end[k]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def model_spans(texts: list[str], net: BiLstmCrf, section: int = 1 << 19) -> list[list[Span]]:
    """Spans that the network finds in each text: one best tag sequence over the whole text, as if 0 stood before and after it."""
    out: dict[str, list[Span]] = dict.fromkeys(texts, [])
    group, size = [], 0
    for text in [*out, None]:  # equal texts are read once; some 60 bytes for a code point
        if group and (text is None or size + len(text) > section):
            out |= zip(group, _spans_of(group, net), strict=True)
            group, size = [], 0
        if text:
            group.append(text)
            size += len(text)
    return [out[t] for t in texts]


def _spans_of(texts: list[str], net: BiLstmCrf, block: int = 256) -> list[list[Span]]:
    gains = blended(texts, net)
    tr = np.where(allowed(), net.w["t"], np.float32(-1e4))
    jobs = sorted((b - a, i, a) for i, g in enumerate(gains) for a, b in undecided(g, tr))
    found: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):
        part = [j for j in jobs[at : at + block] if j[0] <= 2 * jobs[at][0]]  # of like lengths
        at += len(part)
        padded = np.full((part[-1][0] + 2, len(part), TAGS), np.float32(-1e4))
        padded[:, :, 0] = 0
        for j, (n, i, a) in enumerate(part):
            padded[1 : n + 1, j, 0] = 0
            padded[1 : n + 1, j, 1:] = gains[i][:, a : a + n].T
        tags = net.decode(padded)
        for j, (n, i, a) in enumerate(part):
            found[i] += spans_of_tags(tags[1 : n + 1, j], a)
    return [sorted((s for s in f if s[0] != "card" or luhn(NOT_DIGIT.sub("", t[s[1] : s[2]]))), key=lambda s: s[1]) for t, f in zip(texts, found, strict=True)]


def spans_of_tags(tags: np.ndarray, at: int = 0) -> list[Span]:
    """Spans of a tag sequence that begins at code point `at`: each runs from its B over the I that follow."""
    begins = np.flatnonzero(tags % 2 == 1)
    ends = np.append(np.flatnonzero(np.diff(tags > 0, append=False) | np.append(tags[1:] % 2 == 1, False)) + 1, len(tags))
    return [(KINDS[(int(tags[b]) - 1) // 2], at + int(b), at + int(ends[np.searchsorted(ends, b + 1)])) for b in begins]


def merged(base: list[Span], more: list[Span]) -> list[Span]:
    """All base spans, and those of `more` that touch none of them; in the order of base_spans."""
    runs: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    ends = [r[1] for r in runs]
    kept = [s for s in more if (at := bisect.bisect_right(ends, s[1])) == len(runs) or runs[at][0] >= s[2]]
    return sorted({*base, *kept}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover replaced by its kind in capitals; overlapping spans make one stretch, named after its first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _weights(docs: DataFrame):
    """The trained weights as a broadcast: some 60 kB, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast(trained().w)


def _net(w: dict) -> BiLstmCrf:
    net = BiLstmCrf.__new__(BiLstmCrf)
    net.w = w
    return net


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base spans, SHA-256 of the base spans, all spans.

    Null texts count as empty (no spans); null ids and repeated rows stay; extra columns are
    ignored; texts of any length are read whole. One pass, no shuffle.
    """
    weights = _weights(docs)

    def kernel(ids: list, texts: list) -> dict:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": []}
        for text, more in zip(texts, model_spans(texts, _net(weights.value)), strict=True):
            base = base_spans(text)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(merged(base, more)))
        return {"doc_id": ids} | out

    return common.map_texts(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", kernel, id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind; other columns, whatever their names, and null texts, stay as they are."""
    import pyarrow as pa

    common.ship(docs.sparkSession)
    weights, at = _weights(docs), docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, f"c{at}"):
                texts = part.column(at).to_pylist()
                full = [t or "" for t in texts]
                more = model_spans(full, _net(weights.value))
                new = [None if t is None else redacted(t, merged(base_spans(t), m)) for t, m in zip(texts, more, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, type=part.schema.field(at).type))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(common.read(spark, sf_dir, "documents"))

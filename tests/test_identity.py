import hashlib
import time

import pytest
from pyspark.sql import functions as F

from bytefacts.functions import words
from bytefacts.operators import disasm, identity
from bytefacts.plans import batch, predicate, query
from bytefacts.sources import artifacts
from bytefacts.sources.chunks import Chunk, encode, walk

from .test_callees import END, proto, s
from .test_chunks import i51

DOMAIN = b"some-scheme"


def nested():
    """Three levels; the children of the middle one are equal but for their names and lines."""

    def leaf(line):
        made = proto([i51("GETUPVAL", 0, 0), i51("GETTABLE", 1, 0, 256), i51("JMP", sbx=-3), END], [s(b"k")], upvalues=1)
        made.source, made.lines = b"@%d" % line, [line] * 4
        return made

    middle = proto([i51("CLOSURE", 0, bx=0), i51("MOVE", 0, 3), i51("CLOSURE", 1, bx=1), i51("GETUPVAL", 0, 0), i51("SETLIST", 0, 1, 0), 77, END], protos=[leaf(1), leaf(9)], upvalues=1)
    return proto([i51("CLOSURE", 0, bx=0), i51("MOVE", 0, 2), i51("LOADK", 1, bx=0), i51("LOADK", 1, bx=5), i51("SELF", 1, 2, 300), END], [s(b"a"), s(b"b")], [middle])


def u64(n):
    return (n & (1 << 64) - 1).to_bytes(8, "big")


def plain(p, children):
    """A prototype's digest by a walk over its words; roles are put by hand for these few instructions."""
    out = DOMAIN + b"\0\x01" + u64(6) + b"lua5.1" + bytes([p.numparams, p.is_vararg, p.maxstacksize]) + u64(len(p.code))
    left, names = [], words.NAMES["5.1"]
    for pc, w in enumerate(p.code):
        op, a, c, b, bx = w & 63, w >> 6 & 255, w >> 14 & 511, w >> 23 & 511, w >> 14 & 0x3FFFF
        name, role, operands = names[op] if op < len(names) else "?", "instruction", []
        R, N = lambda x: (b"\x20" + bytes([x & 255]), b"\x30"), lambda x: (b"\x21" + u64(x), b"\x30")  # noqa: E731, N806
        K = lambda x: (b"\x21" + u64(x), b"\x31" + u64(x & 255 if x > 255 else x) if (x & 255 if x > 255 else x) < len(p.constants) else b"\x30")  # noqa: E731, N806
        if left:
            kind, k = left.pop(0)
            role = kind
            if kind == "setlist_extra":
                name, operands = "setlist_extra", [(b"\x24" + u64(w), b"\x30")]
            else:
                name, operands = f"{name} (binding descriptor)", [N(k), R(b) if name == "MOVE" else N(b)]
        elif name == "GETUPVAL":
            operands = [R(a), (b"\x21" + u64(b), b"\x32" + bytes([b]))]
        elif name in ("GETTABLE", "SELF"):
            operands = [R(a), R(b), K(c) if c > 255 else R(c)]
        elif name == "JMP":
            operands = [(b"\x22" + u64(bx - 131071), b"\x35" + u64(pc + 1 + bx - 131071))]
        elif name == "CLOSURE":
            operands = [R(a), (b"\x21" + u64(bx), b"\x34" + u64(bx))]
            left = [("closure_binding", k) for k in range(len(p.protos[bx].upvalues))]
        elif name == "SETLIST":
            operands = [R(a), N(b), N(c)]
            left = [("setlist_extra", 0)]
        elif name == "LOADK":
            operands = [R(a), K(bx)]
        elif name == "RETURN":
            operands = [R(a), N(b)]
        out += b"\x02" + u64(len(role)) + role.encode() + u64(len(name)) + name.encode() + u64(len(operands)) + b"".join(b"\x03" + x + y for x, y in operands)
    out += u64(len(p.constants)) + b"".join(b"\x14" + u64(len(k.raw)) + k.raw for k in p.constants) + u64(len(p.upvalues)) + u64(len(children)) + b"".join(b"\x04" + c for c in children)
    return hashlib.sha256(out).digest()


def digests(p):
    below = [digests(c) for c in p.protos]
    return [plain(p, [b[0] for b in below]), *(x for b in below for x in b)]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame([("a", bytearray(encode(Chunk("lua5.1", nested())))), ("b", bytearray(encode(Chunk("lua5.1", nested().protos[0]))))], "path string, content binary").withColumn("status", F.lit("read")).cache()


def test_digests_equal_a_plain_walk(spark, found):
    f = artifacts.facts(artifacts.decoded(found))
    got = {(r.path, tuple(r.proto)): r.digest for r in identity.prototypes(f, DOMAIN).collect()}
    want = {("a", path): d.hex() for (path, _), d in zip(walk(nested()), digests(nested()), strict=True)}
    assert {k: v for k, v in got.items() if k[0] == "a"} == want
    assert got["a", (0, 0, 0)] == got["a", (0, 0, 1)]  # names and lines are no content
    older = {(r.path, tuple(r.proto)): r.digest for r in identity.prototypes(f, DOMAIN, closures_only=True).collect()}
    assert older["a", (0, 0, 0)] == want["a", (0, 0, 0)] and older["a", (0, 0)] != want["a", (0, 0)]  # a SETLIST's word is no companion there
    mine = identity.prototypes(f, DOMAIN)
    assert identity.shared(mine.where("path = 'a'"), mine.where("path = 'b'"), ["proto"]).count() == 3


def test_prototypes_by_digest(found):
    d = digests(nested())[2].hex()
    out = batch.ask(found, f"prototype.digest == '{d}'", domain=DOMAIN)
    assert sorted((r.path, r.id) for r in out.rows.collect()) == [("a", "proto:0/0/0"), ("a", "proto:0/0/1"), ("b", "proto:0/0"), ("b", "proto:0/1")]
    assert batch.ask(found, f"prototype.digest != '{d}'", domain=DOMAIN).rows.count() == 3
    with pytest.raises(predicate.QueryError):
        query.matches({"instruction": found}, "prototype.digest == 'x'")


def test_deep_trees_are_planned_in_linear_time(spark):
    nodes = spark.range(65).select(F.lit(1).alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("position"), F.col("id").cast("int").alias("depth"), F.lit("aa").alias("content"))
    began = time.time()
    got = {r.node: r.digest for r in identity.merkle(nodes, ["tree"]).collect()}
    assert time.time() - began < 90
    want = hashlib.sha256(b"\xaa" + u64(0)).digest()
    for _ in range(64):
        want = hashlib.sha256(b"\xaa" + u64(1) + b"\x04" + want).digest()
    assert got[0] == want.hex()


def test_disassembly_tells_what_is_wrong(spark, found):
    f = artifacts.facts(artifacts.decoded(found.where("path = 'a'")))
    limits = f.prototypes.select("path", "proto", "n_const")
    rows = disasm.disassemble(words.decode(f.words).join(limits, ["path", "proto"]))
    got = {(tuple(r.proto), r.pc): (r.said, [o.display for o in r.operands], r.codes) for r in rows.collect()}
    assert got[(0,), 2] == ("LOADK", ["R(1)", "K(0)"], []) and got[(0,), 3][2] == ["L51-DISASM-002"] and got[(0,), 4] == ("SELF", ["R(1)", "R(2)", "K(44)"], ["L51-DISASM-002"])
    assert got[(0,), 1] == ("MOVE (binding descriptor)", ["upvalue[0]", "parent R(2)"], []) and got[(0, 0), 3][1] == ["upvalue[0]", "parent upvalue[0]"]
    assert got[(0, 0), 5] == ("setlist_extra", ["77 (0x0000004d)"], []) and got[(0, 0, 0), 2] == ("JMP", ["-3"], [])
    odd = spark.createDataFrame([([0], 0, 63)], "proto array<int>, pc int, raw_word long").withColumn("n_const", F.lit(0))
    assert disasm.disassemble(words.decode(odd)).select("said", "codes").first() == ("OP_UNKNOWN_0x3f", ["L51-DISASM-001"])

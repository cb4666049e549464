import copy

import pytest

from bytefacts.operators import diff
from bytefacts.sources import artifacts
from bytefacts.sources.chunks import Chunk, Constant, Local, Prototype, Upvalue, encode

from .test_callees import END, s
from .test_chunks import i51


def main():
    child = Prototype(b"@c", 1, 2, 1, 0, 4, [i51("GETUPVAL", 0, 0), END], [s(b"k")], [Upvalue(1, 0, 0, b"u")], [], [1, 2], [], [Local(b"x", 0, 2)], upvalue_names=1)
    return Prototype(b"@m", 0, 0, 0, 2, 5, [i51("CLOSURE", 0, bx=0), i51("MOVE", 0, 1), i51("LOADK", 1, bx=0), END], [s(b"a"), Constant("float", 0.0, b"\0" * 8)], [], [child, Prototype(code=[END])], [1, 1, 2, 3])


@pytest.fixture(scope="module")
def said(spark):
    def run(change, **options):
        new = copy.deepcopy(main())
        chunk = Chunk("lua5.1", new)
        change(chunk, new)
        frames = [artifacts.facts(artifacts.decoded(spark.createDataFrame([("p", bytearray(encode(c)))], "path string, content binary"))) for c in (Chunk("lua5.1", main()), chunk)]
        return {(tuple(r.proto or ()), r.section, r["index"], r.what) for r in diff.artifacts(*frames, ["path"], **options).collect()}

    return run


def test_what_differs_is_told(said):
    assert said(lambda c, m: None) == set() and said(lambda c, m: None, semantic=True) == set()

    def change(c, m):
        c.trailing = b"x"
        m.maxstacksize = 6
        m.constants = [s(b"b"), Constant("float", -0.0, b"\0" * 7 + b"\x80"), s(b"new")]
        m.code = [*m.code[:2], i51("LOADK", 2, bx=0), END, END]
        m.lines = [1, 1, 2, 4, 4]
        m.protos[0].upvalues[0].name = b"v"
        m.protos[0].locals[0].endpc = 1
        m.protos = m.protos[:1]

    want = {((), "chunk", None, "trailing bytes"), ((0,), "prototype", None, "maxstacksize"), ((0,), "prototype", None, "child prototype count"), ((0,), "constant", None, "constant count"), ((0,), "constant", 0, "constant"), ((0,), "constant", 1, "constant"), ((0,), "instruction", 2, "word"), ((0,), "instruction", 4, "word")}
    debug = {((0,), "prototype", None, "line_info"), ((0, 0), "upvalue", 0, "debug name"), ((0, 0), "prototype", None, "local names/scopes"), ((0, 0), "prototype", None, "upvalue debug names")}
    assert said(change) == want | debug
    assert said(change, ignore_debug=True) == want


def test_roles_count_where_meaning_is_compared(said):
    def change(c, m):  # the child loses its upvalue, so the word after CLOSURE becomes an instruction
        m.protos[0].upvalues, m.protos[0].upvalue_names = [], 0

    base = {((0, 0), "upvalue", None, "upvalue count"), ((0, 0), "prototype", None, "upvalue debug names")}
    assert said(change) == base
    assert said(change, semantic=True) == base | {((0,), "instruction", 1, "word")}

from bytefacts.operators import modules as m
from bytefacts.operators import relations
from bytefacts.sources.chunks import Chunk, encode
from pyspark.sql import functions as F

from .test_callees import END, proto, s
from .test_chunks import i51

CHILD = proto([END])
NAMES = [s(b"module"), s(b"a.b"), s(b"package"), s(b"seeall"), s(b"run"), s(b"print"), s(b"setfenv")]
DECLARE = [i51("GETGLOBAL", 0, bx=0), i51("LOADK", 1, bx=1), i51("CALL", 0, 2, 1)]
SEEALL = [i51("GETGLOBAL", 0, bx=0), i51("LOADK", 1, bx=1), i51("GETGLOBAL", 2, bx=2), i51("GETTABLE", 2, 2, 256 + 3), i51("CALL", 0, 3, 1)]
STORE = [i51("CLOSURE", 0, bx=0), i51("SETGLOBAL", 0, bx=4)]
CALL = [i51("GETGLOBAL", 0, bx=5), i51("CALL", 0, 1, 1)]


def chunk(code, constants=NAMES):
    return encode(Chunk("lua5.1", proto([*code, END], constants, [CHILD])))


def test_strict_admission():
    for head in (DECLARE, SEEALL):
        found = m.declared(chunk([*head, *STORE]))
        assert (found.status, found.segments, found.exports) == ("literal", ["a", "b"], [("run", (0, 0))])
    assert m.declared(chunk(STORE)).status == "none"
    for bad in ([*STORE, *DECLARE], [*DECLARE, *DECLARE], [*DECLARE, *CALL], [*DECLARE, i51("TEST", 0), *STORE], DECLARE[:2]):
        assert m.declared(chunk(bad)).status == "dynamic", bad
    assert m.declared(b"no chunk").status == "dynamic"
    assert m.declared(chunk([*DECLARE, *STORE], [NAMES[0], s(b"a..b"), *NAMES[2:]])).status == "dynamic"
    assert m.declared(chunk([*DECLARE, *STORE], [NAMES[0], s(b".".join([b"x"] * 40)), *NAMES[2:]])).status == "limited"


def test_the_last_store_counts():
    other = [*DECLARE, *STORE, i51("LOADK", 0, bx=5), i51("SETGLOBAL", 0, bx=4)]
    assert m.declared(chunk(other)).exports == []


def test_trusted_admission():
    usual = m.declared(chunk([*DECLARE, *CALL, *STORE]), "trusted-init")
    assert (usual.status, usual.exports) == ("trusted", [("run", (0, 0))])
    branch = [*DECLARE, *CALL, i51("TEST", 0, 0, 0), i51("JMP", sbx=2), *STORE]
    found = m.declared(chunk(branch), "trusted-init")
    assert found.exports == [] and found.marks == [["a", "b", "run"]]
    early = m.declared(chunk([*STORE, *DECLARE]), "trusted-init")
    assert early.marks == [["run"], ["a", "b", "run"]]
    assert m.declared(chunk([*DECLARE, i51("GETGLOBAL", 0, bx=6), i51("CALL", 0, 1, 1)]), "trusted-init").status == "dynamic"
    sometimes = [i51("TEST", 0, 0, 0), i51("JMP", sbx=3), *DECLARE, *STORE]
    assert m.declared(chunk(sometimes), "trusted-init").status == "dynamic"


def test_links_over_artifacts(spark):
    good, twice = chunk([*DECLARE, *STORE]), chunk([*SEEALL, *STORE])
    found = spark.createDataFrame([("one", bytearray(good)), ("two", bytearray(twice)), ("three", bytearray(chunk(CALL)))], "path string, content binary")
    calls = spark.createDataFrame([(1, ["a", "b", "run"]), (2, ["a", "b", "gone"])], "call int, segments array<string>")

    def status(artifacts, most=m.MOST_EXPORTS):
        exports, marks, state = m.export_index(m.module_rows(artifacts), most)
        links = relations.resolve_links(calls, exports.withColumn("target", F.col("path")), marks, state.first().incomplete)
        return {r.call: r.link_status for r in links.collect()}

    assert status(found.where("path != 'two'")) == {1: "resolved", 2: "absent"}
    assert status(found) == {1: "duplicate", 2: "absent"}
    assert status(found, 1) == {1: "dynamic", 2: "dynamic"}
    broken = found.union(spark.createDataFrame([("bad", None)], found.schema))
    assert status(broken) == {1: "duplicate", 2: "dynamic"}

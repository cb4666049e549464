from bytefacts.operators import callees as c
from bytefacts.operators import relations
from bytefacts.sources.chunks import Chunk, Constant, Prototype, Upvalue, encode

from .test_chunks import i51


def s(x):
    return Constant("short-string", x, x)


def proto(code, constants=(), protos=(), upvalues=0, stack=10):
    return Prototype(maxstacksize=stack, code=code, constants=list(constants), protos=list(protos), upvalues=[Upvalue() for _ in range(upvalues)])


def facts(main):
    return {f["call_id"]: f for f in c.callee_facts(encode(Chunk("lua5.1", main)))[0]}


END = i51("RETURN", 0, 1)


def test_paths_labels_and_modules():
    code = [
        i51("GETGLOBAL", 0, bx=0), i51("GETTABLE", 0, 0, 257), i51("CALL", 0, 1, 1),  # os.execute()
        i51("GETGLOBAL", 1, bx=2), i51("LOADK", 2, bx=3), i51("CALL", 1, 2, 2), i51("SELF", 1, 1, 257), i51("CALL", 1, 2, 1),  # require("a.b"):execute()
        i51("NEWTABLE", 3), i51("GETTABLE", 3, 3, 257), i51("CALL", 3, 1, 1), i51("GETTABLE", 4, 4, 5), i51("CALL", 4, 1, 0), i51("CALL", 5, 1, 1), END,
    ]
    f = facts(proto(code, [s(b"os"), s(b"execute"), s(b"require"), s(b"a.b")]))
    said = {i: (f[f"proto:0/pc:{i}"]["status"], f[f"proto:0/pc:{i}"].get("segments"), f[f"proto:0/pc:{i}"].get("reason")) for i in (2, 5, 7, 10, 12, 13)}
    assert said[2] == ("resolved-path", ["os", "execute"], None)
    assert said[5] == ("resolved-path", ["require"], None)
    assert said[7] == ("resolved-path", ["a", "b", "execute"], None) and f["proto:0/pc:7"]["basis"] == "module-label"
    assert said[10][0] == "lookup-label" and f["proto:0/pc:10"]["lookup_key"] == "execute"
    assert said[12] == ("unresolved", None, "dynamic-key")
    assert said[13] == ("unresolved", None, "open-register-window")
    assert f["proto:0/pc:2"]["evidence"] == ["proto:0/pc:0", "proto:0/pc:1"]


def test_branches_meet_and_unreachable_calls_are_told():
    code = [i51("GETGLOBAL", 0, bx=0), i51("TEST", 1, 0, 0), i51("JMP", sbx=1), i51("GETGLOBAL", 0, bx=1), i51("CALL", 0, 1, 1), END, i51("CALL", 0, 1, 1), END]
    f = facts(proto(code, [s(b"f"), s(b"g")]))
    assert f["proto:0/pc:4"]["reason"] == "control-flow-conflict" and f["proto:0/pc:6"]["reason"] == "unreachable"
    same = facts(proto(code, [s(b"f"), s(b"f")]))
    assert same["proto:0/pc:4"]["segments"] == ["f"] and len(same["proto:0/pc:4"]["evidence"]) == 2


def test_loops_settle():
    code = [i51("GETGLOBAL", 0, bx=0), i51("CALL", 0, 1, 1), i51("JMP", sbx=-2), END]
    assert facts(proto(code, [s(b"f")]))["proto:0/pc:1"]["reason"] == "control-flow-conflict"


def test_captures():
    child = proto([i51("GETUPVAL", 0, 0), i51("CALL", 0, 1, 1), END], upvalues=1)
    code = [i51("GETGLOBAL", 0, bx=0), i51("CLOSURE", 1, bx=0), i51("MOVE", 0, 0), i51("CALL", 1, 1, 1), END]
    f = facts(proto(code, [s(b"f")], [child]))
    assert f["proto:0/pc:3"]["prototype"] == [0, 0]
    assert f["proto:0/0/pc:1"]["segments"] == ["f"] and f["proto:0/0/pc:1"]["evidence"] == ["proto:0/pc:0", "proto:0/pc:1", "proto:0/pc:2"]
    later = code[:-1] + [i51("LOADNIL", 0, 0), END]
    assert facts(proto(later, [s(b"f")], [child]))["proto:0/0/pc:1"]["reason"] == "mutable-capture"
    writer = proto([i51("SETUPVAL", 1, 0), i51("GETUPVAL", 0, 0), i51("CALL", 0, 1, 1), END], upvalues=1)
    assert facts(proto(code, [s(b"f")], [writer]))["proto:0/0/pc:2"]["reason"] == "mutable-capture"
    grandchild = proto([i51("CLOSURE", 1, bx=0), i51("GETUPVAL", 0, 0), END], (), [child], upvalues=1)
    assert facts(proto(code, [s(b"f")], [grandchild]))["proto:0/0/0/pc:1"]["segments"] == ["f"]
    deep_writer = proto([i51("CLOSURE", 1, bx=0), i51("GETUPVAL", 0, 0), END], (), [writer], upvalues=1)
    assert facts(proto(code, [s(b"f")], [deep_writer]))["proto:0/0/0/pc:2"]["reason"] == "mutable-capture"


def test_budgets_fail_closed():
    main = proto([i51("GETGLOBAL", 0, bx=0), i51("CALL", 0, 1, 1), END], [s(b"f")])
    tree = c.Tree(main, budget=0)
    run = c.Callees(tree)
    run.run()
    assert [x["reason"] for x in run.calls] == ["analysis-limit"]
    long = [i51("GETGLOBAL", 0, bx=0), *[i51("GETTABLE", 0, 0, 256)] * 40, i51("CALL", 0, 1, 1), END]
    beyond = facts(proto(long, [s(b"f")]))["proto:0/pc:41"]
    assert beyond["status"] == "lookup-label"  # the path was given up at its limit, and later lookups have only their key
    full = [*long[:33], i51("CALL", 0, 1, 1), END]
    assert facts(proto(full, [s(b"f")]))["proto:0/pc:33"]["reason"] == "path-limit"


def test_relations_of_artifacts(spark):
    f, g = proto([END]), proto([END])
    code = [i51("CLOSURE", 0, bx=0), i51("SETGLOBAL", 0, bx=0), i51("CLOSURE", 0, bx=1), i51("SETGLOBAL", 0, bx=1), i51("SETGLOBAL", 0, bx=1), i51("LOADK", 0, bx=3), i51("SETGLOBAL", 0, bx=3)]
    for n in range(4):
        code += [i51("GETGLOBAL", 1, bx=n), i51("CALL", 1, 1, 1)]
    main = proto([*code, END], [s(b"once"), s(b"twice"), s(b"never"), s(b"text")], [f, g])
    found = spark.createDataFrame([("a", bytearray(encode(Chunk("lua5.1", main)))), ("b", None)], "path string, content binary")
    made = relations.call_relations(c.callees(found), c.global_stores(found), ["path", "sha256"])
    said = {r.pc: (r.relation_status, r.callee, r.relation_reason) for r in made.collect()}
    assert said == {8: ("resolved", [0, 0], None), 10: ("unresolved", None, "multiple-prototype-stores"), 12: ("unresolved", None, "missing-prototype-store"), 14: ("unresolved", None, "non-closure-store")}

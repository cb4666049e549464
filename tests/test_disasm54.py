from pyspark.sql import functions as F

from bytefacts.functions import words
from bytefacts.operators import disasm54


def said(spark, *code, n_const=3, n_protos=1):
    enc = lambda name, **f: words.encode("5.4", opcode=F.lit(words.opcode_of(name, "5.4")), **{k: F.lit(v) for k, v in f.items()})
    array = F.array(*(F.lit(c).cast("long") if isinstance(c, int) else enc(c[0], **c[1]) for c in code))
    rows = spark.range(1).select(F.posexplode(array)).toDF("pc", "raw_word").withColumns({"proto": F.array(F.lit(0)), "n_const": F.lit(n_const), "n_protos": F.lit(n_protos)})
    out = disasm54.disassemble(words.decode(rows, "5.4"), ["proto"]).orderBy("pc").collect()
    return [(r.said, [o.display for o in r.operands], [o.resolution for o in r.operands], r.shown_role, r.jump_target, r.companion_pc, r.metamethod, r.codes) for r in out]


def test_operands_roles_and_targets(spark):
    got = said(
        spark, ("LOADKX", {"a": 1}), ("EXTRAARG", {"ax": 2}), ("ADD", {"a": 1, "b": 2, "c": 3}), ("MMBIN", {"a": 2, "b": 3, "c": 6}), ("SETFIELD", {"a": 1, "b": 2, "c": 0, "k": 1}), ("SETTABUP", {"a": 0, "b": 1, "c": 9}),
        ("FORPREP", {"a": 1, "bx": 2}), ("FORLOOP", {"a": 1, "bx": 2}), ("JMP", {"sj": -3}), ("RETURN", {"a": 1, "b": 2, "c": 3, "k": 1}), ("CLOSURE", {"a": 1, "bx": 0}), ("LOADI", {"a": 1, "sbx": -7}), ("LOADFALSE", {"a": 1, "k": 1}), ("EQI", {"a": 1, "sb": 5, "k": 1}), ("RETURN0", {}), ("GETTABUP", {"a": 1, "b": 0, "c": 1}),
    )
    none = (None, None, [])
    assert got[0] == ("LOADKX", ["1", "2"], [None, "constant"], "instruction", None, 1, None, [])
    assert got[1] == ("EXTRAARG", ["2"], [None], "extra_argument", None, 0, None, [])
    assert got[2][3:] == ("instruction", None, 3, None, []) and got[3] == ("MMBIN", ["2", "3", "6"], [None] * 3, "companion", None, 2, "__add", [])
    assert got[4][:3] == ("SETFIELD", ["1", "2", "0k"], [None, "constant", "constant"]) and got[5][:3] == ("SETTABUP", ["0", "1", "9"], ["upvalue", "constant", None])
    assert [g[4] for g in got[6:9]] == [10, 6, 6]
    assert got[9][:2] == ("RETURN", ["1", "2", "3k"]) and got[10][:3] == ("CLOSURE", ["1", "0"], [None, "prototype"]) and got[11][1] == ["1", "-7"] and got[12][1] == ["1k"] and got[13][1] == ["1", "5", "1"]
    assert got[14] == ("RETURN0", [], [], "instruction", None, *none) and got[15][2] == [None, "upvalue", "constant"]


def test_every_name_has_its_operands():
    assert disasm54.covered() == set(words.NAMES["5.4"])


def test_what_is_not_there(spark):
    got = said(spark, 127, ("LOADK", {"a": 0, "bx": 9}), ("SETI", {"a": 0, "b": 9, "c": 9, "k": 1}), ("SETI", {"a": 0, "b": 9, "c": 9}), ("CLOSURE", {"a": 0, "bx": 4}), ("LOADKX", {"a": 0}))
    assert [g[7] for g in got] == [["L54-INVALID-OPCODE"], ["L54-OOB-CONSTANT"], ["L54-OOB-CONSTANT"], [], ["L54-OOB-PROTO"], []]
    assert got[0][0] == "UNKNOWN_0x7f" and got[5][1] == ["0"] and got[2][1] == ["0", "9", "9"]

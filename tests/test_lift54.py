import hashlib
import struct

from bytefacts.functions import words
from bytefacts.operators import identity, lift54, validate
from bytefacts.operators.lift54 import BINARY, EFFECTS, METAMETHODS, NO_EFFECTS, SKIPS, WITH_K
from pyspark.sql import functions as F


def w(name, a=0, k=0, b=0, c=0, bx=None, sj=None):
    op = words.opcode_of(name, "5.4")
    if sj is not None:
        return op | (sj + 16777215) << 7
    return op | a << 7 | (bx << 15 if bx is not None else k << 15 | b << 16 | c << 24)


def lifted(spark, *code):
    frame = spark.createDataFrame(list(enumerate(code)), "pc int, raw_word long")
    return {r.pc: r for r in lift54.lift(words.decode(frame, "5.4")).collect()}


def e(effects):
    return [tuple(x) for x in effects]


def test_every_opcode_is_told_of():
    named = {n for line in EFFECTS.strip().splitlines() for n in line.split()[0].split(",")} | set(BINARY) | set(WITH_K) | set(NO_EFFECTS) | {"CALL", "RETURN", "CLOSURE", "JMP"}
    assert named == set(words.NAMES["5.4"])
    assert set(METAMETHODS) | set(SKIPS) <= named


def test_effects(spark):
    r = lifted(spark, w("GETFIELD", 1, 0, 2, 3), w("SETFIELD", 1, 1, 2, 3), w("SETFIELD", 1, 0, 2, 3), w("CALL", 1, 0, 3, 2), w("CALL", 1, 0, 0, 0), w("JMP", sj=-3), w("CLOSURE", 2, bx=5), w("FORLOOP", 0, bx=4), w("LOADNIL", 2, 0, 3), w("EQ", 1, 0, 2), w("ADDK", 1, 0, 2, 3), w("RETURN", 1, 0, 1))
    assert e(r[0].reads) == [("register", 2, 2), ("constant", 3, 3)] and e(r[0].writes) == [("register", 1, 1)] and r[0].metamethod == "__index"
    assert e(r[1].reads)[0] == ("constant", 3, 3) and e(r[2].reads)[0] == ("register", 3, 3)
    assert e(r[3].reads) == [("register", 1, 1), ("register", 2, 3)] and e(r[3].writes) == [("register", 1, 1)]
    assert e(r[4].reads)[1][0] == "register-to-top" and e(r[4].writes)[0] == ("register-to-top", 1, -1)
    assert r[5].jump_target == 3 and e(r[5].reads) == [("pc", 3, 3)]
    assert e(r[6].reads) == [("prototype", 5, 5)] and r[7].jump_target == 4
    assert e(r[8].writes) == [("register", 2, 5)]
    assert r[9].skip_target == 11 and e(r[9].reads) == []
    assert e(r[10].reads) == [("register", 2, 2), ("constant", 3, 3)] and e(r[11].reads) == []


def test_rules(spark):
    cases = {w("LOADK", 0, bx=9): {"L54-VAL-CONST-001"}, w("GETUPVAL", 0, 0, 3): {"L54-VAL-UPVAL-001"}, w("SETTABUP", 3): {"L54-VAL-UPVAL-002"}, w("CLOSURE", 0, bx=2): {"L54-VAL-PROTO-001"}, w("JMP", sj=50): {"L54-VAL-JUMP-001"}, w("MOVE", 9): {"L54-VAL-REG-001"}, 127: {"L54-VAL-OPCODE-001"}, w("MOVE", 1, 0, 2): set()}
    limits = {"n": 10, "maxstacksize": 5, "n_const": 2, "n_upval": 1, "n_protos": 1}
    frame = words.decode(spark.createDataFrame([(0, x) for x in cases], "pc int, raw_word long"), "5.4").withColumns({k: F.lit(v) for k, v in limits.items()}).withColumn("who", F.col("raw_word"))
    found = {}
    for r in validate.violations(frame, validate.rules_54(), ["who"]).collect():
        found.setdefault(r.who, set()).add(r.code)
    assert found == {x: c for x, c in cases.items() if c}


def test_identity_of_an_empty_prototype(spark):
    """The preimage byte by byte: domain, tag, name with its length, header bytes, and four empty lists."""
    none, zero = F.lit(""), F.lit(0)
    content = identity.prototype_preimage(b"some-scheme", zero, zero, F.lit(2), zero, none, zero, none, zero)
    node = {"tree": F.lit(1), "node": F.lit("p"), "parent": F.lit(None).cast("string"), "position": F.lit(0), "depth": F.lit(0)}
    made = identity.merkle(spark.range(1).select(*(v.alias(k) for k, v in node.items()), content.alias("content")), ["tree"], 0).first().digest
    assert made == hashlib.sha256(b"some-scheme\0" + b"\x01" + (6).to_bytes(8, "big") + b"lua5.1" + bytes([0, 0, 2]) + bytes(32)).hexdigest()


def test_constant_records(spark):
    rows = [("nil", None, None, None), ("boolean", True, None, None), ("float", None, struct.pack("<d", 1.5).hex(), None), ("short-string", None, None, bytearray(b"ab"))]
    frame = spark.createDataFrame(rows, "ctype string, bool_val boolean, raw_hex string, str_raw binary")
    got = [r[0] for r in frame.select(identity.constant_record(*(F.col(c) for c in ("ctype", "bool_val", "raw_hex", "str_raw")))).collect()]
    assert got == ["10", "1101", "130000000000000008" + struct.pack("<d", 1.5).hex(), "1400000000000000026162"]


def test_rules_of_53(spark):
    op = lambda n, a=0, b=0, c=0, bx=None, ax=None: words.opcode_of(n, "5.3") | (ax << 6 if ax is not None else a << 6 | (bx << 14 if bx is not None else b << 23 | c << 14))
    code = [op("LOADKX"), op("EXTRAARG", ax=9), op("EXTRAARG", ax=0), op("LOADKX"), op("MOVE", 5, 1), op("BAND", 0, 256 + 3, 1), op("GETTABUP", 0, 1, 256), op("CONCAT", 0, 2, 1), op("JMP", bx=131071 + 90), op("CLOSURE", 0, bx=1), op("SHL", 0, 1, 7), op("MOVE", 1, 2)]
    limits = {"n": len(code), "maxstacksize": 5, "n_const": 2, "n_upval": 1, "n_protos": 1, "proto": 0}
    frame = words.decode(spark.createDataFrame(list(enumerate(code)), "pc int, raw_word long"), "5.3").withColumns({k: F.lit(v) for k, v in limits.items()})
    found = {}
    for r in validate.violations(validate.neighbours(frame, ["proto"]), validate.rules_52("5.3"), ["proto"]).collect():
        found.setdefault(r.pc, set()).add(r.code)
    assert found == {1: {"L53-CONST-003"}, 2: {"L53-COMPANION-001"}, 3: {"L53-COMPANION-001"}, 4: {"L53-REG-001"}, 5: {"L53-CONST-003"}, 6: {"L53-UPVAL-002"}, 7: {"L53-REG-SPAN-001"}, 8: {"L53-JMP-001"}, 9: {"L53-PROTO-002"}, 10: {"L53-REG-003"}}
    many = spark.createDataFrame([(1, 251), (2, 250)], "proto int, maxstacksize int")
    assert [tuple(r) for r in validate.stack_warnings(many, ["proto"], "5.3").collect()] == [(1, "L53-STACK-001", "warning")]

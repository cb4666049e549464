import pytest
from pyspark.sql import functions as F

from bytefacts.functions import words
from bytefacts.operators import dispatch, lift, lift55


def one(spark, dialect, name, **fields):
    word = words.encode(dialect, opcode=F.lit(words.opcode_of(name, dialect)), **{k: F.lit(v) for k, v in fields.items()})
    return words.decode(spark.range(1).select(F.lit(4).alias("pc"), word.alias("raw_word"), F.lit("p").alias("proto")), dialect)


def effects(row):
    side = lambda xs: [(e.kind, e.first, e.last) for e in xs]
    return side(row.reads), side(row.writes), row.metamethod, row.skip_target, row.jump_target


R, K, U = (lambda a, b=None, k=k: (k, a, a if b is None else b) for k in ("register", "constant", "upvalue"))
LATER = [
    ("MOVE", {"a": 1, "b": 2}, ([R(2)], [R(1)], None, None, None)),
    ("GETTABUP", {"a": 1, "b": 2, "c": 259}, ([U(2), K(3)], [R(1)], "__index", None, None)),
    ("SETTABUP", {"a": 3, "b": 257, "c": 4}, ([U(3), K(1), R(4)], [], "__newindex", None, None)),
    ("LOADNIL", {"a": 2, "b": 3}, ([], [R(2, 5)], None, None, None)),
    ("LOADBOOL", {"a": 2, "b": 1, "c": 1}, ([], [R(2)], None, 6, None)),
    ("SELF", {"a": 2, "b": 7, "c": 256}, ([R(7), K(0)], [R(3), R(2)], "__index", None, None)),
    ("CALL", {"a": 5, "b": 3, "c": 2}, ([R(5), R(6, 7)], [R(5, 5)], "__call", None, None)),
    ("CALL", {"a": 5, "b": 0, "c": 0}, ([R(5)], [], "__call", None, None)),
    ("TFORCALL", {"a": 1, "c": 2}, ([R(1, 3)], [R(4, 5)], None, None, None)),
    ("TFORLOOP", {"a": 1, "sbx": -3}, ([R(2)], [R(1)], None, None, 2)),
    ("FORLOOP", {"a": 1, "sbx": -2}, ([R(1, 3)], [R(1), R(4)], None, None, 3)),
    ("TEST", {"a": 9}, ([R(9)], [], None, 6, None)),
    ("EXTRAARG", {"ax": 9}, ([], [], None, None, None)),
]


@pytest.mark.parametrize("dialect", ["5.2", "5.3"])
def test_later_dialects(spark, dialect):
    for name, fields, want in LATER:
        assert effects(lift.lift(one(spark, dialect, name, **fields), dialect).first()) == want, name
    names = {r.mnemonic for r in lift.lift(words.decode(spark.range(64).select(F.lit(0).alias("pc"), F.col("id").alias("raw_word")), dialect), dialect).collect()}
    assert names == {*words.NAMES[dialect], None}
    assert effects(lift.lift(one(spark, "5.3", "IDIV", a=1, b=2, c=256), "5.3").first()) == ([R(2), K(0)], [R(1)], "__idiv", None, None)


def test_55(spark):
    cases = [
        ("GETTABUP", {"a": 1, "b": 2, "c": 3}, ([U(2), K(3)], [R(1)], "__index", None, None)),
        ("SETTABUP", {"a": 1, "b": 2, "c": 3}, ([K(2)], [U(1)], "__newindex", None, None)),
        ("GETVARG", {"a": 1, "b": 2, "c": 3}, ([R(2), R(3)], [R(1)], None, None, None)),
        ("ERRNNIL", {"a": 1, "bx": 3}, ([R(1)], [], None, None, None)),
        ("CALL", {"a": 1, "b": 2, "c": 3}, ([R(1)], [], "__call", None, None)),
        ("MMBINK", {"a": 1, "b": 2, "c": 6}, ([], [], "__idiv", None, None)),
        ("MMBIN", {"a": 1, "b": 2, "c": 77}, ([], [], "__metamethod", None, None)),
        ("JMP", {"sj": 5}, ([("pc", 10, 10)], [], None, None, 10)),
        ("FORLOOP", {"a": 1, "bx": 9}, ([], [], None, None, 0)),
        ("EQK", {"a": 1}, ([], [], None, 6, None)),
        ("MULK", {"a": 1, "b": 2, "c": 3}, ([R(2), K(3)], [R(1)], None, None, None)),
    ]
    for name, fields, want in cases:
        assert effects(lift55.lift(one(spark, "5.5", name, **fields), ["proto"]).first()) == want, name
    enc = lambda name, **f: words.encode("5.5", opcode=F.lit(words.opcode_of(name, "5.5")), **{k: F.lit(v) for k, v in f.items()})
    pair = spark.range(1).select(F.posexplode(F.array(enc("LOADKX", a=1), enc("EXTRAARG", ax=70_000), enc("LOADKX", a=2), enc("MOVE", a=1)))).toDF("pc", "raw_word").withColumn("proto", F.lit("p"))
    got = {r.pc: effects(r)[:2] for r in lift55.lift(words.decode(pair, "5.5"), ["proto"]).collect()}
    assert got[0] == ([K(70_000)], [R(1)]) and got[2] == ([K(0)], [R(2)])


def test_dispatch_by_profile(spark):
    profiles = [*dispatch.DIALECTS, "other"]
    rows = spark.createDataFrame([(p, "x", 0, 0x00800040) for p in profiles], "profile string, proto string, pc int, raw_word long")
    got = {r.profile: r.mnemonic for r in dispatch.lifted(rows, ["profile", "proto"]).collect()}
    assert got == {p: words.NAMES[d][0x40 & (63 if d < "5.4" else 127)] for p, d in dispatch.DIALECTS.items()}

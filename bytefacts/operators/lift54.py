"""Effects of 5.4 instructions as columns, in the notation of lift, with sides chosen by k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions.words import NAMES
from bytefacts.operators.lift import EFFECT, _effect, _number

BINARY = ("ADD", "SUB", "MUL", "MOD", "POW", "DIV", "IDIV", "BAND", "BOR", "BXOR", "SHL", "SHR")
WITH_K = tuple(f"{n}K" for n in BINARY[:10])
NO_EFFECTS = ("CLOSE", "TBC", "EQ", "LT", "LE", "EQK", "TEST", "TESTSET", "RETURN0", "FORPREP", "TFORPREP", "FORLOOP", "TFORLOOP", "MMBIN", "MMBINI", "MMBINK", "VARARG", "VARARGPREP", "EXTRAARG")
# Fixed values of the format: names, reads, writes. RKk(C) is a constant if k is set, else a register; -1 stands for the top of the frame.
EFFECTS = """
MOVE                            R(B)              R(A)
LOADI,LOADF,LOADFALSE,LFALSESKIP,LOADTRUE  -      R(A)
LOADK                           K(Bx)             R(A)
LOADKX                          -                 R(A)
LOADNIL                         -                 R(A..A+B)
GETUPVAL                        U(B)              R(A)
SETUPVAL                        R(A)              U(B)
GETTABUP                        RKk(C),U(B)       R(A)
GETTABLE                        R(B),R(C)         R(A)
GETI                            R(B)              R(A)
GETFIELD                        R(B),K(C)         R(A)
SETTABUP                        RKk(B),R(C)       U(A)
SETTABLE                        RKk(C),R(A),R(B)  -
SETI                            RKk(C),R(A)       -
SETFIELD                        RKk(C),R(A),K(B)  -
NEWTABLE                        -                 R(A)
SELF                            RKk(C),R(B)       R(A),R(A+1)
ADDI,SHRI,SHLI                  R(B)              R(A)
UNM,BNOT,NOT,LEN                R(B)              R(A)
CONCAT                          R(A..A+B-1)       R(A)
EQI,LTI,LEI,GTI,GEI             R(A)              -
TAILCALL                        R(A)              -
RETURN1                         R(A)              -
TFORCALL                        R(A..A+2)         R(A+3..A+2+C)
SETLIST                         R(A)              -
"""
SKIPS = ("LFALSESKIP", "EQ", "LT", "LE", "EQK", "EQI", "LTI", "LEI", "GTI", "GEI", "TEST", "TESTSET")
METAMETHODS = {"GETTABUP": "__index", "GETTABLE": "__index", "GETI": "__index", "GETFIELD": "__index", "SELF": "__index", "SETTABUP": "__newindex", "SETTABLE": "__newindex", "SETI": "__newindex", "SETFIELD": "__newindex", "UNM": "__unm", "BNOT": "__bnot", "LEN": "__len", "CONCAT": "__concat", "TBC": "__close", "CALL": "__call", "TAILCALL": "__call"}
TOP = -1


def _none() -> Column:
    return F.array().cast(f"array<{EFFECT}>")


def _side(said: str) -> Column:
    if said == "-":
        return _none()
    parts = []
    for one in said.split(","):
        kind, inside = one[:-1].split("(")
        if ".." in inside:
            first, last = map(_number, inside.split(".."))
            parts.append(F.when(last >= first, F.array(_effect("register", first, last))).otherwise(_none()))
        elif kind == "RKk":
            parts.append(F.array(_effect(F.when(F.col("k") != 0, "constant").otherwise("register"), _number(inside))))
        else:
            parts.append(F.array(_effect({"R": "register", "K": "constant", "U": "upvalue"}[kind], _number(inside))))
    return F.concat(*parts)


def _span(first: Column, count: Column) -> Column:
    """`count - 1` registers from first; an open count (0) goes to the top."""
    one = F.array(_effect("register", first, first + count - 2))
    return F.when(count == 0, F.array(_effect("register-to-top", first, F.lit(TOP)))).when(count > 1, one).otherwise(_none())


def lift(words: DataFrame) -> DataFrame:
    """Decoded 5.4 words with reads, writes, metamethod, skip_target and jump_target; the columns are those of the 5.1 lift."""
    number = {n: i for i, n in enumerate(NAMES["5.4"])}
    table = [(names.split(","), r, w) for names, r, w in (line.split() for line in EFFECTS.strip().splitlines())]
    table += [(list(WITH_K), "R(B),K(C)", "R(A)"), (list(BINARY), "R(B),R(C)", "R(A)")]
    a, b, c = (F.col(x).cast("int") for x in "abc")
    reads, writes = F.when(F.lit(False), _none()), F.when(F.lit(False), _none())
    for names, r, w in table:
        here = F.col("opcode").isin(*(number[n] for n in names))
        reads, writes = reads.when(here, _side(r)), writes.when(here, _side(w))
    call, ret = F.col("opcode") == number["CALL"], F.col("opcode") == number["RETURN"]
    closure = F.col("opcode") == number["CLOSURE"]
    reads = reads.when(call, F.concat(F.array(_effect("register", a)), _span(a + 1, b))).when(ret, _span(a, b)).when(closure, F.array(_effect("prototype", F.col("bx").cast("int")))).when(F.col("opcode") == number["JMP"], F.array(_effect("pc", (F.col("pc") + 1 + F.col("sj")).cast("int"))))
    writes = writes.when(call, _span(a, c)).when(closure, F.array(_effect("register", a)))
    m = F.col("mnemonic")
    jump = F.when(m == "JMP", F.col("pc") + 1 + F.col("sj")).when(m.isin("FORPREP", "TFORPREP"), F.col("pc") + 1 + F.col("bx")).when(m.isin("FORLOOP", "TFORLOOP"), F.greatest(F.col("pc") + 1 - F.col("bx"), F.lit(0)))
    meta = F.when(F.lit(False), F.lit(None).cast("string"))
    for n, said in METAMETHODS.items():
        meta = meta.when(m == n, said)
    frame = F.when(m.isin("CALL", "TAILCALL"), a)
    return words.select("*", reads.otherwise(_none()).alias("reads"), writes.otherwise(_none()).alias("writes"), meta.alias("metamethod"), F.when(m.isin(*SKIPS), F.col("pc") + 2).cast("int").alias("skip_target"), jump.cast("int").alias("jump_target"), frame.cast("int").alias("invalid_from"))

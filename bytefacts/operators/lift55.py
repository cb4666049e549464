"""Effects of 5.5 instructions as columns, in the notation of lift54."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.functions.words import NAMES, field
from bytefacts.operators.lift import _effect
from bytefacts.operators.lift54 import BINARY, WITH_K, _none, _side

# Fixed values of the format: names, reads, writes. Names that are not here have no effects on registers.
EFFECTS = """
MOVE                            R(B)              R(A)
LOADI,LOADF,LOADFALSE,LFALSESKIP,LOADTRUE  -      R(A)
LOADK                           K(Bx)             R(A)
LOADNIL                         -                 R(A..A+B)
GETUPVAL                        U(B)              R(A)
SETUPVAL                        R(A)              U(B)
GETTABUP                        U(B),K(C)         R(A)
GETTABLE                        R(B),R(C)         R(A)
GETI                            R(B)              R(A)
GETFIELD                        R(B),K(C)         R(A)
SETTABUP                        K(B)              U(A)
SETTABLE                        R(A),R(B)         -
SETI                            R(A)              -
SETFIELD                        R(A),K(B)         -
NEWTABLE                        -                 R(A)
SELF                            R(B)              R(A),R(A+1)
ADDI,SHLI,SHRI                  R(B)              R(A)
UNM,BNOT,NOT,LEN                R(B)              R(A)
CONCAT                          R(A..A+B-1)       R(A)
EQI,LTI,LEI,GTI,GEI             R(A)              -
CALL,TAILCALL,RETURN1,SETLIST,ERRNNIL  R(A)       -
GETVARG                         R(B),R(C)         R(A)
"""
SKIPS = ("LFALSESKIP", "EQ", "LT", "LE", "EQK", "EQI", "LTI", "LEI", "GTI", "GEI", "TEST", "TESTSET")
METAMETHODS = {"GETTABUP": "__index", "GETTABLE": "__index", "GETI": "__index", "GETFIELD": "__index", "SELF": "__index", "SETTABUP": "__newindex", "SETTABLE": "__newindex", "SETI": "__newindex", "SETFIELD": "__newindex", "CONCAT": "__concat", "TBC": "__close", "CALL": "__call", "TAILCALL": "__call"}
# Fixed values of the format: events of the MMBIN words, by number.
EVENTS = "__add __sub __mul __mod __pow __div __idiv __band __bor __bxor __shl __shr __unm __bnot __lt __le __concat __len __eq".split()


def lift(words: DataFrame, by: list[str]) -> DataFrame:
    """Decoded 5.5 words of prototypes `by` with reads, writes, metamethod, skip_target, jump_target and invalid_from, as of the other lifts.

    A LOADKX reads the constant that the word after it names, or the first if that is no EXTRAARG.
    """
    number = {n: i for i, n in enumerate(NAMES["5.5"])}
    table = [(names.split(","), r, w) for names, r, w in (line.split() for line in EFFECTS.strip().splitlines())]
    table += [(list(WITH_K), "R(B),K(C)", "R(A)"), (list(BINARY), "R(B),R(C)", "R(A)")]
    m, a, op = F.col("mnemonic"), F.col("a").cast("int"), F.col("opcode")
    reads, writes = F.when(F.lit(False), _none()), F.when(F.lit(False), _none())
    for names, r, w in table:
        here = op.isin(*(number[n] for n in names))
        reads, writes = reads.when(here, _side(r)), writes.when(here, _side(w))
    after = F.lead("raw_word").over(Window.partitionBy(*by).orderBy("pc"))
    extra = F.when(field(after, "5.5", "opcode") == number["EXTRAARG"], field(after, "5.5", "ax")).otherwise(0).cast("int")
    target = F.when(m == "JMP", F.col("pc") + 1 + F.col("sj")).when(m.isin("FORPREP", "TFORPREP"), F.col("pc") + 1 + F.col("bx")).when(m.isin("FORLOOP", "TFORLOOP"), F.greatest(F.col("pc") + 1 - F.col("bx"), F.lit(0)))
    reads = reads.when(m == "LOADKX", F.array(_effect("constant", extra))).when(m == "CLOSURE", F.array(_effect("prototype", F.col("bx").cast("int")))).when(m == "JMP", F.array(_effect("pc", target.cast("int"))))
    writes = writes.when(m.isin("LOADKX", "CLOSURE"), F.array(_effect("register", a)))
    meta = F.when(m.startswith("MMBIN"), F.coalesce(F.get(F.array(*map(F.lit, EVENTS)), F.col("c").cast("int")), F.lit("__metamethod")))
    for n, said in METAMETHODS.items():
        meta = meta.when(m == n, said)
    frame = F.when(m.isin("CALL", "TAILCALL"), a)
    return words.select("*", reads.otherwise(_none()).alias("reads"), writes.otherwise(_none()).alias("writes"), meta.alias("metamethod"), F.when(m.isin(*SKIPS), F.col("pc") + 2).cast("int").alias("skip_target"), target.cast("int").alias("jump_target"), frame.cast("int").alias("invalid_from"))

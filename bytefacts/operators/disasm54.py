"""Typed disassembly of 5.4 words as columns, in the notation of disasm.

Besides: S(x) a signed number, F(k) a flag, RKk(x) a constant if k is set and else a register, T(x) a register and Nk(x) a number that are shown with
a k if it is set, X the constant that the word after names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.functions.words import field, opcode_of
from bytefacts.operators.disasm import OPERAND, _operand
from bytefacts.operators.lift54 import BINARY, WITH_K

# Fixed values of the format.
OPERANDS = f"""
MOVE,LOADNIL,GETUPVAL,SETUPVAL,UNM,BNOT,NOT,LEN,CONCAT R(A) R(B)
LOADI,LOADF R(A) S(sBx)
LOADK R(A) K(Bx)
LOADKX R(A) X(Ax)
LOADFALSE T(A)
LFALSESKIP,LOADTRUE,CLOSE,TBC,RETURN1,VARARGPREP R(A)
GETTABUP R(A) U(B) K(C)
GETTABLE,{",".join(BINARY)} R(A) R(B) R(C)
GETI R(A) R(B) N(C)
GETFIELD,SELF,{",".join(WITH_K)} R(A) R(B) K(C)
SETTABUP U(A) K(B) RKk(C)
SETTABLE R(A) R(B) RKk(C)
SETI R(A) N(B) RKk(C)
SETFIELD R(A) K(B) RKk(C)
NEWTABLE,CALL,TAILCALL R(A) N(B) N(C)
ADDI,SHRI,SHLI R(A) R(B) S(sC)
MMBIN R(A) R(B) N(C)
MMBINI R(A) S(sB) N(C) F(k)
MMBINK R(A) K(B) N(C) F(k)
JMP S(sJ)
EQ,LT,LE,TESTSET R(A) R(B) F(k)
EQK R(A) K(B) F(k)
EQI,LTI,LEI,GTI,GEI R(A) S(sB) F(k)
TEST R(A) F(k)
RETURN,SETLIST R(A) N(B) Nk(C)
FORLOOP,FORPREP,TFORPREP,TFORLOOP R(A) N(Bx)
TFORCALL R(A) N(C)
CLOSURE R(A) P(Bx)
VARARG R(A) Nk(C)
EXTRAARG N(Ax)
"""
# Fixed values of the format: events by number.
EVENTS = "__index __newindex __gc __mode __len __eq __add __sub __mul __mod __pow __div __idiv __band __bor __bxor __shl __shr __unm __bnot __lt __le __concat __call __close".split()


def _one(said: str) -> Column:
    kind, name = re.fullmatch(r"(\w+)\((\w+)\)", said).groups()
    x = F.col("next_ax") if kind == "X" else F.col(name.lower())
    tag = F.when(F.col("k") != 0, "k").otherwise("")
    shown, known = x.cast("string"), x < F.col("n_const")
    if kind in ("R", "T"):
        return _operand(name, "register", x, F.concat(shown, tag) if kind == "T" else shown)
    if kind in ("N", "Nk"):
        return _operand(name, "unsigned", x, F.concat(shown, tag) if kind == "Nk" else shown)
    if kind in ("S", "F"):
        return _operand(name, "signed" if kind == "S" else "flag", x, shown)
    if kind == "U":
        return _operand(name, "register", x, shown, "upvalue", x)
    if kind == "P":
        there = x < F.col("n_protos")
        return _operand(name, "unsigned", x, shown, F.when(there, "prototype"), F.when(there, x))
    if kind == "RKk":
        set_ = F.col("k") != 0
        return _operand(name, F.when(set_, "unsigned").otherwise("register"), x, F.when(set_ & known, F.concat(shown, F.lit("k"))).otherwise(shown), F.when(set_ & known, "constant"), F.when(set_ & known, x))
    return _operand(name, "unsigned", x, shown, F.when(known, "constant"), F.when(known, x))


def disassemble(words: DataFrame, by: list[str]) -> DataFrame:
    """Decoded 5.4 words of prototypes `by` with said, operands, role, jump_target, companion_pc, metamethod, codes and child (id of a closure's prototype).

    Needs proto, pc, raw_word, n_const, n_protos and the decoded fields. Jump targets are those that the disassembly shows: a loop's preparation leads past its loop.
    """
    at = Window.partitionBy(*by).orderBy("pc")
    after = F.lead("raw_word").over(at)
    extra = field(after, "5.4", "opcode") == opcode_of("EXTRAARG", "5.4")
    rows = words.select("*", F.when(extra, field(after, "5.4", "ax")).alias("next_ax"), F.lead("mnemonic").over(at).alias("next_mnemonic"), after.isNotNull().alias("has_next"))
    none = F.array().cast(f"array<{OPERAND}>")
    operands = none
    for line in OPERANDS.strip().splitlines():
        names, *said = line.split(" ")
        made = F.array(*map(_one, said))
        if "X(Ax)" in said:
            made = F.when(F.col("next_ax").isNotNull(), made).otherwise(F.array(_one(said[0])))
        operands = F.when(F.col("opcode").isin(*(opcode_of(n, "5.4") for n in names.split(","))), made).otherwise(operands)
    m, pc = F.col("mnemonic"), F.col("pc")
    companion = m.startswith("MMBIN")
    jump = F.when(m == "JMP", pc + 1 + F.col("sj")).when(m.isin("FORLOOP", "TFORLOOP"), pc + 1 - F.col("bx")).when(m.isin("FORPREP", "TFORPREP"), pc + 2 + F.col("bx"))
    forward = F.col("has_next") & (F.col("next_mnemonic").startswith("MMBIN") | (F.col("next_mnemonic") == "EXTRAARG") | (m == "LOADKX"))
    paired = F.when(F.coalesce(forward, F.lit(False)), pc + 1).when((companion | (m == "EXTRAARG")) & (pc > 0), pc - 1)
    out = rows.select(
        *words.columns,
        F.coalesce(m, F.concat(F.lit("UNKNOWN_0x"), F.lpad(F.lower(F.hex("opcode")), 2, "0"))).alias("said"),
        F.when(companion, "companion").when(m == "EXTRAARG", "extra_argument").otherwise("instruction").alias("shown_role"),
        operands.alias("operands"),
        jump.cast("int").alias("jump_target"),
        paired.cast("int").alias("companion_pc"),
        F.when(companion, F.coalesce(F.get(F.array(*map(F.lit, EVENTS)), F.col("c").cast("int")), F.lit("__unknown"))).alias("metamethod"),
        F.when((m == "CLOSURE") & (F.col("bx") < F.col("n_protos")), ids.proto_text(F.concat("proto", F.array(F.col("bx").cast("int"))))).alias("child"),
    )
    names_constant = m.isin("LOADK", "LOADKX", "GETTABUP", "GETFIELD", "SELF", *WITH_K, "SETTABUP", "SETFIELD", "MMBINK", "EQK") | (m.isin("SETTABLE", "SETI") & (F.col("k") != 0))
    lost = {"LOADK": ("Bx",), "LOADKX": ("Ax",), "SETTABUP": ("B", "C"), "SETFIELD": ("B", "C"), "MMBINK": ("B",), "EQK": ("B",)}
    of = F.array(F.lit("C"))
    for n, fields in lost.items():
        of = F.when(m == n, F.array(*map(F.lit, fields))).otherwise(of)
    missing = names_constant & F.exists("operands", lambda o: F.array_contains(of, o["name"]) & (o["kind"] == "unsigned") & o["target"].isNull())
    codes = F.when(m.isNull(), F.array(F.lit("L54-INVALID-OPCODE"))).when(missing, F.array(F.lit("L54-OOB-CONSTANT"))).when((m == "CLOSURE") & (F.col("bx") >= F.col("n_protos")), F.array(F.lit("L54-OOB-PROTO")))
    return out.withColumn("codes", F.coalesce(codes, F.array().cast("array<string>")))


def covered() -> set[str]:
    """Names that the table has; RETURN0 has no operand."""
    return {n for line in OPERANDS.strip().splitlines() for n in line.split(" ")[0].split(",")} | {"RETURN0"}


"""Effects of 5.1, 5.2 and 5.3 instructions as columns: what each reads, writes, skips to and jumps to.

The table says it in a small notation, compiled once to a CASE over the opcode number:
R(x) a register, K(x) a constant, U(x) an upvalue, RK(x) a constant if bit 256 is set and else a register,
R(x..y) a range (nothing if y < x); x and y are sums of fields and numbers. A condition in front, as in B>1?, must hold.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.functions.words import NAMES, RK_BIT, opcode_of

ARITHMETIC = {n: f"__{n.lower()}" for n in ("ADD", "SUB", "MUL", "DIV", "MOD", "POW")}
# Fixed values of the format: mnemonic, reads, writes.
EFFECTS = """
MOVE      R(B)                    R(A)
LOADK     K(Bx)                   R(A)
LOADBOOL  -                       R(A)
LOADNIL   -                       R(A..B)
GETUPVAL  U(B)                    R(A)
SETUPVAL  R(A)                    U(B)
GETGLOBAL K(Bx)                   R(A)
SETGLOBAL R(A),K(Bx)              -
GETTABLE  R(B),RK(C)              R(A)
SETTABLE  R(A),RK(B),RK(C)        -
NEWTABLE  -                       R(A)
SELF      R(B),RK(C)              R(A+1),R(A)
ADD       RK(B),RK(C)             R(A)
SUB       RK(B),RK(C)             R(A)
MUL       RK(B),RK(C)             R(A)
DIV       RK(B),RK(C)             R(A)
MOD       RK(B),RK(C)             R(A)
POW       RK(B),RK(C)             R(A)
UNM       R(B)                    R(A)
NOT       R(B)                    R(A)
LEN       R(B)                    R(A)
CONCAT    R(B..C)                 R(A)
EQ        RK(B),RK(C)             -
LT        RK(B),RK(C)             -
LE        RK(B),RK(C)             -
TEST      R(A)                    -
TESTSET   R(B)                    R(A)
CALL      R(A),B>1?R(A+1..A+B-1)  C>1?R(A..A+C-2)
TAILCALL  R(A),B>1?R(A+1..A+B-1)  -
RETURN    B>1?R(A..A+B-2)         -
FORLOOP   R(A..A+2)               R(A),R(A+3)
FORPREP   R(A..A+2)               R(A)
TFORLOOP  R(A..A+2)               R(A+3..A+2+C)
SETLIST   R(A+1..A+max(B,1))      R(A)
VARARG    -                       B>1?R(A..A+B-2)
"""
# Fixed values of the later formats; 5.2 lacks some of the numbers' operators.
LATER = """
MOVE      R(B)                    R(A)
LOADK     K(Bx)                   R(A)
LOADKX    -                       R(A)
LOADBOOL  -                       R(A)
LOADNIL   -                       R(A..A+B)
GETUPVAL  U(B)                    R(A)
GETTABUP  U(B),RK(C)              R(A)
GETTABLE  R(B),RK(C)              R(A)
SETTABUP  U(A),RK(B),RK(C)        -
SETUPVAL  R(A)                    U(B)
SETTABLE  R(A),RK(B),RK(C)        -
NEWTABLE  -                       R(A)
SELF      R(B),RK(C)              R(A+1),R(A)
ADD       RK(B),RK(C)             R(A)
SUB       RK(B),RK(C)             R(A)
MUL       RK(B),RK(C)             R(A)
MOD       RK(B),RK(C)             R(A)
POW       RK(B),RK(C)             R(A)
DIV       RK(B),RK(C)             R(A)
IDIV      RK(B),RK(C)             R(A)
BAND      RK(B),RK(C)             R(A)
BOR       RK(B),RK(C)             R(A)
BXOR      RK(B),RK(C)             R(A)
SHL       RK(B),RK(C)             R(A)
SHR       RK(B),RK(C)             R(A)
UNM       R(B)                    R(A)
BNOT      R(B)                    R(A)
NOT       R(B)                    R(A)
LEN       R(B)                    R(A)
CONCAT    R(B..C)                 R(A)
EQ        RK(B),RK(C)             -
LT        RK(B),RK(C)             -
LE        RK(B),RK(C)             -
TEST      R(A)                    -
TESTSET   R(B)                    R(A)
CALL      R(A),B>1?R(A+1..A+B-1)  C>1?R(A..A+C-2)
TAILCALL  R(A),B>1?R(A+1..A+B-1)  -
RETURN    B>1?R(A..A+B-2)         -
FORLOOP   R(A..A+2)               R(A),R(A+3)
FORPREP   R(A..A+2)               R(A)
TFORCALL  R(A..A+2)               R(A+3..A+2+C)
TFORLOOP  R(A+1)                  R(A)
SETLIST   R(A+1..A+max(B,1))      R(A)
CLOSURE   -                       R(A)
VARARG    -                       B>1?R(A..A+B-2)
"""
LATER_METAMETHODS = {"GETTABUP": "__index", "GETTABLE": "__index", "SELF": "__index", "SETTABUP": "__newindex", "SETTABLE": "__newindex", "CONCAT": "__concat", "CALL": "__call", "TAILCALL": "__call"} | {n: f"__{n.lower()}" for n in "ADD SUB MUL MOD POW DIV IDIV BAND BOR BXOR SHL SHR".split()}
METAMETHODS = {"GETGLOBAL": "__index", "GETTABLE": "__index", "SETGLOBAL": "__newindex", "SETTABLE": "__newindex", "CONCAT": "__concat"} | ARITHMETIC
SKIPS = ("EQ", "LT", "LE", "TEST", "TESTSET", "TFORLOOP")
JUMPS = ("JMP", "FORLOOP", "FORPREP")
EFFECT = "struct<kind:string,first:int,last:int>"


def _number(said: str) -> Column:
    """A sum such as A+B-1, or max(B,1)."""
    total: Column | None = None
    for sign, part in re.findall(r"([+-]?)(max\(\w+,\d+\)|\w+)", said):
        if m := re.fullmatch(r"max\((\w+),(\d+)\)", part):
            value = F.greatest(F.col(m[1].lower()), F.lit(int(m[2])))
        else:
            value = F.lit(int(part)) if part.isdigit() else F.col(part.lower())
        total = value if total is None else (total - value if sign == "-" else total + value)
    return total.cast("int")


def _effect(kind: Column | str, first: Column, last: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), first.alias("first"), (first if last is None else last).alias("last"))


def _one(said: str) -> Column:
    """An array of the effect, or an empty one."""
    none = F.array().cast(f"array<{EFFECT}>")
    if m := re.fullmatch(r"(\w)>(\d)\?(.*)", said):
        return F.when(F.col(m[1].lower()) > int(m[2]), _one(m[3])).otherwise(none)
    kind, inside = re.fullmatch(r"(RK|R|K|U)\((.*)\)", said).groups()
    if ".." in inside:
        first, last = map(_number, inside.split(".."))
        return F.when(last >= first, F.array(_effect("register", first, last))).otherwise(none)
    x = _number(inside)
    if kind == "RK":
        return F.array(_effect(F.when(x >= RK_BIT, "constant").otherwise("register"), F.when(x >= RK_BIT, x - RK_BIT).otherwise(x)))
    return F.array(_effect({"R": "register", "K": "constant", "U": "upvalue"}[kind], x))


def _side(said: str) -> Column:
    if said == "-":
        return F.array().cast(f"array<{EFFECT}>")
    # commas within max() do not separate
    return F.concat(*map(_one, re.findall(r"(?:\w>\d\?)?(?:RK|R|K|U)\((?:max\([^)]*\)|[^()])*\)", said)))


def _case(choices: dict[str, Column], otherwise: Column, dialect: str = "5.1") -> Column:
    whens = [(F.col("opcode") == opcode_of(n, dialect), c) for n, c in choices.items() if n in NAMES[dialect]]
    return functools.reduce(lambda acc, w: acc.when(*w), whens[1:], F.when(*whens[0])).otherwise(otherwise)


def lift(words: DataFrame, dialect: str = "5.1") -> DataFrame:
    """Decoded words of 5.1, 5.2 or 5.3 with reads, writes (arrays of effects), metamethod, skip_target, jump_target and invalid_from.

    Needs pc and the decoded fields; `role`, where there is one, other than 'instruction' has no effects here.
    invalid_from is the first register whose value a call frame makes unknown.
    """
    old = dialect == "5.1"
    table = [line.split() for line in (EFFECTS if old else LATER).strip().splitlines()]
    none = F.array().cast(f"array<{EFFECT}>")
    executable = F.col("role") == "instruction" if "role" in words.columns else F.lit(True)
    m = F.col("mnemonic")
    skips, jumps = (SKIPS, JUMPS) if old else (SKIPS[:-1], (*JUMPS, "TFORLOOP"))
    skip = F.when(m.isin(*skips) | ((m == "LOADBOOL") & (F.col("c") != 0)), F.col("pc") + 2)
    jump = F.when(m.isin(*jumps), F.col("pc") + 1 + F.col("sbx"))
    frame = F.when(m.isin("CALL", "TAILCALL"), F.col("a")).when(m == ("TFORLOOP" if old else "TFORCALL"), F.col("a") + (2 if old else 3))
    side = lambda k: F.when(executable, _case({x[0]: _side(x[k]) for x in table}, none, dialect)).otherwise(none)
    meta = _case({n: F.lit(said) for n, said in (METAMETHODS if old else LATER_METAMETHODS).items()}, F.lit(None), dialect)
    return words.select(
        "*",
        side(1).alias("reads"),
        side(2).alias("writes"),
        F.when(executable, meta).alias("metamethod"),
        F.when(executable, skip).cast("int").alias("skip_target"),
        F.when(executable, jump).cast("int").alias("jump_target"),
        F.when(executable, frame).cast("int").alias("invalid_from"),
    )


def lines(deltas: DataFrame, by: list[str], order: str = "pc", delta: str = "delta", anchor: str = "anchor") -> DataFrame:
    """A line for each pc from signed deltas and absolute anchors: a running sum that starts again at each anchor."""
    w = Window.partitionBy(*by).orderBy(order)
    numbered = deltas.withColumn("__run", F.count(anchor).over(w))
    within = Window.partitionBy(*by, "__run").orderBy(order)
    step = F.when(F.col(anchor).isNotNull(), F.col(anchor)).otherwise(F.col(delta))
    return numbered.withColumn("line", F.sum(step).over(within)).drop("__run")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))

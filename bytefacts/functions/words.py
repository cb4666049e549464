"""Instruction words as columns: bit fields out of and into unsigned 32-bit words held in longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the bytecode formats: opcode names in the order of their numbers.
NAMES = {
    "5.1": "MOVE LOADK LOADBOOL LOADNIL GETUPVAL GETGLOBAL GETTABLE SETGLOBAL SETUPVAL SETTABLE NEWTABLE SELF ADD SUB MUL DIV MOD POW UNM NOT LEN CONCAT JMP EQ LT LE TEST TESTSET CALL TAILCALL RETURN FORLOOP FORPREP TFORLOOP SETLIST CLOSE CLOSURE VARARG",
    "5.2": "MOVE LOADK LOADKX LOADBOOL LOADNIL GETUPVAL GETTABUP GETTABLE SETTABUP SETUPVAL SETTABLE NEWTABLE SELF ADD SUB MUL DIV MOD POW UNM NOT LEN CONCAT JMP EQ LT LE TEST TESTSET CALL TAILCALL RETURN FORLOOP FORPREP TFORCALL TFORLOOP SETLIST CLOSURE VARARG EXTRAARG",
    "5.3": "MOVE LOADK LOADKX LOADBOOL LOADNIL GETUPVAL GETTABUP GETTABLE SETTABUP SETUPVAL SETTABLE NEWTABLE SELF ADD SUB MUL MOD POW DIV IDIV BAND BOR BXOR SHL SHR UNM BNOT NOT LEN CONCAT JMP EQ LT LE TEST TESTSET CALL TAILCALL RETURN FORLOOP FORPREP TFORCALL TFORLOOP SETLIST CLOSURE VARARG EXTRAARG",
    "5.4": "MOVE LOADI LOADF LOADK LOADKX LOADFALSE LFALSESKIP LOADTRUE LOADNIL GETUPVAL SETUPVAL GETTABUP GETTABLE GETI GETFIELD SETTABUP SETTABLE SETI SETFIELD NEWTABLE SELF ADDI ADDK SUBK MULK MODK POWK DIVK IDIVK BANDK BORK BXORK SHRI SHLI ADD SUB MUL MOD POW DIV IDIV BAND BOR BXOR SHL SHR MMBIN MMBINI MMBINK UNM BNOT NOT LEN CONCAT CLOSE TBC JMP EQ LT LE EQK EQI LTI LEI GTI GEI TEST TESTSET CALL TAILCALL RETURN RETURN0 RETURN1 FORLOOP FORPREP TFORPREP TFORCALL TFORLOOP SETLIST CLOSURE VARARG VARARGPREP EXTRAARG",
    "5.5": "MOVE LOADI LOADF LOADK LOADKX LOADFALSE LFALSESKIP LOADTRUE LOADNIL GETUPVAL SETUPVAL GETTABUP GETTABLE GETI GETFIELD SETTABUP SETTABLE SETI SETFIELD NEWTABLE SELF ADDI ADDK SUBK MULK MODK POWK DIVK IDIVK BANDK BORK BXORK SHRI SHLI ADD SUB MUL MOD POW DIV IDIV BAND BOR BXOR SHL SHR MMBIN MMBINI MMBINK UNM BNOT NOT LEN CONCAT CLOSE TBC JMP EQ LT LE EQK EQI LTI LEI GTI GEI TEST TESTSET CALL TAILCALL RETURN RETURN0 RETURN1 FORLOOP FORPREP TFORPREP TFORCALL TFORLOOP SETLIST CLOSURE VARARG GETVARG ERRNNIL VARARGPREP EXTRAARG",
}
NAMES = {d: tuple(n.split()) for d, n in NAMES.items()}

#: (offset, width) of each field in bits, by format; signed fields are named with their bias.
FIELDS = {
    "5.1": {"opcode": (0, 6), "a": (6, 8), "c": (14, 9), "b": (23, 9), "bx": (14, 18)},
    "5.2": {"opcode": (0, 6), "a": (6, 8), "c": (14, 9), "b": (23, 9), "bx": (14, 18), "ax": (6, 26)},
    "5.3": {"opcode": (0, 6), "a": (6, 8), "c": (14, 9), "b": (23, 9), "bx": (14, 18), "ax": (6, 26)},
    "5.4": {"opcode": (0, 7), "a": (7, 8), "k": (15, 1), "b": (16, 8), "c": (24, 8), "bx": (15, 17), "ax": (7, 25)},
    "5.5": {"opcode": (0, 7), "a": (7, 8), "k": (15, 1), "b": (16, 8), "c": (24, 8), "vb": (16, 6), "vc": (22, 10), "bx": (15, 17), "ax": (7, 25)},
}
BIASED = {
    "5.1": {"sbx": ("bx", 131071)},
    "5.2": {"sbx": ("bx", 131071)},
    "5.3": {"sbx": ("bx", 131071)},
    "5.4": {"sbx": ("bx", 65535), "sj": ("ax", 16777215), "sb": ("b", 127), "sc": ("c", 127)},
    "5.5": {"sbx": ("bx", 65535), "sj": ("ax", 16777215), "sb": ("b", 127), "sc": ("c", 127)},
}
#: Operand forms of the 5.1 opcodes that are not A, B and C.
WITH_BX = ("LOADK", "GETGLOBAL", "SETGLOBAL", "CLOSURE")
WITH_SBX = ("JMP", "FORLOOP", "FORPREP")
RK_BIT = 256


def field(word: Column, dialect: str, name: str) -> Column:
    """One field of a word; signed fields have their bias taken off."""
    if name in BIASED[dialect]:
        base, bias = BIASED[dialect][name]
        return field(word, dialect, base) - F.lit(bias)
    at, width = FIELDS[dialect][name]
    return F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << width) - 1))


def fields(dialect: str) -> list[str]:
    return [*FIELDS[dialect], *BIASED[dialect]]


def decode(words: DataFrame, dialect: str = "5.1", word: str = "raw_word") -> DataFrame:
    """words with a column for each field of the dialect, the mnemonic (null if the number names no opcode) and the operand mode (5.1)."""
    out = words.select("*", *(field(F.col(word), dialect, n).alias(n) for n in fields(dialect)))
    out = out.withColumn("mnemonic", mnemonic(F.col("opcode"), dialect))
    return out.withColumn("mode", mode(F.col("mnemonic"))) if dialect == "5.1" else out


def mnemonic(opcode: Column, dialect: str) -> Column:
    """The name of an opcode number: an element of a constant array, so no join is needed."""
    names = F.array(*map(F.lit, NAMES[dialect]))
    return F.when((opcode >= 0) & (opcode < len(NAMES[dialect])), F.get(names, opcode.cast("int")))


def mode(name: Column) -> Column:
    return F.when(name.isNull(), None).when(name.isin(*WITH_BX), "iabx").when(name.isin(*WITH_SBX), "iasbx").otherwise("iabc")


def encode(dialect: str = "5.1", **values: Column) -> Column:
    """A word from its fields; every value is cut to its field's width. Signed fields get their bias."""
    word = F.lit(0).cast("long")
    for name, value in values.items():
        if name in BIASED[dialect]:
            name, bias = BIASED[dialect][name]
            value = value + F.lit(bias)
        at, width = FIELDS[dialect][name]
        word = word.bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit((1 << width) - 1)), at))
    return word


def opcode_of(name: str, dialect: str = "5.1") -> int:
    return NAMES[dialect].index(name)


def opcode_table(spark: SparkSession) -> DataFrame:
    """(dialect, opcode, mnemonic): the dimension of all dialects."""
    return spark.createDataFrame([(d, i, n) for d, names in NAMES.items() for i, n in enumerate(names)], "dialect string, opcode long, mnemonic string")

"""Typed disassembly of 5.1 words as columns: the operands of each word, what they resolve to, and what is wrong with them.

The table says in a small notation which operands a mnemonic has, in order; each is named after its field: R(x) a register,
N(x) an unsigned number, K(x) a number that names a constant, RK(x) a constant if bit 256 is set and else a register, U(x) a number that
names an upvalue, P(x) a number that names a child prototype, J(x) a signed number that names the word it leads to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.functions.words import NAMES, RK_BIT, opcode_of

# Fixed values of the format.
OPERANDS = """
MOVE      R(A) R(B)
LOADK     R(A) K(Bx)
LOADBOOL  R(A) N(B) N(C)
LOADNIL   R(A) R(B)
GETUPVAL  R(A) U(B)
GETGLOBAL R(A) K(Bx)
GETTABLE  R(A) R(B) RK(C)
SETGLOBAL R(A) K(Bx)
SETUPVAL  R(A) U(B)
SETTABLE  R(A) RK(B) RK(C)
NEWTABLE  R(A) N(B) N(C)
SELF      R(A) R(B) RK(C)
ADD       R(A) RK(B) RK(C)
SUB       R(A) RK(B) RK(C)
MUL       R(A) RK(B) RK(C)
DIV       R(A) RK(B) RK(C)
MOD       R(A) RK(B) RK(C)
POW       R(A) RK(B) RK(C)
UNM       R(A) R(B)
NOT       R(A) R(B)
LEN       R(A) R(B)
CONCAT    R(A) R(B) R(C)
JMP       J(sBx)
EQ        N(A) RK(B) RK(C)
LT        N(A) RK(B) RK(C)
LE        N(A) RK(B) RK(C)
TEST      R(A) N(C)
TESTSET   R(A) R(B) N(C)
CALL      R(A) N(B) N(C)
TAILCALL  R(A) N(B) N(C)
RETURN    R(A) N(B)
FORLOOP   R(A) J(sBx)
FORPREP   R(A) J(sBx)
TFORLOOP  R(A) N(C)
SETLIST   R(A) N(B) N(C)
CLOSE     R(A)
CLOSURE   R(A) P(Bx)
VARARG    R(A) N(B)
"""
OPERAND = "struct<name:string,kind:string,value:long,resolution:string,target:long,display:string>"


def _operand(name: str | Column, kind: str | Column, value: Column, display: Column, resolution: str | Column | None = None, target: Column | None = None) -> Column:
    lit = lambda x, t: (F.lit(x) if x is None or isinstance(x, str) else x).cast(t)
    return F.struct(lit(name, "string").alias("name"), lit(kind, "string").alias("kind"), value.cast("long").alias("value"), lit(resolution, "string").alias("resolution"), lit(target, "long").alias("target"), display.cast("string").alias("display"))


def _shown(mark: str, x: Column) -> Column:
    return F.concat(F.lit(f"{mark}("), x.cast("string"), F.lit(")"))


def _one(said: str, mnemonic: str) -> Column:
    kind, name = re.fullmatch(r"(\w+)\((\w+)\)", said).groups()
    x, n_const = F.col(name.lower()), F.col("n_const")
    byte = x.bitwiseAND(255)
    if kind == "R":
        return _operand(name, "register", byte, _shown("R", x))
    if kind == "N":
        return _operand(name, "unsigned", x, F.when(x != 0, "true").otherwise("false") if (mnemonic, name) == ("LOADBOOL", "B") else x)
    if kind == "K":
        return _operand(name, "unsigned", x, _shown("K", x), F.when(x < n_const, "constant"), F.when(x < n_const, x))
    if kind == "RK":
        is_k = x >= RK_BIT
        known = is_k & (byte < n_const)
        return _operand(name, F.when(is_k, "unsigned").otherwise("register"), F.when(is_k, x).otherwise(byte), F.when(is_k, _shown("K", byte)).otherwise(_shown("R", byte)), F.when(known, "constant"), F.when(known, byte))
    if kind == "U":
        return _operand(name, "unsigned", x, _shown("Upvalue", byte), "upvalue", byte)
    if kind == "P":
        return _operand(name, "unsigned", x, ids.proto_text(F.concat("proto", F.array(x.cast("int")))), "prototype", x)
    return _operand(name, "signed", x, x, "jump-target", F.col("pc") + 1 + x)


def disassemble(words: DataFrame) -> DataFrame:
    """Decoded 5.1 words with said (the mnemonic as it is shown), operands (array of OPERAND) and codes (diagnostics).

    Needs proto, pc, n_const and the decoded fields; role, owner_pc and upvalue_index, where they are there, tell companions:
    a closure binding names the upvalue it fills and where from, a word that a SETLIST owns is a raw number.
    """
    table = dict(line.split(maxsplit=1) for line in OPERANDS.strip().splitlines())
    none = F.array().cast(f"array<{OPERAND}>")
    real = none
    for name, said in reversed(table.items()):
        real = F.when(F.col("opcode") == opcode_of(name), F.array(*(_one(x, name) for x in said.split()))).otherwise(real)
    has_roles = "role" in words.columns
    role = F.col("role") if has_roles else F.lit("instruction")
    owned = F.col("upvalue_index") if has_roles else F.lit(None).cast("int")
    move = F.col("opcode") == opcode_of("MOVE")
    source = F.when(move, F.concat(F.lit("parent "), _shown("R", F.col("b")))).otherwise(F.concat(F.lit("parent upvalue["), F.col("b").cast("string"), F.lit("]")))
    binding = F.array(
        _operand("upvalue_index", "unsigned", owned, F.concat(F.lit("upvalue["), owned.cast("string"), F.lit("]"))),
        _operand("source", F.when(move, "register").otherwise("unsigned"), F.when(move, F.col("b").bitwiseAND(255)).otherwise(F.col("b")), source),
    )
    raw = F.array(_operand("value", "raw", F.col("raw_word"), F.concat(F.col("raw_word").cast("string"), F.lit(" (0x"), F.lpad(F.lower(F.hex("raw_word")), 8, "0"), F.lit(")"))))
    operands = F.when(role == "closure_binding", binding).when(role == "setlist_extra", raw).otherwise(real)
    unknown = F.concat(F.lit("OP_UNKNOWN_0x"), F.lpad(F.lower(F.hex("opcode")), 2, "0"))
    name = F.coalesce("mnemonic", unknown)
    shown = F.when(role == "setlist_extra", "setlist_extra").when(role == "closure_binding", F.concat(name, F.lit(" (binding descriptor)"))).otherwise(name)
    out = words.select("*", shown.alias("said"), operands.alias("operands"))
    instruction = role == "instruction"
    constant = lambda o: o["display"].startswith("K(") & o["target"].isNull()
    missing = F.exists("operands", constant) & ~F.col("mnemonic").isin("GETGLOBAL", "SETGLOBAL")
    codes = F.when(instruction & (F.col("opcode") >= len(NAMES["5.1"])), F.array(F.lit("L51-DISASM-001"))).when(instruction & missing, F.transform(F.filter("operands", constant), lambda _: F.lit("L51-DISASM-002")))
    return out.withColumn("codes", F.coalesce(codes, F.array().cast("array<string>")))


def closure_roles(words: DataFrame, prototypes: DataFrame, by: list[str]) -> DataFrame:
    """words with the roles of the older view, in which closure bindings are the only companions: the last CLOSURE before claims a word.

    words: by, proto, pc, opcode, bx. prototypes: by, proto, n_upval, n_instr.
    """
    child = prototypes.select(*by, F.col("proto").alias("child"), "n_upval")
    closures = words.where(F.col("opcode") == opcode_of("CLOSURE")).select(*by, "proto", F.col("pc").alias("owner"), F.concat("proto", F.array(F.col("bx").cast("int"))).alias("child"))
    claims = closures.join(child, [*by, "child"]).where("n_upval > 0").select(*by, "proto", "owner", F.explode(F.sequence(F.lit(0), F.col("n_upval") - 1)).alias("k"))
    last = claims.groupBy(*by, "proto", (F.col("owner") + 1 + F.col("k")).alias("pc")).agg(F.max_by("k", "owner").alias("upvalue_index"), F.max("owner").alias("owner_pc"))
    plain = words.drop("role", "owner_pc", "upvalue_index")
    joined = plain.join(last, [*by, "proto", "pc"], "left")
    return joined.withColumn("role", F.when(F.col("owner_pc").isNull(), "instruction").otherwise("closure_binding"))


def lines(disassembled: DataFrame) -> Column:
    """One line of text for a word: its place, name and operands."""
    return F.concat_ws(" ", F.lpad(F.col("pc").cast("string"), 6, " "), F.rpad(F.col("said"), 12, " "), F.array_join(F.transform("operands", lambda o: o["display"]), " "))

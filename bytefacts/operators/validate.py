"""Validation rules as one array of conditions for each word, diagnostics, verdicts, and checks of byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.functions.words import NAMES, RK_BIT, WITH_SBX
from bytefacts.operators.lift import SKIPS

SEVERITY = {"error": 0, "warning": 1, "info": 2}
A_NOT_REGISTER = ("JMP", "EQ", "LT", "LE")
B_REGISTER = ("MOVE", "LOADNIL", "GETTABLE", "SELF", "UNM", "NOT", "LEN", "CONCAT", "TESTSET")
RK = ("ADD", "SUB", "MUL", "DIV", "MOD", "POW", "EQ", "LT", "LE")
B_RK, C_RK = ("SETTABLE", *RK), ("GETTABLE", "SETTABLE", "SELF", *RK)


def span_end() -> Column:
    """The last register of an instruction's window, or null."""
    m, a, b, c = F.col("mnemonic"), F.col("a"), F.col("b"), F.col("c")
    call = F.greatest(F.when(b > 0, a + b - 1), F.when(c > 1, a + c - 2))
    return (
        F.when(m == "SELF", a + 1)
        .when(m.isin("FORLOOP", "FORPREP"), a + 3)
        .when(m == "TFORLOOP", a + 2 + c)
        .when(m == "CALL", call)
        .when(m == "TAILCALL", F.when(b > 0, a + b - 1))
        .when(m.isin("RETURN", "VARARG"), F.when(b > 1, a + b - 2))
        .when(m == "SETLIST", F.when(b > 0, a + b))
    )


def rules_51() -> list[tuple[str, str, Column]]:
    """(code, severity, condition) of each 5.1 rule about an executable word.

    Needs pc, n (words of the prototype), the decoded fields, maxstacksize, n_const, n_upval, n_protos, and target_role: the role of the word
    that a jump or skip leads to (null if it is an instruction).
    """
    m, known = F.col("mnemonic"), F.col("mnemonic").isNotNull()
    jump = m.isin(*WITH_SBX)
    target = F.col("pc") + 1 + F.col("sbx")
    inside = (target >= 0) & (target < F.col("n"))
    skip = m.isin(*SKIPS) | ((m == "LOADBOOL") & (F.col("c") != 0))
    stack = F.col("maxstacksize")
    return [
        ("L51-OP-001", "error", ~known),
        ("L51-JMP-001", "error", jump & ~inside),
        ("L51-JMP-002", "error", ((jump & inside) | skip) & F.col("target_role").isNotNull()),
        ("L51-CONST-003", "error", m.isin("LOADK", "GETGLOBAL", "SETGLOBAL") & (F.col("bx") >= F.col("n_const"))),
        ("L51-UPVAL-001", "error", m.isin("GETUPVAL", "SETUPVAL") & (F.col("b") >= F.col("n_upval"))),
        ("L51-BOOL-001", "error", m.isin("EQ", "LT", "LE") & (F.col("a") > 1)),
        ("L51-REG-001", "error", known & ~m.isin(*A_NOT_REGISTER) & (F.col("a") >= stack)),
        ("L51-REG-SPAN-001", "error", known & (span_end() >= stack)),
        ("L51-REG-002", "error", (m.isin(*B_REGISTER) | (m.isin(*B_RK) & (F.col("b") < RK_BIT))) & (F.col("b") >= stack)),
        ("L51-REG-003", "error", ((m == "CONCAT") | (m.isin(*C_RK) & (F.col("c") < RK_BIT))) & (F.col("c") >= stack)),
        ("L51-CONST-004", "error", m.isin(*B_RK) & (F.col("b") >= RK_BIT) & (F.col("b") - RK_BIT >= F.col("n_const"))),
        ("L51-CONST-005", "error", m.isin(*C_RK) & (F.col("c") >= RK_BIT) & (F.col("c") - RK_BIT >= F.col("n_const"))),
        ("L51-PROTO-002", "error", (m == "CLOSURE") & (F.col("bx") >= F.col("n_protos"))),
    ]


def rules_54() -> list[tuple[str, str, Column]]:
    """(code, severity, condition) of each 5.4 rule about a word; columns as for rules_51, and k, sj."""
    m, known = F.col("mnemonic"), F.col("mnemonic").isNotNull()
    target = F.col("pc") + 1 + F.col("sj")
    return [
        ("L54-VAL-OPCODE-001", "error", ~known),
        ("L54-VAL-REG-001", "warning", known & ~m.isin("JMP", "EXTRAARG", "SETTABUP", "RETURN0", "VARARGPREP") & (F.col("a") >= F.col("maxstacksize"))),
        ("L54-VAL-CONST-001", "error", (m == "LOADK") & (F.col("bx") >= F.col("n_const"))),
        ("L54-VAL-UPVAL-001", "error", m.isin("GETUPVAL", "SETUPVAL") & (F.col("b") >= F.col("n_upval"))),
        ("L54-VAL-UPVAL-002", "error", ((m == "GETTABUP") & (F.col("b") >= F.col("n_upval"))) | ((m == "SETTABUP") & (F.col("a") >= F.col("n_upval")))),
        ("L54-VAL-PROTO-001", "error", (m == "CLOSURE") & (F.col("bx") >= F.col("n_protos"))),
        ("L54-VAL-JUMP-001", "error", (m == "JMP") & ((target < 0) | (target >= F.col("n")))),
    ]


def neighbours(words: DataFrame, by: list[str]) -> DataFrame:
    """Words with the mnemonic before and after each, and the one before's C."""
    at = Window.partitionBy(*by).orderBy("pc")
    return words.select("*", F.lag("mnemonic").over(at).alias("prev_mnemonic"), F.lag("c").over(at).alias("prev_c"), F.lead("mnemonic").over(at).alias("next_mnemonic"))


def rules_52(dialect: str) -> list[tuple[str, str, Column]]:
    """(code, severity, condition) of each rule about a word of 5.2 or 5.3; columns as for rules_51, ax, and those of neighbours()."""
    tag, constant = dialect.replace(".", ""), {"5.2": "002", "5.3": "003"}[dialect]
    m, known, stack = F.col("mnemonic"), F.col("mnemonic").isNotNull(), F.col("maxstacksize")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    target = F.col("pc") + 1 + F.col("sbx")
    binary = ("ADD", "SUB", "MUL", "DIV", "MOD", "POW", "IDIV", "BAND", "BOR", "BXOR", "SHL", "SHR", "EQ", "LT", "LE")
    b_rk, c_rk = m.isin("SETTABUP", "SETTABLE", *binary), m.isin("GETTABUP", "GETTABLE", "SETTABUP", "SETTABLE", "SELF", *binary)
    b_reg = m.isin("MOVE", "UNM", "BNOT", "NOT", "LEN", "TESTSET", "GETTABLE", "SELF", "CONCAT")
    k = lambda x: x - RK_BIT >= F.col("n_const")
    after_kx = F.col("prev_mnemonic") == "LOADKX"
    span = (
        ((m == "LOADNIL") & (a + b >= stack))
        | ((m == "SELF") & (a + 1 >= stack))
        | ((m == "CONCAT") & (b > c))
        | (m.isin("CALL", "TAILCALL") & (b > 1) & (a + b - 1 > stack))
        | ((m == "CALL") & (c > 1) & (a + c - 2 >= stack))
        | (m.isin("RETURN", "VARARG") & (b > 1) & (a + b - 2 >= stack))
        | ((m == "FORLOOP") & (a + 3 >= stack))
        | ((m == "FORPREP") & (a + 2 >= stack))
        | ((m == "TFORCALL") & (a + 2 + c > stack))
        | ((m == "TFORLOOP") & (a + 1 >= stack))
        | ((m == "SETLIST") & (b > 0) & (a + b >= stack))
    )
    no_register = m.isin("JMP", "EQ", "LT", "LE", "EXTRAARG", "SETTABUP")
    wrong_extra = (m == "EXTRAARG") & ~F.coalesce(after_kx | ((F.col("prev_mnemonic") == "SETLIST") & (F.col("prev_c") == 0)), F.lit(False))
    return [
        (f"L{tag}-OP-001", "error", ~known),
        (f"L{tag}-COMPANION-001", "error", ((m == "LOADKX") & ~F.coalesce(F.col("next_mnemonic") == "EXTRAARG", F.lit(False))) | wrong_extra),
        (f"L{tag}-JMP-001", "error", m.isin("JMP", "FORLOOP", "FORPREP", "TFORLOOP") & ((target < 0) | (target >= F.col("n")))),
        (f"L{tag}-REG-001", "error", known & ((~no_register & (a >= stack)) | ((m == "JMP") & (a > stack)))),
        (f"L{tag}-REG-002", "error", (b_reg | (b_rk & (b < RK_BIT))) & (b >= stack)),
        (f"L{tag}-REG-003", "error", ((m == "CONCAT") | (c_rk & (c < RK_BIT))) & (c >= stack)),
        (f"L{tag}-CONST-{constant}", "error", (b_rk & (b >= RK_BIT) & k(b)) | (c_rk & (c >= RK_BIT) & k(c)) | ((m == "LOADK") & (F.col("bx") >= F.col("n_const"))) | ((m == "EXTRAARG") & after_kx & (F.col("ax") >= F.col("n_const")))),
        (f"L{tag}-UPVAL-002", "error", (m.isin("GETUPVAL", "SETUPVAL", "GETTABUP") & (b >= F.col("n_upval"))) | ((m == "SETTABUP") & (a >= F.col("n_upval")))),
        (f"L{tag}-PROTO-002", "error", (m == "CLOSURE") & (F.col("bx") >= F.col("n_protos"))),
        (f"L{tag}-REG-SPAN-001", "error", known & span),
    ]


def rules_55() -> list[tuple[str, str, Column]]:
    """(code, severity, condition) of each 5.5 rule about a word; columns as for rules_51, k, sj, ax, and those of neighbours()."""
    m, known, stack = F.col("mnemonic"), F.col("mnemonic").isNotNull(), F.col("maxstacksize")
    a, b, c, n_const = F.col("a"), F.col("b"), F.col("c"), F.col("n_const")
    binary = ("ADD", "SUB", "MUL", "MOD", "POW", "DIV", "IDIV", "BAND", "BOR", "BXOR", "SHL", "SHR")
    with_k = tuple(f"{n}K" for n in binary[:10])
    after_kx = F.col("prev_mnemonic") == "LOADKX"
    alone = (m == "EXTRAARG") & ~F.coalesce(F.col("prev_mnemonic").isin("LOADKX", "NEWTABLE", "SETLIST"), F.lit(False))
    out = lambda t: (t < 0) | (t >= F.col("n"))
    jumps = ((m == "JMP") & out(F.col("pc") + 1 + F.col("sj"))) | (m.isin("FORPREP", "TFORPREP") & out(F.col("pc") + 1 + F.col("bx"))) | (m.isin("FORLOOP", "TFORLOOP") & out(F.col("pc") + 1 - F.col("bx")))
    b_reg = m.isin("MOVE", "GETTABLE", "GETI", "GETFIELD", "SETTABLE", "SELF", "ADDI", "SHLI", "SHRI", *with_k, *binary, "MMBIN", "UNM", "BNOT", "NOT", "LEN", "EQ", "LT", "LE", "TESTSET", "GETVARG")
    c_reg = m.isin("GETTABLE", *binary, "GETVARG") | (m.isin("SETTABUP", "SETTABLE", "SETI", "SETFIELD") & (F.col("k") == 0))
    constant = (
        ((m == "LOADK") & (F.col("bx") >= n_const))
        | (m.isin("GETFIELD", "GETTABUP", *with_k) & (c >= n_const))
        | (m.isin("SETFIELD", "SETTABUP", "MMBINK", "EQK") & (b >= n_const))
        | (m.isin("SETTABLE", "SETI") & (F.col("k") != 0) & (c >= n_const))
        | ((m == "ERRNNIL") & (F.col("bx") > 0) & (F.col("bx") - 1 >= n_const))
        | ((m == "EXTRAARG") & after_kx & (F.col("ax") >= n_const))
    )
    span = (
        ((m == "LOADNIL") & (a + b >= stack))
        | ((m == "CONCAT") & (b > 0) & (a + b - 1 >= stack))
        | ((m == "SELF") & (a + 1 >= stack))
        | (m.isin("CALL", "TAILCALL") & (b > 1) & (a + b - 1 >= stack))
        | ((m == "CALL") & (c > 1) & (a + c - 2 >= stack))
        | ((m == "RETURN") & (b > 1) & (a + b - 2 >= stack))
        | (m.isin("FORLOOP", "FORPREP", "TFORLOOP") & (a + 2 >= stack))
        | ((m == "TFORCALL") & (a + 3 + c >= stack))
    )
    return [
        ("L55-OP-001", "error", ~known),
        ("L55-COMPANION-001", "error", ((m == "LOADKX") & ~F.coalesce(F.col("next_mnemonic") == "EXTRAARG", F.lit(False))) | alone),
        ("L55-JMP-001", "error", jumps),
        ("L55-REG-001", "error", known & ~m.isin("JMP", "EXTRAARG", "SETTABUP", "RETURN0", "VARARGPREP") & (a >= stack)),
        ("L55-REG-002", "error", b_reg & (b >= stack)),
        ("L55-REG-003", "error", c_reg & (c >= stack)),
        ("L55-CONST-002", "error", constant),
        ("L55-UPVAL-002", "error", (m.isin("GETUPVAL", "SETUPVAL", "GETTABUP") & (b >= F.col("n_upval"))) | ((m == "SETTABUP") & (a >= F.col("n_upval")))),
        ("L55-PROTO-002", "error", (m == "CLOSURE") & (F.col("bx") >= F.col("n_protos"))),
        ("L55-REG-SPAN-001", "error", known & span),
    ]


def stack_warnings(prototypes: DataFrame, by: list[str], dialect: str) -> DataFrame:
    """(by, code, severity) of prototypes with more than 250 registers."""
    return prototypes.where("maxstacksize > 250").select(*by, F.lit(f"L{dialect.replace('.', '')}-STACK-001").alias("code"), F.lit("warning").alias("severity"))


def violations(words: DataFrame, rules: list[tuple[str, str, Column]], by: list[str]) -> DataFrame:
    """(by, pc, code, severity): the rules that each executable word breaks. An unknown opcode breaks only its own rule."""
    broken = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, s, c in rules))
    run = words.where("role = 'instruction'") if "role" in words.columns else words
    return run.select(*by, "pc", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("d")).select(*by, "pc", "d.code", "d.severity")


def verdict(diagnostics: DataFrame, artifacts: DataFrame, by: list[str]) -> DataFrame:
    """(by, verdict): invalid with an error, incomplete where a limit was hit, else valid-for-parser."""
    said = diagnostics.groupBy(*by).agg(F.max(F.when(F.col("code").startswith("CORE-LIMIT"), 1).when(F.col("severity") == "error", 2).otherwise(0)).alias("worst"))
    level = F.coalesce("worst", F.lit(0))
    return artifacts.select(*by).distinct().join(said, by, "left").select(*by, F.when(level == 2, "invalid").when(level == 1, "incomplete").otherwise("valid-for-parser").alias("verdict"))


#: Diagnostics of an artifact that are told.
MOST_DIAGNOSTICS = 10_000


def truncated(diagnostics: DataFrame, by: list[str], order: list[str], cap: int = MOST_DIAGNOSTICS) -> DataFrame:
    """At most cap diagnostics of each artifact, repeats dropped first: errors before warnings, in order; the limit notice last if any was cut."""
    once = diagnostics.groupBy(*by, "code", "severity", "target").agg(F.min(F.struct(*order)).alias("first"))
    rank = F.coalesce(*(F.when(F.col("severity") == s, r) for s, r in SEVERITY.items()))
    at = Window.partitionBy(*by).orderBy(rank, "first", "code", "target")
    ranked = once.withColumn("position", F.row_number().over(at)).withColumn("found", F.count("*").over(Window.partitionBy(*by)))
    kept = ranked.where((F.col("found") <= cap) | (F.col("position") < cap)).select(*by, "code", "severity", "target", "position")
    notice = ranked.where((F.col("found") > cap) & (F.col("position") == cap)).select(*by, F.lit("CORE-LIMIT-003").alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("target"), "position")
    return kept.unionByName(notice)


def byte_accounting(ranges: DataFrame, by: list[str], total: str) -> DataFrame:
    """(by, position, kind): gaps and overlaps of ranges (byte_offset, byte_length), and bytes missing at either end. No row: every byte counted once."""
    at = Window.partitionBy(*by).orderBy("byte_offset", "byte_length")
    end = F.col("byte_offset") + F.col("byte_length")
    reach = F.coalesce(F.max(end).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = ranges.withColumn("reach", reach).where(F.col("byte_offset") != F.col("reach"))
    inside = seen.select(*by, F.least("byte_offset", "reach").alias("position"), F.when(F.col("byte_offset") > F.col("reach"), "gap").otherwise("overlap").alias("kind"))
    last = ranges.groupBy(*by).agg(F.max(end).alias("end"), F.max(total).alias("total")).where("end != total")
    return inside.unionByName(last.select(*by, F.least("end", "total").alias("position"), F.when(F.col("end") < F.col("total"), "gap").otherwise("overlap").alias("kind")))


def known_opcodes(dialect: str) -> int:
    return len(NAMES[dialect])

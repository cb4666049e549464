"""The catalog of diagnostic codes, as a dimension: code, severity, category, and what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed codes that stand alone: code, severity, category, what is wrong.
CODES = """
ANA-LIMIT-001 error analysis the index of exports is over its limit, so what it lacks proves nothing
ANA-LIMIT-002 error analysis an artifact has more links than are told
ANA-PRECOND-001 error analysis this dialect is not analysed
CORE-LIMIT-001 error parse prototypes are nested deeper than is read
CORE-LIMIT-002 error parse more prototypes than are read
CORE-LIMIT-003 error parse further diagnostics were left out
CORE-LIMIT-004 error parse more words in all than are read
CORE-OVERFLOW-001 error parse the bounds of a read do not fit a number
CORE-SLICE-001 error parse a read from behind its own end
CORE-TRUNC-001 error parse the artifact ends within a value
INTERNAL-IDENTITY-001 error analysis a question does not go with this artifact
IO-001 error structure the file can't be read
L51-BOOL-001 error instruction a flag beyond 1
L51-CLOSURE-001 error instruction words of a closure are missing
L51-CLOSURE-002 error instruction a word of a closure is neither MOVE nor GETUPVAL
L51-CONST-001 error parse too many constants, or one with an unknown tag
L51-CONST-002 error parse a constant that only the LNUM profile has
L51-CONST-003 error instruction a constant that is not there
L51-CONST-004 error instruction the first operand names a constant that is not there
L51-CONST-005 error instruction the second operand names a constant that is not there
L51-DISASM-001 error instruction an opcode that can't be told
L51-DISASM-002 error instruction an operand names a constant that is not there
L51-HEADER-003 error parse byte order or sizes that are not read
L51-JMP-002 error control-flow a jump or skip leads to a word that is no instruction
L51-SETLIST-001 error instruction the word after SETLIST is missing
L51-UPVAL-001 error instruction an upvalue that is not there
L52-CONST-001 error parse too many constants, or one with an unknown tag
L52-CONST-002 error instruction a constant that is not there
L53-CONST-001 error parse a constant has an unknown tag
L53-CONST-002 error parse too many constants
L53-CONST-003 error instruction a constant that is not there
L54-CONST-001 error parse too many constants
L54-CONST-002 error parse a constant has an unknown tag
L54-INVALID-OPCODE error instruction an opcode that can't be told
L54-OOB-CONSTANT error instruction an operand names a constant that is not there
L54-OOB-PROTO error instruction an operand names a prototype that is not there
L54-SIZE-001 error parse a size beyond any address
L54-VAL-CONST-001 error instruction a constant that is not there
L54-VAL-HEADER-001 error structure words are not of 4 bytes
L54-VAL-HEADER-002 error structure integers are not of 8 bytes
L54-VAL-HEADER-003 error structure numbers are not of 8 bytes
L54-VAL-JUMP-001 error control-flow a jump leaves the prototype
L54-VAL-OPCODE-001 error instruction an unknown opcode
L54-VAL-PROTO-001 error instruction a prototype that is not there
L54-VAL-REG-001 warning instruction register A is beyond the frame
L54-VAL-UPVAL-001 error instruction an upvalue that is not there
L54-VAL-UPVAL-002 error instruction an upvalue to be indexed that is not there
L54-VARINT-001 error parse a number of more than 64 bits
L55-CONST-001 error parse too many constants, or one with an unknown tag
L55-CONST-002 error instruction a constant that is not there
L55-STR-001 error parse a string to use again that is not there
L55-STR-002 error parse a string longer than is read
L55-VARINT-001 error parse a number of more than 64 bits
PARSE-001 error parse the header is damaged
PARSE-SOURCE-001 error parse this is source text
PARSE-UNKNOWN-001 error parse the signature is not known
"""
# Fixed codes that several dialects have: the dialects, what follows their names, severity, category, what is wrong.
SHARED = """
51,52,53,54,55 CHUNK-001 warning structure bytes after the main prototype
51,52,53,54,55 CODE-001 error parse more words than are read
51,52,53,54,55 HEADER-001 error parse the signature is damaged
51,52,53,54,55 HEADER-002 error parse another version
51,52,53,54,55 PROTO-001 error parse more prototypes than are read
51,52,53,54 STR-001 error parse a string longer than is read
52,53,54,55 UPVAL-001 error parse more upvalues than are read
51,52,53,55 JMP-001 error control-flow a jump leaves the prototype
51,52,53,55 OP-001 error instruction an unknown opcode
51,52,53,55 PROTO-002 error instruction a prototype that is not there
51,52,53,55 REG-001 error instruction register A is beyond the frame
51,52,53,55 REG-002 error instruction register B is beyond the frame
51,52,53,55 REG-003 error instruction register C is beyond the frame
51,52,53,55 REG-SPAN-001 error instruction a window of registers leaves the frame
51,52,53,55 STACK-001 warning structure more than 250 registers
52,53,55 COMPANION-001 error instruction an extra word is missing or stands alone
52,53,55 HEADER-003 error structure a format of one's own
52,53,55 UPVAL-002 error instruction an upvalue that is not there
54 HEADER-003 warning structure a format of one's own
"""
# Fixed codes of the rest of the header: dialect, first number, what each in turn is about.
HEADERS = """
52 4 byte order; size of int; size of size_t; size of a word; size of a number; whole numbers; check bytes
53 4 check bytes; size of int; size of size_t; size of a word; size of an integer; size of a number; check integer; check number
54 4 check bytes; size of a word; size of an integer; size of a number; check integer; check number
55 4 check bytes; size of int; check int; size of a word; check word; size of an integer; check integer; size of a number; check number
"""


def entries() -> list[tuple[str, str, str, str]]:
    """(code, severity, category, message) in order of the codes."""
    out = [tuple(line.split(" ", 3)) for line in CODES.strip().splitlines()]
    for line in SHARED.strip().splitlines():
        dialects, name, *rest = line.split(" ", 4)
        out += [(f"L{d}-{name}", *rest) for d in dialects.split(",")]
    for line in HEADERS.strip().splitlines():
        d, first, said = line.split(" ", 2)
        out += [(f"L{d}-HEADER-{int(first) + i:03d}", "error", "structure", f"{what}: not a value that is read") for i, what in enumerate(said.split("; "))]
    return sorted(out)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "code string, severity string, category string, message string")


def told(diagnostics: DataFrame) -> DataFrame:
    """diagnostics with category and catalogued message; a code that the catalog lacks keeps nulls."""
    c = catalog(diagnostics.sparkSession).select("code", "category", F.col("message").alias("catalogued"))
    return diagnostics.join(F.broadcast(c), "code", "left")


def lookup(spark: SparkSession, code: str) -> DataFrame:
    """The entry of one code, or no row."""
    return catalog(spark).where(F.col("code") == code)

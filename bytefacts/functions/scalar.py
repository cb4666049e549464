"""Display of byte strings and numbers, as columns where Spark can and as Python for kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 64
_NAMED = {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 92: "\\\\"}


def escape_bytes(raw: bytes) -> str:
    """Printable ASCII as it is, but for quote and backslash; other bytes as \\n, \\r, \\t or \\xNN."""
    return "".join(_NAMED.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in raw)


def escape(raw: Column) -> Column:
    """escape_bytes for a binary column: plain replacements, and only where a string has other bytes a walk over them."""
    one_each = F.decode(raw, "ISO-8859-1")  # a character for each byte
    shown = F.array(*(F.lit(escape_bytes(bytes([b]))) for b in range(256)))
    walked = F.array_join(F.transform(F.regexp_extract_all(F.hex(raw), F.lit(".."), F.lit(0)), lambda p: F.get(shown, F.conv(p, 16, 10).cast("int"))), "")
    return F.when(one_each.rlike(r"[^\x09\x0A\x0D\x20-\x7E]"), walked).otherwise(escape_ascii(one_each))


def escape_ascii(text: Column) -> Column:
    """escape() of an ASCII string by plain replacements, which stay in generated code."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for b, name in ((34, '\\"'), (10, "\\n"), (13, "\\r"), (9, "\\t")):
        out = F.replace(out, F.lit(chr(b)), F.lit(name))
    return out


def preview(raw: Column, limit: int = PREVIEW) -> Column:
    """The quoted display of at most `limit` bytes; longer strings end in `.." (N bytes)`."""
    n = F.octet_length(raw)
    return F.when(n <= limit, F.concat(F.lit('"'), escape(raw), F.lit('"'))).otherwise(F.concat(F.lit('"'), escape(F.substring(raw, 1, limit)), F.lit('.." ('), n.cast("string"), F.lit(" bytes)")))


def show_float(x: float) -> str:
    """nan, inf, -inf, -0.0, or the shortest digits that read back, with a point or an exponent."""
    if math.isnan(x):
        return "nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return repr(x)


def float_bits(x: Column) -> Column:
    """The bits of a double as 16 hex digits; tells -0.0 from 0.0 and keeps NaN equal to itself only bit for bit."""
    return F.when(x.isNotNull(), F.lpad(F.lower(F.hex(F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long"))), 16, "0"))

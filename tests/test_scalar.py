import math

from bytefacts.functions import scalar
from pyspark.sql import functions as F


def test_escape_and_preview_of_every_byte(spark):
    rows = [bytes(range(256)), b"", b"plain \\ \" text\n\t\r", b"a" * 64, b"b" * 65, b"\xc3\xa9", None] + [bytes([b]) for b in range(256)]
    frame = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(rows)], "i int, raw binary")
    got = {r.i: (r.e, r.p) for r in frame.select("i", scalar.escape(F.col("raw")).alias("e"), scalar.preview(F.col("raw")).alias("p")).collect()}
    for i, r in enumerate(rows):
        assert got[i][0] == (None if r is None else scalar.escape_bytes(r))
    assert got[3][1] == '"' + "a" * 64 + '"' and got[4][1] == '"' + "b" * 64 + '.." (65 bytes)' and got[6] == (None, None)


def test_floats_are_shown_so_that_they_read_back():
    assert [scalar.show_float(x) for x in (math.nan, math.inf, -math.inf, -0.0, 1.0, 0.1, 1e300)] == ["nan", "inf", "-inf", "-0.0", "1.0", "0.1", "1e+300"]

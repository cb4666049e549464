import re

from bytefacts.operators import catalog, validate
from bytefacts.sources import chunks


def test_every_code_is_catalogued_once(spark):
    codes = [e[0] for e in catalog.entries()]
    assert len(set(codes)) == len(codes) == 161
    said = {code for rules in (validate.rules_51(), validate.rules_54(), validate.rules_52("5.2"), validate.rules_52("5.3"), validate.rules_55()) for code, _, _ in rules}
    said |= set(re.findall(r'"((?:CORE|PARSE|L5\d)-[A-Z-]+-\d{3})"', open(chunks.__file__).read()))
    said |= {f"L{d.replace('.', '')}-HEADER-{code}" for d, parts in chunks.HEADER.items() for code, _, _ in parts}
    assert catalog.lookup(spark, "IO-001").count() == 1 and catalog.lookup(spark, "X-1").count() == 0
    assert said <= set(codes)
    assert {e[1] for e in catalog.entries()} == {"error", "warning"}
    frame = spark.createDataFrame([("L51-OP-001",), ("X-1",)], "code string")
    assert {r.code: r.catalogued for r in catalog.told(frame).collect()} == {"L51-OP-001": "an unknown opcode", "X-1": None}

import pytest

from bytefacts.functions import words
from bytefacts.operators import callees, lift, origins, relations
from bytefacts.plans import answers, export
from bytefacts.sources import artifacts as source
from bytefacts.sources.chunks import Chunk, encode
from pyspark.sql import functions as F

from .test_callees import END, proto, s
from .test_chunks import i51


@pytest.fixture(scope="module")
def found(spark):
    target = proto([END])
    one = proto([i51("CLOSURE", 0, bx=0), i51("SETGLOBAL", 0, bx=0), i51("GETGLOBAL", 0, bx=0), i51("LOADK", 1, bx=1), i51("CALL", 0, 2, 1), i51("GETGLOBAL", 0, bx=2), i51("CALL", 0, 1, 1), END], [s(b"run"), s(b"x"), s(b"print")], [target])
    two = proto([i51("GETGLOBAL", 0, bx=0), i51("GETTABLE", 0, 0, 257), i51("CALL", 0, 1, 1), i51("ADD", 0, 256, 257), END], [s(b"m"), s(b"run")])
    rows = [("one", bytearray(encode(Chunk("lua5.1", one)))), ("two", bytearray(encode(Chunk("lua5.1", two))))]
    return spark.createDataFrame(rows, "path string, content binary").cache()


def test_callers_and_coverage(spark, found):
    rel = relations.call_relations(callees.callees(found), callees.global_stores(found), ["path", "sha256"])
    links = spark.createDataFrame([("two", "proto:0/pc:2", "resolved", "one", [0, 0])], "path string, call_id string, link_status string, link_target string, link_proto array<int>")
    out = answers.callers(rel, links, origins.origins(found), "one", [0, 0])
    assert [(r.path, r.pc, r.window_status, len(r.arguments)) for r in out.callers.collect()] == [("one", 4, "fixed", 1), ("two", 2, "fixed", 0)]
    cover = {r.path: r for r in out.coverage.collect()}
    assert (cover["one"].call_sites, cover["one"].caller, cover["one"].unattributed) == (2, 1, 1) and cover["two"].caller == 1
    assert (out.omitted, out.exit) == (0, 0)
    short = answers.callers(rel, links, origins.origins(found), "one", [0, 0], most=1)
    assert (short.callers.count(), short.omitted, short.exit) == (1, 1, answers.EXIT["limit"])
    alone = answers.callers(rel, None, origins.origins(found), "one", [0, 0])
    assert alone.callers.count() == 1
    broken = origins.origins(found).where("path = 'two'")
    with pytest.raises(Exception, match="no argument window"):
        answers.callers(rel, links, broken, "one", [0, 0]).callers.collect()


def test_disassembly_and_explanation(found):
    f = source.facts(source.decoded(found))
    lifted = lift.lift(words.decode(f.words))
    text = {(r.path, r.pc): r.text for r in answers.disassembly(lifted, f.constants, ["path"]).where("proto = array(0)").collect()}
    assert text[("one", 2)] == 'GETGLOBAL R0 K0="run"' and text[("two", 3)] == 'ADD R0 K0="m" K1="run"' and text[("one", 0)] == "CLOSURE R0 P0"
    assert [r.mnemonic for r in answers.explain(lifted, "proto:0/pc:1").where("path = 'two'").collect()] == ["GETTABLE"]
    with pytest.raises(ValueError):
        answers.explain(lifted, "proto:0/constant:1")


def test_outcomes_and_exit_classes(spark):
    found = spark.createDataFrame([("a", "ok", None), ("b", "ok", "PARSE-SOURCE-001"), ("c", "limit", None), ("d", "ok", None)], "path string, status string, skip string")
    diags = spark.createDataFrame([("d", "CORE-TRUNC-001")], "path string, code string")
    counts = spark.createDataFrame([("a", 3), ("a", 4)], "path string, n_instr long")
    out = answers.outcomes(found, diags, counts)
    assert {r.path: (r.outcome, r.instruction_count) for r in out.collect()} == {"a": ("succeeded", 7), "b": ("skipped", 0), "c": ("failed", 0), "d": ("failed", 0)}
    assert answers.exit_of(out) == 0 and answers.exit_of(out, strict=True) == 1 and answers.exit_of(out.where("path = 'b'")) == 1
    codes = spark.createDataFrame([("CORE-LIMIT-001",), ("PARSE-SOURCE-001",), ("L51-OP-001",)], "code string")
    assert [r[0] for r in codes.select(answers.exit_class(F.col("code"))).collect()] == [5, 4, 1]


def test_export_selection_order_and_verification(spark, tmp_path):
    for bad in ("", "instruction,instruction", "nothing", "instruction,"):
        with pytest.raises(export.ExportError):
            export.selected(bad)
    assert export.selected("constant,prototype") == ("prototype", "constant")
    assert export.available("callee", "lua5.1") and not export.available("callee", "lua5.4") and not export.available("instruction", "lua5.2")
    facts = {"prototype": spark.createDataFrame([(1, 7), (2, 8)], "artifact int, id int"), "instruction": spark.createDataFrame([(1, n) for n in range(5)], "artifact int, id int")}
    found = export.records(facts, export.selected("instruction,prototype"), ["artifact"], {k: [F.col("id")] for k in facts})
    kept, outcomes = export.capped(found, ["artifact"], 3)
    stream = export.framed(kept, outcomes, ["artifact"])
    types = [r.record_type for r in stream.orderBy(*export.stream_order()).collect()]
    assert types == ["export_start", "file_start", "prototype", "instruction", "instruction", "file_end", "file_start", "prototype", "file_end", "export_end"]
    assert export.verify(stream).count() == 0
    lost = stream.where("not (record_type = 'instruction' and ordinal = 2)")
    assert [r.problem for r in export.verify(lost).collect()] == ["count"]
    export.write(stream, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 10


def test_export_goes_through_the_tree_in_preorder(spark):
    paths = [[0], [0, 0], [0, 0, 0], [0, 1], [0, 10], [0, 2]]
    protos = spark.createDataFrame([(1, p, "p") for p in paths], "artifact int, proto array<int>, name string")
    instructions = spark.createDataFrame([(1, p, n) for p in paths for n in (10, 9)], "artifact int, proto array<int>, pc int")
    edges = spark.createDataFrame([(1, "s", "t")], "artifact int, source string, target string")
    order = {"prototype": [F.col("proto")], "instruction": [F.col("proto"), F.col("pc")], "xref": [F.col("source")]}
    found = export.records({"prototype": protos, "instruction": instructions, "xref": edges}, export.FAMILIES, ["artifact"], order)
    kept, _ = export.capped(found, ["artifact"], 100)
    said = [(r.record_type, r.proto) for r in kept.orderBy("ordinal").collect()]
    want = [x for p in sorted(paths) for x in (("prototype", p), ("instruction", p), ("instruction", p))]
    assert said == [*want, ("xref", None)]

import json

import pytest
from pyspark.sql import functions as F

from bytefacts.operators import callees, origins, relations
from bytefacts.plans import answers, documents, export, stream
from bytefacts.sources import artifacts
from bytefacts.sources.chunks import Chunk, encode

from .test_callees import END, proto, s
from .test_chunks import PROFILES, i51, sample


def frame(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


def test_documents_of_every_dialect(spark):
    found = frame(spark, **{p: encode(sample(p)) for p in PROFILES}, broken=encode(sample("lua5.3"))[:40])
    f = artifacts.facts(artifacts.decoded(found).cache())
    seen = {r.path: json.loads(r.document) for r in documents.documents(f, documents.inspected(f)).collect()}
    assert set(seen) == {*PROFILES, "broken"}
    for p in PROFILES:
        d = seen[p]
        assert d["schema_version"] == 1 and d["input_identity"]["path"] == p and d["interpretation"]["profile"] == p and d["data"]["prototype_count"] == 2
        assert [x["id"] for x in d["data"]["prototypes"]] == ["proto:0", "proto:0/0"] and "diagnostics" not in d
    assert seen["broken"]["diagnostics"][0]["code"] == "CORE-TRUNC-001" and seen["broken"]["data"]["status"] == "failed"
    said = {r.path: json.loads(r.document)["data"] for r in documents.documents(f, documents.validated(f)).collect()}
    assert said["broken"]["verdict"] == "invalid" and all(x["diagnostic_count"] == len(x["diagnostics"]) for x in said.values())


def test_rules_of_all_dialects_are_asked(spark):
    bad = proto([i51("MOVE", 99, 0), i51("JMP", sbx=1), i51("SETLIST", 0, 1, 0), 7, END], stack=5)
    f = artifacts.facts(artifacts.decoded(frame(spark, a=encode(Chunk("lua5.1", bad)))))
    found = {(r.pc, r.code) for r in documents.violations(f).collect()}
    assert {(0, "L51-REG-001"), (1, "L51-JMP-002")} <= found
    data = documents.validated(f).first().data
    assert data.verdict == "invalid" and data.diagnostics[0].target == "proto:0/pc:0"


def callers_of(spark):
    child = proto([END])
    code = [i51("CLOSURE", 0, bx=0), i51("SETGLOBAL", 0, bx=0), i51("GETGLOBAL", 1, bx=0), i51("LOADK", 2, bx=1), i51("CALL", 1, 2, 1), i51("GETGLOBAL", 1, bx=1), i51("CALL", 1, 1, 1), END]
    return frame(spark, a=encode(Chunk("lua5.1", proto(code, [s(b"f"), s(b"g")], [child]))), b=encode(Chunk("lua5.1", proto([END]))))


def test_answers_from_a_stream_are_those_from_facts(spark):
    found = callers_of(spark)
    made = stream.exported(found)
    got, cover = stream.callers(made, "a", [0, 0])
    rel = relations.call_relations(callees.callees(found), callees.global_stores(found), ["path", "sha256"])
    want = answers.callers(rel, None, origins.origins(found), "a", [0, 0])
    assert [(r.path, r.call_id, r.window_status, r.arguments[0].kind) for r in got.collect()] == [(r.path, r.call_id, r.window_status, r.arguments[0].kind) for r in want.callers.collect()] == [("a", "proto:0/pc:4", "fixed", "literal")]
    assert cover.first().asDict() == want.coverage.first().asDict()
    with pytest.raises(stream.StreamError, match="not found"):
        stream.callers(made, "a", [0, 7])


def test_streams_that_do_not_account_for_themselves_are_refused(spark):
    made = stream.exported(callers_of(spark)).cache()
    assert export.verify(made).count() == 0
    for bad, word in ((made.where("record_type != 'export_end'"), "frame"), (made.where("not (record_type = 'callee' and ordinal = 3)"), "count"), (made.withColumn("data", F.regexp_replace("data", '"schema_version":2', '"schema_version":3')), "schema")):
        with pytest.raises(stream.StreamError, match=word):
            stream.coverage(bad)
    with pytest.raises(stream.StreamError, match="capped"):
        stream.coverage(stream.exported(callers_of(spark), cap=3))

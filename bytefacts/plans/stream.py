"""Answers from an export stream alone: its records are verified, read back and asked as facts are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefacts.operators import callees, origins, relations
from bytefacts.plans import export
from bytefacts.session import cut
from bytefacts.sources import artifacts

BY = ["path", "sha256"]
#: What a question about callers needs.
NEEDED = ("prototype", "callee", "origin", "call_relation")
PROTOTYPE = "id string, proto array<int>, numparams int, n_instr int"
CALLEE = "call_id string, proto array<int>, pc int, status string, reason string"
RELATION = "call_id string, relation_status string, basis string, callee array<int>, relation_reason string"
ORIGIN = "call_id string, window_status string, arguments array<struct<argument_index:int,kind:string,expression:string>>"


class StreamError(ValueError):
    """The stream does not account for itself, or lacks what the question needs."""


def exported(found: DataFrame, cap: int = 1 << 40) -> DataFrame:
    """The export stream (part, key, step, ordinal, record_type, data) of artifacts (path, content), with the families of NEEDED."""
    f = artifacts.facts(cut(artifacts.decoded(found)))
    calls = cut(callees.callees(found))
    related = relations.call_relations(calls, callees.global_stores(found), BY)
    facts = {
        "prototype": f.prototypes.select(*BY, "id", "proto", "numparams", "n_instr"),
        "callee": calls.select(*BY, "call_id", "proto", "pc", "status", "reason"),
        "origin": origins.origins(found).select(*BY, "call_id", F.col("proto").alias("at"), "pc", "window_status", "arguments"),
        "call_relation": related.select(*BY, "call_id", F.col("proto").alias("at"), "pc", "relation_status", "basis", "callee", "relation_reason"),
    }
    order = {"prototype": [F.col("proto")], "callee": [F.col("proto"), F.col("pc")], "origin": [F.col("at"), F.col("pc")], "call_relation": [F.col("at"), F.col("pc")]}
    kept, outcomes = export.capped(export.records(facts, NEEDED, BY, order), BY, cap)
    return export.framed(kept, outcomes, BY)


def family(stream: DataFrame, name: str, schema: str) -> DataFrame:
    """The records of one family as rows (path, sha256, and the columns of schema)."""
    rows = stream.where(F.col("record_type") == name).select("key.*", F.from_json("data", schema).alias("d"))
    return rows.select(*BY, "d.*")


def trusted(stream: DataFrame) -> DataFrame:
    """The stream, written once; StreamError if it breaks a rule, or was cut."""
    stream = cut(stream)
    if (wrong := export.verify(stream).limit(5).collect()):
        raise StreamError("; ".join(f"{r.key or 'the stream'}: {r.problem}" for r in wrong))
    cut_off = stream.where((F.col("record_type") == "file_end") & F.get_json_object("data", "$.is_truncated").cast("boolean"))
    if not cut_off.isEmpty():
        raise StreamError("a capped export cannot classify every call site")
    return stream


def _classified(stream: DataFrame, path: str | None, proto: list[int] | None) -> DataFrame:
    calls, related = family(stream, "callee", CALLEE), family(stream, "call_relation", RELATION)
    sites = calls.join(related, [*BY, "call_id"], "left")
    # every call has its relation, or the stream is no answer
    sites = sites.where(F.assert_true(F.col("relation_status").isNotNull(), F.lit("a call without a relation")).isNull())
    here = F.lit(False) if proto is None else F.coalesce((F.col("path") == path) & (F.col("callee") == F.array(*map(F.lit, proto))), F.lit(False))
    sites = sites.withColumns({"names_target": here, "names_other": F.col("callee").isNotNull() & ~here, "callee_status": F.col("status"), "callee_reason": F.col("reason"), "link_status": F.lit(None).cast("string")})
    return relations.classify_sites(sites, convention=False)


def coverage(stream: DataFrame) -> DataFrame:
    """What became of all call sites, file by file."""
    return relations.coverage(_classified(trusted(stream), None, None), "path")


def callers(stream: DataFrame, path: str, proto: list[int]) -> tuple[DataFrame, DataFrame]:
    """(callers with their argument windows, coverage of the file) of one prototype, as answers.callers gives them from facts without a convention."""
    stream = trusted(stream)
    mine = stream.where(F.col("key.path") == path)
    if family(mine, "prototype", PROTOTYPE).where(F.col("proto") == F.array(*map(F.lit, proto))).isEmpty():
        raise StreamError("prototype not found in target")
    sites = _classified(mine, path, proto)
    found = relations.with_windows(sites.where("class in ('caller', 'conflicting')"), family(mine, "origin", ORIGIN), [*BY, "call_id"])
    return found.orderBy("path", "proto", "pc"), relations.coverage(sites, "path")

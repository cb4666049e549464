"""One question to many artifacts, from bytes to framed answers.

The predicate is read before any artifact. Only the analyses that its fields name are run and joined; Catalyst prunes the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.operators import callees, dispatch, identity, origins, relations
from bytefacts.plans import answers, predicate, query
from bytefacts.session import cut
from bytefacts.sources import artifacts

WHO = ("path", "sha256", "profile")
KEYS = (*WHO, "id", "place")
#: The scheme of prototype.digest where the caller names none; digests of another tool need its scheme's name.
DOMAIN = b"prototype-content-2"


@dataclass
class Answer:
    rows: DataFrame  # WHO, id, entity, position
    outcomes: DataFrame  # path, outcome, error, instruction_count, diagnostic_count, emitted, available, is_truncated


def place(proto: str | None, rank: int, index: str | None):
    """Chunk first, then prototype by prototype in preorder: itself, its instructions, its constants."""
    path = F.array().cast("array<int>") if proto is None else F.col(proto)
    return F.struct(path.alias("proto"), F.lit(rank).alias("rank"), (F.lit(0) if index is None else F.col(index).cast("int")).alias("index")).alias("place")


def frames(found: DataFrame, rows: DataFrame, needs: set[str], domain: bytes = DOMAIN) -> dict[str, DataFrame]:
    """Entity frames of artifacts (path, content) and their decoded rows, with the columns that `needs` adds."""
    f = artifacts.facts(rows)
    instruction = dispatch.lifted(f.words, [*WHO, "proto"]).select(*WHO, "id", place("proto", 1, "pc"), "mnemonic", "reads", "writes")
    key = ["path", "sha256", "id"]
    if needs & {"callees", "relations"}:
        calls = callees.callees(found)
        if "relations" in needs:
            calls = relations.call_relations(calls, callees.global_stores(found), ["path", "sha256"]).withColumns({"call_reason": F.col("relation_reason"), "call_target": ids.proto_text(F.col("callee"))})
        else:
            calls = calls.withColumns({"call_reason": F.lit(None).cast("string"), "call_target": F.lit(None).cast("string")})
        told = calls.select("path", "sha256", F.col("call_id").alias("id"), F.col("status").alias("callee_status"), F.array_join("segments", ".").alias("callee_path"), "lookup_kind", "lookup_key", F.col("reason").alias("callee_reason"), "call_reason", "call_target")
        instruction = instruction.join(told, key, "left")
    if "origins" in needs:
        windows = origins.origins(found).select("path", "sha256", F.col("call_id").alias("id"), "window_status", "arguments")
        instruction = instruction.join(windows, key, "left")
    prototype = f.prototypes.select(*WHO, "id", place("proto", 0, None))
    if "identities" in needs:
        prototype = prototype.join(identity.prototypes(f, domain).select(*WHO, "id", "digest"), [*WHO, "id"], "left")
    return {
        "prototype": prototype,
        "chunk": f.chunks.where("status = 'decoded'").select(*WHO, F.lit("chunk").alias("id"), place(None, 0, None)),
        "instruction": instruction,
        "constant": f.constants.select(*WHO, "id", place("proto", 2, "index"), "ctype", "bool_val", "int_val", "dbl_bits", "str_display"),
    }


def ask(found: DataFrame, where: str | None, limit: int = query.PAGE, domain: bytes = DOMAIN) -> Answer:
    """found: artifacts with path, content and status, as from sources.artifacts. Per artifact at most `limit` rows, and what became of it.

    prototype.digest is told in the scheme `domain`. An artifact of a profile that lacks one of the fields fails with INTERNAL-IDENTITY-001; it is not an artifact without matches.
    """
    tree = None if where is None else predicate.parse(where)
    if tree is not None:
        predicate.validate(tree)
    only_51 = tree is not None and any(predicate.field_of(c.field).only_51 for c in predicate.leaves(tree))
    rows = cut(artifacts.decoded(found))  # decoded once, for all that reads it
    fit = F.col("profile").startswith("lua5.1") if only_51 else F.lit(True)
    facts = {k: v.where(fit) for k, v in frames(found, rows, predicate.analyses(tree) if tree is not None else set(), domain).items()}
    matched = query.matches(facts, where).select(*KEYS, "entity")
    kept, counts = query.batch(matched, ["path"], [F.col("place")], limit)
    f = artifacts.facts(rows)
    skip = found.select("path", "status", artifacts.skip_code(F.col("content")).alias("skip"))
    diagnostics = f.diagnostics.select("path", "code")
    if only_51:
        diagnostics = diagnostics.unionByName(f.chunks.where(~fit & F.col("profile").isNotNull()).select("path", F.lit("INTERNAL-IDENTITY-001").alias("code")))
    said = answers.outcomes(skip, diagnostics, f.prototypes.select("path", F.col("n_instr").cast("long").alias("n_instr")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = said.join(counts, "path", "left").select(*said.columns, zero("emitted"), zero("available"), F.coalesce("is_truncated", F.lit(False)).alias("is_truncated"))
    return Answer(kept, out)

"""Machine documents: one JSON object for each artifact, in an envelope that says what was read, how, and by which rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids, words
from bytefacts.operators import validate
from bytefacts.operators.dispatch import DIALECTS
from bytefacts.sources import chunks
from bytefacts.sources.artifacts import Facts

SCHEMA_VERSION, TOOL_VERSION = 1, "1.0"
#: Limits of the decoder, as they are told in documents.
LIMITS = {"max_input_bytes": chunks.MOST_BYTES, "max_nesting_depth": chunks.MOST_NESTING, "max_total_prototypes": chunks.MOST_PROTOTYPES, "max_instructions": chunks.MOST_WORDS, "max_total_instructions": chunks.MOST_WORDS_IN_ALL, "max_constants": chunks.MOST_CONSTANTS, "max_upvalues": chunks.MOST_UPVALUES, "max_string_bytes": chunks.MOST_STRING}
WHO = ["path", "sha256", "profile"]


def identity() -> Column:
    return F.struct("path", "sha256", "byte_length").alias("input_identity")


def interpretation() -> Column:
    """What the bytes were taken for; null where that is not known."""
    base = F.regexp_extract("profile", r"^lua5\.\d", 0)
    return F.when(F.col("profile").isNotNull(), F.struct(base.alias("base_dialect"), "profile", F.lit("strict").alias("parse_mode"))).alias("interpretation")


def configuration(override: str | None = None) -> Column:
    limits = F.struct(*(F.lit(v).alias(k) for k, v in LIMITS.items())).alias("limits")
    return F.struct(F.lit("strict").alias("mode"), limits, F.lit(override).cast("string").alias("dialect_override")).alias("analysis_configuration")


def documents(f: Facts, data: DataFrame, override: str | None = None) -> DataFrame:
    """(path, sha256, document): data (path, sha256, data: struct) of each artifact in its envelope, with its diagnostics if there are any."""
    told = f.diagnostics.groupBy("path", "sha256").agg(F.array_sort(F.collect_list(F.struct("code", "severity", "target", "pc", "message"))).alias("diagnostics"))
    rows = f.chunks.join(data, ["path", "sha256"], "left").join(told, ["path", "sha256"], "left")
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(TOOL_VERSION).alias("tool_version"), identity(), interpretation(), configuration(override), "data", "diagnostics")
    return rows.select("path", "sha256", F.to_json(body).alias("document"))


def inspected(f: Facts) -> DataFrame:
    """(path, sha256, data): header, trailing bytes and prototypes of each artifact, parents before children."""
    proto = F.struct("proto", "id", F.base64("source_name").alias("source_name"), "line_defined", "last_line_defined", "numparams", "is_vararg", "maxstacksize", "n_instr", "n_const", "n_upval", "n_protos")
    trees = f.prototypes.groupBy("path", "sha256").agg(F.array_sort(F.collect_list(proto)).alias("prototypes"), F.sum("n_instr").alias("instruction_count"), F.count("*").alias("prototype_count"))
    return f.chunks.join(trees, ["path", "sha256"], "left").select("path", "sha256", F.struct("status", "header_hex", "trailing_hex", "prototype_count", "instruction_count", "prototypes").alias("data"))


def limits_of(f: Facts) -> DataFrame:
    """Words of all dialects with what rules look at: their prototype's numbers, and for 5.1 whether a target is a companion."""
    numbers = f.prototypes.select(*WHO, "proto", "maxstacksize", "n_const", "n_upval", "n_protos", F.col("n_instr").alias("n"))
    return f.words.join(numbers, [*WHO, "proto"])


def violations(f: Facts) -> DataFrame:
    """(path, sha256, profile, proto, pc, code, severity) of every word that breaks a rule of its dialect."""
    by, rows, out = [*WHO, "proto"], limits_of(f), None
    companions = f.words.where("role != 'instruction'").select(*by, F.col("pc").alias("to"), F.col("role").alias("target_role"))
    for dialect in dict.fromkeys(DIALECTS.values()):
        mine = words.decode(rows.where(F.col("profile").isin(*(p for p, d in DIALECTS.items() if d == dialect))), dialect)
        if dialect == "5.1":
            to = F.when(F.col("mnemonic").isin(*words.WITH_SBX), F.col("pc") + 1 + F.col("sbx")).otherwise(F.col("pc") + 2)
            mine, rules = mine.withColumn("to", to.cast("int")).join(companions, [*by, "to"], "left"), validate.rules_51()
        elif dialect == "5.4":
            rules = validate.rules_54()
        else:
            mine, rules = validate.neighbours(mine, by), validate.rules_55() if dialect == "5.5" else validate.rules_52(dialect)
        found = validate.violations(mine, rules, by)
        out = found if out is None else out.unionByName(found)
    return out


def validated(f: Facts) -> DataFrame:
    """(path, sha256, data): verdict and diagnostics of each artifact, bounded."""
    found = violations(f).select("path", "sha256", "code", "severity", ids.text(F.col("proto"), "pc", F.col("pc")).alias("target"), F.col("proto").alias("at"), "pc")
    read = f.diagnostics.select("path", "sha256", "code", "severity", "target", F.lit(None).cast("array<int>").alias("at"), "pc")
    every = validate.truncated(read.unionByName(found), ["path", "sha256"], ["at", "pc"])
    verdicts = validate.verdict(every, f.chunks, ["path", "sha256"])
    told = every.groupBy("path", "sha256").agg(F.array_sort(F.collect_list(F.struct("position", "code", "severity", "target"))).alias("found"))
    rows = verdicts.join(told, ["path", "sha256"], "left").withColumn("found", F.coalesce("found", F.array()))
    return rows.select("path", "sha256", F.struct("verdict", F.size("found").alias("diagnostic_count"), F.transform("found", lambda d: F.struct(d["code"].alias("code"), d["severity"].alias("severity"), d["target"].alias("target"))).alias("diagnostics")).alias("data"))

"""Answers built from fact frames: disassembly, explanations, callers of a prototype, file outcomes and exit classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.functions.words import RK_BIT
from bytefacts.operators import relations

# Fixed exit classes.
EXIT = {"success": 0, "invalid": 1, "usage": 2, "io": 3, "unsupported": 4, "limit": 5, "internal": 6}
CALLERS_DEFAULT = 10_000
#: What the profiles can do.
CAPABILITIES = {p: {"structure": True, "validate": True, "analysis": p.startswith("lua5.1") or p == "lua5.4", "callees": p.startswith("lua5.1"), "origins": p.startswith("lua5.1"), "identity": p.startswith("lua5.1"), "reencode": True} for p in ("lua5.1", "lua5.1-stock32", "lua5.1-lnum32", "lua5.2", "lua5.3", "lua5.4", "lua5.5")}


def exit_class(code: Column) -> Column:
    """The exit class of a diagnostic code."""
    name = F.when(code.startswith("CORE-LIMIT") | code.startswith("ANA-LIMIT"), "limit").when(code.isin("PARSE-SOURCE-001", "PARSE-UNKNOWN-001", "ANA-PRECOND-001"), "unsupported").when(code.startswith("IO-"), "io").when(code.startswith("INTERNAL"), "internal").otherwise("invalid")
    return F.element_at(F.create_map(*(F.lit(x) for kv in EXIT.items() for x in kv)), name)


def disassembly(lifted: DataFrame, constants: DataFrame, by: list[str]) -> DataFrame:
    """lifted 5.1 words with an operand list as text, constants resolved: `GETGLOBAL R1 K4="print"`.

    Constants are joined once for each of the two operands that may name one.
    """
    shown = F.coalesce(F.concat(F.lit('"'), "str_display", F.lit('"')), F.col("int_val").cast("string"), F.col("dbl_val").cast("string"), F.col("bool_val").cast("string"), F.lit("nil"))
    k = constants.select(*by, "proto", F.col("index").alias("__i"), shown.alias("__text"))
    m = F.col("mnemonic")
    bx = m.isin("LOADK", "GETGLOBAL", "SETGLOBAL")
    b_rk, c_rk = m.isin("SETTABLE", "ADD", "SUB", "MUL", "DIV", "MOD", "POW", "EQ", "LT", "LE"), m.isin("GETTABLE", "SETTABLE", "SELF", "ADD", "SUB", "MUL", "DIV", "MOD", "POW", "EQ", "LT", "LE")
    first = F.when(bx, F.col("bx")).when(b_rk & (F.col("b") >= RK_BIT), F.col("b") - RK_BIT).cast("int")
    second = F.when(c_rk & (F.col("c") >= RK_BIT), F.col("c") - RK_BIT).cast("int")
    out = lifted.withColumn("__k1", first).withColumn("__k2", second)
    for n in ("1", "2"):
        side = k.withColumnRenamed("__i", f"__k{n}").withColumnRenamed("__text", f"__t{n}")
        out = out.join(side, [*by, "proto", f"__k{n}"], "left")
    constant = lambda n: F.concat(F.lit("K"), F.col(f"__k{n}").cast("string"), F.lit("="), F.coalesce(f"__t{n}", F.lit("?")))
    plain = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    b = F.when(F.col("__k1").isNotNull() & ~bx, constant("1")).when(m.isin("GETUPVAL", "SETUPVAL"), plain("b", "U")).otherwise(plain("b", "R"))
    c = F.when(F.col("__k2").isNotNull(), constant("2")).otherwise(plain("c", "R"))
    tail = F.when(bx, constant("1")).when(F.col("mode") == "iasbx", F.concat(F.lit("to pc "), (F.col("pc") + 1 + F.col("sbx")).cast("string"))).when(m == "CLOSURE", plain("bx", "P")).otherwise(F.concat_ws(" ", b, c))
    text = F.concat_ws(" ", F.coalesce(m, F.lit("?")), F.when(m != "JMP", plain("a", "R")), tail)
    return out.withColumn("text", text).drop("__k1", "__k2", "__t1", "__t2")


def explain(lifted: DataFrame, wanted: str) -> DataFrame:
    """The one instruction with this id; other kinds of ids are refused."""
    if "/pc:" not in wanted:
        raise ValueError(f"{wanted!r} is no instruction")
    return lifted.where(ids.text(F.col("proto"), "pc", F.col("pc")) == wanted)


@dataclass
class Callers:
    callers: DataFrame
    coverage: DataFrame
    omitted: int
    exit: int


def callers(relations_: DataFrame, links: DataFrame | None, windows: DataFrame, target_path: str, target: list[int], most: int = CALLERS_DEFAULT) -> Callers:
    """Every call of one prototype, with its argument window, and what became of all other call sites, file by file.

    relations_: path, sha256, call_id, pc, status, reason, relation_status, relation_reason, callee. links: path, call_id, link_status, link_target,
    link_proto, or None without a convention. windows: path, sha256, call_id, window_status, arguments.
    """
    proto = F.array(*map(F.lit, target))
    sites = relations_
    if links is not None:
        sites = sites.join(links.select("path", "call_id", "link_status", "link_target", "link_proto"), ["path", "call_id"], "left")
    else:
        sites = sites.withColumns({"link_status": F.lit(None).cast("string"), "link_target": F.lit(None).cast("string"), "link_proto": F.lit(None).cast("array<int>")})
    here = (F.col("path") == target_path) & (F.col("callee") == proto)
    linked = (F.col("link_target") == target_path) & (F.col("link_proto") == proto)
    names_target = F.coalesce(here, F.lit(False)) | F.coalesce(linked, F.lit(False))
    other = (F.col("callee").isNotNull() & ~F.coalesce(here, F.lit(False))) | (F.col("link_target").isNotNull() & ~F.coalesce(linked, F.lit(False)))
    sites = sites.withColumns({"names_target": names_target, "names_other": other, "callee_status": F.col("status"), "callee_reason": F.col("reason")})
    classed = relations.classify_sites(sites, convention=links is not None)
    cover = relations.coverage(classed, "path")
    # origins are only looked up for sites that do call the target
    found = relations.with_windows(classed.where("class in ('caller', 'conflicting')"), windows.select("path", "sha256", "call_id", "window_status", "arguments"), ["path", "sha256", "call_id"])
    total = classed.where("class in ('caller', 'conflicting')").count()
    page = found.orderBy("path", ids.sort_key(F.col("proto"), "pc", F.col("pc"))).limit(most)
    return Callers(page, cover, max(0, total - most), EXIT["limit"] if total > most else EXIT["success"])


def outcomes(found: DataFrame, diagnostics: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, status, error, instruction_count, diagnostic_count): succeeded, skipped (no chunk) or failed, for every artifact that was asked for.

    found: path, status, skip (a code or null). diagnostics: path, code. counts: path, n_instr.
    """
    d = diagnostics.groupBy("path").agg(F.count("*").alias("diagnostic_count"), F.min("code").alias("error"))
    n = counts.groupBy("path").agg(F.sum("n_instr").alias("instruction_count"))
    rows = found.join(d, "path", "left").join(n, "path", "left")
    status = F.when(F.col("status") != "ok", "failed").when(F.col("skip").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("path", status.alias("outcome"), F.coalesce("skip", "error").alias("error"), zero("instruction_count"), zero("diagnostic_count"))


def exit_of(outcomes_: DataFrame, strict: bool = False) -> int:
    """0 if any artifact succeeded, 1 if none did, or with `strict` if any failed."""
    r = outcomes_.agg(F.sum((F.col("outcome") == "succeeded").cast("int")).alias("good"), F.sum((F.col("outcome") == "failed").cast("int")).alias("bad")).first()
    return EXIT["invalid"] if not r.good or (strict and r.bad) else EXIT["success"]

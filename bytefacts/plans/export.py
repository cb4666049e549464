"""Framed export: facts of chosen families as JSON records in one order, a cap for each artifact, and totals that account for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed names and order of the families.
FAMILIES = ("prototype", "prototype_identity", "instruction", "constant", "upvalue", "xref", "callee", "origin", "call_relation")
ONLY_51 = ("prototype_identity", "callee", "origin", "call_relation")
PHASES = {f: i for i, f in enumerate(FAMILIES)}
#: Families that are emitted prototype by prototype, parents before children; the others follow, family by family.
TREE = ("prototype", "prototype_identity", "instruction", "constant", "upvalue")
PLACE = ("part_of_tree", "proto", "phase", "position")


SCHEMA_VERSION = 2


class ExportError(ValueError):
    pass


def selected(said: str | None) -> tuple[str, ...]:
    """Families named in a comma-separated list; all for None. Each once, known, at least one."""
    if said is None:
        return FAMILIES
    names = said.split(",")
    if not all(names) or len(set(names)) != len(names) or not set(names) <= set(FAMILIES):
        raise ExportError(f"families are {', '.join(FAMILIES)}, each at most once")
    return tuple(f for f in FAMILIES if f in names)


def available(family: str, profile: str) -> bool:
    """Structure-only dialects have no analyses; some families are known for 5.1 alone."""
    if profile.startswith("lua5.1"):
        return True
    if profile == "lua5.4":
        return family not in ONLY_51
    return family in ("prototype", "constant", "upvalue")


def records(facts: dict[str, DataFrame], families: tuple[str, ...], artifact: list[str], order: dict[str, list[Column]]) -> DataFrame:
    """(artifact, PLACE, record_type, data): every fact as canonical JSON. PLACE orders an artifact's records; paths sort in preorder, number by number."""
    out = None
    for f in families:
        if f in facts:
            frame = facts[f]
            at = Window.partitionBy(*artifact).orderBy(*order[f])
            data = F.to_json(F.struct(*sorted(c for c in frame.columns if c not in artifact)), {"ignoreNullFields": "false"})
            path = F.col("proto").cast("array<int>") if f in TREE and "proto" in frame.columns else F.lit(None).cast("array<int>")
            rows = frame.select(*artifact, F.lit(0 if f in TREE else 1).alias("part_of_tree"), path.alias("proto"), F.lit(PHASES[f]).alias("phase"), F.lit(f).alias("record_type"), data.alias("data"), F.row_number().over(at).alias("position"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ExportError("no family to export")
    return out


def capped(found: DataFrame, artifact: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(records within the cap, one outcome for each artifact): available and emitted counts, is_truncated."""
    at = Window.partitionBy(*artifact).orderBy(*PLACE)
    kept = found.withColumn("ordinal", F.row_number().over(at)).where(F.col("ordinal") <= cap)
    counts = found.groupBy(*artifact).agg(F.count("*").alias("available_fact_count"))
    return kept, counts.select(*artifact, "available_fact_count", F.least("available_fact_count", F.lit(cap)).alias("emitted_fact_count"), (F.col("available_fact_count") > cap).alias("is_truncated"))


def framed(kept: DataFrame, outcomes: DataFrame, artifact: list[str]) -> DataFrame:
    """All records in stream order: export_start, then per artifact file_start, facts and file_end, then export_end with totals."""
    spark = kept.sparkSession
    key = F.struct(*artifact)
    start = spark.createDataFrame([("export_start", f'{{"schema_version":{SCHEMA_VERSION}}}')], "record_type string, data string").withColumns({"part": F.lit(0), "key": F.lit(None).cast(outcomes.select(key).schema[0].dataType), "step": F.lit(0), "ordinal": F.lit(0)})
    body = kept.select("record_type", "data", F.lit(1).alias("part"), key.alias("key"), F.lit(1).alias("step"), "ordinal")
    opens = outcomes.select(F.lit("file_start").alias("record_type"), F.to_json(key).alias("data"), F.lit(1).alias("part"), key.alias("key"), F.lit(0).alias("step"), F.lit(0).alias("ordinal"))
    rest = [c for c in outcomes.columns if c not in artifact]
    closes = outcomes.select(F.lit("file_end").alias("record_type"), F.to_json(F.struct(*rest)).alias("data"), F.lit(1).alias("part"), key.alias("key"), F.lit(2).alias("step"), F.lit(0).alias("ordinal"))
    totals = outcomes.agg(F.count("*").alias("files"), F.sum("available_fact_count").alias("available_fact_count"), F.sum("emitted_fact_count").alias("emitted_fact_count"), F.sum(F.col("is_truncated").cast("int")).alias("truncated_files"))
    end = totals.select(F.lit("export_end").alias("record_type"), F.to_json(F.struct("*")).alias("data"), F.lit(2).alias("part"), F.lit(None).cast(outcomes.select(key).schema[0].dataType).alias("key"), F.lit(0).alias("step"), F.lit(0).alias("ordinal"))
    columns = ["part", "key", "step", "ordinal", "record_type", "data"]
    out = start.select(columns)
    for f in (opens, body, closes, end):
        out = out.unionByName(f.select(columns))
    return out


def stream_order() -> list[str]:
    return ["part", "key", "step", "ordinal"]


def write(stream: DataFrame, path: str) -> None:
    """Range-sorted text files whose names, in order, give the stream."""
    line = F.to_json(F.struct("record_type", F.parse_json("data").alias("data")))
    stream.orderBy(*stream_order()).select(line.alias("value")).write.text(path)


def verify(stream: DataFrame, artifact_field: str = "key") -> DataFrame:
    """(key, problem): framing, counts and limits that do not hold. No row: the stream accounts for all it has.

    Of an artifact: start and end (exactly one), record_type (of a known family), limit (an emitted count above the available, or
    is_truncated that disagrees with them), count (facts other than the end says). Of the stream, with a null key: frame (one export_start and one
    export_end), schema (the start's version), totals (those of the end are sums over artifacts).
    """
    kind, said = F.col("record_type"), lambda name: F.get_json_object("data", f"$.{name}")
    ends = lambda c: F.max(F.when(kind == "file_end", c))
    per = stream.where("part = 1").groupBy(artifact_field).agg(
        F.sum((kind == "file_start").cast("int")).alias("starts"),
        F.sum((kind == "file_end").cast("int")).alias("ends"),
        F.sum((F.col("step") == 1).cast("int")).alias("facts"),
        F.sum(((F.col("step") == 1) & ~kind.isin(*FAMILIES)).cast("int")).alias("strange"),
        ends(said("emitted_fact_count").cast("long")).alias("said"),
        ends(said("available_fact_count").cast("long")).alias("had"),
        ends(said("is_truncated").cast("boolean")).alias("cut"),
    )
    limit = (F.col("said") > F.col("had")) | (F.col("cut") != (F.col("said") < F.col("had")))
    bad = F.when(F.col("starts") != 1, "start").when(F.col("ends") != 1, "end").when(F.col("strange") > 0, "record_type").when(F.coalesce(limit, F.lit(True)), "limit").when(~F.col("facts").eqNullSafe(F.col("said")), "count")
    artifacts = per.select(F.to_json(artifact_field).alias("key"), bad.alias("problem"))
    sums = per.agg(F.count("*").alias("files"), F.coalesce(F.sum("said"), F.lit(0)).alias("emitted"), F.coalesce(F.sum("had"), F.lit(0)).alias("available"))
    frame = stream.where("part != 1").agg(
        F.sum((kind == "export_start").cast("int")).alias("starts"),
        F.sum((kind == "export_end").cast("int")).alias("ends"),
        F.max(F.when(kind == "export_start", said("schema_version").cast("int"))).alias("version"),
        *(F.max(F.when(kind == "export_end", F.coalesce(said(name).cast("long"), F.lit(0)))).alias(f"all_{name}") for name in ("files", "emitted_fact_count", "available_fact_count")),
    )
    totals = (F.col("all_files") == F.col("files")) & (F.col("all_emitted_fact_count") == F.col("emitted")) & (F.col("all_available_fact_count") == F.col("available"))
    broken = F.when((F.coalesce("starts", F.lit(0)) != 1) | (F.coalesce("ends", F.lit(0)) != 1), "frame").when(~F.col("version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema").when(~F.coalesce(totals, F.lit(False)), "totals")
    whole = frame.crossJoin(F.broadcast(sums)).select(F.lit(None).cast("string").alias("key"), broken.alias("problem"))  # one row each
    return artifacts.unionByName(whole).where("problem is not null")

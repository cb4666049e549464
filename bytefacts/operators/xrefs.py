"""The cross-reference index: an edge table (source, target, relation) with sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids


def effect_edges(lifted: DataFrame, by: list[str]) -> DataFrame:
    """reads and writes of constants and upvalues, jumps, closures; register effects make no edge. Needs `proto`, `pc` and lift()'s columns.

    All edges of a word come from one array, so the words are scanned and lifted once.
    """
    kinds = "struct<kind:string,index:int,relation:string>"
    edge = lambda kind, index, relation: F.struct(kind.alias("kind"), index.cast("int").alias("index"), F.lit(relation).alias("relation"))
    named = lambda side: F.transform(F.filter(side, lambda e: e["kind"].isin("constant", "upvalue")), lambda e: edge(e["kind"], e["first"], side))
    none = F.array().cast(f"array<{kinds}>")
    jump = F.when(F.col("jump_target").isNotNull(), F.array(edge(F.lit("pc"), F.col("jump_target"), "jumps-to"))).otherwise(none)
    closure = F.when(F.col("mnemonic") == "CLOSURE", F.array(edge(F.lit("proto"), F.col("bx"), "instantiates"))).otherwise(none)
    rows = lifted.select(*by, "proto", "pc", F.explode(F.concat(named("reads"), named("writes"), jump, closure)).alias("e"))
    child = F.concat(F.col("proto"), F.array(F.col("e.index")))
    index, kind = F.col("e.index"), F.col("e.kind")
    is_proto = kind == "proto"
    target = F.when(is_proto, ids.proto_text(child)).otherwise(F.concat(ids.proto_text(F.col("proto")), F.lit("/"), kind, F.lit(":"), index.cast("string")))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ids.RANKS.items() for x in kv)), kind)
    target_sk = F.when(is_proto, ids.sort_key(child, "proto", 0)).otherwise(ids.sort_key(F.col("proto"), rank, index))
    out = rows.select(*by, ids.text(F.col("proto"), "pc", F.col("pc")).alias("source"), target.alias("target"), F.col("e.relation").alias("relation"), ids.sort_key(F.col("proto"), "pc", F.col("pc")).alias("source_sk"), target_sk.alias("target_sk"))
    return out.dropDuplicates([*by, "source", "target", "relation"])


def order() -> list[Column]:
    return [F.col("source_sk"), F.col("target_sk"), F.col("relation")]


def to(edges: DataFrame, *targets: str) -> DataFrame:
    """Edges that lead to one of these ids."""
    return edges.where(F.col("target").isin(*targets))


def from_(edges: DataFrame, *sources: str) -> DataFrame:
    """Edges that come from one of these ids."""
    return edges.where(F.col("source").isin(*sources))


def exists(facts: DataFrame, id_column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Which wanted ids exist: (wanted_column, found)."""
    known = facts.select(F.col(id_column).alias(wanted_column)).distinct().withColumn("found", F.lit(True))
    return wanted.select(wanted_column).distinct().join(known, wanted_column, "left").select(wanted_column, F.coalesce("found", F.lit(False)).alias("found"))

"""Queries over fact frames: a union of entities in their order, pages with cursors, and batches with a limit for each artifact."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.plans import predicate

PAGE = 100
ENTITIES = ("chunk", "prototype", "instruction", "constant")


def matches(facts: dict[str, DataFrame], where: str | None, profile: str = "lua5.1") -> DataFrame:
    """Rows (common columns, entity) of every entity frame that match. Without a predicate: instructions only.

    The frames need the same key columns; others are dropped from the union. A predicate that can match an entity whose frame is
    not there is a QueryError, not an answer without rows.
    """
    if where is None:
        parts = [(e, facts[e]) for e in facts if e == "instruction"]
    else:
        tree = predicate.parse(where)
        predicate.validate(tree, profile)
        wanted = {e: c for e in ENTITIES if (c := predicate.compiled(tree, e)) is not None}
        if absent := wanted.keys() - facts.keys():
            raise predicate.QueryError(f"no facts about: {', '.join(sorted(absent))}")
        parts = [(e, facts[e].where(c)) for e, c in wanted.items()]
    keys = [c for c in next(iter(facts.values())).columns if all(c in f.columns for f in facts.values())]
    frames = [f.select(*keys, F.lit(e).alias("entity")) for e, f in parts]
    if not frames:
        return next(iter(facts.values())).select(*keys, F.lit("").alias("entity")).where(F.lit(False))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def signature(sha256: str, where: str | None, offset: int) -> str:
    """First 8 hex digits of SHA-256 over the artifact's digest, the predicate and the offset."""
    return hashlib.sha256(sha256.encode() + (where or "").encode() + offset.to_bytes(8, "little")).hexdigest()[:8]


def cursor(sha256: str, where: str | None, offset: int) -> str:
    return f"cur_{signature(sha256, where, offset)}_{offset}"


def offset_of(said: str | None, sha256: str, where: str | None, total: int) -> int:
    """The offset that a cursor stands for; QueryError if it was made for another question or lies beyond the end."""
    if said is None:
        return 0
    parts = said.split("_")
    if len(parts) != 3 or parts[0] != "cur" or not parts[2].isdigit():
        raise predicate.QueryError("no cursor")
    offset = int(parts[2])
    if parts[1] != signature(sha256, where, offset) or offset > total:
        raise predicate.QueryError("this cursor belongs to another query")
    return offset


@dataclass
class Page:
    rows: DataFrame
    total: int
    next_cursor: str | None


def page(found: DataFrame, order: list[Column], sha256: str, where: str | None, limit: int = PAGE, at: str | None = None) -> Page:
    """One page in a total order. Catalyst turns it into a top-k of offset + limit rows, not a sort of all."""
    total = found.count()
    offset = offset_of(at, sha256, where, total)
    more = offset + limit < total
    return Page(found.orderBy(*order).offset(offset).limit(limit), total, cursor(sha256, where, offset + limit) if more else None)


def batch(found: DataFrame, artifact: list[str], order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): at most `limit` rows of each artifact, and per artifact emitted, available and whether it was cut."""
    at = Window.partitionBy(*artifact).orderBy(*order)
    rows = found.withColumn("position", F.row_number().over(at)).where(F.col("position") <= limit)
    counts = found.groupBy(*artifact).agg(F.count("*").alias("available"))
    return rows, counts.select(*artifact, F.least("available", F.lit(limit)).alias("emitted"), "available", (F.col("available") > limit).alias("is_truncated"))

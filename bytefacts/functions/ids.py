"""Stable identifiers: text for display, and a key that sorts as they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.session import cut

#: Kinds in the order in which their ids sort.
RANKS = {"chunk": 0, "proto": 1, "pc": 2, "block": 3, "constant": 4, "upvalue": 5, "local": 6, "diagnostic": 7}


def proto_text(path: Column) -> Column:
    """proto:0/1/2 for the path [0, 1, 2]."""
    return F.concat(F.lit("proto:"), F.array_join(path.cast("array<string>"), "/"))


def text(path: Column, kind: str, index: Column) -> Column:
    """An element of a prototype, such as proto:0/1/pc:10."""
    return F.concat(proto_text(path), F.lit(f"/{kind}:"), index.cast("string"))


def sort_key(path: Column, kind: str | Column, index: Column | int) -> Column:
    """struct(rank, path, index): kinds first, then paths number by number (a prefix before what it begins), then numbers."""
    rank = F.lit(RANKS[kind]) if isinstance(kind, str) else kind
    return F.struct(rank.alias("rank"), path.alias("path"), (F.lit(index) if isinstance(index, int) else index).cast("int").alias("idx"))


def placed(df: DataFrame, key: Column, name: str = "place") -> DataFrame:
    """df with each row's place from 1 in the order of key: a range sort, and the rows of earlier ranges added. No task holds more than a range."""
    rows = cut(df.repartitionByRange(key).sortWithinPartitions(key).withColumn(name, F.monotonically_increasing_id()))
    part, within = F.shiftrightunsigned(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # a row for each range
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, within + 1 + F.col("__before")).drop("__part", "__before")

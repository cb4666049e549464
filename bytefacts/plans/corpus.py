"""A corpus of artifacts linked as a whole: one index of exports, every call resolved against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefacts.operators import callees, modules, relations
from bytefacts.session import cut
from bytefacts.sources import artifacts

BY = ["path", "sha256"]
#: Bytes of all artifacts that callers of one function are looked for in at once.
CORPUS_BYTES = 512 << 20


class CorpusLimit(RuntimeError):
    """More bytes than one answer may rest on."""


@dataclass
class Linked:
    links: DataFrame  # as of relations.link_facts, with those of other dialects
    calls: DataFrame  # as of callees.callees
    exports: DataFrame
    state: DataFrame  # one row: incomplete, refused, over


def distinct(found: DataFrame) -> DataFrame:
    """Artifacts (path, content, status) once for each path and content."""
    return found.withColumn("__digest", F.sha2("content", 256)).dropDuplicates(["path", "__digest"]).drop("__digest")


def bounded(found: DataFrame, most: int = CORPUS_BYTES) -> DataFrame:
    """found, or CorpusLimit where its contents are more than `most` bytes together."""
    total = distinct(found).agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if total > most:
        raise CorpusLimit(f"{total} bytes; {most} may be read for one answer")
    return found


def linked(found: DataFrame, convention: str = "strict", most_links: int = relations.MOST_LINKS, most_exports: int = modules.MOST_EXPORTS) -> Linked:
    """found: artifacts (path, content). Each is decoded once for its calls and once for its exports; an artifact that can't be read makes the index incomplete."""
    once = distinct(found)
    rows = cut(modules.module_rows(once, convention))
    exports, marks, state = modules.export_index(rows, most_exports)
    calls = cut(callees.callees(once))
    links = relations.link_facts(calls, exports, marks, state, BY, most=most_links)
    kinds = once.where("content is not null").select("path", F.sha2("content", 256).alias("sha256"), artifacts.profile(F.col("content")).alias("profile"))
    return Linked(links.unionByName(relations.unsupported_links(kinds.where("profile is not null"), BY)), calls, exports, state)

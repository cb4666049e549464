"""Call relations, cross-artifact links, and the attribution of every call site to exactly one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefacts.session import cut

LINKS = ("resolved", "absent", "duplicate", "dynamic", "unsupported", "limit_exceeded")


def call_relations(callees: DataFrame, stores: DataFrame, by: list[str]) -> DataFrame:
    """callees with relation_status, basis and relation_reason; a basis of their own becomes callee_basis.

    callees: by, call_id, status, prototype, segments, lookup_global, reason. stores: by, name, value_kind (closure, non-closure, unknown),
    prototype. A name resolves if it has exactly one store and that stores a closure.
    """
    per_name = stores.groupBy(*by, "name").agg(F.count("*").alias("stores"), F.first("value_kind").alias("value_kind"), F.first("prototype").alias("stored"))
    joined = callees.join(per_name.withColumnRenamed("name", "lookup_global"), [*by, "lookup_global"], "left")
    n = F.coalesce("stores", F.lit(0))
    single = (F.col("status") == "resolved-path") & (F.size("segments") == 1) & F.col("lookup_global").isNotNull()
    resolved = (F.col("status") == "resolved-prototype") | (single & (n == 1) & (F.col("value_kind") == "closure"))
    reason = (
        F.when(F.col("status") == "lookup-label", "lookup-label-only")
        .when(resolved, None)
        .when(single & (n == 0), "missing-prototype-store")
        .when(single & (n > 1), "multiple-prototype-stores")
        .when(single & (F.col("value_kind") == "non-closure"), "non-closure-store")
        .when(single, "ambiguous-store-value")
        .when(F.col("status") == "resolved-path", "symbolic-path-only")
        .otherwise(F.col("reason"))
    )
    basis = F.when(F.col("status") == "resolved-prototype", "closure-value").when(resolved, "unique-global-store")
    target = F.when(F.col("status") == "resolved-prototype", F.col("prototype")).when(resolved, F.col("stored"))
    kept = [F.col(c).alias("callee_basis") if c == "basis" else F.col(c) for c in callees.columns]
    return joined.select(*kept, F.when(resolved, "resolved").otherwise("unresolved").alias("relation_status"), basis.alias("basis"), target.alias("callee"), reason.alias("relation_reason"))


def last_stores(stores: DataFrame, by: list[str], name: str = "name", order: str = "pc") -> DataFrame:
    """The last root store of each name: a partial aggregate, whatever the number of stores."""
    rest = [c for c in stores.columns if c not in (*by, name)]
    return stores.groupBy(*by, name).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*by, name, "last.*")


def canonical(artifacts: DataFrame) -> DataFrame:
    """Artifacts without exact repeats of (path, sha256, byte_length), in the order in which indexes are built."""
    return artifacts.dropDuplicates(["path", "sha256", "byte_length"]).orderBy("path", "sha256", "byte_length")


def resolve_links(calls: DataFrame, exports: DataFrame, dynamic: DataFrame, incomplete: bool | Column = False) -> DataFrame:
    """calls (with `segments`) with status and target.

    exports: segments, target. dynamic: segments, a marked prefix. A marked prefix makes a link dynamic; one export resolves it, more are
    a duplicate, none is absent. If the index is incomplete, resolved and absent become dynamic. No label is gathered: exports are counted and
    joined on their label; prefixes are at most as many as a label has segments.
    """
    found = exports.groupBy("segments").agg(F.count("*").alias("exports"), F.min("target").alias("target"))
    marked = dynamic.select(F.col("segments").alias("prefix")).distinct().withColumn("marked", F.lit(True))
    prefixes = calls.select("segments").distinct().select("segments", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.slice("segments", 1, k))).alias("prefix"))
    hit = prefixes.join(marked, "prefix").select("segments", "marked").distinct()
    joined = calls.join(found, "segments", "left").join(hit, "segments", "left")
    lacking = F.lit(incomplete) if isinstance(incomplete, bool) else incomplete
    status = F.when(F.col("marked"), "dynamic").when(F.col("exports") == 1, F.when(lacking, "dynamic").otherwise("resolved")).when(F.col("exports") > 1, "duplicate").otherwise(F.when(lacking, "dynamic").otherwise("absent"))
    return joined.select(*calls.columns, status.alias("link_status"), F.when(status == "resolved", F.col("target")).alias("link_target"))


MOST_LINKS = 100_000


def link_facts(calls: DataFrame, exports: DataFrame, marks: DataFrame, state: DataFrame, by: list[str], root: str = "luci", most: int = MOST_LINKS) -> DataFrame:
    """Links (by, call_id, proto, pc, segments, link_status, target_path, target_proto) of calls, at most `most` of an artifact.

    calls: as of callees.callees. exports (segments, path, prototype), marks (segments) and state (one row: refused, over), as of
    modules.export_index. A path of names makes a link if it begins with `root`, is exported, lies below a marked label, holds a name that does not
    print as itself, or has several names while providers are unknown; a label alone, if it is exported or marked. The first that holds decides:
    dynamic (such a name, or a mark), resolved (one export), duplicate (more), absent. While artifacts refuse, what would be resolved or absent is
    dynamic; while the index is over its limit, limit_exceeded. Of an artifact with more links the next one is limit_exceeded, and the rest is left out.
    """
    named = F.when(F.col("status") == "resolved-path", F.col("segments")).when((F.col("status") == "lookup-label") & F.col("key_type").endswith("string"), F.array("lookup_key"))
    rows = calls.select(*by, "call_id", "proto", "pc", (F.col("status") == "resolved-path").alias("whole"), named.alias("segments")).where("segments is not null")
    found = exports.groupBy("segments").agg(F.count("*").alias("exports"), F.min(F.struct("path", "prototype")).alias("target"))
    marked = marks.select(F.col("segments").alias("prefix")).distinct().withColumn("marked", F.lit(True))
    prefixes = rows.select("segments").distinct().select("segments", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.slice("segments", 1, k))).alias("prefix"))
    hit = prefixes.join(marked, "prefix").select("segments", "marked").distinct()
    joined = rows.join(found, "segments", "left").join(hit, "segments", "left").crossJoin(F.broadcast(state.select("refused", "over")))  # one row is broadcast
    n, mark = F.coalesce("exports", F.lit(0)), F.coalesce("marked", F.lit(False))
    odd = F.col("whole") & F.exists("segments", lambda x: ~x.rlike(r'\A[\x20-\x21\x23-\x5b\x5d-\x7e]+\z'))
    unknown = (F.col("refused") > 0) | (F.col("over") > 0)
    linked = (n > 0) | mark | (F.col("whole") & ((F.element_at("segments", 1) == root) | odd | (unknown & (F.size("segments") > 1))))
    lacking = F.when(F.col("refused") > 0, "dynamic").when(F.col("over") > 0, "limit_exceeded")
    status = F.when(odd | mark, "dynamic").when(n > 1, "duplicate").otherwise(F.coalesce(lacking, F.when(n == 1, "resolved").otherwise("absent")))
    at = Window.partitionBy(*by).orderBy("proto", "pc")
    ranked = joined.where(linked).withColumn("position", F.row_number().over(at)).where(F.col("position") <= most + 1)
    status = F.when(F.col("position") > most, "limit_exceeded").otherwise(status)
    known = lambda c: F.when(F.col("link_status") == "resolved", F.col(c))
    return ranked.withColumn("link_status", status).select(*by, "call_id", "proto", "pc", "segments", "link_status", known("target.path").alias("target_path"), known("target.prototype").alias("target_proto"))


def unsupported_links(chunks: DataFrame, by: list[str]) -> DataFrame:
    """One link fact for each decoded artifact that is not of the 5.1 family, in the columns of link_facts. chunks: by, profile."""
    none = lambda t: F.lit(None).cast(t)
    other = chunks.where(~F.col("profile").startswith("lua5.1"))
    return other.select(*by, F.lit("chunk").alias("call_id"), F.array(F.lit(0)).alias("proto"), F.lit(0).alias("pc"), F.array().cast("array<string>").alias("segments"), F.lit("unsupported").alias("link_status"), none("string").alias("target_path"), none("array<int>").alias("target_proto"))


def link_order() -> list[str]:
    """The total order of links: artifacts by path and digest, calls by prototype, number by number, and place."""
    return ["path", "sha256", "proto", "pc", "segments"]


def classify_sites(sites: DataFrame, convention: bool = True) -> DataFrame:
    """sites with `class` and `class_reason`: the first of nine cases that holds, so every site has exactly one.

    Needs names_target, names_other (booleans), callee_status, callee_reason, relation_reason, link_status (all may be null).
    """
    limit = F.col("callee_reason").isin("path-limit", "analysis-limit")
    rel_limit = F.col("relation_reason") == "analysis-limit"
    bad_link = F.col("link_status").isin("dynamic", "limit_exceeded")
    no_link = F.col("link_status").isNull() & F.lit(convention)
    label = F.col("callee_status").isin("resolved-path", "lookup-label")
    target, other = F.coalesce("names_target", F.lit(False)), F.coalesce("names_other", F.lit(False))
    cases = [
        (target & other, "conflicting", None),
        (target, "caller", None),
        (limit, "degraded", F.concat(F.lit("callee:"), "callee_reason")),
        (rel_limit, "degraded", F.concat(F.lit("call_relation:"), "relation_reason")),
        (bad_link, "degraded", F.concat(F.lit("link:"), "link_status")),
        (other, "attributed_elsewhere", None),
        (no_link & label & F.coalesce(F.col("relation_reason").isin("symbolic-path-only", "lookup-label-only"), F.lit(False)), "unmapped_label", None),
    ]
    name, why = F.lit("unattributed"), F.coalesce("callee_reason", "relation_reason", F.concat(F.lit("link:"), "link_status"), F.lit("cross_artifact:not-requested"))
    for condition, label_, reason in reversed(cases):
        hit = F.coalesce(condition, F.lit(False))
        name = F.when(hit, label_).otherwise(name)
        why = F.when(hit, F.lit(None) if reason is None else reason).otherwise(why)
    return sites.withColumn("class", name).withColumn("class_reason", why)


def coverage(classified: DataFrame, file: str) -> DataFrame:
    """A row for each file: call_sites, a count for each class, and maps of reasons; the classes add up to call_sites."""
    per_reason = classified.groupBy(file, "class", "class_reason").agg(F.count("*").alias("n"))
    only = lambda k: F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(k)
    reasons = lambda k: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when((F.col("class") == k) & F.col("class_reason").isNotNull(), F.struct("class_reason", "n"))), lambda x: x.isNotNull()))).alias(f"{k}_reasons")
    classes = ("caller", "conflicting", "attributed_elsewhere", "unmapped_label", "degraded", "unattributed")
    return per_reason.groupBy(file).agg(F.sum("n").alias("call_sites"), *map(only, classes), reasons("degraded"), reasons("unattributed"))


def with_windows(callers: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """callers with their argument window; a caller without one is an error of the analysis, not a missing row."""
    joined = callers.join(windows.withColumn("__there", F.lit(True)), key, "left")
    return joined.where(F.assert_true(F.col("__there").isNotNull(), F.lit("a call site has no argument window")).isNull()).drop("__there")


def binding_chain(binds: DataFrame, most: int = 128) -> DataFrame:
    """(source, target, hops): every pair along an acyclic `binds` relation (source, target).

    Paths of 1 to k hops joined to those of k hops give those of up to 2k: the number of rounds is the logarithm of the longest, and each
    is written before the next. A chain longer than `most`, such as a cycle, raises ValueError.
    """
    pair = ["source", "target", "hops"]
    out = cut(binds.select("source", "target", F.lit(1).alias("hops")).distinct())
    reach = 1
    while True:
        last = out.where(F.col("hops") == reach).select(F.col("source").alias("from"), F.col("target").alias("source"), F.lit(reach).alias("so_far"))
        more = last.join(out, "source").select(F.col("from").alias("source"), "target", (F.col("so_far") + F.col("hops")).alias("hops")).distinct()
        more = cut(more)
        if more.isEmpty():
            return out
        if reach >= most:
            raise ValueError(f"a chain of more than {most} bindings")
        out, reach = cut(out.unionByName(more.select(pair))), 2 * reach

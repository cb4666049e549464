"""Control flow: leaders, blocks and typed edges by windows and joins; graph fixpoints in one kernel for each prototype.

Frames carry the columns `by` that name a prototype. A prototype's words are bounded by the decoder's limits, so a window or a
kernel over one of them is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marked(lifted: DataFrame, by: list[str]) -> DataFrame:
    """Words with `executable`, `n`, and `leader`: does a block begin here?

    A leader is the first executable word, one that a jump or skip leads to, or the next one after a jump, a skip or a return.
    """
    at = Window.partitionBy(*by).orderBy("pc")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    executable = F.col("role") == "instruction" if "role" in lifted.columns else F.lit(True)
    words = lifted.withColumn("executable", executable)
    ends = F.col("jump_target").isNotNull() | F.col("skip_target").isNotNull() | F.col("mnemonic").startswith("RETURN")
    last = F.last(F.when(F.col("executable"), F.coalesce(ends, F.lit(False))), ignorenulls=True).over(before)
    words = words.select("*", F.count("*").over(Window.partitionBy(*by)).alias("n"), F.coalesce(last, F.lit(True)).alias("__after"))
    targets = words.where("executable").select(*by, F.explode(F.array("jump_target", "skip_target")).alias("pc")).where("pc is not null").distinct().withColumn("__target", F.lit(True))
    found = words.join(targets, [*by, "pc"], "left")
    return found.withColumn("leader", F.col("executable") & (F.col("__after") | F.coalesce("__target", F.lit(False)))).drop("__after", "__target")


def leaders(words: DataFrame, by: list[str]) -> DataFrame:
    """(by, pc) of every block entry. words: as from marked()."""
    return words.where("leader").select(*by, "pc")


def blocks(words: DataFrame, by: list[str]) -> DataFrame:
    """A row for each block: index, start_pc, end_pc, its executable pcs, is_entry, is_exit, and its last executable word."""
    at = Window.partitionBy(*by).orderBy("pc")
    placed = words.withColumn("index", F.sum(F.col("leader").cast("int")).over(at) - 1).where("index >= 0")
    last = F.max(F.when(F.col("executable"), F.struct("pc", "mnemonic", "jump_target", "skip_target")))
    out = placed.groupBy(*by, "index").agg(
        F.min("pc").alias("start_pc"),
        F.max("pc").alias("end_pc"),
        F.array_sort(F.collect_list(F.when(F.col("executable"), F.col("pc")))).alias("instruction_pcs"),
        last.alias("last"),
    )
    return out.select("*", (F.col("index") == 0).alias("is_entry"), F.coalesce(F.col("last.mnemonic").startswith("RETURN"), F.lit(False)).alias("is_exit"))


def edges(blocks_: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """(by, from_block, to_block, kind). A fall-through is left out after RETURN and JMP, and where an edge goes there anyway.

    A target begins a block, as marked() has it. One that is no instruction (a word of another, or none) has no edge; such artifacts are not admitted to analysis.
    """
    last = blocks_.where("last is not null").select(*by, F.col("index").alias("from_block"), "end_pc", F.col("last.mnemonic").alias("mnemonic"), F.col("last.jump_target").alias("jump"), F.col("last.skip_target").alias("skip"))
    jump = last.where("jump is not null").withColumn("kind", F.when(F.col("jump") <= F.col("end_pc"), "loop-back").when(F.col("mnemonic") == "JMP", "unconditional-jump").otherwise("conditional-true")).withColumn("target", F.col("jump"))
    skip = last.where("skip is not null").withColumn("kind", F.lit("conditional-skip")).withColumn("target", F.col("skip"))
    columns = [*by, "from_block", "to_block", "kind"]
    moves = jump.unionByName(skip).select(*by, "from_block", "kind", "target")
    starts = blocks_.select(*by, F.col("start_pc").alias("target"), F.col("index").alias("to_block"))
    taken = moves.join(starts, [*by, "target"]).select(columns)
    fall = last.where("not mnemonic like 'RETURN%' and mnemonic != 'JMP'").withColumn("to_block", F.col("from_block") + 1).withColumn("kind", F.lit("fallthrough"))
    fall = fall.join(blocks_.select(*by, F.col("index").alias("to_block")), [*by, "to_block"], "left_semi").join(taken.select(*by, "from_block", "to_block").distinct(), [*by, "from_block", "to_block"], "left_anti")
    return taken.unionByName(fall.select(columns))


def predecessors(edges_: DataFrame, by: list[str]) -> DataFrame:
    """(by, index, predecessors): duplicates kept."""
    return edges_.groupBy(*by, F.col("to_block").alias("index")).agg(F.array_sort(F.collect_list("from_block")).alias("predecessors"))


# Graph fixpoints over one prototype's edges.


def reachable_order(successors: dict[int, list[int]], entry: int = 0) -> list[int]:
    """Blocks that can be reached, in reverse postorder."""
    seen, post, stack = {entry}, [], [(entry, iter(successors.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        for s in rest:
            if s not in seen:
                seen.add(s)
                stack.append((s, iter(successors.get(s, ()))))
                break
        else:
            post.append(node)
            stack.pop()
    return post[::-1]


def immediate_dominators(successors: dict[int, list[int]], entry: int = 0) -> dict[int, int | None]:
    """The immediate dominator of every reachable block (None for the entry), by intersecting along the tree found so far."""
    order = reachable_order(successors, entry)
    rank = {b: i for i, b in enumerate(order)}
    preds: dict[int, list[int]] = {b: [] for b in order}
    for b in order:
        for s in successors.get(b, ()):
            preds[s].append(b)
    idom = {entry: entry}
    moved = True
    while moved:
        moved = False
        for b in order[1:]:
            new = None
            for p in preds[b]:
                if p in idom:
                    x, y = p, new
                    while y is not None and x != y:
                        if rank[x] > rank[y]:
                            x = idom[x]
                        else:
                            y = idom[y]
                    new = x
            if idom.get(b) != new:
                idom[b], moved = new, True
    return {b: None if b == entry else idom[b] for b in order}


def frontiers(pairs: Iterable[tuple[int, int]], entry: int = 0) -> dict[int, set[int]]:
    """Dominance frontier of every reachable block; only blocks with two predecessor edges or more are joins."""
    successors: dict[int, list[int]] = {}
    preds: dict[int, list[int]] = {}
    for a, b in pairs:
        successors.setdefault(a, []).append(b)
        preds.setdefault(b, []).append(a)
    idom = immediate_dominators(successors, entry)
    out: dict[int, set[int]] = {b: set() for b in idom}
    for b in idom:
        if len(preds.get(b, ())) >= 2:
            for p in preds[b]:
                while p is not None and p in idom and p != idom[b]:
                    out[p].add(b)
                    p = idom[p]
    return out


def analyse(edges_: DataFrame, blocks_: DataFrame, by: list[str]) -> DataFrame:
    """(by, index, is_reachable, immediate_dominator, frontier): one kernel call for each prototype."""
    kinds = {f.name: f.dataType for f in blocks_.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by) + ", index long, is_reachable boolean, immediate_dominator long, frontier array<long>"
    listed = edges_.groupBy(*by).agg(F.collect_list(F.struct("from_block", "to_block")).alias("pairs"))
    count = blocks_.groupBy(*by).agg(F.count("*").alias("blocks"))
    whole = count.join(listed, by, "left")

    def run(batches):
        for batch in batches:
            rows = []
            for _, r in batch.iterrows():
                pairs = [] if r.pairs is None else [(int(p["from_block"]), int(p["to_block"])) for p in r.pairs]
                successors: dict[int, list[int]] = {}
                for a, b in pairs:
                    successors.setdefault(a, []).append(b)
                idom, df = immediate_dominators(successors), frontiers(pairs)
                rows += [(*(r[c] for c in by), i, i in idom, idom.get(i), sorted(df[i]) if i in df else []) for i in range(int(r.blocks))]
            yield pd.DataFrame(rows, columns=[*by, "index", "is_reachable", "immediate_dominator", "frontier"]).astype({"immediate_dominator": "Int64"})

    return whole.mapInPandas(run, schema)


#: Fixed colours of edge kinds in DOT output.
COLORS = {"fallthrough": "black", "conditional-true": "green", "conditional-false": "red", "unconditional-jump": "blue", "loop-back": "purple", "conditional-skip": "orange", "return-continuation": "gray"}


def dot(name: str, blocks_: list[tuple[int, int, int]], edges_: list[tuple[int, int, str]]) -> str:
    """A digraph of one prototype: blocks as (index, start_pc, end_pc), edges as (from, to, kind)."""
    lines = [f'digraph "{name}" {{', "  node [shape=box];"]
    lines += [f'  b{i} [label="block {i}\\npc {a}..{b}"];' for i, a, b in blocks_]
    lines += [f'  b{a} -> b{b} [label="{k}", color={COLORS[k]}];' for a, b, k in edges_]
    return "\n".join([*lines, "}", ""])

"""Content identity: a digest for every node of a tree, made from its own content and its children's digests in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.functions.words import decode
from bytefacts.operators import disasm
from bytefacts.session import cut
from bytefacts.sources.artifacts import Facts

# Fixed values of the record tags. The domain, which keeps schemes apart, is the caller's: digests agree with those of any other tool that uses the same one.
RECORD_PROTOTYPE, RECORD_INSTRUCTION, RECORD_OPERAND, RECORD_CHILD = "01", "02", "03", "04"
CONSTANT_TAGS = {"nil": "10", "boolean": "11", "integer": "12", "float": "13", "short-string": "14", "long-string": "15"}
OPERAND_TAGS = {"register": "20", "unsigned": "21", "signed": "22", "flag": "23", "raw": "24"}
RESOLUTION_TAGS = {"none": "30", "constant": "31", "upvalue": "32", "local": "33", "prototype": "34", "jump-target": "35", "metamethod": "36"}


def u64(x: Column) -> Column:
    """8 bytes, big-endian, as hex."""
    return F.lpad(F.lower(F.hex(x.cast("long"))), 16, "0")


def u8(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")


def sized(hex_digits: Column) -> Column:
    """A byte string with its length before it."""
    return F.concat(u64(F.length(hex_digits) / 2), hex_digits)


def constant_record(ctype: Column, bool_val: Column, raw_hex: Column, str_raw: Column) -> Column:
    tag = reduce(lambda acc, kv: acc.when(ctype == kv[0], kv[1]), list(CONSTANT_TAGS.items())[1:], F.when(ctype == "nil", CONSTANT_TAGS["nil"]))
    body = F.when(ctype == "nil", "").when(ctype == "boolean", F.when(bool_val, "01").otherwise("00")).when(ctype.isin("integer", "float"), sized(raw_hex)).otherwise(sized(F.lower(F.hex(str_raw))))
    return F.concat(tag, body)


def prototype_preimage(domain: bytes, params: Column, vararg: Column, stack: Column, n_instructions: Column, instructions: Column, n_constants: Column, constants: Column, n_upvalues: Column) -> Column:
    """Hex of everything before the children: the domain and a zero byte first; instructions and constants are hex of their records in order."""
    name = b"lua5.1".hex()
    return F.concat(F.lit(domain.hex() + "00" + RECORD_PROTOTYPE), sized(F.lit(name)), u8(params), u8(vararg), u8(stack), u64(n_instructions), instructions, u64(n_constants), constants, u64(n_upvalues))


def operand_record(o: Column) -> Column:
    """The record of one operand, as of disasm.OPERAND."""
    kind = reduce(lambda acc, kv: acc.when(o["kind"] == kv[0], kv[1]), list(OPERAND_TAGS.items())[1:], F.when(o["kind"] == "register", OPERAND_TAGS["register"]))
    value = F.when(o["kind"].isin("register", "flag"), u8(o["value"])).otherwise(u64(o["value"]))
    known = list(RESOLUTION_TAGS.items())[1:]
    tag = reduce(lambda acc, kv: acc.when(o["resolution"] == kv[0], kv[1]), known, F.when(o["resolution"].isNull(), RESOLUTION_TAGS["none"]))
    target = F.when(o["resolution"].isNull(), "").when(o["resolution"] == "upvalue", u8(o["target"])).otherwise(u64(o["target"]))
    return F.concat(F.lit(RECORD_OPERAND), kind, value, tag, target)


def instruction_record(role: Column, said: Column, operands: Column) -> Column:
    """The record of a word: its role, its name and its operands."""
    text = lambda c: sized(F.lower(F.hex(F.encode(c, "UTF-8"))))
    return F.concat(F.lit(RECORD_INSTRUCTION), text(role), text(said), u64(F.size(operands)), F.array_join(F.transform(operands, operand_record), ""))


def merkle(nodes: DataFrame, by: list[str], levels: int | None = None) -> DataFrame:
    """nodes (by, node, parent, position, depth, content: hex) with a column digest (64 hex digits), from the deepest level up.

    digest = SHA-256(content, number of children, and for each in order a tag and its digest). One aggregate and one join for a level, keyed by
    parent, and each level is written before the next, so that a plan holds one level whatever the depth; levels is the greatest depth (the
    root has 0), looked up if it is not given.
    """
    if levels is None:
        levels = nodes.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    for depth in range(levels, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        body, n = F.lit(""), F.lit(0)
        if done:
            listed = done[-1].groupBy(*by, F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("position", "digest"))).alias("children"))
            here = here.join(listed, [*by, "node"], "left")
            body = F.coalesce(F.array_join(F.transform("children", lambda c: F.concat(F.lit(RECORD_CHILD), c["digest"])), ""), F.lit(""))
            n = F.when(F.col("children").isNull(), 0).otherwise(F.size("children"))
        done.append(cut(here.select(*by, "node", "parent", "position", "depth", F.sha2(F.unhex(F.concat("content", u64(n), body)), 256).alias("digest"))))
    return reduce(DataFrame.unionByName, done)


def prototypes(f: Facts, domain: bytes, closures_only: bool = False) -> DataFrame:
    """(path, sha256, profile, proto, id, digest) of every 5.1 prototype: what it is and all below it, whatever its names, lines and place.

    f: the facts of decoded artifacts. domain names the scheme; with closures_only, the older one's roles. Words and constants become records in
    columns and are joined in their order for each prototype, which the decoder bounds; digests go up level by level.
    """
    by = ["path", "sha256", "profile"]
    old = lambda df: df.where(F.col("profile").startswith("lua5.1"))
    limits = old(f.prototypes).select(*by, "proto", "n_const")
    words_ = decode(old(f.words)).join(limits, [*by, "proto"])
    if closures_only:
        words_ = disasm.closure_roles(words_, old(f.prototypes), by)
    records = disasm.disassemble(words_).select(*by, "proto", "pc", instruction_record(F.col("role"), F.col("said"), F.col("operands")).alias("r"))
    joined = lambda df, place, name: df.groupBy(*by, "proto").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "r"))), lambda x: x["r"]), "").alias(name))
    constants = old(f.constants).select(*by, "proto", "index", constant_record(F.col("ctype"), F.col("bool_val"), F.col("raw_hex"), F.col("str_raw")).alias("r"))
    nodes = old(f.prototypes).join(joined(records, "pc", "instructions"), [*by, "proto"], "left").join(joined(constants, "index", "constants"), [*by, "proto"], "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = prototype_preimage(domain, F.col("numparams"), F.col("is_vararg"), F.col("maxstacksize"), F.col("n_instr"), empty("instructions"), F.col("n_const"), empty("constants"), F.col("n_upval"))
    depth = F.size("proto") - 1
    tree = cut(nodes.select(*by, F.col("proto").alias("node"), F.slice("proto", 1, depth).alias("parent"), F.element_at("proto", -1).alias("position"), depth.alias("depth"), content.alias("content")))
    return merkle(tree, by).select(*by, F.col("node").alias("proto"), ids.proto_text(F.col("node")).alias("id"), "digest")


def shared(left: DataFrame, right: DataFrame, columns: list[str], digest: str = "digest") -> DataFrame:
    """Rows of left whose digest some row of right has: the same content elsewhere. right is reduced to its digests first."""
    return left.join(right.select(digest).distinct(), digest, "left_semi").select(*columns, digest)

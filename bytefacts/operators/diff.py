"""Positional diffs: a full outer join by place, compared bit for bit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefacts.functions import words
from bytefacts.operators.dispatch import DIALECTS
from bytefacts.sources.artifacts import Facts


def positional(old: DataFrame, new: DataFrame, place: list[str], compare: Column | str, how: str = "full_outer") -> DataFrame:
    """(place, old, new) where they differ; with full_outer also where one side has no row, with inner only where both have.

    `compare` is what counts: an expression over either side, best as text of bits; null equals null.
    """
    value = F.expr(compare) if isinstance(compare, str) else compare
    a = old.select(*place, value.alias("old"), F.lit(True).alias("__a"))
    b = new.select(*place, value.alias("new"), F.lit(True).alias("__b"))
    both = a.join(b, place, how)
    changed = ~F.col("old").eqNullSafe(F.col("new")) | F.col("__a").isNull() | F.col("__b").isNull()
    return both.where(changed).select(*place, "old", "new")


def counts(old: DataFrame, new: DataFrame, by: list[str], section: str) -> DataFrame:
    """(by, section, old, new): numbers of rows that differ, for keys that both sides have."""
    a = old.groupBy(*by).agg(F.count("*").alias("old"))
    b = new.groupBy(*by).agg(F.count("*").alias("new"))
    return a.join(b, by).where("old != new").select(*by, F.lit(section).alias("section"), "old", "new")


def paired(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Prototypes (column `proto`) that both trees have with all their ancestors; a path of the tree has its ancestors by construction."""
    return old.select(*key, "proto").join(new.select(*key, "proto"), [*key, "proto"])


def constant_bits() -> Column:
    """What makes two constants equal: type, value, and the raw bytes, never a double."""
    return F.concat_ws(":", "ctype", F.col("bool_val").cast("string"), "raw_hex", F.hex("str_raw"))


def upvalue_bits() -> Column:
    """What makes two captures equal: where they come from and their kind."""
    return F.concat_ws(":", "instack", "idx", "kind")


def described(rows: DataFrame, semantic: bool) -> DataFrame:
    """Words with `said`: their bits, or with `semantic` also their fields by the profile's layout; a companion its role and bits."""
    bits = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("raw_word")), 8, "0"))
    if not semantic:
        return rows.withColumn("said", bits)
    said = F.concat(F.lit("uninterpreted physical_word="), bits)
    for dialect in dict.fromkeys(DIALECTS.values()):
        field = lambda n, d=dialect: words.field(F.col("raw_word"), d, n)
        name = F.coalesce(words.mnemonic(field("opcode"), dialect), F.lit("UNKNOWN"))
        parts = [x for n, shown in (("opcode", "opcode"), ("a", "A"), ("b", "B"), ("c", "C"), ("bx", "Bx"), ("sbx", "sBx")) for x in (F.lit(f" {shown}="), field(n).cast("string"))]
        said = F.when(F.col("profile").isin(*(p for p, d in DIALECTS.items() if d == dialect)), F.concat(name, *parts, F.lit(" physical_word="), bits)).otherwise(said)
    companion = F.concat("role", F.lit(":"), F.col("owner_pc").cast("string"), F.lit(" physical_word="), bits)
    return rows.withColumn("said", F.when(F.col("role") != "instruction", companion).otherwise(said))


SECTIONS = ("chunk", "prototype", "constant", "upvalue", "instruction")


def _changes(old: DataFrame, new: DataFrame, key: list[str], values: dict[str, Column], section: str) -> DataFrame:
    """(key, section, index, what, old, new): a row for each of the named values that differs between rows that both sides have."""
    pick = lambda side: F.array(*(F.struct(F.lit(n).alias("what"), v.cast("string").alias("value")) for n, v in values.items())).alias(side)
    both = old.select(*key, pick("a")).join(new.select(*key, pick("b")), key)
    rows = both.select(*key, F.explode(F.zip_with("a", "b", lambda x, y: F.struct(x["what"].alias("what"), x["value"].alias("old"), y["value"].alias("new")))).alias("d"))
    index = F.col("index").cast("int") if "index" in key else F.lit(None).cast("int")
    return rows.where(~F.col("d.old").eqNullSafe(F.col("d.new"))).select(*(k for k in key if k != "index"), F.lit(section).alias("section"), index.alias("index"), "d.*")


def artifacts(old: Facts, new: Facts, by: list[str], semantic: bool = False, ignore_debug: bool = False) -> DataFrame:
    """(by, proto, section, index, what, old, new): what differs between artifacts of two sets that have the same `by`. No row: nothing that is compared.

    Compared are dialect, header and trailing bytes; of prototypes that both trees have at one place their numbers and, unless ignore_debug, names, lines
    and scopes; constants and upvalues slot by slot, as far as both have them, and their counts; words place by place, also those one side lacks. A subtree
    that one side lacks shows in its parent's count of children alone. Doubles are compared by their bits, strings by their bytes.
    """
    place = [*by, "proto"]
    whole = {"dialect": F.col("profile"), "header": F.col("header_hex"), "trailing bytes": F.col("trailing_hex")}
    chunks = _changes(old.chunks, new.chunks, by, whole, "chunk").withColumn("proto", F.lit(None).cast("array<int>"))
    numbers = {"numparams": "numparams", "is_vararg": "is_vararg", "maxstacksize": "maxstacksize", "child prototype count": "n_protos"}
    if not ignore_debug:
        numbers |= {"line_defined": "line_defined", "last_line_defined": "last_line_defined", "source name bytes": "source_hex", "line_info": "lines", "local names/scopes": "scopes", "upvalue debug names": "names"}

    def prototypes(f: Facts) -> DataFrame:
        out = f.prototypes.withColumn("source_hex", F.hex("source_name"))
        if ignore_debug:
            return out
        in_order = lambda rows, what, name: rows.groupBy(*place).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*what)))).alias(name))
        lines = in_order(f.words.where("line is not null"), ("pc", "line"), "lines")
        scopes = in_order(f.locals.withColumn("name", F.hex("name")), ("index", "name", "startpc", "endpc"), "scopes")
        names = in_order(f.upvalues.where("name is not null").withColumn("name", F.hex("name")), ("index", "name"), "names")
        return reduce(lambda a, b: a.join(b, place, "left"), (lines, scopes, names), out)

    a, b = prototypes(old), prototypes(new)
    paired = a.select(*place).join(b.select(*place), place)
    protos = _changes(a, b, place, {k: F.col(v) for k, v in numbers.items()}, "prototype")
    counts = [_changes(a, b, place, {f"{s} count": F.col(c)}, s) for s, c in (("constant", "n_const"), ("upvalue", "n_upval"))]
    slots = [*place, "index"]
    constants = _changes(old.constants, new.constants, slots, {"constant": constant_bits()}, "constant")
    captures = {"capture": upvalue_bits()} | ({} if ignore_debug else {"debug name": F.hex("name")})
    upvalues = _changes(old.upvalues, new.upvalues, slots, captures, "upvalue")
    words_ = lambda f: described(f.words, semantic).join(paired, place).select(*place, F.col("pc").alias("index"), "said")
    code = positional(words_(old), words_(new), slots, "said").select(*place, F.lit("instruction").alias("section"), "index", F.lit("word").alias("what"), "old", "new")
    columns = [*place, "section", "index", "what", "old", "new"]
    return reduce(DataFrame.unionByName, (x.select(columns) for x in (chunks, protos, *counts, constants, upvalues, code)))

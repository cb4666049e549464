"""Fact frames made from the driver's tables, so that plain SQL over these tables tells what operators must answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefacts.functions.words import encode, opcode_of
from bytefacts.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5.1 word for each line item: opcode l_linenumber - 1, A = l_suppkey mod 256, B = l_quantity, C = l_partkey mod 512.

    An order is a prototype and a line number its pc + 1.
    """
    li = table(spark, sf_dir, "lineitem")
    word = encode("5.1", opcode=F.col("l_linenumber") - 1, a=F.col("l_suppkey") % 256, b=F.col("l_quantity").cast("long"), c=F.col("l_partkey") % 512)
    return li.select("l_orderkey", F.array(F.lit(0), F.col("l_orderkey").cast("int")).alias("proto"), (F.col("l_linenumber") - 1).cast("int").alias("pc"), word.alias("raw_word"))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time as a program of 5.1 words.

    view: MOVE; click: TEST, which skips a word; error: a jump to the word number value mod n; purchase: RETURN; signup: CALL.
    """
    ev = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = ev.select("user_id", "event_type", "value", (F.row_number().over(at) - 1).cast("int").alias("pc"), F.count("*").over(Window.partitionBy("user_id")).alias("size"))
    target = F.coalesce(F.floor(F.abs("value")), F.lit(0)) % F.col("size")
    kind = F.col("event_type")
    word = (
        F.when(kind == "click", encode("5.1", opcode=F.lit(opcode_of("TEST")), a=F.lit(1), c=F.lit(1)))
        .when(kind == "error", encode("5.1", opcode=F.lit(opcode_of("JMP")), sbx=target - F.col("pc") - 1))
        .when(kind == "purchase", encode("5.1", opcode=F.lit(opcode_of("RETURN")), a=F.lit(0), b=F.lit(1)))
        .when(kind == "signup", encode("5.1", opcode=F.lit(opcode_of("CALL")), a=F.lit(2), b=F.lit(2), c=F.lit(2)))
        .otherwise(encode("5.1", opcode=F.lit(opcode_of("MOVE")), a=F.lit(1), b=F.lit(2)))
    )
    return ev.select("user_id", F.array(F.lit(0)).alias("proto"), "pc", word.alias("raw_word"))


def part_chunks(spark: SparkSession, sf_dir: str, profile: str, size: int = 500) -> DataFrame:
    """(path, content): a chunk for every `size` parts, whose constants are their names, prices, and where the dialect has integers their sizes.

    The chunk's words load each part's first constant; its lines are the parts' sizes.
    """
    import struct
    from collections.abc import Iterator

    import pyarrow as pa

    from bytefacts.sources.chunks import Chunk, Constant, Prototype
    from bytefacts.sources.chunks import encode as encode_chunk

    integers = profile in ("lua5.3", "lua5.4", "lua5.5")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                constants, code = [], []
                for p in parts:
                    code.append(opcode_of("LOADK", "5.1") | len(constants) << 14)
                    name = p["p_name"].encode()
                    constants.append(Constant("short-string", name, name))
                    constants.append(Constant("float", p["p_retailprice"], struct.pack("<d", p["p_retailprice"])))
                    if integers:
                        constants.append(Constant("integer", p["p_size"], p["p_size"].to_bytes(8, "little", signed=True)))
                main = Prototype(b"@parts", code=code, constants=constants, lines=[p["p_size"] % 100 for p in parts])
                paths.append(path)
                contents.append(encode_chunk(Chunk(profile, main, size_size=4 if profile == "lua5.1-stock32" else 8)))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    p = table(spark, sf_dir, "part")
    group = F.floor(F.col("p_partkey") / size)
    rows = p.groupBy(F.concat(F.lit("parts-"), group).alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice", "p_size"))).alias("parts"))
    return rows.mapInArrow(run, "path string, content binary")


def part_calls(spark: SparkSession, sf_dir: str, size: int = 60) -> DataFrame:
    """(path, content): a 5.1 chunk for every `size` parts, which calls for each part the function that its name's two words name, with its size:

    `word1.word2(size)` for most parts; for a part of size 1 to 5 the function is in a variable, `word1[size](size)`.
    """
    import struct
    from collections.abc import Iterator

    import pyarrow as pa

    from bytefacts.sources.chunks import Chunk, Constant, Prototype
    from bytefacts.sources.chunks import encode as encode_chunk

    names = {n: opcode_of(n) for n in ("GETGLOBAL", "GETTABLE", "LOADK", "CALL", "RETURN")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                constants: dict = {}

                def constant(key, constants=constants) -> int:
                    return constants.setdefault(key, len(constants))

                code = []
                for p in parts:
                    first, second = p["p_name"].split(" ", 1)
                    k, n = constant(float(p["p_size"])), constant(second)
                    key = 256 + n if p["p_size"] > 5 else 1
                    code += [names["GETGLOBAL"] | constant(first) << 14, names["LOADK"] | 1 << 6 | k << 14, names["GETTABLE"] | key << 14, names["CALL"] | 2 << 23 | 1 << 14]
                code.append(names["RETURN"] | 1 << 23)
                made = [Constant("float", c, struct.pack("<d", c)) if isinstance(c, float) else Constant("short-string", c.encode(), c.encode()) for c in constants]
                paths.append(path)
                contents.append(encode_chunk(Chunk("lua5.1", Prototype(b"@calls", code=code, constants=made))))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    p = table(spark, sf_dir, "part")
    rows = p.groupBy(F.concat(F.lit("calls-"), F.floor(F.col("p_partkey") / size)).alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("parts"))
    return rows.mapInArrow(run, "path string, content binary")


def order_words(spark: SparkSession, sf_dir: str, profile: str, names: tuple[str, ...]) -> DataFrame:
    """(o_orderkey, profile, pc, raw_word): a word for each order, its opcode one of four names by o_orderkey // 4 mod 4, its fields from the order's keys.

    A = o_custkey mod 200. 5.2 and 5.3: B = o_orderkey mod 300, C = o_custkey mod 512. 5.4 and 5.5: B = o_orderkey mod 200, C = o_custkey mod 250, k = o_orderkey mod 2.
    """
    d = profile.removeprefix("lua")
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    code = F.get(F.array(*(F.lit(opcode_of(n, d)) for n in names)), (F.floor(key / 4) % 4).cast("int"))
    rest = {"b": key % 300, "c": cust % 512} if d < "5.4" else {"b": key % 200, "c": cust % 250, "k": key % 2}
    return o.select("o_orderkey", F.lit(profile).alias("profile"), F.lit(10).alias("pc"), encode(d, opcode=code, a=cust % 200, **rest).alias("raw_word"))


def _made_of_parts(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """(path, content): a 5.1 chunk for each part, built by build(row)."""
    from collections.abc import Iterator

    import pyarrow as pa

    from bytefacts.sources.chunks import Chunk
    from bytefacts.sources.chunks import encode as encode_chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            contents = [encode_chunk(Chunk("lua5.1", build(r))) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{r['p_partkey']}" for r in rows], pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").mapInArrow(run, "path string, content binary")


def _strings(*said: str) -> list:
    from bytefacts.sources.chunks import Constant

    return [Constant("short-string", x.encode(), x.encode()) for x in said]


def _word(name: str, a: int = 0, b: int = 0, c: int = 0, bx: int | None = None, jump: int | None = None) -> int:
    bx = jump + 131071 if jump is not None else bx
    return opcode_of(name) | a << 6 | (bx << 14 if bx is not None else b << 23 | c << 14)


def part_cases(spark: SparkSession, sf_dir: str, what: str = "case") -> DataFrame:
    """A chunk for each part, of the kind p_partkey mod 6, about the two words of its name.

    case: a call of what two branches load (0: the two words, 1: the first twice), of a closure over the first word's value that stays (2) or is
    written later (3), one that nothing leads to (4), and require("one").two() (5). value: a call whose argument comes from two branches (0), a table
    (1), a parameter (2), a concatenation (3), a parameter's field (4; another one's is written), or as many as there are (5).
    """
    from bytefacts.sources.chunks import Prototype, Upvalue

    w, end = _word, _word("RETURN", 0, 1)

    def case(r: dict) -> Prototype:
        one, two = r["p_name"].split(" ", 1)
        kind, names, protos = r["p_partkey"] % 6, _strings(one, two, "require"), []
        if kind < 2:
            code = [w("GETGLOBAL", 0, bx=0), w("TEST", 1), w("JMP", jump=1), w("GETGLOBAL", 0, bx=1 - kind), w("CALL", 0, 1, 1)]
        elif kind < 4:
            protos = [Prototype(maxstacksize=4, code=[w("GETUPVAL", 0, 0), w("CALL", 0, 1, 1), end], upvalues=[Upvalue()])]
            code = [w("GETGLOBAL", 0, bx=0), w("CLOSURE", 1, bx=0), w("MOVE", 0, 0), w("CALL", 1, 1, 1)] + [w("LOADNIL", 0, 0)] * (kind == 3)
        elif kind == 4:
            code = [w("GETGLOBAL", 0, bx=0), end, w("CALL", 0, 1, 1)]
        else:
            code = [w("GETGLOBAL", 0, bx=2), w("LOADK", 1, bx=0), w("CALL", 0, 2, 2), w("GETTABLE", 0, 0, 257), w("CALL", 0, 1, 1)]
        return Prototype(maxstacksize=6, code=[*code, end], constants=names, protos=protos)

    def value(r: dict) -> Prototype:
        one, two = r["p_name"].split(" ", 1)
        kind, f = r["p_partkey"] % 6, w("GETGLOBAL", 0 if r["p_partkey"] % 6 not in (2, 4) else 3, bx=2)
        at = 3 if kind in (2, 4) else 0
        code = {
            0: [f, w("LOADK", 1, bx=0), w("TEST", 2), w("JMP", jump=1), w("LOADK", 1, bx=1)],
            1: [w("NEWTABLE", 1), w("SETTABLE", 1, 256, 257), f],
            2: [f, w("MOVE", 4, 0)],
            3: [w("LOADK", 1, bx=0), w("LOADK", 2, bx=1), w("CONCAT", 1, 1, 2), f],
            4: [w("GETTABLE", 4, 0, 256), w("MOVE", 5, 4), f, w("SETTABLE", 1, 257, 5)],
            5: [f, w("LOADK", 1, bx=0)],
        }[kind]
        return Prototype(maxstacksize=8, numparams=2 if kind in (2, 4) else 0, code=[*code, w("CALL", at, 0 if kind == 5 else 2, 1), end], constants=_strings(one, two, "call"))

    return _made_of_parts(spark, sf_dir, what, case if what == "case" else value)


def part_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each part: a module named after its name, with a function run<size> (p_partkey mod 3 = 0, 2; the latter calls print first), or one that calls it (1)."""
    from bytefacts.sources.chunks import Prototype

    w, end = _word, _word("RETURN", 0, 1)

    def build(r: dict) -> Prototype:
        kind, name = r["p_partkey"] % 3, f"run{r['p_size']}"
        if kind == 1:
            one, two = r["p_name"].split(" ", 1)
            code = [w("GETGLOBAL", 0, bx=0), w("GETTABLE", 0, 0, 257), w("GETTABLE", 0, 0, 258), w("CALL", 0, 1, 1)]
            return Prototype(maxstacksize=4, code=[*code, end], constants=_strings(one, two, name))
        declare = [w("GETGLOBAL", 0, bx=0), w("LOADK", 1, bx=1), w("CALL", 0, 2, 1)]
        call = [w("GETGLOBAL", 0, bx=3), w("CALL", 0, 1, 1)] if kind == 2 else []
        return Prototype(maxstacksize=4, code=[*declare, *call, w("CLOSURE", 0, bx=0), w("SETGLOBAL", 0, bx=2), end], constants=_strings("module", r["p_name"].replace(" ", "."), name, "print"), protos=[Prototype(code=[end])])

    return _made_of_parts(spark, sf_dir, "module", build)

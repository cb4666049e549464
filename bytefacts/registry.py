"""Queries over the driver's tables, each with SQL that answers it from the source columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytefacts.functions import ids, scalar, words
from bytefacts.operators import callees, cfg, diff, disasm, dispatch, identity, lift, modules, origins, relations, validate, xrefs
from bytefacts.plans import corpus, documents, export, query, stream
from bytefacts.session import cut
from bytefacts.sources import artifacts
from bytefacts.synth import lineitem_words, order_words, part_calls, part_cases, part_chunks, part_modules, programs, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def asked(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


OPCODES = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(words.NAMES["5.1"])) + ") o(opcode, mnemonic)"
LINE = f"""
line AS (
  SELECT l_orderkey, l_linenumber - 1 AS pc, o.mnemonic, l_suppkey % 256 AS a, CAST(l_quantity AS BIGINT) AS b, l_partkey % 512 AS c
  FROM lineitem JOIN {OPCODES} ON o.opcode = l_linenumber - 1
)"""


def decoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.decode(lineitem_words(spark, sf_dir))


@asked("SELECT l_orderkey, CAST(l_linenumber - 1 AS INTEGER) AS pc, CAST(l_linenumber - 1 AS BIGINT) AS opcode, l_suppkey % 256 AS a, CAST(l_quantity AS BIGINT) AS b, l_partkey % 512 AS c FROM lineitem")
def decode_iabc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words encoded from line items and decoded again."""
    return decoded_lines(spark, sf_dir).select("l_orderkey", "pc", "opcode", "a", "b", "c")


@asked("SELECT o_orderkey, o_custkey % 131071 - 65535 AS sbx, CAST(o_orderkey % 256 AS BIGINT) AS a FROM orders")
def decode_iasbx_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed jumps through their bias."""
    want = F.col("o_custkey") % 131071 - 65535
    word = words.encode("5.1", opcode=F.lit(words.opcode_of("JMP")), a=F.col("o_orderkey") % 256, sbx=want)
    return words.decode(table(spark, sf_dir, "orders").select("o_orderkey", word.alias("raw_word"))).select("o_orderkey", "sbx", "a")


@asked("SELECT o_orderkey, o_custkey % 256 AS a, o_orderkey % 2 AS k, o_custkey % 251 AS b, o_orderkey % 256 AS c, o_orderkey % 127 - 64 AS sc FROM orders")
def decode_54_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5.4 layout: eight-bit B and C, k, and a signed C."""
    o = table(spark, sf_dir, "orders")
    plain = words.encode("5.4", opcode=F.lit(34), a=F.col("o_custkey") % 256, k=F.col("o_orderkey") % 2, b=F.col("o_custkey") % 251, c=F.col("o_orderkey") % 256)
    signed = words.encode("5.4", opcode=F.lit(21), sc=F.col("o_orderkey") % 127 - 64)
    return words.decode(o.select("o_orderkey", plain.alias("raw_word"), signed.alias("s")), "5.4").select("o_orderkey", "a", "k", "b", "c", words.field(F.col("s"), "5.4", "sc").alias("sc"))


@asked(f"WITH {LINE} SELECT mnemonic, count(*) AS n, CAST(sum(a) AS BIGINT) AS sum_a FROM line GROUP BY mnemonic")
def opcode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded_lines(spark, sf_dir).groupBy("mnemonic").agg(F.count("*").alias("n"), F.sum("a").alias("sum_a"))


def line_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lifted = lift.lift(decoded_lines(spark, sf_dir))
    return {"instruction": lifted.select(F.col("l_orderkey").alias("key"), "pc", "mnemonic", "reads", "writes", "a")}


def instructions_where(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return query.matches(line_facts(spark, sf_dir), where).select(F.col("key").alias("l_orderkey"), "pc", "mnemonic", "a")


@asked(f"WITH {LINE} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, mnemonic, a FROM line WHERE mnemonic = 'GETTABLE'")
def query_mnemonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions_where(spark, sf_dir, "mnemonic == 'OP_gettable'")


@asked(f"WITH {LINE} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, mnemonic, a FROM line WHERE mnemonic IN ('MOVE', 'GETUPVAL') OR (mnemonic <> 'LOADK' AND mnemonic = 'LOADNIL')")
def query_or_and_paren(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instructions_where(spark, sf_dir, "(MOVE || 'GETUPVAL') or opcode != LOADK && opcode == LOADNIL")


@asked(f"WITH {LINE} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, mnemonic, a FROM line WHERE mnemonic IN ('MOVE', 'GETTABLE') AND b = 7 OR mnemonic = 'GETTABLE' AND c = 7")
def query_effect_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact registers only: the range that LOADNIL writes never matches."""
    return instructions_where(spark, sf_dir, "effect.read.register == 7")


@asked(f"""WITH {LINE} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, mnemonic, a FROM line
WHERE NOT (mnemonic IN ('MOVE', 'LOADK', 'LOADBOOL', 'GETUPVAL', 'GETGLOBAL', 'GETTABLE') AND a = 3 OR mnemonic = 'LOADNIL' AND a = 3 AND b = 3)""")
def query_effect_not_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """!= means that there is no such effect."""
    return instructions_where(spark, sf_dir, "effect.write.register != 3")


def typed_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as constants: sizes as integers, prices as floats, names as strings."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None)
    bits = F.lpad(F.lower(F.hex(F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col("p_retailprice")).cast("long"))), 16, "0")
    ints = p.select(F.col("p_partkey").alias("key"), F.lit("integer").alias("ctype"), F.col("p_size").cast("long").alias("int_val"), none.cast("string").alias("dbl_bits"), none.cast("string").alias("str_display"))
    floats = p.select(F.col("p_partkey").alias("key"), F.lit("float").alias("ctype"), none.cast("long").alias("int_val"), bits.alias("dbl_bits"), none.cast("string").alias("str_display"))
    strings = p.select(F.col("p_partkey").alias("key"), F.lit("short-string").alias("ctype"), none.cast("long").alias("int_val"), none.cast("string").alias("dbl_bits"), scalar.escape_ascii(F.col("p_name")).alias("str_display"))
    return ints.unionByName(floats).unionByName(strings).withColumn("bool_val", none.cast("boolean"))


@asked("""SELECT p_partkey AS key, 'integer' AS ctype FROM part WHERE p_size = 11 UNION ALL SELECT p_partkey, 'float' FROM part WHERE p_retailprice = 11
UNION ALL SELECT p_partkey, 'float' FROM part WHERE p_retailprice = 900.0 UNION ALL SELECT p_partkey, 'integer' FROM part WHERE p_size = 900
UNION ALL SELECT p_partkey, 'short-string' FROM part WHERE contains(p_name, 'ring')""")
def query_typed_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = {"constant": typed_constants(spark, sf_dir)}
    return query.matches(facts, "constant == 11 or k == 900.0 or string contains 'ring'").select("key", "ctype")


@asked("""SELECT c_custkey AS key, 'prototype' AS entity FROM customer WHERE substr(sha256(c_name), 1, 64) = sha256('Customer#000000007')
UNION ALL SELECT o_orderkey, 'instruction' FROM orders WHERE o_orderstatus = 'F'""")
def query_entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`or` across entities is a union; each side is false for the other entity."""
    protos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.sha2("c_name", 256).alias("digest"))
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "MOVE").otherwise("LOADK").alias("mnemonic"))
    import hashlib

    want = hashlib.sha256(b"Customer#000000007").hexdigest()
    return query.matches({"prototype": protos, "instruction": calls}, f"prototype.digest == '{want}' or MOVE").select("key", "entity")


@asked("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_orderkey = o_orderkey
WHERE flag IS NOT NULL AND flag <> 'R'""")
def query_not_equals_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """!= asks for a fact that is there: calls without a callee path do not match."""
    path = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("callee_path"))
    calls = table(spark, sf_dir, "orders").join(path, "o_orderkey", "left").select("o_orderkey", "callee_path")
    return query.matches({"instruction": calls}, "callee.path != 'R'").select("o_orderkey")


@asked("""SELECT o_orderkey, CAST(total AS BIGINT) AS total, 'cur_' || substr(sha256(encode('orders') || encode('MOVE') || '\\xC8\\x00\\x00\\x00\\x00\\x00\\x00\\x00'::BLOB), 1, 8) || '_200' AS next_cursor
FROM (SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 100)""")
def query_page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, reached by the first one's cursor, and its own."""
    calls = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "MOVE").otherwise("LOADK").alias("mnemonic"))
    found = query.matches({"instruction": calls}, "MOVE")
    first = query.page(found, [F.col("o_orderkey")], "orders", "MOVE")
    second = query.page(found, [F.col("o_orderkey")], "orders", "MOVE", at=first.next_cursor)
    return second.rows.select("o_orderkey", F.lit(second.total).cast("long").alias("total"), F.lit(second.next_cursor).alias("next_cursor"))


PROGRAM = """
program AS (
  SELECT user_id, event_type, pc, n, CAST(floor(abs(value)) AS BIGINT) % n AS target FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pc, count(*) OVER (PARTITION BY user_id) AS n FROM events)
), word AS (
  SELECT user_id, pc, n, event_type, CASE WHEN event_type = 'error' THEN target END AS jump, CASE WHEN event_type = 'click' THEN pc + 2 END AS skip FROM program
), leader AS (
  SELECT user_id, 0 AS pc FROM word GROUP BY user_id
  UNION SELECT user_id, jump FROM word WHERE jump IS NOT NULL
  UNION SELECT user_id, skip FROM word WHERE skip < n
  UNION SELECT user_id, pc + 1 FROM word WHERE event_type IN ('click', 'error', 'purchase') AND pc + 1 < n
), block AS (
  SELECT l.user_id, row_number() OVER (PARTITION BY l.user_id ORDER BY l.pc) - 1 AS index, l.pc AS start_pc,
         coalesce(lead(l.pc) OVER (PARTITION BY l.user_id ORDER BY l.pc), s.n) - 1 AS end_pc
  FROM leader l JOIN (SELECT user_id, max(n) AS n FROM word GROUP BY 1) s USING (user_id)
), ending AS (
  SELECT b.*, w.event_type, w.jump, w.skip FROM block b JOIN word w ON w.user_id = b.user_id AND w.pc = b.end_pc
), taken AS (
  SELECT e.user_id, e.index AS from_block, t.index AS to_block, CASE WHEN e.jump <= e.end_pc THEN 'loop-back' ELSE 'unconditional-jump' END AS kind
  FROM ending e JOIN block t ON t.user_id = e.user_id AND e.jump BETWEEN t.start_pc AND t.end_pc
  UNION ALL
  SELECT e.user_id, e.index, t.index, 'conditional-skip' FROM ending e JOIN block t ON t.user_id = e.user_id AND e.skip BETWEEN t.start_pc AND t.end_pc
), edge AS (
  SELECT * FROM taken
  UNION ALL
  SELECT e.user_id, e.index, e.index + 1, 'fallthrough' FROM ending e JOIN block t ON t.user_id = e.user_id AND t.index = e.index + 1
  WHERE e.event_type NOT IN ('error', 'purchase') AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.user_id = e.user_id AND x.from_block = e.index AND x.to_block = e.index + 1)
)"""
USER = ["user_id"]


def program_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.marked(lift.lift(words.decode(programs(spark, sf_dir))), USER)


def program_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = program_words(spark, sf_dir)
    b = cfg.blocks(w, USER)
    return b, cfg.edges(b, w, USER)


@asked(f"WITH {PROGRAM} SELECT user_id, CAST(pc AS INTEGER) AS pc FROM leader")
def cfg_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.leaders(program_words(spark, sf_dir), USER)


@asked(f"WITH {PROGRAM} SELECT user_id, CAST(index AS BIGINT) AS index, CAST(start_pc AS INTEGER) AS start_pc, CAST(end_pc AS INTEGER) AS end_pc, index = 0 AS is_entry, event_type = 'purchase' AS is_exit FROM ending")
def cfg_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.blocks(program_words(spark, sf_dir), USER).select("user_id", "index", "start_pc", "end_pc", "is_entry", "is_exit")


@asked(f"WITH {PROGRAM} SELECT user_id, CAST(from_block AS BIGINT) AS from_block, CAST(to_block AS BIGINT) AS to_block, kind FROM edge")
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program_graph(spark, sf_dir)[1]


@asked(f"WITH {PROGRAM} SELECT user_id, CAST(to_block AS BIGINT) AS index, string_agg(from_block, ',' ORDER BY from_block) AS predecessors FROM edge GROUP BY 1, 2")
def cfg_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.predecessors(program_graph(spark, sf_dir)[1], USER).select("user_id", "index", F.array_join("predecessors", ",").alias("predecessors"))


@asked(f"""WITH RECURSIVE {PROGRAM}, reached AS (
  SELECT user_id, CAST(0 AS BIGINT) AS index FROM block GROUP BY user_id
  UNION SELECT e.user_id, CAST(e.to_block AS BIGINT) FROM reached r JOIN edge e ON e.user_id = r.user_id AND e.from_block = r.index)
SELECT b.user_id, CAST(b.index AS BIGINT) AS index, r.index IS NOT NULL AS is_reachable FROM block b LEFT JOIN reached r ON r.user_id = b.user_id AND r.index = b.index""")
def cfg_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = program_graph(spark, sf_dir)
    return cfg.analyse(e, b, USER).select("user_id", "index", "is_reachable")


DOMINANCE = f"""{PROGRAM}, avoid AS (
  SELECT b.user_id, b.index AS gone, CAST(0 AS BIGINT) AS index FROM block b WHERE b.index > 0
  UNION SELECT a.user_id, a.gone, CAST(e.to_block AS BIGINT) FROM avoid a JOIN edge e ON e.user_id = a.user_id AND e.from_block = a.index AND e.to_block <> a.gone
), reached AS (
  SELECT user_id, CAST(0 AS BIGINT) AS index FROM block GROUP BY user_id
  UNION SELECT e.user_id, CAST(e.to_block AS BIGINT) FROM reached r JOIN edge e ON e.user_id = r.user_id AND e.from_block = r.index
), strict AS (
  SELECT n.user_id, n.index, d.index AS dom FROM reached n JOIN reached d ON d.user_id = n.user_id AND d.index <> n.index AND n.index <> 0
  WHERE d.index = 0 OR NOT EXISTS (SELECT 1 FROM avoid a WHERE a.user_id = n.user_id AND a.gone = d.index AND a.index = n.index)
), depth AS (SELECT user_id, index, count(*) AS d FROM strict GROUP BY 1, 2
), idom AS (
  SELECT s.user_id, s.index, arg_max(s.dom, coalesce(d.d, 0)) AS idom FROM strict s LEFT JOIN depth d ON d.user_id = s.user_id AND d.index = s.dom GROUP BY 1, 2
)"""


@asked(f"WITH RECURSIVE {DOMINANCE} SELECT user_id, CAST(index AS BIGINT) AS index, CAST(idom AS BIGINT) AS immediate_dominator FROM idom")
def cfg_idom(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = program_graph(spark, sf_dir)
    return cfg.analyse(e, b, USER).where("immediate_dominator is not null").select("user_id", "index", "immediate_dominator")


@asked(f"""WITH RECURSIVE {DOMINANCE}, dominates AS (SELECT user_id, dom, index FROM strict UNION ALL SELECT user_id, index, index FROM reached)
SELECT DISTINCT p.user_id, CAST(p.dom AS BIGINT) AS index, CAST(e.to_block AS BIGINT) AS frontier
FROM edge e JOIN reached t ON t.user_id = e.user_id AND t.index = e.to_block JOIN dominates p ON p.user_id = e.user_id AND p.index = e.from_block
WHERE (SELECT count(*) FROM edge x WHERE x.user_id = e.user_id AND x.to_block = e.to_block) >= 2
  AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.user_id = e.user_id AND s.index = e.to_block AND s.dom = p.dom)""")
def cfg_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = program_graph(spark, sf_dir)
    return cfg.analyse(e, b, USER).select("user_id", "index", F.explode("frontier").alias("frontier"))


@asked(f"""WITH {PROGRAM} SELECT user_id, event_type, count(*) AS n FROM word GROUP BY 1, 2""")
def program_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for x in ("TEST", "click", "JMP", "error", "RETURN", "purchase", "CALL", "signup", "MOVE", "view")))
    return words.decode(programs(spark, sf_dir)).groupBy("user_id", F.element_at(names, F.col("mnemonic")).alias("event_type")).agg(F.count("*").alias("n"))


@asked(f"""WITH {PROGRAM}, effect AS (
  SELECT user_id, pc, 'read' AS side, 2 AS register FROM word WHERE event_type IN ('view', 'signup')
  UNION ALL SELECT user_id, pc, 'read', 1 FROM word WHERE event_type = 'click'
  UNION ALL SELECT user_id, pc, 'read', 3 FROM word WHERE event_type = 'signup'
  UNION ALL SELECT user_id, pc, 'write', 1 FROM word WHERE event_type = 'view'
  UNION ALL SELECT user_id, pc, 'write', 2 FROM word WHERE event_type = 'signup')
SELECT user_id, side, CAST(register AS INTEGER) AS register, count(*) AS n FROM effect GROUP BY 1, 2, 3""")
def def_use_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lifted = lift.lift(words.decode(programs(spark, sf_dir)))
    sides = [lifted.select("user_id", F.lit(s).alias("side"), F.explode(c).alias("e")) for s, c in (("read", "reads"), ("write", "writes"))]
    registers = sides[0].unionByName(sides[1]).where("e.kind = 'register'").select("user_id", "side", F.explode(F.sequence("e.first", "e.last")).alias("register"))
    return registers.groupBy("user_id", "side", "register").agg(F.count("*").alias("n"))


XREF = f"""{LINE}, edge AS (
  SELECT DISTINCT 'proto:0/' || l_orderkey || '/pc:' || pc AS source, 'proto:0/' || l_orderkey || '/' ||
    CASE WHEN mnemonic = 'GETUPVAL' THEN 'upvalue:' || b WHEN mnemonic = 'GETTABLE' THEN 'constant:' || (c - 256) ELSE 'constant:' || (b * 512 + c) END AS target, 'reads' AS relation
  FROM line WHERE mnemonic IN ('LOADK', 'GETGLOBAL', 'GETUPVAL') OR (mnemonic = 'GETTABLE' AND c >= 256))"""


@asked(f"WITH {XREF} SELECT source, target, relation FROM edge")
def xref_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xrefs.effect_edges(lift.lift(decoded_lines(spark, sf_dir)), []).select("source", "target", "relation")


@asked(f"WITH {XREF} SELECT source, target, relation FROM edge WHERE target LIKE 'proto:0/7/upvalue:%' OR target LIKE 'proto:0/39/upvalue:%'")
def xref_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xrefs.to(xrefs.effect_edges(lift.lift(decoded_lines(spark, sf_dir)), []), *(f"proto:0/{p}/upvalue:{i}" for p in (7, 39) for i in range(51))).select("source", "target", "relation")


@asked(f"WITH {XREF} SELECT source, target, relation FROM edge WHERE source IN ('proto:0/7/pc:1', 'proto:0/39/pc:1', 'proto:0/39/pc:4')")
def xref_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xrefs.from_(xrefs.effect_edges(lift.lift(decoded_lines(spark, sf_dir)), []), "proto:0/7/pc:1", "proto:0/39/pc:1", "proto:0/39/pc:4").select("source", "target", "relation")


@asked("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS found FROM orders")
def xref_target_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xrefs.exists(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey")


@asked("""SELECT c_custkey, s.n AS stores, CASE WHEN s.n IS NULL THEN 'missing-prototype-store' WHEN s.n > 1 THEN 'multiple-prototype-stores' WHEN s.bal > 5000 THEN NULL ELSE 'non-closure-store' END AS relation_reason
FROM customer LEFT JOIN (SELECT s_suppkey % 70 AS name, count(*) AS n, min(s_acctbal) AS bal FROM supplier GROUP BY 1) s ON s.name = c_custkey % 90""")
def relation_unique_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global resolves if one store names it and that stores a closure."""
    stores = table(spark, sf_dir, "supplier").select(F.lit(1).alias("artifact"), (F.col("s_suppkey") % 70).cast("string").alias("name"), F.when(F.col("s_acctbal") > 5000, "closure").otherwise("non-closure").alias("value_kind"), F.array(F.lit(0)).alias("prototype"))
    name = (F.col("c_custkey") % 90).cast("string")
    none = F.lit(None)
    callees = table(spark, sf_dir, "customer").select(F.lit(1).alias("artifact"), "c_custkey", F.lit("resolved-path").alias("status"), none.cast("array<int>").alias("prototype"), F.array(name).alias("segments"), name.alias("lookup_global"), none.cast("string").alias("reason"))
    made = relations.call_relations(callees, stores, ["artifact"])
    n = stores.groupBy(F.col("name").alias("lookup_global")).agg(F.count("*").alias("stores"))
    return made.join(n, "lookup_global", "left").select("c_custkey", "stores", "relation_reason")


LINKED = """
label AS (SELECT p_partkey, string_split(p_name, ' ') AS segments FROM part),
exported AS (SELECT string_split(p_name, ' ') AS segments, count(*) AS n, min(p_partkey) AS target FROM part WHERE p_size <= 2 GROUP BY 1),
marked AS (SELECT DISTINCT string_split(p_name, ' ')[1:1] AS prefix FROM part WHERE p_size = 50 AND p_retailprice < 920)"""


@asked(f"""WITH {LINKED} SELECT p_partkey, CASE WHEN segments[1:1] IN (SELECT prefix FROM marked) OR segments IN (SELECT prefix FROM marked) THEN 'dynamic'
  WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'duplicate' ELSE 'absent' END AS link_status,
  CASE WHEN n = 1 AND NOT (segments[1:1] IN (SELECT prefix FROM marked) OR segments IN (SELECT prefix FROM marked)) THEN target END AS link_target
FROM label LEFT JOIN exported USING (segments)""")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to exports; a marked prefix makes a link dynamic."""
    p = table(spark, sf_dir, "part").withColumn("segments", F.split("p_name", " "))
    exports = p.where("p_size <= 2").select("segments", F.col("p_partkey").alias("target"))
    dynamic = p.where("p_size = 50 and p_retailprice < 920").select(F.slice("segments", 1, 1).alias("segments"))
    return relations.resolve_links(p.select("p_partkey", "segments"), exports, dynamic).select("p_partkey", "link_status", "link_target")


@asked(f"""WITH {LINKED} SELECT p_partkey, CASE WHEN n > 1 THEN 'duplicate' ELSE 'dynamic' END AS link_status FROM label LEFT JOIN exported USING (segments)""")
def link_incomplete_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unreadable artifact turns what was resolved or absent to dynamic; a duplicate stays one."""
    p = table(spark, sf_dir, "part").withColumn("segments", F.split("p_name", " "))
    exports = p.where("p_size <= 2").select("segments", F.col("p_partkey").alias("target"))
    none = exports.where("false").select("segments")
    return relations.resolve_links(p.select("p_partkey", "segments"), exports, none, incomplete=True).select("p_partkey", "link_status")


SITES = """
site AS (
  SELECT l_suppkey % 20 AS file, l_returnflag = 'R' AS names_target, l_linenumber = 2 AS names_other,
    CASE WHEN l_linenumber IN (3, 4) THEN 'unresolved' ELSE 'resolved-path' END AS callee_status,
    CASE WHEN l_linenumber = 3 THEN 'path-limit' WHEN l_linenumber = 4 THEN 'dynamic-key' END AS callee_reason,
    CASE WHEN l_linenumber = 5 THEN 'symbolic-path-only' WHEN l_linenumber = 6 THEN 'analysis-limit' END AS relation_reason,
    CASE WHEN l_linenumber = 7 THEN 'dynamic' WHEN l_linenumber = 1 THEN 'absent' END AS link_status
  FROM lineitem
), classed AS (
  SELECT *, CASE WHEN names_target AND names_other THEN 'conflicting' WHEN names_target THEN 'caller' WHEN callee_reason = 'path-limit' OR relation_reason = 'analysis-limit' OR link_status = 'dynamic' THEN 'degraded'
    WHEN names_other THEN 'attributed_elsewhere' WHEN link_status IS NULL AND relation_reason = 'symbolic-path-only' THEN 'unmapped_label' ELSE 'unattributed' END AS class FROM site
)"""


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("file"),
        (F.col("l_returnflag") == "R").alias("names_target"),
        (n == 2).alias("names_other"),
        F.when(n.isin(3, 4), "unresolved").otherwise("resolved-path").alias("callee_status"),
        F.when(n == 3, "path-limit").when(n == 4, "dynamic-key").alias("callee_reason"),
        F.when(n == 5, "symbolic-path-only").when(n == 6, "analysis-limit").alias("relation_reason"),
        F.when(n == 7, "dynamic").when(n == 1, "absent").alias("link_status"),
    )
    return relations.classify_sites(li)


@asked(f"WITH {SITES} SELECT file, class, count(*) AS n FROM classed GROUP BY 1, 2")
def callers_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_sites(spark, sf_dir).groupBy("file", "class").agg(F.count("*").alias("n"))


@asked(f"""WITH {SITES} SELECT file, count(*) AS call_sites, CAST(count(*) FILTER (class = 'caller') AS BIGINT) AS caller,
  CAST(count(*) FILTER (class = 'degraded' AND callee_reason = 'path-limit') AS BIGINT) AS path_limit, CAST(count(*) FILTER (class = 'degraded' AND relation_reason IS NOT NULL) AS BIGINT) AS relation_limit,
  CAST(count(*) FILTER (class = 'unattributed' AND callee_reason = 'dynamic-key') AS BIGINT) AS dynamic_key, true AS adds_up FROM classed GROUP BY 1""")
def callers_counts_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relations.coverage(call_sites(spark, sf_dir), "file")
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0)).cast("long")
    adds = F.col("call_sites") == sum((F.col(k) for k in ("caller", "conflicting", "attributed_elsewhere", "unmapped_label", "degraded", "unattributed")), F.lit(0))
    return c.select("file", "call_sites", "caller", of("degraded_reasons", "callee:path-limit").alias("path_limit"), of("degraded_reasons", "call_relation:analysis-limit").alias("relation_limit"), of("unattributed_reasons", "dynamic-key").alias("dynamic_key"), adds.alias("adds_up"))


@asked("SELECT user_id, event_type AS name, arg_max(event_id, event_id) AS pc, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_store_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), F.col("event_id").alias("pc"), "value")
    return relations.last_stores(stores, ["user_id"]).select("user_id", "name", "pc", "value")


U64 = "lpad(lower(printf('%x', CAST({} AS BIGINT))), 16, '0')"
CHILDREN = "string_agg('04' || {d}, '' ORDER BY {o})"


@asked(f"""WITH leaf AS (SELECT c_nationkey, c_custkey, sha256(unhex(lower(hex(encode(c_name))) || {U64.format(0)})) AS d FROM customer),
nat AS (SELECT n_nationkey, n_regionkey, sha256(unhex(lower(hex(encode(n_name))) || {U64.format("count(d)")} || coalesce({CHILDREN.format(d="d", o="c_custkey")}, ''))) AS d FROM nation LEFT JOIN leaf ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name),
reg AS (SELECT r_regionkey, sha256(unhex(lower(hex(encode(r_name))) || {U64.format("count(d)")} || coalesce({CHILDREN.format(d="d", o="n_nationkey")}, ''))) AS d FROM region LEFT JOIN nat ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name)
SELECT 'r' || r_regionkey AS node, d AS digest FROM reg UNION ALL SELECT 'n' || n_nationkey, d FROM nat UNION ALL SELECT 'c' || c_custkey, d FROM leaf""")
def identity_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree; digests from the leaves up."""
    content = lambda c: F.lower(F.hex(F.encode(c, "UTF-8")))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("position"), F.lit(0).alias("depth"), content("r_name").alias("content"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("position"), F.lit(1).alias("depth"), content("n_name").alias("content"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").alias("position"), F.lit(2).alias("depth"), content("c_name").alias("content"))
    nodes = r.unionByName(n).unionByName(c).withColumn("tree", F.lit(1))
    return identity.merkle(nodes, ["tree"], 2).select("node", "digest")


@asked("""WITH d AS (SELECT o_orderkey AS key, o_orderstatus AS tree, sha256(o_custkey || ':' || o_orderpriority) AS digest FROM orders)
SELECT key, digest FROM d WHERE tree = 'O' AND digest IN (SELECT digest FROM d WHERE tree = 'F')""")
def content_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one tree that have the same digest as some node of another."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("tree"), F.sha2(F.concat_ws(":", "o_custkey", "o_orderpriority"), 256).alias("digest"))
    return identity.shared(d.where("tree = 'O'"), d.where("tree = 'F'"), ["key"])


@asked("""WITH a AS (SELECT o_orderkey AS pc, CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderkey % 97 <> 0), b AS (SELECT o_orderkey AS pc, CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS v FROM orders WHERE o_orderkey % 89 <> 0)
SELECT coalesce(a.pc, b.pc) AS pc, a.v AS old, b.v AS new FROM a FULL JOIN b ON a.pc = b.pc WHERE a.v IS DISTINCT FROM b.v""")
def diff_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table of words, by position; rows that one side lacks count."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 97 != 0").select(F.col("o_orderkey").alias("pc"), F.col("o_custkey").alias("word"))
    new = o.where("o_orderkey % 89 != 0").select(F.col("o_orderkey").alias("pc"), F.when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("word"))
    return diff.positional(old, new, ["pc"], "cast(word as string)")


@asked("""SELECT p_partkey AS index, p_name AS old, p_name || '!' AS new FROM part WHERE p_size = 7""")
def diff_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("index"), F.col("p_name").alias("v"))
    new = p.select(F.col("p_partkey").alias("index"), F.when(F.col("p_size") == 7, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("v"))
    return diff.positional(old, new, ["index"], "v", "inner")


BROKEN = f"""{LINE}, broken AS (
  SELECT l_orderkey, pc, 'L51-CONST-003' AS code FROM line WHERE mnemonic IN ('LOADK', 'GETGLOBAL') AND b * 512 + c >= 5000
  UNION ALL SELECT l_orderkey, pc, 'L51-UPVAL-001' FROM line WHERE mnemonic = 'GETUPVAL' AND b >= 30
  UNION ALL SELECT l_orderkey, pc, 'L51-REG-001' FROM line WHERE a >= 40
  UNION ALL SELECT l_orderkey, pc, 'L51-REG-002' FROM line WHERE mnemonic IN ('MOVE', 'LOADNIL', 'GETTABLE') AND b >= 40
  UNION ALL SELECT l_orderkey, pc, 'L51-REG-003' FROM line WHERE mnemonic = 'GETTABLE' AND c < 256 AND c >= 40
  UNION ALL SELECT l_orderkey, pc, 'L51-CONST-005' FROM line WHERE mnemonic = 'GETTABLE' AND c >= 256 AND c - 256 >= 5000)"""


def line_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"n": 7, "maxstacksize": 40, "n_const": 5000, "n_upval": 30, "n_protos": 0}
    w = decoded_lines(spark, sf_dir).withColumns({k: F.lit(v) for k, v in limits.items()} | {"target_role": F.lit(None).cast("string")})
    return validate.violations(w, validate.rules_51(), ["l_orderkey"])


@asked(f"WITH {BROKEN} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, code, 'error' AS severity FROM broken")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_violations(spark, sf_dir)


@asked(f"WITH {BROKEN} SELECT o_orderkey AS l_orderkey, CASE WHEN EXISTS (SELECT 1 FROM broken b WHERE b.l_orderkey = o_orderkey) THEN 'invalid' ELSE 'valid-for-parser' END AS verdict FROM orders")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return validate.verdict(line_violations(spark, sf_dir), orders, ["l_orderkey"])


@asked("""WITH once AS (SELECT user_id, event_type AS code, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS target, min(event_id) AS first FROM events GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'error' THEN 0 ELSE 1 END, first, code, target) AS position, count(*) OVER (PARTITION BY user_id) AS found FROM once)
SELECT user_id, code, severity, target, CAST(position AS INTEGER) AS position FROM ranked WHERE found <= 12 OR position < 12
UNION ALL SELECT user_id, 'CORE-LIMIT-003', 'error', NULL, 12 FROM ranked WHERE found > 12 AND position = 12""")
def diag_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("code"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"), (F.floor("value") % 10).cast("string").alias("target"), "event_id")
    return validate.truncated(d, ["user_id"], ["event_id"], 12)


@asked("""WITH r AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2), s AS (
  SELECT l_orderkey, l_linenumber, q, coalesce(sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT l_orderkey, CAST(start - 1 AS BIGINT) AS position, 'overlap' AS kind FROM s WHERE l_linenumber = 5 AND start > 0""")
def byte_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that tile an artifact, but that each fifth one begins a byte early."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    start = F.coalesce(F.sum("q").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    early = ((F.col("l_linenumber") == 5) & (start > 0)).cast("int")
    ranges = r.select("l_orderkey", (start - early).alias("byte_offset"), (F.col("q") + early).alias("byte_length"), F.sum("q").over(Window.partitionBy("l_orderkey")).alias("total"))
    return validate.byte_accounting(ranges, ["l_orderkey"], "total")


@asked("""WITH t AS (SELECT conv_id, turn, length(text) % 7 - 3 AS delta, CASE WHEN turn % 4 = 0 THEN turn * 10 END AS anchor FROM conversations),
g AS (SELECT *, count(anchor) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, turn, CAST(sum(coalesce(anchor, delta)) OVER (PARTITION BY conv_id, run ORDER BY turn) AS BIGINT) AS line FROM g""")
def line_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from signed deltas with an absolute anchor every fourth place."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 7 - 3).cast("long").alias("delta"), F.when(F.col("turn") % 4 == 0, F.col("turn") * 10).alias("anchor"))
    return lift.lines(t, ["conv_id"], "turn").select("conv_id", "turn", "line")


@asked("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, count(*) OVER (PARTITION BY user_id) AS available FROM events)
SELECT user_id, event_id, CAST(position AS INTEGER) AS position, available, least(available, 60) AS emitted, available > 60 AS is_truncated FROM e WHERE position <= 60""")
def batch_limit_per_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    rows, counts = query.batch(e, ["user_id"], [F.col("event_id")], 60)
    return rows.join(counts, "user_id").select("user_id", "event_id", "position", "available", F.col("emitted").cast("long").alias("emitted"), "is_truncated")


def order_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("artifact"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("artifact"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pc"), F.col("l_partkey").alias("word"))
    found = export.records({"prototype": o, "instruction": li}, export.selected("instruction,prototype"), ["artifact"], {"prototype": [F.col("id")], "instruction": [F.col("id"), F.col("pc"), F.col("word")]})
    return export.capped(found, ["artifact"], 500)


@asked("""WITH f AS (SELECT o_custkey % 50 AS artifact FROM orders UNION ALL SELECT l_suppkey % 50 FROM lineitem), c AS (SELECT artifact, count(*) AS n FROM f GROUP BY 1), k AS (SELECT artifact, least(n, 500) AS kept FROM c),
p AS (SELECT o_custkey % 50 AS artifact, count(*) AS n FROM orders GROUP BY 1)
SELECT 'export_start' AS record_type, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'export_end', 1 UNION ALL SELECT 'file_start', count(*) FROM c UNION ALL SELECT 'file_end', count(*) FROM c
UNION ALL SELECT 'prototype', CAST(sum(least(coalesce(p.n, 0), 500)) AS BIGINT) FROM k LEFT JOIN p USING (artifact) HAVING sum(coalesce(p.n, 0)) > 0
UNION ALL SELECT 'instruction', CAST(sum(kept - least(coalesce(p.n, 0), 500)) AS BIGINT) FROM k LEFT JOIN p USING (artifact) HAVING sum(kept - least(coalesce(p.n, 0), 500)) > 0""")
def export_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a framed export by type."""
    kept, outcomes = order_export(spark, sf_dir)
    return export.framed(kept, outcomes, ["artifact"]).groupBy("record_type").agg(F.count("*").alias("n"))


@asked("""WITH f AS (SELECT o_custkey % 50 AS artifact FROM orders UNION ALL SELECT l_suppkey % 50 FROM lineitem)
SELECT artifact, count(*) AS available_fact_count, least(count(*), 500) AS emitted_fact_count, count(*) > 500 AS is_truncated FROM f GROUP BY 1""")
def family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_export(spark, sf_dir)[1].withColumn("emitted_fact_count", F.col("emitted_fact_count").cast("long"))


@asked("""SELECT '{"artifact":7}' AS key, 'count' AS problem UNION ALL SELECT '{"artifact":8}', 'end' UNION ALL SELECT '{"artifact":9}', 'start' UNION ALL SELECT '{"artifact":11}', 'record_type'
UNION ALL SELECT NULL, 'totals'""")
def export_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with a fault in each of four artifacts (a record gone, the end gone, the start twice, a strange record): exactly these are found, and that totals no longer hold."""
    kept, outcomes = order_export(spark, sf_dir)
    whole = export.framed(kept, outcomes, ["artifact"])
    at, kind = F.coalesce(F.col("key.artifact"), F.lit(-1)), F.col("record_type")
    gone = ((at == 7) & (F.col("step") == 1) & (F.col("ordinal") == 3)) | ((at == 8) & (kind == "file_end"))
    copies = F.when((at == 9) & (kind == "file_start"), 2).otherwise(1)
    odd = whole.where(~gone).withColumn("record_type", F.when((at == 11) & (F.col("ordinal") == 2), "gossip").otherwise(kind))
    return export.verify(odd.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy"))


@asked("SELECT 'frame' AS problem")
def export_verify_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that breaks off before its last record."""
    kept, outcomes = order_export(spark, sf_dir)
    return export.verify(export.framed(kept, outcomes, ["artifact"]).where("record_type != 'export_end'")).select("problem")


@asked("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
chain AS (SELECT source, target, 1 AS hops FROM e UNION ALL SELECT chain.source, e.target, hops + 1 FROM chain JOIN e ON e.source = chain.target)
SELECT source, target, CAST(hops AS INTEGER) AS hops FROM chain""")
def binding_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    return relations.binding_chain(n.unionByName(c))


@asked(r"""SELECT conv_id, turn, replace(replace(replace(replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') AS display FROM conversations""")
def scalar_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings as they are displayed, from their bytes."""
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.escape(F.encode(ascii_only, "UTF-8")).alias("display"))


@asked(r"""SELECT p_partkey, CASE WHEN length(s) <= 64 THEN '"' || s || '"' ELSE '"' || substr(s, 1, 64) || '.." (' || length(s) || ' bytes)' END AS preview
FROM (SELECT p_partkey, repeat(p_name || '-', 1 + p_size % 9) AS s FROM part)""")
def scalar_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.encode(F.repeat(F.concat("p_name", F.lit("-")), F.lit(1) + F.col("p_size") % 9), "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.preview(s).alias("preview"))


@asked("SELECT o_orderkey, row_number() OVER (ORDER BY rank, p1, p2, idx) AS place FROM (SELECT o_orderkey, o_orderkey % 8 AS rank, o_custkey % 3 AS p1, o_custkey AS p2, o_orderkey AS idx FROM orders)")
def stable_id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers sort by kind, then by path number by number, then by index; never as text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    key = ids.sort_key(F.array((F.col("o_custkey") % 3).cast("int"), F.col("o_custkey").cast("int")), (F.col("o_orderkey") % 8).cast("int"), F.col("o_orderkey"))
    return ids.placed(o, key).select("o_orderkey", "place")


PART = """
part_at AS (SELECT 'parts-' || CAST(p_partkey // 500 AS BIGINT) AS path, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS place, * FROM part)"""


def undumped(profile: str, each: int):
    """A query that decodes chunks made from parts, and its SQL; `each` constants for a part."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = artifacts.decoded(part_chunks(spark, sf_dir, profile))
        k = artifacts.facts(rows).constants
        return k.select("path", F.col("index").cast("long").alias("index"), "ctype", "int_val", "dbl_val", "str_display", "profile")

    sql = f"""WITH {PART}
SELECT path, place * {each} AS index, 'short-string' AS ctype, NULL AS int_val, NULL AS dbl_val, p_name AS str_display, '{profile}' AS profile FROM part_at
UNION ALL SELECT path, place * {each} + 1, 'float', NULL, p_retailprice, NULL, '{profile}' FROM part_at"""
    if each == 3:
        sql += f"\nUNION ALL SELECT path, place * 3 + 2, 'integer', CAST(p_size AS BIGINT), NULL, NULL, '{profile}' FROM part_at"
    name = "undump_" + profile.removeprefix("lua").replace(".", "").replace("-", "_")
    f.__name__ = name
    QUERIES[name], ORACLES[name] = f, sql


for _profile in ("lua5.1", "lua5.1-stock32", "lua5.2"):
    undumped(_profile, 2)
for _profile in ("lua5.3", "lua5.4", "lua5.5"):
    undumped(_profile, 3)


@asked(f"""WITH {PART} SELECT path, CAST(place AS INTEGER) AS pc, 1 + place * 2 * 16384 AS raw_word, CAST(p_size % 100 AS BIGINT) AS line FROM part_at""")
def undump_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines of 5.1 chunks."""
    rows = artifacts.decoded(part_chunks(spark, sf_dir, "lua5.1"))
    return artifacts.facts(rows).words.select("path", "pc", "raw_word", "line")


@asked(f"""WITH {PART} SELECT path, count(*) AS n_instr, 2 * count(*) AS n_const, 'valid-for-parser' AS verdict FROM part_at GROUP BY 1""")
def undump_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each prototype, and its artifact's verdict: no rule is broken."""
    rows = artifacts.decoded(part_chunks(spark, sf_dir, "lua5.1"))
    f = artifacts.facts(rows)
    limits = f.prototypes.select("path", "proto", "maxstacksize", "n_const", "n_upval", "n_protos", F.col("n_instr").alias("n"))
    w = words.decode(f.words).join(limits, ["path", "proto"]).withColumn("target_role", F.lit(None).cast("string"))
    said = validate.verdict(validate.violations(w, validate.rules_51(), ["path"]), f.prototypes, ["path"])
    return f.prototypes.join(said, "path").select("path", F.col("n_instr").cast("long").alias("n_instr"), F.col("n_const").cast("long").alias("n_const"), "verdict")


CALLED = """
called AS (SELECT 'calls-' || CAST(p_partkey // 60 AS BIGINT) AS path, 4 * (row_number() OVER (PARTITION BY p_partkey // 60 ORDER BY p_partkey) - 1) + 3 AS pc,
  CASE WHEN p_size > 5 THEN replace(p_name, ' ', '.') END AS callee_path, p_size FROM part)"""


@asked(f"""WITH {CALLED} SELECT path, CAST(pc AS INTEGER) AS pc, CASE WHEN callee_path IS NULL THEN 'unresolved' ELSE 'resolved-path' END AS status, callee_path, CASE WHEN callee_path IS NULL THEN 'dynamic-key' END AS reason FROM called""")
def callee_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The callee of each call of chunks whose calls are known from the table."""
    return callees.callees(part_calls(spark, sf_dir)).select("path", "pc", "status", F.array_join("segments", ".").alias("callee_path"), "reason")


@asked(f"""WITH {CALLED} SELECT path, CAST(pc AS INTEGER) AS pc, 'fixed' AS window_status, 'literal' AS kind, CAST(p_size AS DOUBLE) AS value FROM called""")
def argument_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin of each call's argument: a number, told by its bits."""
    rows = origins.origins(part_calls(spark, sf_dir)).select("path", "pc", "window_status", F.explode("arguments").alias("a"))
    digits = F.get_json_object("a.expression", "$.parts[0][1]")
    # eight bytes, little-endian: small whole numbers have their exponent and first digits in the last two
    high = F.conv(F.concat(F.substring(digits, 15, 2), F.substring(digits, 13, 2)), 16, 10).cast("long")
    exponent = F.shiftright(high, 4) - 1023
    fraction = high.bitwiseAND(15) / 16 + F.conv(F.substring(digits, 11, 2), 16, 10).cast("long") / 4096
    return rows.select("path", "pc", "window_status", "a.kind", (F.pow(F.lit(2.0), exponent) * (1 + fraction)).alias("value"))


@asked(f"""WITH {CALLED} SELECT path, count(*) AS call_sites, CAST(count(*) FILTER (callee_path = 'red widget') AS BIGINT) AS caller, CAST(count(*) FILTER (callee_path IS NULL) AS BIGINT) AS dynamic_key,
CAST(count(*) FILTER (callee_path IS NOT NULL) AS BIGINT) AS unmapped_label FROM called GROUP BY 1""")
def native_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees, relations and classes of all call sites, from bytes to counts; none calls a prototype that is known."""
    found = part_calls(spark, sf_dir)
    rel = relations.call_relations(callees.callees(found), callees.global_stores(found), ["path", "sha256"])
    sites = rel.withColumns({"names_target": F.lit(False), "names_other": F.col("callee").isNotNull(), "callee_status": F.col("status"), "callee_reason": F.col("reason"), "link_status": F.lit(None).cast("string")})
    c = relations.coverage(relations.classify_sites(sites), "path")
    return c.select("path", "call_sites", "caller", F.coalesce(F.element_at("unattributed_reasons", F.lit("dynamic-key")), F.lit(0)).cast("long").alias("dynamic_key"), "unmapped_label")


@asked(f"""WITH {LINE} SELECT l_orderkey, CAST(pc AS INTEGER) AS pc, mnemonic AS said, 'R(' || a || ')' || CASE mnemonic
  WHEN 'MOVE' THEN ' R(' || b || ')' WHEN 'LOADK' THEN ' K(' || (b * 512 + c) || ')' WHEN 'LOADBOOL' THEN ' ' || (b <> 0) || ' ' || c WHEN 'LOADNIL' THEN ' R(' || b || ')'
  WHEN 'GETUPVAL' THEN ' Upvalue(' || b || ')' WHEN 'GETGLOBAL' THEN ' K(' || (b * 512 + c) || ')' ELSE ' R(' || b || ')' || CASE WHEN c >= 256 THEN ' K(' || (c - 256) || ')' ELSE ' R(' || c || ')' END END AS operands,
  CASE WHEN mnemonic = 'LOADK' AND b * 512 + c >= 5000 OR mnemonic = 'GETTABLE' AND c >= 256 + 200 THEN 'L51-DISASM-002' ELSE '' END AS codes FROM line""")
def disasm_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed operands of each word; constants resolve up to a number of them (200 for a line's seventh word, else 5,000)."""
    w = decoded_lines(spark, sf_dir).withColumn("n_const", F.when(F.col("mnemonic") == "GETTABLE", 200).otherwise(5000))
    d = disasm.disassemble(w)
    return d.select("l_orderkey", "pc", "said", F.array_join(F.transform("operands", lambda o: o["display"]), " ").alias("operands"), F.array_join("codes", ",").alias("codes"))


HEX8 = U64
LITTLE = " || ".join(f"substr(hex(CAST(CAST(p_retailprice AS BIT) AS BLOB)), {15 - 2 * i}, 2)" for i in range(8))


@asked(f"""WITH {PART}, record AS (
  SELECT path, place, '02' || {HEX8.format(11)} || lower(hex(encode('instruction'))) || {HEX8.format(5)} || lower(hex(encode('LOADK'))) || {HEX8.format(2)} || '03200030' || '0321' || {HEX8.format("place * 2")} || '31' || {HEX8.format("place * 2")} AS word,
    '14' || {HEX8.format("octet_length(encode(p_name))")} || lower(hex(encode(p_name))) || '13' || {HEX8.format(8)} || lower({LITTLE}) AS constants FROM part_at)
SELECT path, 'proto:0' AS id, sha256(unhex(lower(hex(encode('scheme'))) || '00' || '01' || {HEX8.format(6)} || lower(hex(encode('lua5.1'))) || '000002' || {HEX8.format("count(*)")} || string_agg(word, '' ORDER BY place)
  || {HEX8.format("2 * count(*)")} || string_agg(constants, '' ORDER BY place) || {HEX8.format(0)} || {HEX8.format(0)})) AS digest FROM record GROUP BY path""")
def prototype_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of the prototypes of 5.1 chunks made from parts."""
    f = artifacts.facts(artifacts.decoded(part_chunks(spark, sf_dir, "lua5.1")))
    return identity.prototypes(f, b"scheme").select("path", "id", "digest")


ORDER_FIELDS = "SELECT o_orderkey, o_custkey % 200 AS a, o_orderkey % 300 AS b, o_custkey % 512 AS c, o_orderkey % 200 AS lb, o_custkey % 250 AS lc, o_orderkey % 2 AS k, o_orderkey // 4 % 4 AS kind FROM orders"
RK = "CASE WHEN {0} >= 256 THEN 'co' || ({0} - 256) ELSE 're' || {0} END"
SPAN = "'re' || {0} || CASE WHEN {1} <> {0} THEN '-' || ({1}) ELSE '' END"


def effects_of(spark: SparkSession, sf_dir: str, profile: str, names: tuple[str, ...]) -> DataFrame:
    said = lambda side: F.array_join(F.transform(side, lambda e: F.concat(F.substring(e["kind"], 1, 2), e["first"].cast("string"), F.when(e["last"] != e["first"], F.concat(F.lit("-"), e["last"].cast("string"))).otherwise(""))), " ").alias(side)
    rows = dispatch.lifted(order_words(spark, sf_dir, profile, names), ["o_orderkey"])
    return rows.select("o_orderkey", "mnemonic", said("reads"), said("writes"), "metamethod", "skip_target")


def lifted_later(dialect: str) -> None:
    sql = f"""WITH o AS ({ORDER_FIELDS}) SELECT o_orderkey, CASE kind WHEN 0 THEN 'GETTABUP' WHEN 1 THEN 'SETTABUP' WHEN 2 THEN 'CONCAT' ELSE 'TESTSET' END AS mnemonic,
  CASE kind WHEN 0 THEN 'up' || b || ' ' || {RK.format("c")} WHEN 1 THEN 'up' || a || ' ' || {RK.format("b")} || ' ' || {RK.format("c")} WHEN 2 THEN CASE WHEN c >= b THEN {SPAN.format("b", "c")} ELSE '' END ELSE 're' || b END AS reads,
  CASE kind WHEN 1 THEN '' ELSE 're' || a END AS writes, CASE kind WHEN 0 THEN '__index' WHEN 1 THEN '__newindex' WHEN 2 THEN '__concat' END AS metamethod, CASE kind WHEN 3 THEN 12 END AS skip_target FROM o"""

    @asked(sql)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return effects_of(spark, sf_dir, f"lua{dialect}", ("GETTABUP", "SETTABUP", "CONCAT", "TESTSET"))

    name = f"lift_{dialect.replace('.', '')}"
    QUERIES[name], ORACLES[name] = QUERIES.pop("f"), ORACLES.pop("f")


lifted_later("5.2")
lifted_later("5.3")


@asked(f"""WITH o AS ({ORDER_FIELDS}) SELECT o_orderkey, CASE kind WHEN 0 THEN 'GETTABUP' WHEN 1 THEN 'SETFIELD' WHEN 2 THEN 'CONCAT' ELSE 'EQI' END AS mnemonic,
  CASE kind WHEN 0 THEN CASE k WHEN 1 THEN 'co' ELSE 're' END || lc || ' up' || lb WHEN 1 THEN CASE k WHEN 1 THEN 'co' ELSE 're' END || lc || ' re' || a || ' co' || lb WHEN 2 THEN CASE WHEN lb >= 1 THEN {SPAN.format("a", "a + lb - 1")} ELSE '' END ELSE 're' || a END AS reads,
  CASE WHEN kind IN (0, 2) THEN 're' || a ELSE '' END AS writes, CASE kind WHEN 0 THEN '__index' WHEN 1 THEN '__newindex' WHEN 2 THEN '__concat' END AS metamethod, CASE kind WHEN 3 THEN 12 END AS skip_target FROM o""")
def lift_54(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects_of(spark, sf_dir, "lua5.4", ("GETTABUP", "SETFIELD", "CONCAT", "EQI"))


@asked("""WITH o AS (SELECT o_orderkey, o_custkey % 200 AS a, o_orderkey % 200 AS lb, o_custkey % 250 AS lc, o_orderkey // 4 % 4 AS kind FROM orders) SELECT o_orderkey, CASE kind WHEN 0 THEN 'GETTABUP' WHEN 1 THEN 'SETFIELD' WHEN 2 THEN 'GETVARG' ELSE 'MMBIN' END AS mnemonic,
  CASE kind WHEN 0 THEN 'up' || lb || ' co' || lc WHEN 1 THEN 're' || a || ' co' || lb WHEN 2 THEN 're' || lb || ' re' || lc ELSE '' END AS reads, CASE WHEN kind IN (0, 2) THEN 're' || a ELSE '' END AS writes,
  CASE kind WHEN 0 THEN '__index' WHEN 1 THEN '__newindex' WHEN 3 THEN CASE lc WHEN 0 THEN '__add' WHEN 1 THEN '__sub' WHEN 2 THEN '__mul' WHEN 3 THEN '__mod' WHEN 4 THEN '__pow' WHEN 5 THEN '__div' WHEN 6 THEN '__idiv' WHEN 7 THEN '__band' WHEN 8 THEN '__bor' WHEN 9 THEN '__bxor'
    WHEN 10 THEN '__shl' WHEN 11 THEN '__shr' WHEN 12 THEN '__unm' WHEN 13 THEN '__bnot' WHEN 14 THEN '__lt' WHEN 15 THEN '__le' WHEN 16 THEN '__concat' WHEN 17 THEN '__len' WHEN 18 THEN '__eq' ELSE '__metamethod' END END AS metamethod, CAST(NULL AS INTEGER) AS skip_target FROM o""")
def lift_55(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects_of(spark, sf_dir, "lua5.5", ("GETTABUP", "SETFIELD", "GETVARG", "MMBIN"))


@asked("""WITH o AS (SELECT o_orderkey, o_custkey % 200 AS a, o_orderkey % 200 AS lb, o_custkey % 250 AS lc, o_orderkey // 4 % 4 AS kind, o_orderkey % 2 AS k FROM orders), w AS (SELECT *, lb * 2 + lc * 512 + k AS bx FROM o)
SELECT o_orderkey, 'L54-VAL-CONST-001' AS code, 'error' AS severity FROM w WHERE kind = 0 AND bx >= 60000 UNION ALL SELECT o_orderkey, 'L54-VAL-UPVAL-001', 'error' FROM w WHERE kind = 1 AND lb >= 100
UNION ALL SELECT o_orderkey, 'L54-VAL-UPVAL-002', 'error' FROM w WHERE kind = 2 AND a >= 100 UNION ALL SELECT o_orderkey, 'L54-VAL-PROTO-001', 'error' FROM w WHERE kind = 3 AND bx >= 70000
UNION ALL SELECT o_orderkey, 'L54-VAL-REG-001', 'warning' FROM w WHERE kind <> 2 AND a >= 150""")
def validate_rules_54(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words.decode(order_words(spark, sf_dir, "lua5.4", ("LOADK", "GETUPVAL", "SETTABUP", "CLOSURE")), "5.4")
    w = w.withColumns({k: F.lit(v) for k, v in {"n": 20, "maxstacksize": 150, "n_const": 60_000, "n_upval": 100, "n_protos": 70_000}.items()})
    return validate.violations(w, validate.rules_54(), ["o_orderkey"]).select("o_orderkey", "code", "severity")


CASES = """
cases AS (SELECT 'case-' || p_partkey AS path, p_partkey % 6 AS kind, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part)"""


@asked(f"""WITH {CASES} SELECT path, 'proto:0/pc:4' AS call_id, CASE WHEN kind = 0 AND one <> two THEN 'unresolved' ELSE 'resolved-path' END AS status, CASE WHEN kind = 0 AND one <> two THEN NULL ELSE one END AS callee_path,
  CASE WHEN kind = 0 AND one <> two THEN 'control-flow-conflict' END AS reason FROM cases WHERE kind IN (0, 1)
UNION ALL SELECT path, 'proto:0/pc:3', 'resolved-prototype', NULL, NULL FROM cases WHERE kind IN (2, 3)
UNION ALL SELECT path, 'proto:0/0/pc:1', CASE kind WHEN 2 THEN 'resolved-path' ELSE 'unresolved' END, CASE kind WHEN 2 THEN one END, CASE kind WHEN 3 THEN 'mutable-capture' END FROM cases WHERE kind IN (2, 3)
UNION ALL SELECT path, 'proto:0/pc:2', 'unresolved', NULL, 'unreachable' FROM cases WHERE kind = 4
UNION ALL SELECT path, 'proto:0/pc:2', 'resolved-path', 'require', NULL FROM cases WHERE kind = 5 UNION ALL SELECT path, 'proto:0/pc:4', 'resolved-path', one || '.' || two, NULL FROM cases WHERE kind = 5""")
def callee_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees where branches meet, through captures that are written later or not, where nothing leads, and through a module that is required."""
    return callees.callees(part_cases(spark, sf_dir)).select("path", "call_id", "status", F.array_join("segments", ".").alias("callee_path"), "reason")


VALUES = """
cases AS (SELECT 'value-' || p_partkey AS path, p_partkey % 6 AS kind, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two FROM part)"""


@asked(f"""WITH {VALUES} SELECT path, CASE WHEN kind = 5 THEN 'open' ELSE 'fixed' END AS window_status, CASE kind WHEN 0 THEN CASE WHEN one = two THEN 'literal' ELSE 'alternatives' END WHEN 1 THEN 'table-literal' WHEN 2 THEN 'parameter' WHEN 3 THEN 'concat' WHEN 4 THEN 'field' END AS kind,
  CASE WHEN kind < 5 THEN false END AS has_unknown FROM cases""")
def origin_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of a call's argument: where branches meet, of a table built before, of a parameter, of text put together, of a field; and an open window."""
    rows = origins.origins(part_cases(spark, sf_dir, "value")).select("path", "window_status", F.explode_outer("arguments").alias("a"))
    return rows.select("path", "window_status", "a.kind", "a.has_unknown")


@asked(f"""WITH {VALUES} SELECT path, CAST(0 AS INTEGER) AS pc, 'read' AS access, CAST(0 AS INTEGER) AS parameter_index, lower(hex(encode(one))) AS key_hex FROM cases WHERE kind = 4
UNION ALL SELECT path, CAST(3 AS INTEGER), 'write', CAST(1 AS INTEGER), lower(hex(encode(two))) FROM cases WHERE kind = 4""")
def parameter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of parameters that are read and written."""
    return origins.parameter_fields(part_cases(spark, sf_dir, "value")).select("path", "pc", "access", "parameter_index", "key_hex")


def module_oracle(dynamic_status: str, dynamic_exports: str) -> str:
    return f"""WITH m AS (SELECT 'module-' || p_partkey AS path, p_partkey % 3 AS kind, replace(p_name, ' ', '.') AS label, 'run' || p_size AS name FROM part)
SELECT path, 'status:' || CASE kind WHEN 0 THEN 'literal' WHEN 1 THEN 'none' ELSE '{dynamic_status}' END AS kind, CASE WHEN kind = 0 OR kind = 2 AND '{dynamic_status}' = 'trusted' THEN label ELSE '' END AS label FROM m
UNION ALL SELECT path, 'export', label || '.' || name FROM m WHERE kind = 0 {dynamic_exports}"""


@asked(module_oracle("dynamic", ""))
def modules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What modules declare; one that calls something else while it starts is not admitted."""
    return modules.module_rows(part_modules(spark, sf_dir)).select("path", "kind", F.array_join("segments", ".").alias("label"))


@asked(module_oracle("trusted", "OR kind = 2"))
def modules_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where what modules call while they start is trusted."""
    return modules.module_rows(part_modules(spark, sf_dir), "trusted-init").select("path", "kind", F.array_join("segments", ".").alias("label"))


@asked("""WITH m AS (SELECT 'module-' || p_partkey AS path, p_partkey % 3 AS kind, replace(p_name, ' ', '.') || '.run' || p_size AS label FROM part), e AS (SELECT label, count(*) AS n, min(path) AS target FROM m WHERE kind IN (0, 2) GROUP BY 1)
SELECT m.path, m.label, CASE WHEN e.n = 1 THEN 'resolved' WHEN e.n > 1 THEN 'duplicate' END AS link_status, CASE WHEN e.n = 1 THEN e.target END AS target_path FROM m JOIN e USING (label) WHERE m.kind = 1""")
def corpus_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a whole corpus resolved against what its modules export, from bytes to links."""
    made = corpus.linked(part_modules(spark, sf_dir), "trusted-init", most_exports=10_000_000)
    return made.links.select("path", F.array_join("segments", ".").alias("label"), "link_status", "target_path")


@asked(f"""WITH {PART}, old AS (SELECT path, 2 * place AS index, 's' || p_name AS v FROM part_at UNION ALL SELECT path, 2 * place + 1, 'f' || p_retailprice FROM part_at),
new AS (SELECT path, 3 * place AS index, 's' || p_name AS v FROM part_at UNION ALL SELECT path, 3 * place + 1, 'f' || p_retailprice FROM part_at UNION ALL SELECT path, 3 * place + 2, 'i' || p_size FROM part_at)
SELECT path, 'constant' AS section, count(*) + 1 AS n FROM old JOIN new USING (path, index) WHERE old.v <> new.v GROUP BY path
UNION ALL SELECT path, 'instruction', count(*) - 1 FROM part_at GROUP BY path UNION ALL SELECT DISTINCT path, 'chunk', 2 FROM part_at""")
def diff_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the same parts, 5.1 and 5.3: headers, constants slot by slot and words differ; names, lines and numbers do not."""
    old, new = (artifacts.facts(cut(artifacts.decoded(part_chunks(spark, sf_dir, p)))) for p in ("lua5.1", "lua5.3"))
    return diff.artifacts(old, new, ["path"]).groupBy("path", "section").agg(F.count("*").alias("n"))


@asked(f"""WITH {PART} SELECT path, 'valid-for-parser' AS verdict, CAST(0 AS BIGINT) AS diagnostics, count(*) AS words, CAST(1 AS BIGINT) AS schema_version FROM part_at GROUP BY path""")
def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as machine documents: chunks of 5.2 and 5.5 made from parts, whose words and constants are all there."""
    f = artifacts.facts(cut(artifacts.decoded(part_chunks(spark, sf_dir, "lua5.2"))))
    said = documents.documents(f, documents.validated(f)).select("path", F.col("document").alias("d"))
    seen = documents.documents(f, documents.inspected(f)).select("path", F.get_json_object("document", "$.data.instruction_count").cast("long").alias("words"))
    field = lambda name, kind: F.get_json_object("d", name).cast(kind)
    return said.join(seen, "path").select("path", field("$.data.verdict", "string").alias("verdict"), field("$.data.diagnostic_count", "long").alias("diagnostics"), "words", field("$.schema_version", "long").alias("schema_version"))


@asked("""SELECT 'module-' || p_partkey AS path, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS call_sites, CAST(0 AS BIGINT) AS caller,
CAST(CASE WHEN p_partkey % 3 = 1 THEN 1 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS rest FROM part""")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of all call sites, answered from an export stream alone."""
    found = part_modules(spark, sf_dir)
    made = stream.coverage(stream.exported(found))
    return made.select("path", "call_sites", "caller", (F.col("call_sites") - F.col("caller")).alias("rest"))

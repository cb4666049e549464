import random
import struct

import pytest

from bytefacts.functions import ids, words
from bytefacts.operators import cfg, diff, lift, validate, xrefs
from bytefacts.plans import predicate, query
from bytefacts.sources import artifacts as source
from bytefacts.sources import chunks
from bytefacts.sources.chunks import MOST_NESTING, Chunk, ChunkError, Constant, Local, Prototype, Upvalue, decode, detect, encode, roles, walk
from pyspark.sql import functions as F

PROFILES = ("lua5.1", "lua5.1-stock32", "lua5.1-lnum32", "lua5.2", "lua5.3", "lua5.4", "lua5.5")


def i51(name, a=0, b=0, c=0, bx=None, sbx=None):
    op = words.opcode_of(name)
    if sbx is not None:
        bx = sbx + 131071
    return op | a << 6 | (bx << 14 if bx is not None else b << 23 | c << 14)


def number(x, profile):
    return Constant("float", x, struct.pack("<d", x))


def sample(profile):
    child = Prototype(b"@child", 3, 4, 1, 0, 3, [i51("GETUPVAL", 0, 0), i51("RETURN", 0, 2)], [Constant("nil")], [Upvalue(1, 0, 0, b"up")], [], [1, 1], [], [Local(b"x", 0, 2)], upvalue_names=1)
    texts = [Constant("short-string", s, s) for s in (b"print", b"", b"\x00\xff\"q\\", b"print")]
    constants = [Constant("nil"), Constant("boolean", True), Constant("boolean", False), number(1.5, profile), *texts]
    if profile in ("lua5.3", "lua5.4", "lua5.5"):
        constants += [Constant("integer", n, n.to_bytes(8, "little", signed=True)) for n in (0, -1, 2**63 - 1, -(2**63))] + [Constant("long-string", b"z" * 300, b"z" * 300)]
    if profile == "lua5.1-lnum32":
        constants += [Constant("integer", -7, (-7).to_bytes(4, "little", signed=True))]
    code = [i51("CLOSURE", 0, bx=0), i51("MOVE", 0, 0), i51("GETGLOBAL", 1, bx=4), i51("CALL", 1, 1, 2), i51("RETURN", 0, 1)]
    main = Prototype(b"@main.lua", 0, 0, 0, 2, 4, code, constants, [Upvalue(0, 0, 0, b"_ENV")] if profile != "lua5.1" else [], [child], [1, 1, 2, 2, 3], [], [Local(b"f", 1, 5)])
    main.upvalue_names = len(main.upvalues)
    if profile.startswith("lua5.1"):
        main.upvalues, main.upvalue_names = [], 0
    if profile in ("lua5.4", "lua5.5"):
        main.lines, main.anchors = [1, 0, -128, 1, -1], [(2, 100)]
    c = Chunk(profile, main, trailing=b"tail", upvalues=len(main.upvalues))
    if profile == "lua5.1-stock32":
        c.size_size = 4
    if profile == "lua5.1-lnum32":
        c.size_size, c.integral = 4, 4
    return c


@pytest.mark.parametrize("profile", PROFILES)
def test_round_trip(profile):
    raw = encode(sample(profile))
    assert detect(raw) == profile
    c = decode(raw)
    assert encode(c) == raw and c.trailing == b"tail"
    want = sample(profile).main
    assert [k.value if k.ctype != "nil" else None for k in c.main.constants] == [k.value for k in want.constants]
    assert [(p, len(q.code)) for p, q in walk(c.main)] == [((0,), 5), ((0, 0), 2)]
    assert c.main.code == want.code and c.main.protos[0].upvalues[0].name == b"up"


@pytest.mark.parametrize("profile", PROFILES)
def test_damaged_chunks_are_refused_and_nothing_else_is_raised(profile):
    raw, r = encode(sample(profile)), random.Random(1)
    for n in range(len(raw) - 5):
        with pytest.raises(ChunkError):
            decode(raw[:n], profile)
    for _ in range(400):
        bad = bytearray(raw)
        for _ in range(r.randint(1, 6)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            decode(bytes(bad), profile)
        except ChunkError:
            pass
    for _ in range(300):
        try:
            decode(raw[:12] + r.randbytes(r.randrange(200)), profile)
        except ChunkError:
            pass


def test_nesting_is_bounded():
    p = Prototype(code=[i51("RETURN", 0, 1)])
    for _ in range(MOST_NESTING + 2):
        p = Prototype(code=[i51("RETURN", 0, 1)], protos=[p])
    with pytest.raises(ChunkError, match="CORE-LIMIT-001"):
        decode(encode(Chunk("lua5.1", p)))


def test_roles_claim_words_once():
    two = Prototype(upvalues=[Upvalue(), Upvalue()])
    p = Prototype(code=[i51("CLOSURE", 0, bx=0), i51("CLOSURE", 0, bx=0), i51("MOVE"), i51("SETLIST", 0, 1, 0), 7, i51("SETLIST", 0, 1, 0)], protos=[two])
    said, faults = roles(p)
    assert [x[0] for x in said] == ["instruction", "closure_binding", "closure_binding", "instruction", "setlist_extra", "instruction"]
    assert faults == [("L51-SETLIST-001", 5)]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("artifacts")
    for p in PROFILES:
        (at / f"{p}.luac").write_bytes(encode(sample(p)))
    (at / "source.lua").write_bytes(b"-- a comment\nprint(1)\n")
    (at / "noise.bin").write_bytes(bytes(range(128, 256)))
    (at / "cut.luac").write_bytes(encode(sample("lua5.4"))[:40])
    found = source.artifacts(spark, str(at)).cache()
    return at, found, source.decoded(found).cache()


def test_classification(spark, tree):
    at, found, rows = tree
    said = {r.path.rsplit("/", 1)[1]: (r.p, r.s) for r in found.select("path", source.profile(F.col("content")).alias("p"), source.skip_code(F.col("content")).alias("s")).collect()}
    assert said["source.lua"] == (None, "PARSE-SOURCE-001") and said["noise.bin"] == (None, "PARSE-UNKNOWN-001")
    assert all(said[f"{p}.luac"] == (p, None) for p in PROFILES) and said["cut.luac"] == ("lua5.4", None)
    status = {r.path.rsplit("/", 1)[1]: r.status for r in source.facts(rows).chunks.collect()}
    assert status["cut.luac"] == "failed" and status["lua5.5.luac"] == "decoded"
    small = source.artifacts(spark, str(at), most=100)
    assert {r.status for r in small.collect()} == {"ok", "limit"} and small.where("status = 'limit' and content is not null").count() == 0


def test_input_list_keeps_order_and_repeats(spark, tree):
    at, *_ = tree
    text = f"  {at}/source.lua \n\n{at}/lua5.1.luac\n{at}/source.lua\n/nowhere\n"
    rows = source.listed(spark, text).orderBy("ord").collect()
    assert [(r.ord, r.status) for r in rows] == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "missing")]


def test_facts_and_bytes(spark, tree):
    _, _, rows = tree
    f = source.facts(rows)
    k = {(r.profile, r["index"]): r for r in f.constants.where("proto = array(0)").collect()}
    assert k[("lua5.1", 6)].str_display == "\\x00\\xff\\\"q\\\\" and k[("lua5.4", 3)].dbl_val == 1.5
    assert k[("lua5.5", 11)].int_val == -(2**63) and k[("lua5.1-lnum32", 8)].int_val == -7
    lines = [r.line for r in f.words.where("profile = 'lua5.4' and proto = array(0)").orderBy("pc").collect()]
    assert lines == [1, 1, 100, 101, 100]
    bound = f.upvalues.where("profile = 'lua5.1' and proto = array(0, 0)").first()
    assert (bound.instack, bound.idx) == (1, 0)
    r = f.words.where("profile = 'lua5.1' and proto = array(0)").orderBy("pc").collect()
    assert [x.role for x in r] == ["instruction", "closure_binding", "instruction", "instruction", "instruction"]
    assert f.words.where("id = 'proto:0/0/pc:1'").count() == len(PROFILES)


def test_lift_xrefs_and_query_over_chunks(spark, tree):
    _, _, rows = tree
    f = source.facts(rows.where("profile = 'lua5.1'"))
    lifted = lift.lift(words.decode(f.words))
    by_pc = {r.pc: r for r in lifted.where("proto = array(0)").collect()}
    assert [tuple(e) for e in by_pc[3].reads] == [("register", 1, 1)] and [tuple(e) for e in by_pc[3].writes] == [("register", 1, 1)]
    assert by_pc[2].metamethod == "__index" and by_pc[3].invalid_from == 1 and by_pc[1].reads == []
    edges = {(r.source, r.target, r.relation) for r in xrefs.effect_edges(lifted, ["path"]).collect()}
    assert edges == {("proto:0/pc:2", "proto:0/constant:4", "reads"), ("proto:0/pc:0", "proto:0/0", "instantiates"), ("proto:0/0/pc:0", "proto:0/0/upvalue:0", "reads")}
    facts = {"instruction": lifted.select("id", "mnemonic", "reads", "writes"), "constant": f.constants.select("id", "ctype", "bool_val", "int_val", "dbl_bits", "str_display")}
    found = query.matches(facts, "GETGLOBAL or constant == 'print' or constant == true or k == 1.5")
    assert {r.id for r in found.collect()} == {"proto:0/pc:2", "proto:0/constant:1", "proto:0/constant:3", "proto:0/constant:4", "proto:0/constant:7"}
    assert query.matches(facts, None).count() == 7


def test_diff_of_one_changed_word(spark):
    a, b = sample("lua5.1"), sample("lua5.1")
    b.main.code[3] = i51("CALL", 1, 1, 1)
    frames = [source.facts(source.decoded(spark.createDataFrame([("x", bytearray(encode(c)))], "path string, content binary"))).words for c in (a, b)]
    out = diff.positional(*frames, ["proto", "pc"], "hex(raw_word)").collect()
    assert [(r.proto, r.pc) for r in out] == [([0], 3)]
    assert diff.positional(frames[0], frames[0], ["proto", "pc"], "hex(raw_word)").count() == 0


def test_validation_finds_one_planted_fault_each(spark):
    limits = {"n": 10, "maxstacksize": 5, "n_const": 2, "n_upval": 1, "n_protos": 1}
    cases = {
        i51("MOVE", 5, 0): {"L51-REG-001"}, i51("MOVE", 0, 5): {"L51-REG-002"}, i51("LOADK", 0, bx=2): {"L51-CONST-003"}, i51("GETUPVAL", 0, 1): {"L51-UPVAL-001"}, i51("EQ", 2, 0, 0): {"L51-BOOL-001"}, 63: {"L51-OP-001"},
        i51("JMP", sbx=20): {"L51-JMP-001"}, i51("ADD", 0, 258, 0): {"L51-CONST-004"}, i51("ADD", 0, 0, 258): {"L51-CONST-005"}, i51("CLOSURE", 0, bx=1): {"L51-PROTO-002"}, i51("CALL", 3, 4, 1): {"L51-REG-SPAN-001"}, i51("CONCAT", 0, 1, 5): {"L51-REG-003"}, i51("MOVE", 4, 4): set(), i51("RETURN", 0, 1): set(),
    }
    frame = words.decode(spark.createDataFrame([(n, w) for n, w in enumerate(cases)], "pc int, raw_word long")).withColumns({k: F.lit(v) for k, v in limits.items()} | {"target_role": F.lit(None).cast("string"), "pc": F.col("pc") % 5})
    found: dict[int, set] = {}
    for r in validate.violations(frame.withColumn("who", F.col("raw_word")), validate.rules_51(), ["who"]).collect():
        found.setdefault(r.who, set()).add(r.code)
    assert found == {w: c for w, c in cases.items() if c}


def test_predicates_are_checked():
    for bad in ("", "mnemonic ==", "(MOVE", "MOVE MOVE", "nonsense == 1", "callee.status == 'x'", "constant == word", "effect.read.register == x", "mnemonic contains 'x'", "callee.path == word", "'open"):
        with pytest.raises(predicate.QueryError):
            predicate.validate(predicate.parse(bad))
    with pytest.raises(predicate.QueryError):
        predicate.validate(predicate.parse("callee.path == 'x'"), "lua5.4")
    with pytest.raises(predicate.QueryError):
        predicate.tokens("a " * 10_001)
    tree = predicate.parse("a == b or c == d and e == f")
    assert isinstance(tree, predicate.Either) and isinstance(tree.right, predicate.Both)
    assert predicate.analyses(predicate.parse("callee.path == 'x' or origin.kind == 'literal'")) == {"callees", "origins"}


def test_number_literals(spark):
    rows = [("integer", 0, None), ("float", None, struct.pack(">d", 0.0).hex()), ("float", None, struct.pack(">d", -0.0).hex()), ("integer", 5, None)]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], "ctype string, int_val long, dbl_bits string, bool_val boolean, str_display string")
    hits = lambda lit: [r.i for r in frame.withColumn("i", F.monotonically_increasing_id()).where(predicate.typed_literal(lit, False)).coalesce(1).collect()]
    assert [len(hits(x)) for x in ("0", "+0", "0.0", "+0.0", "-0", "-0.0", "5.0", "nil")] == [2, 2, 2, 2, 1, 1, 1, 0]


def test_cursors_belong_to_their_question():
    said = query.cursor("abc", "MOVE", 100)
    assert query.offset_of(said, "abc", "MOVE", 150) == 100
    for other in (("abd", "MOVE", 150), ("abc", "LOADK", 150), ("abc", "MOVE", 50)):
        with pytest.raises(predicate.QueryError):
            query.offset_of(said, *other)


def test_graph_fixpoints():
    diamond = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)]
    succ = {0: [1, 2], 1: [3], 2: [3], 3: [0], 5: [3]}
    assert cfg.immediate_dominators(succ) == {0: None, 1: 0, 2: 0, 3: 0}
    assert cfg.frontiers(diamond) == {0: set(), 1: {3}, 2: {3}, 3: set()}
    irreducible = [(0, 1), (0, 2), (1, 2), (2, 1), (1, 3)]
    succ = {0: [1, 2], 1: [2, 3], 2: [1]}
    assert cfg.immediate_dominators(succ) == {0: None, 1: 0, 2: 0, 3: 1}
    assert cfg.frontiers(irreducible)[1] == {2} and cfg.frontiers(irreducible)[2] == {1}
    assert "b0 -> b1" in cfg.dot("p", [(0, 0, 1), (1, 2, 3)], [(0, 1, "fallthrough")])


def test_ids_sort_by_number(spark):
    frame = spark.createDataFrame([([0], 10), ([0], 9), ([0, 1], 1), ([0, 0, 5], 0)], "path array<int>, i int")
    got = [(r.path, r.i) for r in frame.orderBy(ids.sort_key(F.col("path"), "pc", F.col("i"))).collect()]
    assert got == [([0], 9), ([0], 10), ([0, 0, 5], 0), ([0, 1], 1)]


def test_stream_decodes_each_content_once(spark, tmp_path):
    from bytefacts.streaming.artifacts import arriving, decoded_once

    raw = encode(sample("lua5.1"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.luac").write_bytes(raw)
    (tmp_path / "in/b.luac").write_bytes(raw)
    q = decoded_once(arriving(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("rows").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rows").where("kind = 'chunk'").count() == 1 and spark.table("rows").where("kind = 'word'").count() == 7


@pytest.mark.parametrize("profile", PROFILES)
def test_damage_is_named(profile):
    raw, d = encode(sample(profile)), "L" + chunks.dialect_of(profile).replace(".", "")
    code = lambda bad: pytest.raises(ChunkError, decode, bytes(bad), profile).value.code
    assert code(b"x" + raw[1:]) == f"{d}-HEADER-001" and code(raw[:4] + b"\x99" + raw[5:]) == f"{d}-HEADER-002"
    assert code(raw[:6] + b"\x07" + raw[7:]) == (f"{d}-HEADER-003" if d == "L51" else f"{d}-HEADER-004")
    assert code(raw[:-20]) == "CORE-TRUNC-001"
    if d == "L54":
        assert decode(raw[:5] + b"\x01" + raw[6:], profile).main.code
    elif d != "L51":
        assert code(raw[:5] + b"\x01" + raw[6:]) == f"{d}-HEADER-003"


def test_rules_55(spark):
    w = lambda name, **f: words.encode("5.5", opcode=F.lit(words.opcode_of(name, "5.5")), **{k: F.lit(v) for k, v in f.items()})
    cases = [
        (w("MOVE", a=9, b=0), {"L55-REG-001"}), (w("MOVE", a=0, b=9), {"L55-REG-002"}), (w("ADD", a=0, b=0, c=9), {"L55-REG-003"}), (w("SETFIELD", a=0, b=0, c=9), {"L55-REG-003"}), (w("SETFIELD", a=0, b=5, c=9, k=1), {"L55-CONST-002"}),
        (w("LOADKX", a=0), set()), (w("EXTRAARG", ax=9), {"L55-CONST-002"}), (w("EXTRAARG", ax=0), {"L55-COMPANION-001"}), (w("LOADKX", a=0), {"L55-COMPANION-001"}), (w("ERRNNIL", a=0, bx=3), {"L55-CONST-002"}), (w("ERRNNIL", a=0, bx=2), set()),
        (w("GETTABUP", a=0, b=3, c=0), {"L55-UPVAL-002"}), (w("SETTABUP", a=3, b=0, c=0), {"L55-UPVAL-002"}), (w("CLOSURE", a=0, bx=1), {"L55-PROTO-002"}), (w("CALL", a=3, b=4, c=1), {"L55-REG-SPAN-001"}), (w("JMP", sj=90), {"L55-JMP-001"}), (w("FORLOOP", a=0, bx=90), {"L55-JMP-001"}), (F.lit(127), {"L55-OP-001"}),
    ]
    rows = spark.range(1).select(F.posexplode(F.array(*(c for c, _ in cases)))).toDF("pc", "raw_word").withColumn("p", F.lit(1))
    limits = {"n": len(cases), "maxstacksize": 5, "n_const": 2, "n_upval": 3, "n_protos": 1}
    d = validate.neighbours(words.decode(rows, "5.5"), ["p"]).withColumns({k: F.lit(v) for k, v in limits.items()})
    found = {}
    for r in validate.violations(d, validate.rules_55(), ["p"]).collect():
        found.setdefault(r.pc, set()).add(r.code)
    assert [found.get(i, set()) for i in range(len(cases))] == [c for _, c in cases]

import pytest
from pyspark.sql import functions as F

from bytefacts.functions import ids
from bytefacts.operators import modules, relations
from bytefacts.plans import corpus
from bytefacts.sources.chunks import Chunk, encode

from .test_callees import END, proto, s
from .test_chunks import i51, sample
from .test_modules import CALL, DECLARE, STORE, chunk


def caller(*names, odd=False):
    code = [i51("GETGLOBAL", 0, bx=0), *[i51("GETTABLE", 0, 0, 256 + k) for k in range(1, len(names))], i51("CALL", 0, 1, 1), END]
    return encode(Chunk("lua5.1", proto(code, [s(n) for n in names])))


def frame(spark, **files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")


def status(made):
    return {(r.path, ".".join(r.segments)): r.link_status for r in made.links.collect()}


def test_all_six_statuses(spark):
    good = chunk([*DECLARE, *STORE])
    calls = {"c1": caller(b"a", b"b", b"run"), "c2": caller(b"luci", b"gone"), "c3": caller(b"other", b"gone"), "c4": caller(b"x\n", b"y"), "five": encode(sample("lua5.4"))}
    got = status(corpus.linked(frame(spark, m=good, **calls)))
    assert got == {("c1", "a.b.run"): "resolved", ("c2", "luci.gone"): "absent", ("c4", "x\\x0a.y"): "dynamic", ("five", ""): "unsupported"} or got == {("c1", "a.b.run"): "resolved", ("c2", "luci.gone"): "absent", ("c4", "x\\n.y"): "dynamic", ("five", ""): "unsupported"}
    two = status(corpus.linked(frame(spark, m=good, n=good, c1=calls["c1"])))
    assert two == {("c1", "a.b.run"): "duplicate"}
    refused = status(corpus.linked(frame(spark, m=good, bad=None, **calls)))
    assert refused[("c1", "a.b.run")] == refused[("c3", "other.gone")] == "dynamic"
    over = status(corpus.linked(frame(spark, m=good, n=chunk([*DECLARE, *STORE], [*NAMES_B]), **calls), most_exports=1))
    assert over[("c2", "luci.gone")] == "limit_exceeded" and "limit_exceeded" in (over.get(("c1", "a.b.run")), over[("c3", "other.gone")])


NAMES_B = [s(b"module"), s(b"z.z"), s(b"package"), s(b"seeall"), s(b"run"), s(b"print"), s(b"setfenv")]


def test_links_of_an_artifact_are_bounded_and_ordered(spark):
    many = [x for _ in range(5) for x in (i51("GETGLOBAL", 0, bx=0), i51("GETTABLE", 0, 0, 257), i51("CALL", 0, 1, 1))]
    found = frame(spark, a=encode(Chunk("lua5.1", proto([*many, END], [s(b"luci"), s(b"f")]))))
    made = corpus.linked(found, most_links=3).links.orderBy(*relations.link_order()).collect()
    assert [(r.pc, r.link_status) for r in made] == [(2, "absent"), (5, "absent"), (8, "absent"), (11, "limit_exceeded")]


def test_the_corpus_is_bounded(spark):
    found = frame(spark, a=b"x" * 60, b=b"x" * 60)
    assert corpus.bounded(found, 120) is found
    with pytest.raises(corpus.CorpusLimit):
        corpus.bounded(found, 119)
    assert corpus.distinct(found.union(found)).count() == 2


def test_chains_double_and_cycles_raise(spark):
    line = spark.range(70).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = relations.binding_chain(line)
    assert got.count() == 71 * 70 // 2 and got.where("hops != target - source").count() == 0
    with pytest.raises(ValueError):
        relations.binding_chain(spark.createDataFrame([(1, 2), (2, 1)], "source long, target long"))


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = ids.placed(rows.repartition(5), F.col("k"))
    assert got.where("place != k + 1").count() == 0 and got.count() == 1000
    assert ids.placed(rows.limit(0), F.col("k")).count() == 0
    assert modules.MOST_EXPORTS > 0 and CALL

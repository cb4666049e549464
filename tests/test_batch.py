import pytest

from bytefacts.plans import answers, batch, predicate
from bytefacts.sources import artifacts as source
from bytefacts.sources.chunks import Chunk, encode

from .test_callees import END, proto, s
from .test_chunks import i51, sample


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    main = proto([i51("GETGLOBAL", 0, bx=0), i51("GETTABLE", 0, 0, 257), i51("LOADK", 1, bx=2), i51("CALL", 0, 2, 1), END], [s(b"os"), s(b"execute"), s(b"ls")])
    (at / "a.luac").write_bytes(encode(Chunk("lua5.1", main)))
    (at / "b.luac").write_bytes(encode(sample("lua5.4")))
    (at / "c.lua").write_bytes(b"print('os')\n")
    (at / "d.luac").write_bytes(encode(Chunk("lua5.1", main))[:30])
    return source.artifacts(spark, str(at)).cache()


def named(rows):
    return sorted((r.path.rsplit("/", 1)[1], r.id) for r in rows.collect())


def test_only_named_analyses_run(found):
    assert predicate.analyses(predicate.parse("MOVE")) == set()
    plan = batch.ask(found, "MOVE").rows._jdf.queryExecution().toString()
    more = batch.ask(found, "callee.path == 'os.execute' and origin.kind == 'literal'").rows._jdf.queryExecution().toString()
    assert "callee_path" not in plan and "callee_path" in more and "window_status" in more


def test_answers_and_outcomes(found):
    out = batch.ask(found, "callee.path == 'os.execute' and origin.kind == 'literal'")
    assert named(out.rows) == [("a.luac", "proto:0/pc:3")]
    said = {r.path.rsplit("/", 1)[1]: (r.outcome, r.error) for r in out.outcomes.collect()}
    assert said["a.luac"] == ("succeeded", None) and said["b.luac"] == ("failed", "INTERNAL-IDENTITY-001")
    assert said["c.lua"] == ("skipped", "PARSE-SOURCE-001") and said["d.luac"][0] == "failed"
    assert answers.exit_of(out.outcomes) == 0


def test_order_limits_and_entities(found):
    out = batch.ask(found, "constant contains 's' or GETGLOBAL or interpretation.profile == 'lua5.1'", limit=2)
    rows = [(r.id, r.position) for r in out.rows.where("path like '%a.luac'").orderBy("position").collect()]
    assert rows == [("chunk", 1), ("proto:0/pc:0", 2)]
    count = {r.path.rsplit("/", 1)[1]: (r.emitted, r.available, r.is_truncated) for r in out.outcomes.collect()}
    assert count["a.luac"] == (2, 4, True) and count["c.lua"] == (0, 0, False)
    assert batch.ask(found, None).rows.where("path like '%a.luac'").count() == 5
    with pytest.raises(predicate.QueryError):
        batch.ask(found, "callee.path ==")

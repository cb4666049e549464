import pytest

from bytefacts.llm.shards import SMALLEST, Shard, ShardStore, VersionTaken, compacted, plan, tier

from .helpers import edge_docs, got, no_docs


def test_tiers_and_plan():
    assert [tier(x) for x in (0, SMALLEST - 1, SMALLEST, 4 * SMALLEST - 1, 4 * SMALLEST)] == [0, 0, 1, 1, 2]
    small = [Shard(f"s{i}", 10, 1) for i in range(5)]
    large = [Shard(f"l{i}", 8 * SMALLEST, 1) for i in range(3)]
    assert plan(small + large) == [small]
    assert plan(small[:3] + large) == []
    assert plan([Shard(f"t{i}", 64 << 20, 1) for i in range(9)]) == []


def test_compaction_keeps_every_row_and_column(spark, tmp_path):
    docs = edge_docs(spark)
    out = compacted(docs.repartition(6), f"{tmp_path}/store", rows_per_file=2)
    assert out.schema == docs.schema and got(out) == got(docs)
    store = ShardStore(spark, f"{tmp_path}/store")
    assert store.version() == 2 and len(store.shards(1)) >= 6 and len(store.shards()) == 1
    assert sum(s.rows for s in store.shards()) == docs.count()
    assert got(compacted(no_docs(spark), f"{tmp_path}/none")) == []


def test_versions_are_immutable_and_exclusive(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/store")
    docs = edge_docs(spark)
    assert store.version() == 0 and got(store.read(docs.schema)) == []
    for _ in range(4):
        store.append(docs.coalesce(1), 0)
    before = got(store.read(docs.schema))
    assert store.compact(fanout=4) == 5
    assert got(store.read(docs.schema)) == before == got(store.read(docs.schema, 4))
    with pytest.raises(VersionTaken):
        store.commit([], 5)
    assert got(store.read(docs.schema)) == before
    assert len(store.shards()) == 1
    assert store.vacuum() == 4 and got(store.read(docs.schema)) == before


def test_an_append_during_compaction_is_not_lost(spark, tmp_path):
    store, other = ShardStore(spark, f"{tmp_path}/store"), ShardStore(spark, f"{tmp_path}/store")
    docs = edge_docs(spark)
    for _ in range(4):
        store.append(docs.coalesce(1), 0)
    commit, once = store.commit, []

    def late(shards, version):
        if not once:
            once.append(other.append(docs.coalesce(1), 0))
        return commit(shards, version)

    store.commit = late
    store.compact()
    assert store.read(docs.schema).count() == 5 * docs.count()


def test_what_no_version_names_is_not_read(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/store")
    docs = edge_docs(spark)
    store.append(docs)
    docs.write.parquet(f"{tmp_path}/store/data/left-by-a-lost-writer")
    assert store.read(docs.schema).count() == docs.count()

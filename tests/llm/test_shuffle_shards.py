import zlib
from collections import Counter

from creditscope.llm import shuffle_shards as shards


def test_rows_law(awkward, no_rows):
    got = shards.external_shuffle(awkward, n_shards=3, bucket_bytes=30_000).collect()
    assert Counter(r.record.asDict()["text"] for r in got) == Counter(r.text for r in awkward.collect())
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert shards.external_shuffle(no_rows).collect() == []


def test_order_is_shuffled(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 50) as text")
    rows = shards.external_shuffle(df, n_shards=4, bucket_bytes=20_000).collect()
    order = [r.record.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert sorted(order) == list(range(4000)) and len(rows) == 4000
    # Neighbours in the input are apart, and every stretch of the order spans the input.
    near = sum(abs(a - b) <= 10 for a, b in zip(order, order[1:]))
    assert near < 80
    assert all(max(order[i:i + 200]) - min(order[i:i + 200]) > 3000 for i in range(0, 4000, 200))
    other = shards.external_shuffle(df, n_shards=4, bucket_bytes=20_000, seed=1).collect()
    assert order != [r.record.doc_id for r in sorted(other, key=lambda r: (r.slot, r.shard))]


def test_written_shards_read_back(spark, tmp_path):
    df = spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text")
    shards.write_shards(shards.external_shuffle(df, n_shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_native_plan(spark, awkward):
    plan = shards.external_shuffle(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_digest(spark):
    from creditscope.llm.queries import QUERIES
    from tests.conftest import SF001
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op9_sharding"](spark, SF001).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_places_do_not_depend_on_the_partitions(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "repeat('y', 100) as text", "id as `a.b`")
    places = [{r.record.doc_id: (r.shard, r.slot) for r in shards.external_shuffle(
        x, n_shards=4, bucket_bytes=20_000).collect()} for x in (df.coalesce(1), df.repartition(7), df.orderBy("text"))]
    assert places[0] == places[1] == places[2] and len(places[0]) == 1000


def test_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "EQUAL_ROWS", 100)
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text", "id as n").unionByName(
        spark.range(1000).selectExpr("id as doc_id", "'z' as text", "id as n"))
    seen = []
    stored = shards.stored
    monkeypatch.setattr(shards, "stored", lambda t, name: (seen.append(stored(t, name)), seen[-1])[1])
    rows = shards.external_shuffle(df, n_shards=4, bucket_bytes=500).collect()
    sizes = [r["count"] for r in seen[-1].groupBy("bucket").count().collect()]
    assert len(rows) == 4000 and len({(r.shard, r.slot) for r in rows}) == 4000 and max(sizes) < 1200

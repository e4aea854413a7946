"""The sharding query shuffles the records themselves."""

from auditspan.llm import queries, sharding


def test_report_has_the_places_of_the_records(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, queries.op6_sharding(spark, sf_dir).collect())) == sorted(map(key, sharding.sharded(docs).collect()))


def test_equal_rows_scatter(spark):
    """Ten thousand equal rows are dealt over the buckets and shards as others are, and the order is the same however they come."""
    rows = spark.range(30_000).selectExpr("if(id < 10000, null, id) as doc_id", "if(id < 10000, null, concat('text ', id)) as text", "1 as shard")
    out = sharding.sharded(rows, bucket_bytes=4096)
    found = [(r.doc_id, r.shard, r.slot) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "shard", "slot"] and len(found) == 30_000 == len({f[1:] for f in found})
    for shard in range(8):
        own = [d for d, s, _ in found if s == shard]
        assert len(own) == 3750 and 1100 < sum(d is None for d in own) < 1400
    for again in (sharding.sharded(rows.repartition(5), bucket_bytes=4096), sharding.sharded(rows, bucket_bytes=4096, copies=999)):
        assert sorted(map(str, found)) == sorted(str((r.doc_id, r.shard, r.slot)) for r in again.collect())


def test_many_equal_rows_are_numbered_in_ranges(spark):
    """Three million copies of one row and some of others: each has its own number, and no array is longer than `most`."""
    rows = spark.range(3_000_000).selectExpr("7 as doc_id", "'x' as text", "1 as _part").unionAll(spark.range(9).selectExpr("id div 3 as doc_id", "null", "2"))
    for most in (1 << 16, 3_000_000):
        out = sharding._numbered(rows, "n", most)
        assert sorted(map(tuple, out.groupBy("doc_id", "text", "_part").agg({"n": "max"}).collect()), key=str) == [(0, None, 2, 2), (1, None, 2, 2), (2, None, 2, 2), (7, "x", 1, 2_999_999)]
        assert out.distinct().count() == out.count() == 3_000_009


def test_copies_share_a_shard_no_more_than_by_chance(spark):
    rows = spark.range(800).selectExpr("id as doc_id", "concat('text ', id) as text")
    by = {}
    for r in sharding.sharded(rows.union(rows), bucket_bytes=2048).collect():
        by.setdefault(r.doc_id, []).append(r.shard)
    assert 60 < sum(a == b for a, b in by.values()) < 145


def test_order_equals_a_plain_two_pass_shuffle(spark):
    """Buckets end to end, each in the order of its rows' hashes and then permuted, cut into shards of equal counts."""
    rows = spark.range(500).selectExpr("id as doc_id", "if(id % 7 = 0, null, repeat('x', int(id % 50))) as text")
    size = sum((0 if r.text is None else len(r.text)) + 1 for r in rows.collect())
    n = -(-size // 512)
    keyed = rows.selectExpr("doc_id", f"xxhash64({sharding.SEED + 1}, doc_id, text, 0L) as digest", f"int(pmod(xxhash64({sharding.SEED}, doc_id, text, 0L), {n})) as bucket").collect()
    order = []
    for b in range(n):
        own = [r.doc_id for r in sorted(keyed, key=lambda r: r.digest) if r.bucket == b]
        order += [own[i] for i in sharding.fisher_yates(len(own), [sharding.SEED, b])]
    want = {(order[i], s, i - -(-s * 500 // 8)) for i in range(500) for s in [i * 8 // 500]}
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(rows, bucket_bytes=512).collect()} == want

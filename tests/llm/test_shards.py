"""Sharding: the report describes rows that were written, and equal rows do not meet in one bucket."""

import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from docketry.llm import shards
from docketry.llm.common import Scratch, shared_dir


def test_report_is_of_the_written_rows(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "s"), 4, bucket_bytes=20_000)
    held = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    told = shards.assign(docs, 4, bucket_bytes=20_000)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in told.collect()) == held
    files = told.inputFiles()
    assert files and all(shared_dir(spark).split(":")[-1] in f and "/shard=" in f for f in files)


def test_equal_rows_are_spread(spark):
    rows = [(7, "the same text " * 20)] * 3000 + [(i, f"text {i} " * 20) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    at, before, buckets = shards.scatter(df, 4, seed=17, text="text", key="doc_id", bucket_bytes=50_000, bucket_rows=20_000, scratch=Scratch(spark, "t"))
    n = {r["bucket"]: r["count"] for r in at.groupBy("bucket").count().collect()}
    assert sum(n.values()) == len(rows) and max(n.values()) < 400 and set(n) <= {r["bucket"] for r in before.collect()} and buckets >= len(n)
    out = shards.assign(df, 4, bucket_bytes=50_000).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in by.values())


def rendezvous(key, shards, seed):
    """The shard of greatest seeded hash, by XXH64 alone."""
    best = []
    for s in range(shards):
        h = 42
        for raw in (seed.to_bytes(4, "little"), s.to_bytes(4, "little"), b"" if key is None else key.to_bytes(8, "little", signed=True)):
            h = xxhash.xxh64_intdigest(raw, h) if raw else h
        best.append((h - (1 << 64) if h >> 63 else h, s))
    return max(best)[1]


def test_rendezvous(docs):
    for r in shards.assign(docs, 7, seed=5).collect():
        assert (r.shard, r.grown_shard) == (rendezvous(r.doc_id, 7, 5), rendezvous(r.doc_id, 8, 5))


def test_nothing_is_lost(spark, tmp_path):
    """Columns named like the operator's own, with a leading underscore, and with its inner names keep their values."""
    rows = [(i, f"t{i % 3}", i, f"s{i}", -i, "r", 1.5) for i in range(60)] + [(None, None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, Slot string, _keep int, row string, bucket double")
    assert shards.write_shards(df, str(tmp_path / "s"), 4, bucket_rows=5) == ("shard_", "slot_")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    by = defaultdict(list)
    for r in back.collect():
        by[r["shard_"]].append(r["slot_"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_each_bucket_is_one_shuffle(spark, tmp_path):
    """Over many seeds each row of a bucket comes first about equally often; a bucket's rows have adjoining slots."""
    df = spark.createDataFrame([(i, "x") for i in range(8)], "doc_id long, text string").coalesce(1)
    first = Counter()
    for seed in range(120):
        got = {r.slot: r.doc_id for r in df.groupBy().agg(F.shuffle(F.sort_array(F.collect_list("doc_id")), F.lit(seed)).alias("x")).select(F.posexplode("x").alias("slot", "doc_id")).collect()}
        assert sorted(got.values()) == list(range(8))
        first[got[0]] += 1
    assert len(first) == 8 and sum((n - 15) ** 2 / 15 for n in first.values()) < 24.3  # chi-square, 7 degrees, 0.1 %
    out = {r.slot: r.doc_id for r in shards.assign(df, 1, seed=3, bucket_rows=100).collect()}
    assert [out[i] for i in range(8)] != list(range(8)) and sorted(out.values()) == list(range(8))

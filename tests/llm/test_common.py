"""Components to the fixed point, joins of hot keys, the shared folder."""

import random
from types import SimpleNamespace

import pytest

from docketry.llm import common, graph


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("most", [5, 50_000])
def test_components(spark, most):
    """A long path, a hub, random pairs; loops, repeats and null ends."""
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1100)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(120)]
    df = spark.createDataFrame([*edges, (5, 5), (3, 4), (None, 7), (7, None)], "a long, b long")
    got = graph.components(df, common.Scratch(spark, "t"), most).collect()
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert {x.node: x.root for x in got} == want and len(got) == len(want)
    assert graph.components(df.limit(0), common.Scratch(spark, "t")).count() == 0


def test_spread_join(spark):
    rows = spark.createDataFrame([(i % 7 if i < 300 else 99, i) for i in range(1000)] + [(None, 5), (8, 6), (8, 6)], "x long, y long")
    one = spark.createDataFrame([(0, "a"), (99, "b"), (50, "c"), (8, "d")], "x long, z string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(one, "x", how).collect()))
        assert sorted(map(str, common.spread_join(rows, one, "x", 100, how).collect())) == want
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        at = common.spread_join(rows, one, "x", 100).withColumn("t", common.F.spark_partition_id())
        assert at.where("x = 99").select("t").distinct().count() > 1
    finally:
        for k in off:
            spark.conf.unset(k)


def test_shared_dir_must_be_named_on_a_cluster():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
    assert common.shared_dir(session("local[2]"))


def test_small_batches(spark):
    """Batches are small unless the session asks for a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "2000"), ("5000", "5000")):
            spark.conf.set(key, given)
            common.small_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)

"""Ranking metrics, label handling and paired tests over run and label tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.config import SEED


def merge_labels(draft: DataFrame, reviewed: DataFrame) -> DataFrame:
    """qid, doc, grade: a reviewed grade wins over a drafted one."""
    r = reviewed.select("qid", "doc", F.col("grade").alias("r"))
    return draft.join(r, ["qid", "doc"], "full_outer").select("qid", "doc", F.coalesce("r", "grade").alias("grade"))


def label_provenance(draft: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Counts of drafted, reviewed and changed pairs; reviewed without a draft counts as changed."""
    r = reviewed.select("qid", "doc", F.col("grade").alias("r"), F.lit(1).alias("in_r"))
    d = draft.select("qid", "doc", F.col("grade").alias("d"), F.lit(1).alias("in_d"))
    both = d.join(r, ["qid", "doc"], "full_outer")
    return both.agg(F.count("in_d").alias("draft_pairs"), F.count("in_r").alias("reviewed_pairs"), F.count(F.when(F.col("in_r").isNotNull() & ~F.col("d").eqNullSafe(F.col("r")), 1)).alias("changed"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def per_query(run: DataFrame, labels: DataFrame) -> DataFrame:
    """system, qid and the seven metrics; run(system, qid, rank, doc), labels(qid, doc, grade).

    Unjudged is grade 0.  Queries without a relevant document are left out; a system that returned nothing
    for a query scores 0.
    """
    ideal = labels.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "doc")))
    best = ideal.groupBy("qid").agg(
        F.sum(F.when(F.col("grade") >= 1, 1).otherwise(0)).alias("relevant"),
        F.sum(F.when(F.col("r") <= 5, _gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal5"),
        F.sum(F.when(F.col("r") <= 10, _gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal10"),
    ).where("relevant > 0")
    judged = run.join(labels, ["qid", "doc"], "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    top = lambda k, c: F.when(F.col("rank") <= k, c)
    hit = F.when(F.col("g") >= 1, 1).otherwise(0)
    sums = judged.groupBy("system", "qid").agg(
        F.sum(top(5, hit)).alias("h5"), F.sum(top(10, hit)).alias("h10"),
        F.min(F.when((F.col("g") >= 1) & (F.col("rank") <= 5), F.col("rank"))).alias("first"),
        F.sum(top(5, _gain(F.col("g"), F.col("rank")))).alias("d5"), F.sum(top(10, _gain(F.col("g"), F.col("rank")))).alias("d10"),
        F.count(top(5, F.col("grade"))).alias("j5"),
    )
    grid = run.select("system").distinct().crossJoin(best)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return grid.join(sums, ["system", "qid"], "left").select(
        "system", "qid", (z("h5") / 5).alias("p5"), (z("h5") / F.col("relevant")).alias("r5"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr5"),
        (F.coalesce("d5", F.lit(0.0)) / F.col("ideal5")).alias("ndcg5"), (z("h10") / 10).alias("p10"),
        (F.coalesce("d10", F.lit(0.0)) / F.col("ideal10")).alias("ndcg10"), (z("j5") / 5).alias("judged5"),
    )


METRICS = ("p5", "r5", "mrr5", "ndcg5", "p10", "ndcg10", "judged5")


def summarize(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*(by or ("system",))).agg(*[F.avg(m).alias(m) for m in METRICS])


def build_pool(run: DataFrame, depths: DataFrame) -> DataFrame:
    """run(system, qid, rank, doc) cut at depths(system, depth), distinct, in a seeded blind order."""
    rows = run.join(F.broadcast(depths), "system").where(F.col("rank") <= F.col("depth")).select("qid", "doc").distinct()
    w = Window.partitionBy("qid").orderBy(F.xxhash64(F.lit(SEED), "qid", "doc"), "doc")
    return rows.withColumn("pos", F.row_number().over(w))


def paired_differences(metrics: DataFrame, a: str, b: str, metric: str = "ndcg5") -> DataFrame:
    """qid, d: system a minus system b over the queries both have."""
    x = metrics.where(F.col("system") == a).select("qid", F.col(metric).alias("x"))
    y = metrics.where(F.col("system") == b).select("qid", F.col(metric).alias("y"))
    return x.join(y, "qid").select("qid", (F.col("x") - F.col("y")).alias("d"))


def paired_bootstrap(diffs: DataFrame, n: int = 10_000, seed: int = SEED, block: int = 1 << 14, share: int = 500) -> DataFrame:
    """Mean difference, 95 % interval, sign-flip p-value, wins, losses, ties; no row for fewer than two queries.

    Queries are dealt by hash to blocks of about ``block``.  A draw first deals its picks to the blocks (multinomial), then
    picks within each, so that it is one of n from n; ``share`` draws of a block are one unit of work.  Generators are
    seeded with (seed, draw, block), so each draw is the same on any cluster.
    """
    spark = diffs.sparkSession
    dealt = lambda k: diffs.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "qid"), F.lit(k)).cast("int"))
    sizes = {r["b"]: r["count"] for r in dealt(max(1, -(-diffs.count() // block))).groupBy("b").count().collect()}
    total, names = sum(sizes.values()), sorted(sizes)
    odds = [sizes[b] / total for b in names]
    packed = dealt(max(1, -(-total // block))).groupBy("b").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "d"))), lambda x: x["d"]).alias("d"))

    def run(batches):
        for batch in batches:
            for b, d, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d, draws = np.array(d, float), np.arange(start, min(n, start + share))
                boot, perm, mine = [], [], names.index(b)
                for draw in draws.tolist():
                    picks = np.random.default_rng([seed, draw]).multinomial(total, odds)[mine]
                    rng = np.random.default_rng([seed, draw, b + 1])
                    boot.append(d[rng.integers(0, len(d), picks)].sum())
                    perm.append(d.sum() - 2 * d[rng.integers(0, 2, len(d), np.int8) == 1].sum())
                yield pa.RecordBatch.from_pydict({"id": pa.array(draws), "boot": pa.array(boot, pa.float64()), "perm": pa.array(perm, pa.float64())})

    units = packed.crossJoin(F.broadcast(spark.range(0, n, share))).repartition(max(1, min(2000, len(names) * -(-n // share))), "b", "id")
    sums = units.select("b", "d", "id").mapInArrow(run, "id long, boot double, perm double").groupBy("id").agg(F.sum("boot").alias("boot"), F.sum("perm").alias("perm"))
    stats = diffs.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.sum((F.col("d") > 0).cast("int")).alias("wins"), F.sum((F.col("d") < 0).cast("int")).alias("losses"), F.sum((F.col("d") == 0).cast("int")).alias("ties")).where("n >= 2")
    means = sums.crossJoin(F.broadcast(stats)).withColumn("boot", F.col("boot") / F.col("n")).withColumn("perm", F.abs(F.col("perm") / F.col("n")))
    out = (
        means.withColumn("ge", (F.col("perm") >= F.abs("mean") - 1e-12).cast("int"))
        .groupBy("n", "mean", "wins", "losses", "ties")
        .agg(F.percentile("boot", F.lit(0.025)).alias("ci_low"), F.percentile("boot", F.lit(0.975)).alias("ci_high"), ((F.sum("ge") + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    )
    return out.withColumnRenamed("n", "n_queries")


def set_scores(predicted: DataFrame, gold: DataFrame, *keys: str) -> DataFrame:
    """Micro precision, recall and F1 of two sets of rows; null on a zero denominator."""
    p = predicted.select(*keys).distinct().withColumn("in_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("in_g", F.lit(1))
    c = p.join(g, list(keys), "full_outer").agg(F.count(F.when(F.col("in_p").isNotNull() & F.col("in_g").isNotNull(), 1)).alias("tp"), F.count("in_p").alias("np"), F.count("in_g").alias("ng"))
    precision, recall = F.col("tp") / F.nullif(F.col("np"), F.lit(0)), F.col("tp") / F.nullif(F.col("ng"), F.lit(0))
    return c.select("tp", "np", "ng", precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / F.nullif(F.col("np") + F.col("ng"), F.lit(0))).alias("f1"))


def provision_scores(predicted: DataFrame, gold: DataFrame, key: str = "doc") -> DataFrame:
    """variant, tp, np, ng, precision, recall, f1 of (key, act_id, ref): strict, and lenient, where the reference alone counts."""
    strict = set_scores(predicted, gold, key, "act_id", "ref").select(F.lit("strict").alias("variant"), "*")
    return strict.unionByName(set_scores(predicted, gold, key, "ref").select(F.lit("lenient").alias("variant"), "*"))


def best_per_metric(table: DataFrame) -> DataFrame:
    """metric, best, systems: the greatest mean of each metric (9 places) and the systems that reach it, by name."""
    long = table.select("system", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in METRICS])).alias("x")).select("system", "x.*")
    top = long.groupBy("metric").agg(F.max("value").alias("best"))
    return long.join(top, "metric").where(F.col("value") == F.col("best")).groupBy("metric", "best").agg(F.sort_array(F.collect_list("system")).alias("systems"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Accuracy and macro-F1 over the classes that occur on either side."""
    c = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    flat = c.select(F.explode(F.array(F.struct(F.col("g").alias("c"), F.lit("g").alias("side"), "n", (F.col("g") == F.col("p")).alias("ok")), F.struct(F.col("p").alias("c"), F.lit("p").alias("side"), "n", (F.col("g") == F.col("p")).alias("ok")))).alias("x")).select("x.*")
    f1 = flat.groupBy("c").agg((F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"))
    acc = c.agg((F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return f1.agg(F.avg("f1").alias("macro_f1")).crossJoin(acc)

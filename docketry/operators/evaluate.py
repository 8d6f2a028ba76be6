"""Tables of an evaluation and of a corpus's report: runs with labels, splits by intent, agreement, overlaps, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import tokenize
from docketry.operators import metrics
from docketry.operators.scoring import candidate_pool


def with_metadata(rows: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Rows that have metadata, with it; of repeated metadata keys the least row holds."""
    rest = [c for c in meta.columns if c != key]
    one = meta.groupBy(key).agg(F.min(F.struct(*rest)).alias("_m")).select(key, "_m.*")
    return rows.join(one, key)


def without_counterpart(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks: files not yet read, cases without features.  A null key has no counterpart."""
    return rows.join(others.select(key), key, "left_anti")


def judged_run(run: DataFrame, labels: DataFrame) -> DataFrame:
    """run(system, qid, doc, rank) with grade and judged; an unjudged document has grade 0."""
    return run.join(labels, ["qid", "doc"], "left").withColumn("judged", F.col("grade").isNotNull()).fillna(0, ["grade"])


def cut_run(run: DataFrame, depth: int) -> DataFrame:
    return run.where(F.col("rank") <= depth)


def by_intent(per_query: DataFrame, queries: DataFrame, metric: str = "ndcg5") -> DataFrame:
    """system, intent, explicit, mean, n: a metric by intent, and within it by whether the query names a provision; null for "all".

    queries(qid, intent, explicit).
    """
    rows = per_query.join(queries, "qid")
    out = rows.rollup("system", "intent", "explicit").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    return out.select("system", "intent", "explicit", "mean", "n", F.col("_g").cast("int").alias("level"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """agreement, n over the rows that have both."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def spot_precision(rows: DataFrame, check: str, correct: Column) -> DataFrame:
    """check, precision, n of hand-checked samples."""
    return rows.groupBy(check).agg(F.avg(correct.cast("int")).alias("precision"), F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, by: str, ms: str) -> DataFrame:
    """by, median, p95, interpolated between neighbours."""
    return rows.groupBy(by).agg(F.percentile(ms, F.lit(0.5)).alias("median"), F.percentile(ms, F.lit(0.95)).alias("p95"))


def most_frequent(rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """key, n of the ``k`` most frequent values, ties by the value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def dataset_stats(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", by: str = "lang", size: str = "n_chars", label: str = "quality") -> DataFrame:
    """by, median size, and how many rows are good, bad, unlabelled; of repeated labels the greatest holds."""
    one = labels.groupBy(key).agg(F.max(label).alias("_l"))
    j = docs.join(one, key, "left")
    return j.groupBy(by).agg(F.percentile(size, F.lit(0.5)).alias("median_chars"), F.count_if(F.col("_l") == 1).alias("good"), F.count_if(F.col("_l") == 0).alias("bad"), F.count_if(F.col("_l").isNull()).alias("unknown"))


def vocabulary_coverage(queries: DataFrame, vocabulary: DataFrame, *, query: str = "item_id", text: str = "text") -> DataFrame:
    """query, coverage: the share of a query's tokens, repeats counted, that vocabulary(term) knows."""
    asked = queries.select(query, F.explode(tokenize(F.col(text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("tf"))
    known = asked.join(vocabulary.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    return known.groupBy(query).agg((F.sum(F.col("tf") * F.coalesce("known", F.lit(0))) / F.sum("tf")).alias("coverage"))


def top_overlap(tops: DataFrame, k: int = 5) -> DataFrame:
    """overlap: the mean share of documents that two queries' top ``k`` have in common, over all pairs of tops(qid, doc).

    Counted by document (n queries share n (n - 1) / 2 pairs), so that no pairs are formed.
    """
    tops = tops.select("qid", "doc").distinct()
    shared = tops.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("shared"))
    n = tops.agg(F.count_distinct("qid").alias("n"))
    return shared.crossJoin(n).where("n > 1").select((F.col("shared") / k / (F.col("n") * (F.col("n") - 1) / 2)).alias("overlap"))


def run_stability(runs: DataFrame, k: int = 5) -> DataFrame:
    """a, b, overlap: the mean share of the top ``k`` that two repeats of one system have in common; runs(repeat, qid, doc, rank)."""
    top = runs.where(F.col("rank") <= k).select("repeat", "qid", "doc").distinct()
    n = top.groupBy("repeat").agg(F.count_distinct("qid").alias("n"))
    both = top.withColumnRenamed("repeat", "a").join(top.withColumnRenamed("repeat", "b"), ["qid", "doc"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = n.select(F.col("repeat").alias("a"), "n").crossJoin(n.select(F.col("repeat").alias("b"))).where("a < b")  # a handful of repeats
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (F.coalesce("c", F.lit(0)) / k / F.col("n")).alias("overlap"))


def linked_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc, n: how many of seeds(doc) a document cites or is cited by."""
    return both_ways(edges).select(F.col("a").alias("doc"), F.col("b").alias("other")).join(seeds.select(F.col("doc").alias("other")).distinct(), "other", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b: every edge(src, dst) in both directions, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def in_pool(signals: DataFrame, k: int = 100) -> DataFrame:
    """The signal rows of documents that some signal nominates."""
    return signals.join(candidate_pool(signals, k), ["qid", "doc"], "left_semi")


def top_evidence(parts: DataFrame, *by: str, k: int = 3) -> DataFrame:
    """by, keys: the ``k`` authorities of greatest contribution (then the greater key) of parts(by, key, part)."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("part", "key")), asc=False), 1, k)
    return parts.groupBy(*by).agg(F.transform(best, lambda x: x["key"]).alias("keys"))


def ordered(rows: DataFrame, *order: Column | str, name: str = "pos", start: int = 0) -> DataFrame:
    """``rows`` with their place in a total order, from ``start``.

    Sorted by ranges and written once; then each range's rows are numbered behind the rows of the ranges before it, so no
    task sees more than its range.
    """
    from docketry.sources.shared import Scratch

    rows = Scratch(rows.sparkSession, "ordered").put(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row for each range
    out = rows.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.withColumn(name, (F.col("_before") + place + start).cast("int")).drop("_id", "_p", "_before")


def select_by_prefix(scores: DataFrame, *, config: str = "config", score: str = "score", size: int = 1) -> DataFrame:
    """prefix, system: of the configurations whose names begin alike the best, ties to the greater name."""
    return scores.groupBy(F.substring(config, 1, size).alias("prefix")).agg(F.max_by(config, F.struct(F.round(score, 9), config)).alias("system"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both with side "both", and rows of ``a`` alone with side "left"; each once."""
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


def report(run: DataFrame, labels: DataFrame, queries: DataFrame, main: str, *, pairs: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """The tables of a report: per_query, main_table, by_intent, tests (paired, of the main system against each other one)."""
    per_query = metrics.per_query(run, labels)
    if pairs is None:
        pairs = [(main, r.system) for r in run.select("system").distinct().orderBy("system").collect() if r.system != main]  # a few dozen systems
    tests = None
    for a, b in pairs:
        t = metrics.paired_bootstrap(metrics.paired_differences(per_query, a, b)).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*")
        tests = t if tests is None else tests.unionByName(t)
    out = {"per_query": per_query, "main_table": metrics.summarize(per_query), "by_intent": by_intent(per_query, queries)}
    return out | ({"tests": tests} if tests is not None else {})


def write_report(tables: dict[str, DataFrame], to: str, form: str = "parquet") -> None:
    """Each table in a folder of its own under ``to``."""
    from docketry.sources.records import write_records

    for name, df in tables.items():
        write_records(df, f"{to}/{name}", form=form)

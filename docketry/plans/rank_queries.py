"""Joins, aggregates, windows, sets, scoring and evaluation queries (D to J)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.config import ADAPTIVE, FIXED, INTENTS, PAIRWISE, RUN_DEPTH, STOPWORDS, TABLE
from docketry.config import SIGNALS as SIGNAL_NAMES
from docketry.functions import legal as L
from docketry.functions import vectors as V
from docketry.operators import corpus, metrics
from docketry.operators import entities as E
from docketry.operators import evaluate as EV
from docketry.operators import intents as I
from docketry.operators import labels as LB
from docketry.operators import retrieval as R
from docketry.operators import scoring as S
from docketry.plans import systems as SY
from docketry.plans.fixtures import CITES, LABELS, RUN, SIGNALS, query, rows, table, tok

_BM25 = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) x GROUP BY 1, 2),
  l AS (SELECT doc_id, len({tok('text')}) AS dl FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS av FROM l),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM f, s), m AS (SELECT avg(raw) AS mean FROM r),
  i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, m),
  q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) x GROUP BY 1, 2),
  b AS (SELECT item_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM q JOIN i USING (term) JOIN p USING (term) JOIN l ON l.doc_id = p.doc_id, s GROUP BY 1, 2)"""


def _bm25(s, d):
    return R.bm25(table(s, d, "documents"), table(s, d, "benchmark"))


@query("E03_bm25_topk", f"WITH {_BM25}, k AS (SELECT item_id, doc_id, round(score, 6) AS score FROM b), w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM k WHERE score > 0) SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM w WHERE rank <= 10")
def e03(s, d):
    return R.top_k(_bm25(s, d).withColumn("score", F.round("score", 6)), 10, by="item_id", tie="doc_id", positive=True)


@query("D04_bm25_scores", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 4) AS score FROM b")
def d04(s, d):
    return _bm25(s, d).withColumn("score", F.round("score", 4))


@query("D01_metadata_join", "SELECT c_custkey AS key, c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def d01(s, d):
    meta = table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return EV.with_metadata(table(s, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), meta, "key").groupBy("key", "c_name").agg(F.count(F.lit(1)).alias("n"))


@query("D02_missing_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d02(s, d):
    held = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return EV.without_counterpart(table(s, d, "customer").select("c_custkey"), held, "c_custkey")


@query("D03_features_join", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def d03(s, d):
    return EV.with_metadata(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _grams(name: str, key: str, source: str) -> str:
    return f"""{name}t AS (SELECT {key}, list_filter({tok('text')}, lambda x: NOT list_contains({_STOP}, x)) AS t FROM {source}),
  {name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}t) x GROUP BY 1, 2)"""


_TFIDF = f"""{_grams('tf', 'doc_id', 'documents')}, tn AS (SELECT count(*) AS n FROM documents), tdf AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  vo AS MATERIALIZED (SELECT term, ln((1 + n) / (1.0 + df)) + 1 AS idf FROM tdf, tn WHERE df >= 2 AND df <= 0.5 * n),
  w AS MATERIALIZED (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vo USING (term)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1)"""


@query("D05_tfidf_scores", f"""WITH {_TFIDF}, {_grams('qt', 'item_id', 'benchmark')}, qw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS q FROM qt JOIN vo USING (term)), qz AS (SELECT item_id, sqrt(sum(q * q)) AS qz FROM qw GROUP BY 1)
  SELECT item_id, doc_id, round(sum(q * w) / (any_value(z) * any_value(qz)), 6) AS score FROM qw JOIN w USING (term) JOIN z USING (doc_id) JOIN qz USING (item_id) GROUP BY 1, 2""")
def d05(s, d):
    return R.tfidf_scores(table(s, d, "documents"), table(s, d, "benchmark")).withColumn("score", F.round("score", 6))


@query("D06_vector_scores", """WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)
  SELECT qid, vec_id, round(list_sum(list_transform(list_zip(embedding, qv), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 5) AS score FROM embeddings, q""")
def d06(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return R.vector_scores(e, q).select("qid", "vec_id", F.round("score", 5).alias("score"))


@query("D10_in_corpus_links", "SELECT DISTINCT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_orderkey WHERE a.o_orderkey <> b.o_orderkey")
def d10(s, d):
    o = table(s, d, "orders")
    return S.in_corpus_links(o.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("scr")), o.select(F.col("o_orderkey").alias("doc"), F.col("o_orderkey").alias("scr")))


@query("D11_named_fuzzy_match", """WITH a AS (SELECT DISTINCT l_suppkey % 50 AS x, l_partkey % 5 AS y FROM lineitem), q AS (SELECT n_nationkey AS z FROM nation), m AS (SELECT z, x, y, 0.6 + 0.4 * (1 + CASE WHEN y = z % 5 THEN 1 ELSE 0 END) / 2.0 AS score FROM a JOIN q ON x = z)
  SELECT z, concat('supplier ', x, ' v part ', y) AS key, round(score, 6) AS score FROM m WHERE score >= 0.75""")
def d11(s, d):
    a = rows(s, d, "SELECT DISTINCT concat('supplier ', l_suppkey % 50, ' v part ', l_partkey % 5) AS key FROM lineitem")
    q = table(s, d, "nation").select(F.col("n_nationkey").alias("z"), F.array(F.concat(F.lit("supplier "), "n_nationkey", F.lit(" v part "), F.col("n_nationkey") % 5)).alias("asked"))
    return S.match_precedents(q, a, query="z", slack=1.0).select("z", "key", F.round("score", 6).alias("score"))


@query("D12_first_party_contains", "SELECT o_orderkey AS qid, concat('supplier ', s_suppkey, ' v region ', s_nationkey) AS key FROM orders JOIN supplier ON o_custkey = s_suppkey")
def d12(s, d):
    keys = rows(s, d, "SELECT DISTINCT concat('supplier ', s_suppkey, ' v region ', s_nationkey) AS key FROM supplier")
    said = rows(s, d, "SELECT o_orderkey AS qid, concat('what did Supplier ', o_custkey, ' say of bail') AS text FROM orders").withColumn("asked", F.array().cast("array<string>"))
    return S.match_precedents(said, keys, text="text").select("qid", "key")


_AUTH = f"SELECT doc, concat('a', auth) AS key, ord AS pos, polarity FROM ({CITES}) c"
_COLLAPSED = f"SELECT doc, key, coalesce(max_by(polarity, pos) FILTER (WHERE polarity <> 'neutral'), 'neutral') AS polarity FROM ({_AUTH}) a GROUP BY doc, key"


def _collapsed(s, d):
    return S.collapse_polarity(rows(s, d, _AUTH))


@query("H07_collapse_polarity", f"SELECT polarity, key, count(*) AS n FROM ({_COLLAPSED}) x GROUP BY 1, 2")
def h07(s, d):
    # several items of one order may share an authority; positions are unique in an order
    return _collapsed(s, d).groupBy("polarity", "key").agg(F.count(F.lit(1)).alias("n"))


_STATS = f"SELECT key, count(DISTINCT doc) AS df, ln(1 + (SELECT count(DISTINCT l_orderkey) FROM lineitem) / count(DISTINCT doc)) AS idf FROM ({_AUTH}) a GROUP BY key"


def _stats(s, d):
    a = rows(s, d, _AUTH)
    return S.authority_stats(a, a.agg(F.count_distinct("doc").alias("n")))


@query("E02_authority_idf", f"SELECT key, df, round(idf, 6) AS idf FROM ({_STATS}) x")
def e02(s, d):
    return _stats(s, d).withColumn("idf", F.round("idf", 6))


_SEEDS = "SELECT DISTINCT o_orderkey AS doc FROM orders WHERE o_orderkey % 100 = 0"
_EDGES = "SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey <> o_custkey"


@query("D13_shared_authorities", f"""WITH c AS ({_COLLAPSED}), st AS ({_STATS}), se AS ({_SEEDS}), v AS (SELECT key, count(*) AS votes FROM c JOIN se USING (doc) WHERE key IN (SELECT key FROM st WHERE df >= 2) GROUP BY key)
  SELECT doc, round(sum((votes - CASE WHEN doc IN (SELECT doc FROM se) THEN 1 ELSE 0 END) * idf * CASE polarity WHEN 'positive' THEN 1.0 ELSE 0.8 END), 5) AS part FROM c JOIN v USING (key) JOIN st USING (key)
  WHERE votes - CASE WHEN doc IN (SELECT doc FROM se) THEN 1 ELSE 0 END > 0 GROUP BY doc""")
def d13(s, d):
    none = rows(s, d, _EDGES).where("false")
    out = S.shared_scores(_collapsed(s, d), _stats(s, d), rows(s, d, _SEEDS), none)
    return out.select("doc", F.round(F.expm1("score"), 5).alias("part"))


@query("D14_linked_seeds", f"WITH e AS (SELECT src AS doc, dst AS other FROM ({_EDGES}) x UNION SELECT dst, src FROM ({_EDGES}) y) SELECT doc, count(*) AS n FROM e WHERE other IN (SELECT doc FROM ({_SEEDS}) z) GROUP BY doc")
def d14(s, d):
    return EV.linked_seeds(rows(s, d, _EDGES), rows(s, d, _SEEDS))


@query("H06_citation_scores", f"""WITH c AS ({_COLLAPSED}), st AS ({_STATS}), se AS ({_SEEDS}), v AS (SELECT key, count(*) AS votes FROM c JOIN se USING (doc) WHERE key IN (SELECT key FROM st WHERE df >= 2) GROUP BY key),
  p AS (SELECT doc, (votes - CASE WHEN doc IN (SELECT doc FROM se) THEN 1 ELSE 0 END) * idf * CASE polarity WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.6 ELSE 0.15 END AS part FROM c JOIN v USING (key) JOIN st USING (key) WHERE votes - CASE WHEN doc IN (SELECT doc FROM se) THEN 1 ELSE 0 END > 0
    UNION ALL SELECT doc, 2.0 FROM (SELECT src AS doc, dst AS other FROM ({_EDGES}) x UNION SELECT dst, src FROM ({_EDGES}) y) e WHERE other IN (SELECT doc FROM se))
  SELECT doc, round(ln(1 + sum(part)), 5) AS score FROM p GROUP BY doc""")
def h06(s, d):
    out = S.shared_scores(_collapsed(s, d), _stats(s, d), rows(s, d, _SEEDS), rows(s, d, _EDGES), "SUPPORTING_PRECEDENT")
    return out.withColumn("score", F.round("score", 5))


@query("H06_named_scores", f"SELECT doc, max(CASE polarity WHEN 'negative' THEN 1.0 WHEN 'neutral' THEN 0.4 ELSE 0.15 END) AS score FROM ({_COLLAPSED}) x WHERE key IN ('a1', 'a2') GROUP BY doc")
def h06n(s, d):
    return S.named_scores(_collapsed(s, d), s.createDataFrame([("a1",), ("a2",)], "key string"), "CONTRASTING_PRECEDENT")


_PQ = """j AS (SELECT r.system, r.qid, r.rank, coalesce(l.grade, 0) AS g, l.grade IS NOT NULL AS judged FROM r LEFT JOIN l ON r.qid = l.qid AND r.doc = l.doc),
  i AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS k FROM l),
  b AS (SELECT qid, count(*) FILTER (WHERE grade >= 1) AS rel, coalesce(sum((2.0 ** grade - 1) / log2(k + 1)) FILTER (WHERE k <= 5), 0) AS i5, coalesce(sum((2.0 ** grade - 1) / log2(k + 1)) FILTER (WHERE k <= 10), 0) AS i10 FROM i GROUP BY qid),
  m AS (SELECT system, qid, count(*) FILTER (WHERE g >= 1 AND rank <= 5) / 5.0 AS p5, count(*) FILTER (WHERE g >= 1 AND rank <= 5) * 1.0 / any_value(rel) AS r5, coalesce(1.0 / min(rank) FILTER (WHERE g >= 1 AND rank <= 5), 0) AS mrr5,
    coalesce(sum((2.0 ** g - 1) / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) / any_value(i5) AS ndcg5, count(*) FILTER (WHERE g >= 1 AND rank <= 10) / 10.0 AS p10,
    coalesce(sum((2.0 ** g - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) / any_value(i10) AS ndcg10, count(*) FILTER (WHERE judged AND rank <= 5) / 5.0 AS judged5 FROM j JOIN b USING (qid) WHERE rel > 0 GROUP BY 1, 2)"""
_ROUND = ", ".join(f"round({m}, 6) AS {m}" for m in metrics.METRICS)


def _per_query(s, d):
    return metrics.per_query(rows(s, d, RUN), rows(s, d, LABELS))


@query("E10_E15_per_query_metrics", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ} SELECT system, qid, {_ROUND} FROM m")
def e10(s, d):
    return _per_query(s, d).select("system", "qid", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)


@query("E15_summarize", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ} SELECT system, {_AVG} FROM m GROUP BY system")
def e15(s, d):
    return metrics.summarize(_per_query(s, d)).select("system", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


@query("E16_by_intent", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ}, x AS (SELECT system, qid % 5 AS intent, CAST(qid % 3 = 0 AS INT) AS explicit, ndcg5 FROM m) SELECT system, intent, explicit, round(avg(ndcg5), 6) AS mean, count(*) AS n, CAST(grouping(system, intent, explicit) AS INT) AS level FROM x GROUP BY ROLLUP (system, intent, explicit)")
def e16(s, d):
    queries = rows(s, d, LABELS).select("qid").distinct().select("qid", (F.col("qid") % 5).alias("intent"), (F.col("qid") % 3 == 0).cast("int").alias("explicit"))
    out = EV.by_intent(_per_query(s, d), queries)
    return out.withColumn("mean", F.round("mean", 6))


_DRAFT = "SELECT l_orderkey AS qid, l_linenumber AS doc, max(CAST(l_quantity AS INT) % 3) AS grade FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2"
_REVIEW = "SELECT l_orderkey AS qid, l_linenumber AS doc, max(CAST(l_quantity AS INT) % 2) AS grade FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY 1, 2"


@query("D18_merge_labels", f"SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc, b.doc) AS doc, coalesce(b.grade, a.grade) AS grade FROM ({_DRAFT}) a FULL OUTER JOIN ({_REVIEW}) b ON a.qid = b.qid AND a.doc = b.doc")
def d18(s, d):
    return metrics.merge_labels(rows(s, d, _DRAFT), rows(s, d, _REVIEW))


@query("E17_label_provenance", f"SELECT (SELECT count(*) FROM ({_DRAFT}) x) AS draft_pairs, (SELECT count(*) FROM ({_REVIEW}) x) AS reviewed_pairs, (SELECT count(*) FROM ({_REVIEW}) b LEFT JOIN ({_DRAFT}) a ON a.qid = b.qid AND a.doc = b.doc WHERE a.grade IS DISTINCT FROM b.grade) AS changed")
def e17(s, d):
    return metrics.label_provenance(rows(s, d, _DRAFT), rows(s, d, _REVIEW))


@query("E18_confusion", "SELECT o_orderstatus AS gold, o_orderpriority AS pred, count(*) AS n FROM orders GROUP BY 1, 2")
def e18(s, d):
    return metrics.confusion(rows(s, d, "SELECT o_orderstatus AS gold, o_orderpriority AS pred FROM orders"), "gold", "pred")


@query("E18_macro_f1", """WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber % 4 = 0 THEN 'N' ELSE l_returnflag END AS p FROM lineitem), c AS (SELECT g AS c FROM x UNION SELECT p FROM x),
  f AS (SELECT c, 2.0 * (SELECT count(*) FROM x WHERE g = c AND p = c) / ((SELECT count(*) FROM x WHERE g = c) + (SELECT count(*) FROM x WHERE p = c)) AS f1 FROM c) SELECT round(avg(f1), 6) AS macro_f1, round((SELECT avg(CASE WHEN g = p THEN 1.0 ELSE 0 END) FROM x), 6) AS accuracy FROM f""")
def e18f(s, d):
    x = rows(s, d, "SELECT l_returnflag AS g, CASE WHEN l_linenumber % 4 = 0 THEN 'N' ELSE l_returnflag END AS p FROM lineitem")
    return metrics.class_scores(x, "g", "p").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query("E05_E06_chunk_aggregates", """WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS start, l_discount AS sim, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS r FROM lineitem)
  SELECT doc, max(sim) AS sim_max, round(avg(sim) FILTER (WHERE r <= 3), 6) AS sim_mean3, min(start) FILTER (WHERE r = 1) AS best_start FROM c GROUP BY doc""")
def e05(s, d):
    sims = rows(s, d, "SELECT l_orderkey AS doc, l_linenumber AS start, l_discount AS sim FROM lineitem")
    return R.best_chunk(sims, "doc").withColumn("sim_mean3", F.round("sim_mean3", 6))


@query("E01_term_frequencies", f"SELECT term, count(*) AS n FROM (SELECT unnest({tok('text')}) AS term FROM documents) x GROUP BY 1")
def e01(s, d):
    return R.term_frequencies(table(s, d, "documents"), "doc_id").groupBy("term").agg(F.sum("tf").alias("n"))


@query("E04_issue_tfidf", f"WITH {_TFIDF} SELECT doc_id, term, round(w / z, 6) AS weight FROM w JOIN z USING (doc_id)")
def e04(s, d):
    return R.tfidf(table(s, d, "documents"))[0].withColumn("weight", F.round("weight", 6))


@query("E07_corpus_report", r"""WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, length(text) AS c FROM documents)
  SELECT count(*) AS docs, CAST(min(n) AS INT) AS min_words, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_words, CAST(floor(avg(n)) AS BIGINT) AS mean_words, CAST(max(n) AS INT) AS max_words, CAST(sum(n) AS BIGINT) AS words, count(*) FILTER (WHERE c < 1500) AS short_docs FROM w""")
def e07(s, d):
    return corpus.corpus_report(table(s, d, "documents"))


@query("E08_top_features", f"SELECT key, n FROM (SELECT key, count(*) AS n FROM ({_AUTH}) a GROUP BY key) x ORDER BY n DESC, key LIMIT 10")
def e08(s, d):
    return EV.most_frequent(rows(s, d, _AUTH), "key")


@query("E09_dataset_stats", "SELECT lang, median(n_chars) AS median_chars, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def e09(s, d):
    return EV.dataset_stats(table(s, d, "documents"), table(s, d, "labels"))


@query("E20_outcome_agreement", "SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS agreement, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' END AS a, CASE WHEN o_custkey % 10 = 0 THEN 'allowed' WHEN o_orderstatus = 'F' THEN 'dismissed' ELSE 'allowed' END AS b FROM orders) x WHERE a IS NOT NULL AND b IS NOT NULL")
def e20(s, d):
    x = rows(s, d, "SELECT CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' END AS a, CASE WHEN o_custkey % 10 = 0 THEN 'allowed' WHEN o_orderstatus = 'F' THEN 'dismissed' ELSE 'allowed' END AS b FROM orders")
    return EV.agreement(x, "a", "b")


@query("E21_spot_checks", "SELECT event_type AS check_name, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS n FROM events GROUP BY 1")
def e21(s, d):
    return EV.spot_precision(table(s, d, "events").withColumnRenamed("event_type", "check_name"), "check_name", F.col("value") > 50).withColumn("precision", F.round("precision", 6))


@query("E22_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def e22(s, d):
    return EV.latency(table(s, d, "events"), "event_type", "value").select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("E23_label_overview", f"""WITH c AS (SELECT qid, count(*) AS candidates FROM (SELECT l_orderkey AS qid FROM lineitem) x GROUP BY 1), a AS ({_DRAFT}), b AS ({_REVIEW}), m AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(b.grade, a.grade) AS g FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.doc = b.doc)
  SELECT qid, candidates, (SELECT count(*) FROM a WHERE a.qid = c.qid) AS drafted, (SELECT count(*) FROM b WHERE b.qid = c.qid) AS reviewed, (SELECT count(*) FROM m WHERE m.qid = c.qid AND g >= 1) AS relevant FROM c""")
def e23(s, d):
    return LB.overview(rows(s, d, "SELECT l_orderkey AS qid, l_linenumber AS doc FROM lineitem"), rows(s, d, _DRAFT), rows(s, d, _REVIEW))


@query("E24_first_wins", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def e24(s, d):
    return corpus.first_wins(table(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("E25_validate", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(e) AS BIGINT) AS empty_lang, 0 AS empty_source FROM (SELECT text, count(*) AS n, count(*) FILTER (WHERE lang IS NULL) AS e FROM documents GROUP BY text) x")
def e25(s, d):
    return corpus.validate(table(s, d, "documents"), "text", ("lang", "source"))


@query("E27_vocabulary_coverage", f"WITH v AS (SELECT DISTINCT unnest({tok('text')}) AS term FROM documents), q AS (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) SELECT item_id, round(avg(CASE WHEN v.term IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM q LEFT JOIN v ON q.term = v.term GROUP BY 1")
def e27(s, d):
    return EV.vocabulary_coverage(table(s, d, "benchmark"), R.vocabulary(table(s, d, "documents"), "doc_id")).withColumn("coverage", F.round("coverage", 6))


@query("E28_vector_norms", "WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS v FROM embeddings) SELECT round(min(v), 5) AS lo, round(median(v), 5) AS mid, round(max(v), 5) AS hi FROM n")
def e28(s, d):
    n = table(s, d, "embeddings").select(V.norm(F.col("embedding")).alias("v"))
    return n.agg(F.round(F.min("v"), 5).alias("lo"), F.round(F.percentile("v", F.lit(0.5)), 5).alias("mid"), F.round(F.max("v"), 5).alias("hi"))


@query("E29_top5_overlap", "WITH t AS (SELECT l_suppkey % 20 AS q, l_partkey AS doc FROM lineitem GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc) AS r FROM t), k AS (SELECT * FROM p WHERE r <= 5), n AS (SELECT count(DISTINCT q) AS n FROM k) SELECT round(count(*) / 5.0 / any_value(n * (n - 1) / 2), 6) AS overlap FROM k a JOIN k b ON a.doc = b.doc AND a.q < b.q, n")
def e29(s, d):
    t = rows(s, d, "SELECT DISTINCT l_suppkey % 20 AS qid, l_partkey AS doc, -l_partkey AS score FROM lineitem")
    return EV.top_overlap(R.top_k(t, 5, by="qid", tie="doc")).select(F.round("overlap", 6).alias("overlap"))


@query("F01_corpus_order", "SELECT doc, CAST(row_number() OVER (ORDER BY y, k, path) - 1 AS INT) AS doc_ord FROM (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 7 = 0 THEN 9999 ELSE 2000 + o_custkey % 20 END AS y, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey END AS k, concat('p', o_orderkey) AS path FROM orders) x")
def f01(s, d):
    r = rows(s, d, "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE concat(2000 + o_custkey % 20, ' INSC ', o_orderkey) END AS neutral, concat('p', o_orderkey) AS path FROM orders")
    return corpus.neutral_order(r, "neutral", "path").select("doc", "doc_ord")


@query("F02_stable_rank", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS INT) AS rank FROM lineitem")
def f02(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.struct("l_orderkey", "l_linenumber").alias("tie"))
    return R.top_k(li, None, by="l_suppkey", tie="tie", score="l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("F05_candidate_pool", f"SELECT DISTINCT qid, doc FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid, signal ORDER BY raw DESC, doc) AS r FROM ({SIGNALS}) x WHERE signal <> 'outcome' AND (signal <> 'citation' OR raw > 0)) y WHERE r <= 100")
def f05(s, d):
    return S.candidate_pool(rows(s, d, SIGNALS))


@query("F08_run_top20", f"SELECT system, qid, doc, rank FROM ({RUN}) x WHERE rank <= 20")
def f08(s, d):
    return EV.cut_run(rows(s, d, RUN), RUN_DEPTH)


@query("F09_case_page", "SELECT page_id, url, (SELECT count(*) FROM pages WHERE contains(lower(url), 'http')) AS total FROM pages WHERE contains(lower(url), 'http') ORDER BY page_id LIMIT 50 OFFSET 10")
def f09(s, d):
    return LB.list_cases(table(s, d, "pages").select("page_id", "url"), "HTTP", ("url",), "page_id", 10, 50)


@query("F10_top_provisions", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity * 10 + l_linenumber DESC, l_orderkey, l_linenumber) AS r FROM lineitem) x WHERE r <= 40")
def f10(s, d):
    scored = table(s, d, "lineitem").withColumn("score", F.col("l_quantity") * 10 + F.col("l_linenumber")).withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    return R.top_k(scored, 40, by="l_suppkey", tie="tie").select("l_orderkey", "l_linenumber")


@query("F11_top_authorities", f"WITH p AS (SELECT doc, key, round(idf * CASE polarity WHEN 'positive' THEN 1.0 ELSE 0.8 END, 9) AS part FROM ({_COLLAPSED}) c JOIN ({_STATS}) st USING (key)) SELECT doc, string_agg(key, ',' ORDER BY part DESC, key DESC) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part DESC, key DESC) AS r FROM p) c WHERE r <= 3 GROUP BY doc")
def f11(s, d):
    parts = _collapsed(s, d).join(_stats(s, d), "key").select("doc", "key", F.round(F.col("idf") * F.when(F.col("polarity") == "positive", 1.0).otherwise(0.8), 9).alias("part"))
    return EV.top_evidence(parts, "doc").select("doc", F.array_join("keys", ",").alias("keys"))


@query("F14_select_config", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ} SELECT system FROM (SELECT system, avg(ndcg5) AS a, avg(mrr5) AS b FROM m GROUP BY system) x ORDER BY round(a, 9) DESC, round(b, 9) DESC, system DESC LIMIT 1")
def f14(s, d):
    return SY.select_config(metrics.summarize(_per_query(s, d)), "")


@query("F16_overview_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey = 1 THEN 0 ELSE 1 END, n_nationkey) AS INT) AS pos FROM nation")
def f16(s, d):
    return EV.ordered(table(s, d, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey") != 1, "n_nationkey", start=1).select("n_nationkey", "pos")


@query("F18_best_passage")
def f18(s, d):
    asked, held = table(s, d, "benchmark"), table(s, d, "documents")
    vocabulary = R.written_vocabulary(held, "doc_id")
    top = R.top_k(R.bm25(held, asked, terms=vocabulary).withColumn("score", F.round("score", 6)), 10, by="item_id", tie="doc_id", positive=True)
    docs = top.join(held, "doc_id").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("doc"), "text")
    idf = R.bm25_idf(vocabulary, held.agg(F.count(F.lit(1)).alias("n")))
    terms = R.term_frequencies(asked, "item_id").join(idf, "term").select(F.col("item_id").alias("qid"), "term", "idf")
    numbers = E.extract(asked, "item_id").where("kind = 'provision'").select(F.col("item_id").alias("qid"), F.regexp_replace("ref", "^(?:art|r|s)", "").alias("number"))
    return LB.best_passage(docs, terms, numbers=numbers.distinct()).withColumn("score", F.round("score", 6))


@query("G01_I03_pool", f"SELECT DISTINCT qid, doc FROM ({RUN}) x WHERE rank <= CASE system WHEN 'a' THEN 10 ELSE 5 END")
def g01(s, d):
    depths = s.createDataFrame([("a", 10), ("b", 5), ("c", 5)], "system string, depth int")
    return metrics.build_pool(rows(s, d, RUN), depths).select("qid", "doc")


@query("G02_act_union", "SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity < 5 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def g02(s, d):
    a = table(s, d, "lineitem").where("l_quantity < 5").select(F.col("l_suppkey").alias("qid"), F.lit("a").alias("doc"), F.lit("a").alias("system"), F.lit(1).alias("rank"))
    b = table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("qid"), F.lit("a").alias("doc"), F.lit("b").alias("system"), F.lit(1).alias("rank"))
    depths = s.createDataFrame([("a", 1), ("b", 1)], "system string, depth int")
    return metrics.build_pool(a.unionByName(b), depths).select(F.col("qid").alias("k"))


@query("G03_intersect_except", "SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') x UNION ALL SELECT k, 'left' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') y")
def g03(s, d):
    o = table(s, d, "orders")
    f, p = (o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("k")) for x in "FP")
    return EV.set_difference(f, p)


@query("G05_edge_union", f"SELECT src AS a, dst AS b FROM ({_EDGES}) x UNION SELECT dst, src FROM ({_EDGES}) y")
def g05(s, d):
    return EV.both_ways(rows(s, d, _EDGES))


_ASKED = "SELECT o_orderkey % 40 AS qid, concat('act', o_custkey % 7) AS act_id, concat('s', o_custkey % 90 + 1) AS ref FROM orders GROUP BY 1, 2, 3"
_HELD2 = "SELECT l_orderkey AS doc, concat('act', l_suppkey % 7) AS act_id, concat('s', l_partkey % 90 + 1) AS ref, sum(CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS head, sum(CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END) AS body FROM lineitem GROUP BY 1, 2, 3"


@query("H05_section_scores", f"WITH q AS ({_ASKED}), h AS ({_HELD2}), n AS (SELECT qid, count(*) AS n FROM q GROUP BY 1) SELECT qid, doc, round(sum(v) / any_value(n), 6) AS score FROM (SELECT q.qid, h.doc, q.act_id, q.ref, max(CASE WHEN head > 0 THEN 1.0 WHEN body >= 3 THEN 0.6 ELSE 0.3 END) AS v FROM q JOIN h ON q.ref = h.ref AND q.act_id = h.act_id GROUP BY 1, 2, 3, 4) x JOIN n USING (qid) GROUP BY 1, 2")
def h05(s, d):
    return S.section_scores(rows(s, d, _ASKED), rows(s, d, _HELD2)).withColumn("score", F.round("score", 6))


@query("H05_weighted_parts", "SELECT l_orderkey AS qid, l_partkey AS doc, round(sum(l_discount * w) / sum(w), 6) AS score FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.4 ELSE 0.3 END AS w FROM lineitem) x GROUP BY 1, 2")
def h05w(s, d):
    p = rows(s, d, "SELECT l_orderkey AS qid, l_partkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'section' ELSE 'issue' END AS part, l_discount AS value, CAST(CASE l_linenumber % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.4 ELSE 0.3 END AS DOUBLE) AS weight FROM lineitem")
    return S.weighted_parts(p).withColumn("score", F.round("score", 6))


@query("H03_H04_salience", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'O' THEN 1.0 WHEN l_quantity >= 3 THEN 0.6 WHEN l_quantity > 0 THEN 0.3 ELSE 0.0 END AS salience FROM lineitem")
def h03(s, d):
    sal = L.act_salience(F.col("l_returnflag") == "A", (F.col("l_linestatus") == "O").cast("int"), F.col("l_quantity"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", sal.alias("salience"))


@query("H11_resolve_weights", "SELECT 'F3_equal' AS config, s AS signal, 0.2 AS weight FROM (VALUES ('bm25'), ('semantic'), ('legal'), ('citation'), ('outcome')) v(s)")
def h11(s, d):
    return S.resolve_weights(s).where("config = 'F3_equal' AND intent = 'LEGAL_ISSUE'").select("config", "signal", "weight")


_W = "SELECT * FROM (VALUES ('bm25', 0.40), ('semantic', 0.15), ('legal', 0.30), ('citation', 0.10), ('outcome', 0.05)) v(signal, w)"


@query("H12_I02_fuse", f"""WITH sg AS ({SIGNALS}), w AS ({_W}), u AS (SELECT DISTINCT qid, signal FROM sg), e AS (SELECT u.qid, u.signal, w / sum(w) OVER (PARTITION BY u.qid) AS eff FROM u JOIN w USING (signal)),
  p AS (SELECT DISTINCT qid, doc FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid, signal ORDER BY raw DESC, doc) AS r FROM sg WHERE signal <> 'outcome' AND (signal <> 'citation' OR raw > 0)) y WHERE r <= 100),
  g AS (SELECT p.qid, p.doc, e.signal, e.eff, coalesce(sg.raw, CASE e.signal WHEN 'outcome' THEN 0.5 ELSE 0 END) AS raw FROM p JOIN e USING (qid) LEFT JOIN sg ON sg.qid = p.qid AND sg.doc = p.doc AND sg.signal = e.signal),
  n AS (SELECT *, CASE WHEN signal = 'outcome' THEN raw WHEN max(raw) OVER z - min(raw) OVER z < 1e-12 THEN 0 ELSE (raw - min(raw) OVER z) / (max(raw) OVER z - min(raw) OVER z) END AS norm FROM g WINDOW z AS (PARTITION BY qid, signal))
  SELECT 'F2_lexical_anchor' AS config, qid, doc, round(sum(eff * norm), 5) AS score FROM n GROUP BY qid, doc""")
def h12(s, d):
    return S.fuse(rows(s, d, SIGNALS), S.resolve_weights(s).where("config = 'F2_lexical_anchor'")).withColumn("score", F.round("score", 5))


def _weight_values() -> str:
    """Every configuration's weights as SQL, written from the constants."""
    out = []
    for i in INTENTS:
        named = {**FIXED, **{f"{n}_{k}": row for n, options in PAIRWISE.items() for k, row in enumerate(options)}}
        out += [(c, i, s, w) for c, row in named.items() for s, w in zip(SIGNAL_NAMES, row, strict=True)]
        for c, (base, lam) in ADAPTIVE.items():
            other = FIXED[base] if base else (0.0,) * len(SIGNAL_NAMES)
            out += [(c, i, s, (1 - lam) * t + lam * b) for s, t, b in zip(SIGNAL_NAMES, TABLE[i], other, strict=True)]
    return ", ".join(f"('{c}', '{i}', '{s}', {w!r}::DOUBLE)" for c, i, s, w in out)


_ALL_W = f"w AS (SELECT * FROM (VALUES {_weight_values()}) v(config, intent, signal, w) WHERE w > 0)"
_FUSED = f"""sg AS MATERIALIZED ({SIGNALS}), {_ALL_W}, u AS (SELECT DISTINCT qid, intent, signal FROM sg), e AS MATERIALIZED (SELECT config, qid, signal, w / sum(w) OVER (PARTITION BY config, qid) AS eff FROM u JOIN w USING (intent, signal)),
  t AS (SELECT qid, doc, signal FROM (SELECT qid, doc, signal, row_number() OVER (PARTITION BY qid, signal ORDER BY raw DESC, doc) AS r FROM sg WHERE signal <> 'outcome' AND (signal <> 'citation' OR raw > 0)) y WHERE r <= 100),
  p AS (SELECT DISTINCT config, t.qid, doc FROM t JOIN e USING (qid, signal)),
  g AS (SELECT p.config, p.qid, p.doc, e.signal, e.eff, coalesce(sg.raw, CASE e.signal WHEN 'outcome' THEN 0.5 ELSE 0 END) AS raw FROM p JOIN e ON e.config = p.config AND e.qid = p.qid LEFT JOIN sg ON sg.qid = p.qid AND sg.doc = p.doc AND sg.signal = e.signal),
  m AS (SELECT *, CASE WHEN signal = 'outcome' THEN raw WHEN max(raw) OVER z - min(raw) OVER z < 1e-12 THEN 0 ELSE (raw - min(raw) OVER z) / (max(raw) OVER z - min(raw) OVER z) END AS norm FROM g WINDOW z AS (PARTITION BY config, qid, signal))"""


@query("H13_rank_all_configs", f"WITH {_FUSED}, s AS (SELECT config, qid, doc, round(sum(eff * norm), 9) AS score FROM m GROUP BY 1, 2, 3) SELECT config, qid, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, doc) AS rank FROM s) x WHERE rank <= 10")
def h13(s, d):
    fused = S.fuse(rows(s, d, SIGNALS), S.resolve_weights(s)).withColumn("by", F.struct("config", "qid")).withColumn("score", F.round("score", 9))
    return R.top_k(fused, 10, by="by", tie="doc").select("config", "qid", "doc", "score", "rank")


@query("H17_rule_intent", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'CONTRASTING_PRECEDENT' WHEN 1 THEN 'SUPPORTING_PRECEDENT' WHEN 2 THEN 'STATUTE_BASED' WHEN 3 THEN 'FACTUAL_SIMILARITY' ELSE 'LEGAL_ISSUE' END AS intent FROM orders""")
def h17(s, d):
    q = rows(s, d, """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'cases that distinguish this rule' WHEN 1 THEN 'judgments that relied on Ram v. State' WHEN 2 THEN concat('scope of Section ', o_orderkey % 400 + 1)
      WHEN 3 THEN 'my client was arrested and found with a bag' ELSE 'meaning of dishonesty' END AS q FROM orders""")  # fmt: skip
    return q.select("o_orderkey", L.rule_intent(F.col("q")).alias("intent"))


@query("H18_intent_features", """SELECT o_orderkey, concat_ws(',', CASE o_orderkey % 3 WHEN 2 THEN '1.333333' ELSE '0.666667' END, '0.666667', CASE o_orderkey % 3 WHEN 1 THEN '2.0' ELSE '0.0' END, CASE o_orderkey % 3 WHEN 1 THEN '1.0' ELSE '0.0' END, '0.0', '0.0',
  CASE o_orderkey % 3 WHEN 0 THEN '2.0' ELSE '0.0' END, CASE o_orderkey % 3 WHEN 0 THEN '2.0' ELSE '0.0' END, CASE o_orderkey % 3 WHEN 0 THEN '0.25' WHEN 1 THEN '0.5' ELSE '0.3' END) AS features FROM orders""")
def h18(s, d):
    q = rows(s, d, """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('what is Section ', o_orderkey % 400 + 1, ' IPC?') WHEN 1 THEN concat('judgments relied on Ram v. State for Section ', o_orderkey % 400 + 1, ' IPC')
      ELSE concat('u/s. ', o_orderkey % 400 + 1, ' IPC with Section 3') END AS text FROM orders""")  # fmt: skip
    q = q.join(I.act_counts(q, "o_orderkey"), "o_orderkey")
    return q.select("o_orderkey", F.concat_ws(",", F.transform(L.intent_features(F.col("text"), F.col("acts")), lambda x: F.round(x, 6).cast("string"))).alias("features"))


@query("I06_I07_paired_tests")
def i06(s, d):
    return metrics.paired_bootstrap(metrics.paired_differences(_per_query(s, d), "a", "b"))


@query("D17_paired_differences", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ} SELECT x.qid, round(x.ndcg5 - y.ndcg5, 6) AS d FROM m x JOIN m y ON x.qid = y.qid WHERE x.system = 'a' AND y.system = 'b'")
def d17(s, d):
    return metrics.paired_differences(_per_query(s, d), "a", "b").select("qid", F.round("d", 6).alias("d"))


@query("J03_list_cases", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')) AS total FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') ORDER BY c_custkey LIMIT 50")
def j03(s, d):
    return LB.list_cases(table(s, d, "customer"), "build", ("c_name", "c_mktsegment"), "c_custkey").select("c_custkey", "c_name", "total")


@query("J09_label_upsert", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) x WHERE r = 1")
def j09(s, d):
    return LB.latest(table(s, d, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value")), "user_id", "event_type", time="event_id")


@query("J10_confirm_all", f"SELECT * FROM ({_REVIEW}) b UNION ALL SELECT a.* FROM ({_DRAFT}) a WHERE NOT EXISTS (SELECT 1 FROM ({_REVIEW}) b WHERE a.qid = b.qid AND a.doc = b.doc)")
def j10(s, d):
    return LB.confirm_all(rows(s, d, _REVIEW), rows(s, d, _DRAFT), "qid", "doc")


@query("J11_rank_diff", f"WITH r AS MATERIALIZED ({RUN}) SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc, b.doc) AS doc, a.rank AS rank_a, b.rank AS rank_b FROM (SELECT * FROM r WHERE system = 'a') a FULL OUTER JOIN (SELECT * FROM r WHERE system = 'b') b ON a.qid = b.qid AND a.doc = b.doc")
def j11(s, d):
    r = rows(s, d, RUN)
    return LB.rank_diff(r.where("system = 'a'"), r.where("system = 'b'"))

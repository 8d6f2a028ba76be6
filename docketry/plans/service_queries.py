"""Queries of the index, the registry of systems, the evaluation's remaining tables and the service."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import evaluate as EV
from docketry.operators import intents as I
from docketry.operators import labels as LB
from docketry.operators import metrics
from docketry.operators import retrieval as R
from docketry.operators import scoring as S
from docketry.operators import service as SV
from docketry.plans import systems as SY
from docketry.plans.fixtures import CITES, LABELS, RUN, SIGNALS, query, rows, table
from docketry.plans.rank_queries import _BM25, _COLLAPSED, _DRAFT, _EDGES, _PQ, _REVIEW, _STATS, _collapsed, _per_query, _stats
from docketry.sources.shared import Scratch


@query("A11_index_search", f"WITH {_BM25} SELECT item_id, doc_id AS doc, round(score, 4) AS score FROM b")
def a11(s, d):
    at = Scratch(s, "index").root
    R.write_index(table(s, d, "documents"), at)
    return R.search_index(s, at, table(s, d, "benchmark")).withColumn("score", F.round("score", 4))


@query("E19_provision_scores", """WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 7 AS a, l_partkey % 30 AS r FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 5 AS a, l_partkey % 30 AS r FROM lineitem WHERE l_linenumber >= 2),
  x AS (SELECT 'strict' AS variant, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p JOIN g USING (doc, a, r)) AS tp UNION ALL
  SELECT 'lenient', (SELECT count(DISTINCT (doc, r)) FROM p), (SELECT count(DISTINCT (doc, r)) FROM g), (SELECT count(*) FROM (SELECT DISTINCT doc, r FROM p) u JOIN (SELECT DISTINCT doc, r FROM g) v USING (doc, r)))
  SELECT variant, tp, np, ng, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM x""")
def e19(s, d):
    p = rows(s, d, "SELECT l_orderkey AS doc, l_suppkey % 7 AS act_id, l_partkey % 30 AS ref FROM lineitem WHERE l_linenumber <= 3")
    g = rows(s, d, "SELECT l_orderkey AS doc, l_suppkey % 5 AS act_id, l_partkey % 30 AS ref FROM lineitem WHERE l_linenumber >= 2")
    return metrics.provision_scores(p, g).select("variant", "tp", "np", "ng", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("F13_any_sign", "SELECT s_nationkey, s_suppkey, s_acctbal, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) x WHERE r <= 30")
def f13(s, d):
    scores = table(s, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.col("s_acctbal").alias("score"))
    return SV.positive_or_any(scores, 30, by="s_nationkey", tie="s_suppkey", positive=False).drop("score")


@query("F15_best_model", "WITH m AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'logreg' ELSE concat('svm', l_linenumber % 3) END AS model, avg(l_quantity) AS f1 FROM lineitem GROUP BY 1) SELECT model, round(f1, 6) AS f1 FROM m ORDER BY round(f1, 9) DESC, model <> 'logreg', model LIMIT 1")
def f15(s, d):
    m = rows(s, d, "SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'logreg' ELSE concat('svm', l_linenumber % 3) END AS model, avg(l_quantity) AS f1 FROM lineitem GROUP BY 1")
    return SV.best_model(m).withColumn("f1", F.round("f1", 6))


@query("H06_citation_signal", f"""WITH c AS ({_COLLAPSED}), st AS ({_STATS}), se AS (SELECT o_orderkey % 100 AS qid, o_orderkey AS doc FROM orders WHERE o_orderkey % 100 < 4), nm AS (SELECT 2 AS qid, 'a3' AS key UNION ALL SELECT 2, 'a4'),
  w AS (SELECT * FROM (VALUES (0, 'positive', 1.0), (0, 'neutral', 0.8), (0, 'negative', 0.8), (1, 'positive', 1.0), (1, 'neutral', 0.6), (1, 'negative', 0.15), (2, 'positive', 0.15), (2, 'neutral', 0.4), (2, 'negative', 1.0), (3, 'positive', 1.0), (3, 'neutral', 0.8), (3, 'negative', 0.8)) v(qid, polarity, pw)),
  fs AS (SELECT * FROM se WHERE qid <> 2), v AS (SELECT fs.qid, c.key, count(*) AS votes FROM fs JOIN c USING (doc) JOIN st USING (key) WHERE df >= 2 GROUP BY 1, 2),
  r AS (SELECT v.qid, c.doc, (votes - CASE WHEN fs.doc IS NULL THEN 0 ELSE 1 END) AS lft, idf, pw FROM v JOIN c USING (key) JOIN st USING (key) JOIN w ON w.qid = v.qid AND w.polarity = c.polarity LEFT JOIN fs ON fs.qid = v.qid AND fs.doc = c.doc),
  e AS (SELECT src AS doc, dst AS other FROM ({_EDGES}) x UNION SELECT dst, src FROM ({_EDGES}) y), p AS (SELECT qid, doc, lft * idf * pw AS part FROM r WHERE lft > 0 UNION ALL SELECT fs.qid, e.doc, 2.0 FROM e JOIN fs ON fs.doc = e.other WHERE fs.qid IN (SELECT qid FROM v))
  SELECT qid, doc, round(ln(1 + sum(part)), 5) AS score FROM p GROUP BY 1, 2 UNION ALL SELECT 2, c.doc, max(pw) FROM c JOIN nm USING (key) JOIN w ON w.qid = 2 AND w.polarity = c.polarity GROUP BY c.doc""")
def h06s(s, d):
    queries = s.createDataFrame([(0, "LEGAL_ISSUE"), (1, "SUPPORTING_PRECEDENT"), (2, "CONTRASTING_PRECEDENT"), (3, "STATUTE_BASED")], "qid long, intent string")
    named = s.createDataFrame([(2, "a3"), (2, "a4")], "qid long, key string")
    seeds = rows(s, d, "SELECT o_orderkey % 100 AS qid, o_orderkey AS doc FROM orders WHERE o_orderkey % 100 < 4")
    return S.citation_signal(_collapsed(s, d), _stats(s, d), rows(s, d, _EDGES), queries, named, seeds).withColumn("score", F.round("score", 5))


@query("H21_stratified_folds", """WITH g AS (SELECT o_custkey AS g, min(o_orderstatus) AS label FROM orders GROUP BY 1), n AS (SELECT label, count(*) AS n FROM g GROUP BY 1)
  SELECT label, n, CAST(floor(n / 5.0) AS BIGINT) AS fewest, CAST(ceil(n / 5.0) AS BIGINT) AS most FROM n""")
def h21s(s, d):
    folds = I.stratified_folds(table(s, d, "orders"), "o_custkey", "o_orderstatus")
    by = table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("label")).join(folds, "o_custkey").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy("label").agg(F.sum("c").alias("n"), F.when(F.count(F.lit(1)) < 5, 0).otherwise(F.min("c")).alias("fewest"), F.max("c").alias("most"))


@query("I01_run_systems", f"""WITH sg AS ({SIGNALS}), k AS (SELECT CASE signal WHEN 'bm25' THEN 'B1_bm25' ELSE 'X_legal_only' END AS system, qid, doc, row_number() OVER (PARTITION BY signal, qid ORDER BY round(raw, 9) DESC, doc) AS rank FROM sg WHERE signal = 'legal' OR signal = 'bm25' AND raw > 0)
  SELECT system, qid, doc, CAST(rank AS INT) AS rank FROM k WHERE rank <= 20""")
def i01(s, d):
    sig = rows(s, d, SIGNALS)
    return SY.run_systems({(v, "predicted"): sig for v in ("whole", "chunked_max", "chunked_mean3")}, [x for x in SY.baseline_systems() if x.signal in ("bm25", "legal")])


_LINES = f"SELECT doc, ord AS pos, concat('a', auth) AS key, name, treatment, polarity FROM ({CITES}) c"


@query("I04_label_cards", f"""WITH c AS ({_LINES}), p AS (SELECT n_nationkey AS qid, l_orderkey AS doc FROM nation JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey % 200 = n_nationkey),
  k AS (SELECT p.qid, p.doc, c.pos, concat(name, ' - ', treatment) AS t, row_number() OVER (PARTITION BY p.qid, p.doc ORDER BY c.pos) AS r FROM p JOIN c USING (doc) WHERE c.key = 'a3' AND p.qid = 1 OR p.qid % 2 = 0 AND polarity <> 'neutral')
  SELECT p.qid, p.doc, coalesce(string_agg(t, '; ' ORDER BY r) FILTER (WHERE r <= 5), '') AS cited FROM p LEFT JOIN k ON k.qid = p.qid AND k.doc = p.doc GROUP BY 1, 2""")
def i04(s, d):
    docs = rows(s, d, "SELECT DISTINCT l_orderkey AS doc FROM lineitem")
    intents = rows(s, d, "SELECT n_nationkey AS qid, CASE n_nationkey % 2 WHEN 0 THEN 'SUPPORTING_PRECEDENT' ELSE 'LEGAL_ISSUE' END AS intent FROM nation")
    pool = rows(s, d, "SELECT n_nationkey AS qid, l_orderkey AS doc FROM nation JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l_orderkey % 200 = n_nationkey")
    named = s.createDataFrame([(1, "a3")], "qid int, key string")
    return SV.label_cards(pool, docs, rows(s, d, _LINES), intents, named).select("qid", "doc", F.concat_ws("; ", "cited").alias("cited"))


@query("I10_run_stability", f"WITH r AS MATERIALIZED ({RUN}), t AS (SELECT DISTINCT system, qid, doc FROM r WHERE rank <= 5), n AS (SELECT system, count(DISTINCT qid) AS n FROM t GROUP BY 1) SELECT x.system AS a, y.system AS b, round((SELECT count(*) FROM t u JOIN t v USING (qid, doc) WHERE u.system = x.system AND v.system = y.system) / 5.0 / x.n, 6) AS overlap FROM n x JOIN n y ON x.system < y.system")
def i10(s, d):
    return EV.run_stability(rows(s, d, RUN).withColumnRenamed("system", "repeat")).withColumn("overlap", F.round("overlap", 6))


@query("J01_health", "SELECT 'docs' AS \"table\", count(*) AS rows FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def j01(s, d):
    return SV.health(table(s, d, "documents"), labels=table(s, d, "labels"), pages=table(s, d, "pages"))


@query("J06_saved_report", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ} SELECT system, round(avg(ndcg5), 6) AS ndcg5, round(avg(p5), 6) AS p5, count(*) AS n FROM m GROUP BY 1")
def j06(s, d):
    at = Scratch(s, "report").root
    per_query = _per_query(s, d)
    EV.write_report({"per_query": per_query}, at)
    return s.read.parquet(f"{at}/per_query").groupBy("system").agg(F.round(F.avg("ndcg5"), 6).alias("ndcg5"), F.round(F.avg("p5"), 6).alias("p5"), F.count(F.lit(1)).alias("n"))


@query("J08_labels_of_query", f"SELECT coalesce(a.doc, b.doc) AS doc, coalesce(b.grade, a.grade) AS grade, CASE WHEN b.doc IS NULL THEN 'draft' ELSE 'reviewed' END AS source FROM (SELECT * FROM ({_DRAFT}) x WHERE qid = 7) a FULL OUTER JOIN (SELECT * FROM ({_REVIEW}) y WHERE qid = 7) b ON a.doc = b.doc")
def j08(s, d):
    return LB.of_query(rows(s, d, _DRAFT), rows(s, d, _REVIEW), 7)


@query("J11_best_per_metric", f"WITH r AS ({RUN}), l AS ({LABELS}), {_PQ}, a AS (SELECT system, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in metrics.METRICS) + f""" FROM m GROUP BY 1), u AS (UNPIVOT a ON {', '.join(metrics.METRICS)} INTO NAME metric VALUE v), t AS (SELECT metric, max(v) AS best FROM u GROUP BY 1)
  SELECT metric, round(best, 6) AS best, string_agg(system, ',' ORDER BY system) AS systems FROM u JOIN t USING (metric) WHERE v = best GROUP BY metric, best""")
def j11b(s, d):
    return metrics.best_per_metric(metrics.summarize(_per_query(s, d))).select("metric", F.round("best", 6).alias("best"), F.array_join("systems", ",").alias("systems"))

"""Search, models, sources and the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.config import INTENTS, TABLE
from docketry.config import SIGNALS as SIGNAL_NAMES
from docketry.functions import text as T
from docketry.functions import vectors as V
from docketry.operators import entities as E
from docketry.operators import evaluate as EV
from docketry.operators import intents as I
from docketry.operators import metrics
from docketry.operators import retrieval as R
from docketry.operators import scoring as S
from docketry.operators import service as SV
from docketry.plans import search as P
from docketry.plans import systems as SY
from docketry.plans.fixtures import LABELS, LEGAL, RUN, SIGNALS, query, rows, table
from docketry.plans.rank_queries import _BM25, _FUSED, _TFIDF, _grams
from docketry.sources import records
from docketry.streaming import jobs


#: The adaptive table's weights by number of the intent, as SQL.
_A1 = ", ".join(f"({n}, '{name}', {w!r}::DOUBLE)" for n, i in enumerate(INTENTS) for name, w in zip(SIGNAL_NAMES, TABLE[i], strict=True))


@query("A02_find_pdf", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('c', p_partkey, '_EN.pdf') WHEN p_partkey % 3 = 1 THEN concat('c', p_partkey, '.pdf') END AS pdf FROM part")
def a02(s, d):
    r = rows(s, d, "SELECT p_partkey, concat('c', p_partkey) AS stem FROM part")
    listing = rows(s, d, "SELECT concat('c', p_partkey, '_EN.pdf') AS file FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT concat('c', p_partkey, '.pdf') FROM part WHERE p_partkey % 3 <= 1")
    return records.find_pdf(r, listing).select("p_partkey", "pdf")


@query("A14_histogram", "SELECT CAST(least(greatest(floor((value - 0) / 10.0), -1), 10) + 1 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def a14(s, d):
    return records.histogram(table(s, d, "events"), "value", 0.0, 100.0, 10)


@query("A15_missing_downloads", "SELECT concat('f', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS file FROM orders WHERE o_orderstatus <> 'F' ORDER BY 1 LIMIT 100")
def a15(s, d):
    w = table(s, d, "orders").select(F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("file"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("size"))
    return records.missing_downloads(w.select("file"), w)


_HELD_ACTS = "SELECT l_orderkey AS doc, concat('act', l_suppkey % 7) AS act_id, max(l_linenumber = 1) AS listed, count(*) FILTER (WHERE l_linestatus = 'O') AS head, count(*) FILTER (WHERE l_linestatus = 'F') AS body FROM lineitem GROUP BY 1, 2"
_ASKED_ACTS = "SELECT n_nationkey AS qid, concat('act', n_nationkey % 7) AS act_id FROM nation UNION SELECT n_nationkey, concat('act', n_regionkey) FROM nation"
_SALIENCE = "CASE WHEN listed OR head > 0 THEN 1.0 WHEN body >= 3 THEN 0.6 WHEN body > 0 THEN 0.3 ELSE 0.0 END"


@query("D07_act_lookup", f"SELECT qid, doc, round(sum({_SALIENCE}) / any_value(n), 6) AS score FROM ({_ASKED_ACTS}) q JOIN ({_HELD_ACTS}) h USING (act_id) JOIN (SELECT qid, count(*) AS n FROM ({_ASKED_ACTS}) x GROUP BY 1) c USING (qid) GROUP BY qid, doc")
def d07(s, d):
    return S.act_scores(rows(s, d, _ASKED_ACTS), rows(s, d, _HELD_ACTS)).withColumn("score", F.round("score", 6))


_HELD_CONCEPTS = "SELECT l_orderkey AS doc, concat('c', l_partkey % 9) AS concept, count(*) FILTER (WHERE l_linestatus = 'O') AS head, count(*) FILTER (WHERE l_linestatus = 'F') AS body FROM lineitem GROUP BY 1, 2"
_ASKED_CONCEPTS = "SELECT n_nationkey AS qid, concat('c', n_nationkey % 9) AS concept FROM nation UNION SELECT n_nationkey, concat('c', n_regionkey) FROM nation"


@query("D09_concept_lookup", f"SELECT qid, doc, round(sum(CASE WHEN head > 0 THEN 1.0 ELSE 0.5 END) / any_value(n), 6) AS score FROM ({_ASKED_CONCEPTS}) q JOIN ({_HELD_CONCEPTS}) h USING (concept) JOIN (SELECT qid, count(*) AS n FROM ({_ASKED_CONCEPTS}) x GROUP BY 1) c USING (qid) GROUP BY qid, doc")
def d09(s, d):
    return S.concept_scores(rows(s, d, _ASKED_CONCEPTS), rows(s, d, _HELD_CONCEPTS)).withColumn("score", F.round("score", 6))


_ISSUE = "SELECT l_suppkey % 20 AS qid, l_partkey AS doc, max(l_discount) AS score FROM lineitem GROUP BY 1, 2"
_PARTS = {n: f"SELECT l_suppkey % 20 AS qid, l_partkey AS doc, max({c}) AS score FROM lineitem WHERE l_suppkey % 20 % {m} = 0 GROUP BY 1, 2" for n, c, m in (("acts", "l_tax", 2), ("sections", "l_discount * 5", 3), ("implied", "l_tax * 2", 7), ("concepts", "l_quantity / 50", 4))}
_FLAGS = "SELECT DISTINCT l_suppkey % 20 AS qid, l_suppkey % 20 % 2 = 0 AS has_acts, l_suppkey % 20 % 3 = 0 AS has_sections, l_suppkey % 20 % 7 = 0 AND l_suppkey % 20 % 3 > 0 AS has_implied, l_suppkey % 20 % 4 = 0 AS has_concepts FROM lineitem"


@query("H05_legal_scores", f"""WITH f AS ({_FLAGS}), i AS ({_ISSUE}), t AS (SELECT qid, max(score) AS top FROM i GROUP BY 1), p AS (
  SELECT i.qid, doc, CASE WHEN top > 0 THEN 0.3 * CASE WHEN has_concepts THEN 0.5 ELSE 1 END * score / top ELSE 0 END AS part FROM i JOIN t USING (qid) JOIN f USING (qid)
  UNION ALL SELECT qid, doc, 0.15 * score FROM ({_PARTS['concepts']}) a UNION ALL SELECT qid, doc, 0.3 * score FROM ({_PARTS['acts']}) b UNION ALL SELECT qid, doc, 0.4 * score FROM ({_PARTS['sections']}) c UNION ALL SELECT qid, doc, 0.2 * score FROM ({_PARTS['implied']}) d JOIN f USING (qid) WHERE has_implied)
  SELECT qid, doc, round(sum(part) / (0.3 + any_value(CASE WHEN has_acts THEN 0.3 ELSE 0 END + CASE WHEN has_sections THEN 0.4 WHEN has_implied THEN 0.2 ELSE 0 END)), 6) AS score FROM p JOIN f USING (qid) GROUP BY qid, doc""")
def h05l(s, d):
    parts = {n: rows(s, d, sql) for n, sql in _PARTS.items()}
    flags = rows(s, d, _FLAGS)
    parts["implied"] = parts["implied"].join(flags.where("has_implied").select("qid"), "qid", "left_semi")
    return S.legal_scores(rows(s, d, _ISSUE), asked=flags, **parts).withColumn("score", F.round("score", 6))


@query("D16_run_qrels", f"SELECT system, r.qid, r.doc, rank, coalesce(grade, 0) AS grade, grade IS NOT NULL AS judged FROM ({RUN}) r LEFT JOIN ({LABELS}) l ON r.qid = l.qid AND r.doc = l.doc")
def d16(s, d):
    return EV.judged_run(rows(s, d, RUN), rows(s, d, LABELS))


@query("D19_pool_query_meta", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d19(s, d):
    return EV.with_metadata(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key")), table(s, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name"), "key").select("c_custkey", "n_name")


@query("D21_case_lookup", """WITH e AS (SELECT DISTINCT o_orderkey % 60 AS src, o_custkey % 60 AS dst FROM orders WHERE o_orderkey % 60 <> o_custkey % 60)
  SELECT doc_id AS doc, source, (SELECT coalesce(string_agg(dst, ',' ORDER BY dst), '') FROM e WHERE src = 17) AS cites, (SELECT coalesce(string_agg(src, ',' ORDER BY src), '') FROM e WHERE dst = 17) AS cited_by FROM documents WHERE doc_id = 17""")
def d21(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("doc"), "source")
    links = rows(s, d, "SELECT o_orderkey % 60 AS src, o_custkey % 60 AS dst FROM orders WHERE o_orderkey % 60 <> o_custkey % 60")
    return SV.case(docs, links, 17).select("doc", "source", F.array_join("cites", ",").alias("cites"), F.array_join("cited_by", ",").alias("cited_by"))


@query("F03_F12_positive_rank", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier WHERE s_acctbal > 0) x WHERE r <= 5")
def f03(s, d):
    return R.top_k(table(s, d, "supplier"), 5, by="s_nationkey", tie="s_suppkey", score="s_acctbal", positive=True).select("s_nationkey", "s_suppkey")


@query("F04_seeds", f"""WITH s AS ({SIGNALS}), n AS (SELECT count(DISTINCT doc) AS n FROM s), x AS (SELECT qid, doc, signal, raw FROM s WHERE signal IN ('bm25', 'legal')),
  g AS (SELECT qid, signal, CASE WHEN count(*) < any_value(n) THEN least(min(raw), 0) ELSE min(raw) END AS lo, CASE WHEN count(*) < any_value(n) THEN greatest(max(raw), 0) ELSE max(raw) END AS hi FROM x, n GROUP BY 1, 2),
  t AS (SELECT qid, doc, round(sum(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (raw - lo) / (hi - lo) END), 9) AS v FROM x JOIN g USING (qid, signal) GROUP BY 1, 2)
  SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, doc) AS r FROM t) y WHERE r <= 10""")
def f04(s, d):
    x = rows(s, d, SIGNALS)
    return S.seeds(x, x.agg(F.count_distinct("doc").alias("n")))


@query("F06_outside_pool_removed", f"SELECT qid, doc, signal FROM ({SIGNALS}) s WHERE (qid, doc) IN (SELECT (qid, doc) FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid, signal ORDER BY raw DESC, doc) AS r FROM ({SIGNALS}) x WHERE signal <> 'outcome' AND (signal <> 'citation' OR raw > 0)) y WHERE r <= 100)")
def f06(s, d):
    return EV.in_pool(rows(s, d, SIGNALS)).select("qid", "doc", "signal")


@query("G04_ordered_distinct", "SELECT o_orderkey, concat_ws(',', o_orderstatus, CASE WHEN o_orderpriority <> o_orderstatus THEN o_orderpriority END) AS k FROM orders")
def g04(s, d):
    return table(s, d, "orders").select("o_orderkey", F.concat_ws(",", T.distinct_in_order(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus"))).alias("k"))


@query("H01_analyze", "SELECT o_orderkey AS item_id, 'STATUTE_BASED' AS intent, CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE '' END AS requirements FROM orders")
def h01(s, d):
    q = rows(s, d, "SELECT o_orderkey AS item_id, concat('Section ', o_orderkey % 511 + 1, CASE o_orderstatus WHEN 'F' THEN ' IPC appeal dismissed' WHEN 'O' THEN ' IPC appeal allowed' ELSE ' IPC' END) AS text FROM orders")
    return P.analyze(q).select("item_id", "intent", F.concat_ws("|", "requirements").alias("requirements"))


_PARTIES = "SELECT DISTINCT concat('supplier ', l_suppkey % 50, ' v part ', l_partkey % 5) AS key FROM lineitem"


@query("H02_match_precedents", """WITH a AS (SELECT DISTINCT l_suppkey % 50 AS x, l_partkey % 5 AS y FROM lineitem), m AS (SELECT n_nationkey AS z, x, y, 0.6 + 0.4 * (1 + CASE WHEN y = n_nationkey % 5 THEN 1 ELSE 0 END) / 2.0 AS sc FROM a JOIN nation ON x = n_nationkey)
  SELECT z, concat('supplier ', x, ' v part ', y) AS key FROM (SELECT *, max(sc) OVER (PARTITION BY z) AS b FROM m WHERE sc >= 0.75) t WHERE sc >= b - 0.05 AND z % 2 = 0 UNION ALL SELECT n_nationkey, concat('supplier ', x, ' v part ', y) FROM nation JOIN a ON x = n_nationkey WHERE n_nationkey % 2 = 1""")
def h02(s, d):
    # even ones name a case in full, odd ones only its first party
    q = table(s, d, "nation").select(F.col("n_nationkey").alias("z"), F.concat(F.lit("supplier "), "n_nationkey").alias("first"))
    full = F.array(F.concat("first", F.lit(" v part "), F.col("z") % 5))
    q = q.select("z", F.when(F.col("z") % 2 == 0, full).otherwise(F.array().cast("array<string>")).alias("asked"), F.concat(F.lit("the rule in "), "first", F.lit(" and bail")).alias("text"))
    return S.match_precedents(q, rows(s, d, _PARTIES), query="z", text="text").select("z", "key")


_SIM = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))"
_UNIT = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings WHERE vec_id < 500"


@query("H10_H15_search", f"""WITH {_BM25}, {_TFIDF}, {_grams('qt', 'item_id', 'benchmark')}, qw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS q FROM qt JOIN vo USING (term)), qz AS (SELECT item_id, sqrt(sum(q * q)) AS qz FROM qw GROUP BY 1),
  ts AS (SELECT item_id, doc_id, sum(q * w) / (any_value(z) * any_value(qz)) AS score FROM qw JOIN w USING (term) JOIN z USING (doc_id) JOIN qz USING (item_id) GROUP BY 1, 2), un AS MATERIALIZED ({_UNIT}),
  sg AS MATERIALIZED (SELECT item_id AS qid, doc_id AS doc, 'bm25' AS signal, score AS raw FROM b UNION ALL SELECT item_id, doc_id, 'legal', score / max(score) OVER (PARTITION BY item_id) FROM ts
    UNION ALL SELECT item_id, doc_id, 'semantic', {_SIM} FROM documents JOIN un a ON a.vec_id = doc_id % 500, benchmark JOIN un b ON b.vec_id = item_id),
  wt AS (SELECT item_id AS qid, signal, w FROM benchmark JOIN (VALUES {_A1}) v(i, signal, w) ON i = item_id % 5), u AS (SELECT DISTINCT qid, signal FROM sg), e AS MATERIALIZED (SELECT qid, signal, w / sum(w) OVER (PARTITION BY qid) AS eff FROM u JOIN wt USING (qid, signal)),
  pl AS (SELECT DISTINCT qid, doc FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid, signal ORDER BY raw DESC, doc) AS r FROM sg) y WHERE r <= 100),
  g AS (SELECT pl.qid, pl.doc, e.signal, e.eff, coalesce(sg.raw, 0) AS raw FROM pl JOIN e USING (qid) LEFT JOIN sg ON sg.qid = pl.qid AND sg.doc = pl.doc AND sg.signal = e.signal),
  nm AS (SELECT *, eff * CASE WHEN max(raw) OVER z - min(raw) OVER z < 1e-12 THEN 0 ELSE (raw - min(raw) OVER z) / (max(raw) OVER z - min(raw) OVER z) END AS part FROM g WINDOW z AS (PARTITION BY qid, signal)),
  sc AS (SELECT qid, doc, round(sum(part), 9) AS score FROM nm GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM sc),
  ld AS (SELECT qid, doc, signal, row_number() OVER (PARTITION BY qid, doc ORDER BY round(part, 4) DESC, signal) AS o FROM nm WHERE round(part, 4) > 0), st AS (SELECT qid, doc, string_agg(signal, '; ' ORDER BY o) AS strongest FROM ld WHERE o <= 2 GROUP BY 1, 2)
  SELECT qid, doc, CAST(rank AS INT) AS rank, round(score, 6) AS score, coalesce(strongest, '') AS strongest, '' AS reason FROM rk LEFT JOIN st USING (qid, doc) WHERE rank <= 10""")
def h15(s, d):
    """Search over all documents; a document's vector is that of the embedding with its number modulo 500, a query's that with its own."""
    docs, asked = table(s, d, "documents"), table(s, d, "benchmark")
    unit = table(s, d, "embeddings").where("vec_id < 500").select("vec_id", V.unit(F.col("embedding")).alias("v"))
    chunks = docs.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 500).alias("vec_id")).join(unit, "vec_id").select("doc", F.lit(0).alias("start"), "v")
    vectors = asked.select(F.col("item_id").alias("qid"), F.col("item_id").alias("vec_id")).join(unit, "vec_id").select("qid", "v")
    intents = F.array(*[F.lit(i) for i in INTENTS])
    asked = asked.withColumn("intent", F.get(intents, (F.col("item_id") % 5).cast("int")))
    out = P.search(P.features(docs, chunks=chunks), asked, override="intent", vectors=vectors)
    return out.select("qid", "doc", "rank", F.round("score", 6).alias("score"), "strongest", "reason")


@query("H14_explain", f"""WITH {_FUSED}, s AS (SELECT config, qid, doc, round(sum(eff * norm), 9) AS score FROM m WHERE config = 'F3_equal' GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s),
  ld AS (SELECT qid, doc, signal, row_number() OVER (PARTITION BY qid, doc ORDER BY round(eff * norm, 4) DESC, signal) AS o FROM m WHERE config = 'F3_equal' AND round(eff * norm, 4) > 0), st AS (SELECT qid, doc, string_agg(signal, '; ' ORDER BY o) AS strongest FROM ld WHERE o <= 2 GROUP BY 1, 2)
  SELECT qid, doc, CAST(rank AS INT) AS rank, round(score, 6) AS score, coalesce(strongest, '') AS strongest FROM k LEFT JOIN st USING (qid, doc) WHERE rank <= 10""")
def h14(s, d):
    return P.rank(rows(s, d, SIGNALS), S.resolve_weights(s).where("config = 'F3_equal'")).select("qid", "doc", "rank", F.round("score", 6).alias("score"), "strongest")


@query("H19_H20_intent_model")
def h19(s, d):
    q = rows(s, d, """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'cases that distinguish or overrule this rule' WHEN 1 THEN concat('scope of Section ', o_orderkey % 400 + 1, ' of the Code') ELSE 'my client was arrested and found with a bag of goods' END AS text,
      CASE o_orderkey % 3 WHEN 0 THEN 'CONTRASTING_PRECEDENT' WHEN 1 THEN 'STATUTE_BASED' ELSE 'FACTUAL_SIMILARITY' END AS intent FROM orders""")  # fmt: skip
    train = q.where(I.fold_of("id") != 0)
    return I.predict_intents(I.train_intents(train, rows=500), q.where(I.fold_of("id") == 0)).select("id", "intent", "predicted")


@query("H22_document_vectors")
def h22(s, d):
    docs = table(s, d, "documents")
    v = I.document_vectors(I.train_vectors(docs), docs, "doc_id")
    return v.select("doc_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


@query("I05_select_by_prefix", "SELECT prefix, system FROM (SELECT substr(config, 1, 1) AS prefix, config AS system, row_number() OVER (PARTITION BY substr(config, 1, 1) ORDER BY score DESC, config DESC) AS r FROM (SELECT concat(l_returnflag, l_linestatus) AS config, round(avg(l_quantity), 9) AS score FROM lineitem GROUP BY 1) x) y WHERE r = 1")
def i05(s, d):
    x = rows(s, d, "SELECT concat(l_returnflag, l_linestatus) AS config, round(avg(l_quantity), 9) AS score FROM lineitem GROUP BY 1")
    return EV.select_by_prefix(x)


@query("I08_comparisons", "WITH t AS (SELECT DISTINCT event_type AS y FROM events) SELECT (SELECT min(y) FROM t) AS x, y, CAST(row_number() OVER (ORDER BY y) - 1 AS INT) AS k FROM t WHERE y <> (SELECT min(y) FROM t)")
def i08(s, d):
    names = [r.event_type for r in table(s, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # five types
    return s.createDataFrame([(a, b, k) for k, (a, b) in enumerate(SY.comparisons(names[0], names))], "x string, y string, k int")


@query("C10_heading_acts", "SELECT o_orderkey AS doc, 'penal_code' AS act_id, concat('s', o_orderkey % 400 + 1) AS ref FROM orders")
def c10(s, d):
    raw = rows(s, d, "SELECT o_orderkey AS doc, concat('Penal Code, 1860 - s. ', o_orderkey % 400 + 1, ' - scope') AS text FROM orders")
    return E.extract(raw, "doc").where("kind = 'provision'").select("doc", "act_id", "ref")


@query("C30_outcome_segments", "SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'acquittal' ELSE 'remanded' END AS label, 0.8 AS confidence FROM orders WHERE o_orderkey % 4 IN (0, 2)")
def c30(s, d):
    raw = rows(s, d, """SELECT o_orderkey AS doc, concat('The trial court acquitted him', CASE o_orderkey % 4 WHEN 0 THEN '. The appellants are acquitted.' WHEN 1 THEN '; whether they are acquitted is open.' WHEN 2 THEN ' – the High Court had quashed it – the case is remanded.' ELSE '.' END) AS tail, '' AS held FROM orders""")
    return E.substantive_outcomes(raw, "doc", "tail", "held").select("doc", "label", "confidence")


@query("E26_pilot_metrics", f"WITH r AS ({RUN}), l AS ({LABELS}), j AS (SELECT system, r.qid, rank, coalesce(grade, 0) AS g FROM r LEFT JOIN l ON r.qid = l.qid AND r.doc = l.doc) SELECT system, qid, count(*) FILTER (WHERE g >= 1 AND rank <= 5) / 5.0 AS p5, round(coalesce(1.0 / min(rank) FILTER (WHERE g >= 1 AND rank <= 5), 0), 6) AS mrr5 FROM j WHERE qid IN (SELECT qid FROM l GROUP BY qid HAVING max(grade) >= 1) GROUP BY 1, 2")
def e26(s, d):
    return metrics.per_query(rows(s, d, RUN), rows(s, d, LABELS)).select("system", "qid", "p5", F.round("mrr5", 6).alias("mrr5"))


@query("K_window_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def k01(s, d):
    return jobs.windowed_counts(table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))

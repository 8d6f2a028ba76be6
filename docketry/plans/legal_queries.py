"""Legal extraction queries (C) over synthetic sentences built from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import legal as L
from docketry.operators import entities as E
from docketry.operators import metrics
from docketry.operators import scoring as S
from docketry.plans.fixtures import CITES, LEGAL, PROVISIONS, query, rows, table


@query("C01_normalize_act_name", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Penal Code, 1860' WHEN 1 THEN 'Code of Criminal Procedure' WHEN 2 THEN 'Income Tax Act' ELSE 'Arms Act' END AS act FROM orders")
def c01(s, d):
    raw = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'The Indian  Penal Code, 1860.' WHEN 1 THEN 'Criminal Procedure Code' WHEN 2 THEN 'Income-tax Act' ELSE ' the Arms Act;' END AS act FROM orders")
    return raw.select("o_orderkey", L.normalize_act_name(F.trim("act")).alias("act"))


@query("C02_canonical_act", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'penal_code' WHEN 1 THEN 'code_of_criminal_procedure_1898' WHEN 2 THEN 'arms_act' WHEN 3 THEN NULL ELSE 'local_shops_act' END AS act_id,
  CASE o_orderkey % 5 WHEN 0 THEN 1860 WHEN 1 THEN 1898 WHEN 2 THEN 1959 WHEN 3 THEN NULL ELSE 1971 END AS year FROM orders""")
def c02(s, d):
    raw = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'IPC' WHEN 1 THEN 'Code of Criminal Procedure, 1898' WHEN 2 THEN 'the Arms Act' WHEN 3 THEN 'Blue Sky' ELSE 'Local Shops Act, 1971' END AS name FROM orders")
    return E.canonical_act(raw, "name", E.act_table(s)).select("o_orderkey", "act_id", "year")


@query("C03_act_label", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'IPC' WHEN 1 THEN 'Given' ELSE 'Local Shops Act' END AS label FROM orders")
def c03(s, d):
    raw = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'penal_code' ELSE 'local_shops_act' END AS act_id, CASE o_orderkey % 3 WHEN 1 THEN 'Given' END AS given FROM orders")
    return E.act_label(raw, E.act_table(s), "given").select("o_orderkey", "label")


@query("C04_resolve_abbreviation", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Code of Criminal Procedure' WHEN 1 THEN 'Negotiable Instruments Act' WHEN 2 THEN 'Penal Code' END AS act FROM orders")
def c04(s, d):
    raw = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Cr. P.C.' WHEN 1 THEN 'N.I. Act' WHEN 2 THEN 'I.P.C.' ELSE 'X.Y.' END AS a FROM orders")
    return raw.select("o_orderkey", L.resolve_abbreviation(F.col("a")).alias("act"))


@query("C05_find_concepts", """SELECT o_orderkey AS doc, concept, CAST(n AS INT) AS n FROM (SELECT o_orderkey, 'bail' AS concept, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n FROM orders
  UNION ALL SELECT o_orderkey, 'anticipatory bail', CASE o_orderkey % 4 WHEN 1 THEN 1 ELSE 0 END FROM orders UNION ALL SELECT o_orderkey, 'arrest', CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END FROM orders) x WHERE n > 0""")
def c05(s, d):
    concepts = s.createDataFrame([("bail", ["bail", "bail bond", "bail bond form"], []), ("anticipatory bail", ["anticipatory bail", "apprehending arrest"], []), ("arrest", ["arrest", "grounds of arrest"], [])], "concept string, phrases array<string>, implied array<string>")
    raw = rows(s, d, """SELECT o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN 'Bail and a bail bond; bailiff' WHEN 1 THEN 'Anticipatory bail: arrested, arrest' WHEN 2 THEN 'The grounds of arrest, the arrest and a bail bond form' ELSE 'arrested jailbail bails' END AS text FROM orders""")
    return E.find_concepts(raw, concepts, "doc").select("doc", "concept", "n")


@query("C06_implied_provisions", "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'penal_code:s302' ELSE 'evidence_act:s32' END AS provision FROM orders UNION ALL SELECT o_orderkey, 'penal_code:s300' FROM orders WHERE o_orderkey % 2 = 0")
def c06(s, d):
    concepts = s.createDataFrame([("murder", ["murder"], ["penal_code:s302", "penal_code:s300"]), ("dying declaration", ["dying declaration"], ["evidence_act:s32"])], "concept string, phrases array<string>, implied array<string>")
    asked = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'murder' ELSE 'dying declaration' END AS concept FROM orders")
    return E.implied_provisions(asked, concepts).select("o_orderkey", "provision")


@query("C07_normalize_number", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN concat(l_partkey % 900 + 1, 'B') WHEN 1 THEN concat(l_partkey % 900 + 1, '') ELSE concat(l_partkey % 900 + 1, 'A') END AS num FROM lineitem")
def c07(s, d):
    raw = rows(s, d, "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN concat(l_partkey % 900 + 1, ' (B)') WHEN 1 THEN concat(l_partkey % 900 + 1, '(2)(b)') ELSE concat(l_partkey % 900 + 1, '-A') END AS raw FROM lineitem")
    return raw.select("l_orderkey", "l_linenumber", L.normalize_number(F.col("raw")).alias("num"))


@query("C08_split_numbers", "SELECT o_orderkey, concat(o_orderkey % 500 + 1, '|', o_custkey % 90 + 1, '|34') AS nums FROM orders")
def c08(s, d):
    raw = rows(s, d, "SELECT o_orderkey, concat(o_orderkey % 500 + 1, ', ', o_custkey % 90 + 1, ' read with 34') AS raw FROM orders")
    return raw.select("o_orderkey", F.concat_ws("|", L.split_numbers(F.col("raw"))).alias("nums"))


@query("C11_extract_acts", "SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'penal_code' ELSE 'code_of_criminal_procedure' END AS act_id, 1 AS n FROM orders WHERE o_orderstatus <> 'P'")
def c11(s, d):
    return E.extract(rows(s, d, LEGAL), "doc").where("kind = 'act'").groupBy("doc", "act_id").agg(F.count(F.lit(1)).alias("n"))


@query("C12_extract_provisions", """SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'penal_code' WHEN 'O' THEN 'code_of_criminal_procedure' ELSE '?' END AS act_id, concat('s', o_orderkey % 511 + 1) AS ref, 1 AS n FROM orders""")
def c12(s, d):
    return E.extract(rows(s, d, LEGAL), "doc").where("kind = 'provision'").groupBy("doc", "act_id", "ref").agg(F.count(F.lit(1)).alias("n"))


@query("C13_parse_list_of_acts", "SELECT o_orderkey AS doc, 'penal_code' AS act_id, 1860 AS year FROM orders UNION ALL SELECT o_orderkey, 'arms_act', 1900 + o_orderkey % 90 FROM orders")
def c13(s, d):
    raw = rows(s, d, "SELECT o_orderkey AS doc, concat('Penal Code, 1860 - ss. 302, 34; Arms Act, ', 1900 + o_orderkey % 90, '; Nothing here') AS acts FROM orders")
    return E.parse_list_of_acts(raw, "doc", "acts", E.act_table(s)).select("doc", "act_id", "year")


@query("C14_default_act_map", """SELECT l_orderkey AS doc, CASE WHEN count(DISTINCT l_suppkey % 7) FILTER (WHERE l_suppkey % 2 = 0) = 1 THEN min(concat('act', l_suppkey % 7)) FILTER (WHERE l_suppkey % 2 = 0) END AS code_id,
  CASE WHEN count(DISTINCT l_suppkey % 7) FILTER (WHERE l_suppkey % 2 = 1) = 1 THEN min(concat('act', l_suppkey % 7)) FILTER (WHERE l_suppkey % 2 = 1) END AS act_id FROM lineitem GROUP BY 1""")
def c14(s, d):
    listed = rows(s, d, "SELECT l_orderkey AS doc, concat('act', l_suppkey % 7) AS act_id, CASE l_suppkey % 2 WHEN 0 THEN 'Some Code' ELSE 'Some Act' END AS name FROM lineitem")
    return E.default_act_map(listed)


@query("C15_resolve_unattributed", f"""WITH p AS (SELECT doc, act_id, ref, sum(n) AS n FROM ({PROVISIONS}) x GROUP BY 1, 2, 3),
  o AS (SELECT doc, ref, count(DISTINCT act_id) AS k, min(act_id) AS owner FROM p WHERE act_id <> '?' GROUP BY 1, 2)
  SELECT p.doc, CASE WHEN p.act_id = '?' AND o.k = 1 THEN o.owner ELSE p.act_id END AS act_id, p.ref, CAST(sum(n) AS BIGINT) AS n FROM p LEFT JOIN o ON p.doc = o.doc AND p.ref = o.ref GROUP BY 1, 2, 3""")
def c15(s, d):
    p = rows(s, d, PROVISIONS).groupBy("doc", "act_id", "ref").agg(F.sum("n").alias("n"))
    return E.resolve_unattributed(p, None, "n")


@query("C16_summarize_zones", f"SELECT doc, act_id, ref, CAST(sum(CASE zone WHEN 'headnotes' THEN n ELSE 0 END) AS BIGINT) AS head, CAST(sum(CASE zone WHEN 'headnotes' THEN 0 ELSE n END) AS BIGINT) AS body FROM ({PROVISIONS}) x GROUP BY 1, 2, 3")
def c16(s, d):
    return E.summarize_zones(rows(s, d, PROVISIONS), "doc", "act_id", "ref")


@query("C17_resolve_with_labels", f"""WITH p AS (SELECT doc, act_id, ref, sum(n) AS n FROM ({PROVISIONS}) x GROUP BY 1, 2, 3),
  o AS (SELECT doc, ref, count(DISTINCT act_id) AS k, min(act_id) AS owner FROM p WHERE act_id <> '?' GROUP BY 1, 2),
  r AS (SELECT p.doc, CASE WHEN p.act_id = '?' AND o.k = 1 THEN o.owner ELSE p.act_id END AS act_id, p.ref, sum(n) AS n FROM p LEFT JOIN o ON p.doc = o.doc AND p.ref = o.ref GROUP BY 1, 2, 3)
  SELECT doc, act_id, ref, CAST(n AS BIGINT) AS n, CASE WHEN act_id = '?' THEN concat('s. ', substr(ref, 2)) ELSE concat('Act', substr(act_id, 4), ' s. ', substr(ref, 2)) END AS label FROM r""")
def c17(s, d):
    p = rows(s, d, PROVISIONS).groupBy("doc", "act_id", "ref").agg(F.sum("n").alias("n"))
    return E.provision_labels(E.resolve_unattributed(p, None, "n"), E.act_table(s))


@query("C18_act_merge", """WITH a AS (SELECT l_orderkey AS doc, l_suppkey % 7 AS act, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS listed, sum(CASE WHEN l_linestatus = 'O' AND l_linenumber <> 1 THEN 1 ELSE 0 END) AS head, sum(CASE WHEN l_linestatus = 'F' AND l_linenumber <> 1 THEN 1 ELSE 0 END) AS body FROM lineitem GROUP BY 1, 2)
  SELECT doc, act, listed = 1 AS listed, CAST(head AS BIGINT) AS head, CAST(body AS BIGINT) AS body FROM a WHERE listed = 1 OR head > 0 OR body >= 2""")
def c18(s, d):
    m = rows(s, d, "SELECT l_orderkey AS doc, l_suppkey % 7 AS act, CASE WHEN l_linenumber = 1 THEN 'listed' WHEN l_linestatus = 'O' THEN 'head' ELSE 'body' END AS place FROM lineitem")
    return E.merge_acts(m, "doc", "act")


@query("C19_concept_merge", """WITH a AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS concept, count(*) FILTER (WHERE l_linestatus = 'O') AS head, count(*) FILTER (WHERE l_linestatus = 'F') AS body FROM lineitem GROUP BY 1, 2) SELECT * FROM a WHERE head > 0 OR body >= 3""")
def c19(s, d):
    m = rows(s, d, "SELECT l_orderkey AS doc, l_suppkey % 3 AS concept, CASE WHEN l_linestatus = 'O' THEN 'head' ELSE 'body' END AS place FROM lineitem")
    return E.merge_concepts(m, "doc", "concept")


_ASKED = "SELECT o_orderkey % 40 AS qid, min(CASE o_orderkey % 3 WHEN 0 THEN '?' ELSE concat('act', o_custkey % 7) END) AS act_id, concat('s', o_custkey % 90 + 1) AS ref FROM orders GROUP BY o_orderkey % 40, concat('s', o_custkey % 90 + 1)"
_HELD = f"SELECT doc, act_id, ref, sum(CASE zone WHEN 'headnotes' THEN n ELSE 0 END) AS head, sum(CASE zone WHEN 'headnotes' THEN 0 ELSE n END) AS body FROM ({PROVISIONS}) x GROUP BY doc, act_id, ref"


@query("C20_provision_matches", f"""SELECT q.qid, h.doc, q.ref, q.act_id AS q_act, h.act_id AS d_act, CASE WHEN q.act_id = '?' OR q.act_id = h.act_id THEN 1.0 ELSE 0.7 END * CASE WHEN head > 0 THEN 1.0 WHEN body >= 3 THEN 0.6 WHEN body > 0 THEN 0.3 ELSE 0.0 END AS value
  FROM ({_ASKED}) q JOIN ({_HELD}) h ON q.ref = h.ref AND (q.act_id = '?' OR h.act_id = q.act_id OR h.act_id = '?')""")
def c20(s, d):
    return S.match_provisions(rows(s, d, _ASKED), rows(s, d, _HELD)).select("qid", "doc", "ref", F.col("act_id").alias("q_act"), "d_act", "value")


@query("C21_polarity", f"SELECT polarity, count(*) AS n FROM ({CITES}) x GROUP BY 1")
def c21(s, d):
    return rows(s, d, CITES).groupBy(L.polarity(F.col("treatment")).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


@query("C22_normalize_party", "SELECT l_orderkey, l_linenumber, concat('supplier ', l_suppkey, ' v part ', l_partkey) AS party FROM lineitem")
def c22(s, d):
    return rows(s, d, CITES).select(F.col("doc").alias("l_orderkey"), F.col("pos").alias("l_linenumber"), L.normalize_party(F.col("name")).alias("party"))


@query("C23_case_key", "SELECT l_orderkey, l_linenumber, concat('supplier ', l_suppkey, ' v part ', l_partkey) AS k FROM lineitem")
def c23(s, d):
    return rows(s, d, CITES).select(F.col("doc").alias("l_orderkey"), F.col("pos").alias("l_linenumber"), L.case_key(F.col("name")).alias("k"))


@query("C24_split_entry", "SELECT l_orderkey AS doc, l_linenumber AS pos, concat('Supplier ', l_suppkey, ' v. Part ', l_partkey, ' & Ors') AS name, concat('[2024] ', l_linenumber, ' SCR ', l_orderkey % 999 + 1) AS first_cite FROM lineitem")
def c24(s, d):
    raw = rows(s, d, CITES).select("doc", "pos", F.concat("name", F.lit(" "), "cite").alias("entry"))
    e = E.split_entry(F.col("entry"))
    return raw.select("doc", "pos", e["name"].alias("name"), F.get(e["citations"], F.lit(0)).alias("first_cite"))


@query("C25_scr_key", "SELECT l_orderkey AS doc, l_linenumber AS pos, concat('[2024] ', l_linenumber, ' SCR ', l_orderkey % 999 + 1) AS scr FROM lineitem")
def c25(s, d):
    return rows(s, d, CITES).select("doc", "pos", L.scr_key(F.regexp_replace("cite", "SCR", "S.C.R.")).alias("scr"))


@query("C26_parse_case_law", f"SELECT doc, concat('supplier ', l, ' v part ', p) AS key, treatment, polarity FROM (SELECT l_orderkey AS doc, l_suppkey AS l, l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 'relied on' WHEN 'R' THEN 'distinguished' ELSE 'referred to' END AS treatment, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS polarity FROM lineitem) x")
def c26(s, d):
    block = rows(s, d, CITES).groupBy("doc").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat("name", F.lit(" "), "cite", F.lit(" - "), "treatment", F.lit("."))))).alias("block"))
    return E.parse_case_law(block, "doc", "block").select("doc", "key", "treatment", "polarity")


@query("C27_named_precedents", "SELECT o_orderkey, concat('ram kumar v state of region', chr(CAST(97 + o_custkey % 20 AS INT))) AS k FROM orders")
def c27(s, d):
    raw = rows(s, d, "SELECT o_orderkey, concat('find cases that follow Ram Kumar v. State of Region', chr(CAST(97 + o_custkey % 20 AS INT)), ' on bail') AS q FROM orders")
    return raw.select("o_orderkey", F.explode(E.named_precedents(F.col("q"))).alias("k"))


_KEYS = "SELECT l_orderkey, l_linenumber, concat('supplier ', l_suppkey % 9, ' v part ', l_partkey % 5) AS a, concat('supplier ', l_orderkey % 9, ' v part ', l_linenumber) AS b FROM lineitem"


@query("C28_key_matches", """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 9 = l_orderkey % 9 THEN 0.6 + 0.4 * (1 + CASE WHEN l_partkey % 5 = l_linenumber THEN 1 ELSE 0 END) / 2.0 ELSE 0.0 END AS score FROM lineitem""")
def c28(s, d):
    return rows(s, d, _KEYS).select("l_orderkey", "l_linenumber", L.key_match(F.col("a"), F.col("b")).alias("score"))


@query("C29_procedural_outcome", "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 = 0 THEN 'disposed' ELSE CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE 'partly_allowed' END END AS outcome FROM orders")
def c29(s, d):
    result = F.when(F.col("doc") % 5 != 0, F.col("text"))
    return rows(s, d, LEGAL).select("doc", L.procedural_outcome(result, F.lit("Disposed off")).alias("outcome"))


@query("C31_substantive_outcomes", "SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'acquittal' ELSE 'bail_granted' END AS label, CASE WHEN o_orderkey % 3 = 1 THEN 1.0 WHEN o_orderkey % 3 = 0 THEN 0.8 ELSE 0.6 END AS confidence FROM orders")
def c31(s, d):
    raw = rows(s, d, """SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'The appellants are acquitted.' WHEN 1 THEN 'He is released on bail.' ELSE 'We do not say he is released on bail.' END AS tail,
      CASE o_orderkey % 3 WHEN 0 THEN 'Whether they stand acquitted.' ELSE 'Held: he is released on bail.' END AS held FROM orders""")  # fmt: skip
    return E.substantive_outcomes(raw, "doc", "tail", "held")


@query("C32_outcome_requirements", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'bail_granted' WHEN 1 THEN '' ELSE 'remanded|dismissed' END AS labels FROM orders")
def c32(s, d):
    raw = rows(s, d, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'bail was granted' WHEN 1 THEN 'court refused to quash the FIR' ELSE 'matter remanded and appeal dismissed' END AS q FROM orders")
    return raw.select("o_orderkey", F.concat_ws("|", L.outcome_requirements(F.col("q"))).alias("labels"))


_REQ = "SELECT r AS qid, CASE r WHEN 0 THEN 'dismissed' WHEN 1 THEN 'allowed' ELSE 'acquittal' END AS label, 1 AS pos FROM (SELECT DISTINCT n_nationkey % 3 AS r FROM nation) z"
_OUT = "SELECT o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'dismissed' WHEN 'O' THEN 'allowed' ELSE 'conviction_upheld' END AS label, CASE o_orderkey % 2 WHEN 0 THEN 0.9 ELSE 0.6 END AS confidence FROM orders"


_CLASH = "(r.label = 'dismissed' AND o.label = 'allowed') OR (r.label = 'allowed' AND o.label = 'dismissed') OR (r.label = 'acquittal' AND o.label = 'conviction_upheld')"


@query("C33_outcome_compatibility", f"""SELECT qid, doc, round(CASE WHEN r.label = o.label THEN 0.5 + 0.5 * confidence WHEN {_CLASH} THEN 0.5 - 0.5 * confidence ELSE 0.5 END, 6) AS score,
  CASE WHEN r.label = o.label OR {_CLASH} THEN concat('outcome ', chr(39), replace(o.label, '_', ' '), chr(39), CASE WHEN r.label = o.label THEN ' matches request' ELSE ' conflicts with request' END) ELSE 'outcome could not be determined' END AS reason FROM ({_REQ}) r, ({_OUT}) o""")
def c33(s, d):
    held = rows(s, d, _OUT)
    return S.outcome_scores(rows(s, d, _REQ), held, s, held.select("doc")).select("qid", "doc", F.round("score", 6).alias("score"), "reason")


@query("C34_prf", """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 50 AS a FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 50 AS a FROM lineitem WHERE l_linenumber >= 2),
  c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p JOIN g ON p.k = g.k AND p.a = g.a) AS tp) SELECT tp, np, ng, round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM c""")
def c34(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 50).alias("a"), "l_linenumber")
    m = metrics.set_scores(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 2"), "k", "a")
    return m.select("tp", "np", "ng", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])

"""Literal cases of the column functions and operators."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.functions import legal as L
from docketry.functions import text as T
from docketry.functions import vectors as V
from docketry.operators import corpus, entities, labels, metrics
from docketry.operators import retrieval as R
from docketry.operators import scoring as S


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("naïve über a_b x1 42"))) == ["x1", "42"]
    assert one(spark, T.content_tokens(F.lit("The cases of bail and the bail"))) == ["bail", "bail"]


@pytest.mark.parametrize(("n", "count"), [(400, 1), (401, 2), (700, 2), (701, 3), (0, 0), (1, 1)])
def test_chunks(spark, n, count):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i.cast("string"))
    got = one(spark, T.chunks(F.slice(tokens, 1, n)))
    assert len(got) == count and (not count or (got[-1].tokens[-1] == str(n - 1) and all(len(c.tokens) <= 400 for c in got)))


def test_text_cleaning(spark):
    assert one(spark, T.normalize_space(F.lit("  a\u00a0 b\u200bc\u2003\u2002d\n"))) == "a bc d"
    assert one(spark, T.normalize_space(F.lit("\u200b a  b \x1c"))) == "a b" and one(spark, T.normalize_space(F.lit(None).cast("string"))) is None
    assert one(spark, T.split_sentences(F.lit("The appeal fails. It is dismissed. See s. 302 IPC."))) == ["The appeal fails.", "It is dismissed.", "See s. 302 IPC."]
    assert one(spark, T.slug(F.lit("Unlawful Activities (Prevention) Act"))) == "unlawful_activities_prevention_act"
    assert one(spark, T.assemble(F.lit("a"), F.lit(""), F.lit("b"))) == "a\n\nb"
    assert one(spark, T.segments(F.lit("one; two – three.  "))) == ["one;", "two", "three."]
    assert len(one(spark, T.paragraphs(F.lit("x" * 81 + "1\n\nshort\n" + "y" * 90 + "1")))) == 2


def test_minmax(spark):
    df = spark.createDataFrame([("a", 3.0, True)] * 3 + [("b", 1.0, True), ("b", 2.0, True), ("b", 3.0, False)], "g string, x double, p boolean")
    got = sorted((r.g, r.y) for r in df.select("g", V.minmax(F.col("x"), F.col("p"), "g").alias("y")).collect())
    assert got == [("a", 0.0)] * 3 + [("b", 0.0), ("b", 0.0), ("b", 1.0)]


def test_numbers(spark):
    assert [one(spark, L.normalize_number(F.lit(x))) for x in ("30(2)(b)", "120(B)", "120-B", "x")] == ["30", "120B", "120B", ""]
    assert one(spark, L.split_numbers(F.lit("302/34"))) == ["302", "34"]
    assert one(spark, L.split_numbers(F.lit("120B, 420 and 468"))) == ["120B", "420", "468"]


@pytest.mark.parametrize(("t", "p"), [("relied on", "positive"), ("held inapplicable", "negative"), ("referred to", "neutral"), ("need not be overruled", "negative"), ("Held  Overruled", "negative")])
def test_polarity(spark, t, p):
    assert one(spark, L.polarity(F.lit(t))) == p


def test_case_keys(spark):
    assert one(spark, L.case_key(F.lit("Arnesh Kumar & Anr. versus State of Bihar (Dead)"))) == "arnesh kumar v state of bihar"
    score = lambda a, b: one(spark, L.key_match(F.lit(a), F.lit(b)))
    a = "arnesh kumar v state of bihar"
    assert score(a, a) == pytest.approx(1.0) and score(a, "arnesh kumar v state of delhi") == pytest.approx(0.6 + 0.4 * 2 / 3) and score(a, "ravi kumar v state of bihar") == 0
    assert one(spark, L.scr_key(F.lit("[2007] 3 Suppl. S.C.R. 507"))) == "[2007] 3 SCR 507" and one(spark, L.scr_key(F.lit("(2007) 3 SCC 1"))) is None


def test_outcomes(spark):
    f = lambda r, d: one(spark, L.procedural_outcome(F.lit(r), F.lit(d)))
    assert [f("Appeals partly allowed", None), f("Appeal dismissed", None), f("", "Disposed off"), f(None, None)] == ["partly_allowed", "dismissed", "disposed", None]
    req = spark.createDataFrame([(1, "dismissed", 0), (2, "dismissed", 0), (2, "acquittal", 1)], "qid int, label string, pos int")
    out = spark.createDataFrame([(7, "allowed", 0.9), (7, "acquittal", 0.8)], "doc int, label string, confidence double")
    assert {r.qid: round(r.score, 6) for r in S.outcome_scores(req, out, spark).collect()} == {1: 0.05, 2: 0.9}
    assert one(spark, L.outcome_requirements(F.lit("refused to quash but bail was granted"))) == ["bail_granted"]


def _found(spark, text, defaults=None):
    rows = entities.extract(spark.createDataFrame([(1, text)], "doc int, text string"), "doc", defaults=defaults).collect()
    return Counter((x.act_id, x.ref) for x in rows if x.kind == "provision"), Counter(x.act_id for x in rows if x.kind == "act")


def test_entities(spark):
    found, acts = _found(spark, "Penal Code, 1860 – ss. 302/34. Article 21 of the Constitution. Section 438 Cr.P.C. and Order 7 Rule 11. Rule 5 applies; section 0.")
    assert set(found) == {("penal_code", "s302"), ("penal_code", "s34"), ("constitution_of_india", "art21"), ("code_of_criminal_procedure", "s438"), ("code_of_civil_procedure", "o7r11"), ("?", "r11"), ("?", "r5")}
    assert acts == {"penal_code": 1, "constitution_of_india": 1, "code_of_criminal_procedure": 1}
    assert _found(spark, "") == (Counter(), Counter()) and _found(spark, None) == (Counter(), Counter())


@pytest.mark.parametrize(
    ("text", "provisions", "acts"),
    [
        ("u/s. 120-B, 420 and 468 of the Indian Penal Code", ["penal_code:s120B", "penal_code:s420", "penal_code:s468"], ["penal_code"]),
        ("u/s 34 I.P.C.", ["penal_code:s34"], ["penal_code"]),
        ("Secs. 7 and 13 of the P.C. Act; ss. 3 to 5 PMLA", ["prevention_of_corruption_act:s7", "prevention_of_corruption_act:s13", "prevention_of_money_laundering_act:s3", "prevention_of_money_laundering_act:s5"], ["prevention_of_corruption_act", "prevention_of_money_laundering_act"]),
        ("Section 30(2)(b) read with 120(B) of the Arms Act, 1959", ["arms_act:s30", "arms_act:s120B"], ["arms_act"]),
        ("Unlawful Activities (Prevention) Act, 1967 – Bail – s. 43D(5)", ["unlawful_activities_prevention_act:s43D"], ["unlawful_activities_prevention_act"]),
        ("Constitution of India – Arts. 14, 19(1)(a) and 21", ["constitution_of_india:art14", "constitution_of_india:art19", "constitution_of_india:art21"], ["constitution_of_india"]),
        ("Section 7 of the Blue (Red and Green) Lake Rules, 2001 and regulation 4", ["blue_red_and_green_lake_rules:s7"], ["blue_red_and_green_lake_rules"]),
        ("Rule 4 of the Local Shops Act applies", ["local_shops_act:r4"], []),
        ("Order XXI, r. 90A and O. 39 Rule 2 of the Constitution", ["code_of_civil_procedure:oXXIr90A", "constitution_of_india:o39r2", "?:r90A", "constitution_of_india:r2"], ["constitution_of_india"]),
        ("Section 3 of the Code. Section 4 of the Act. Section 12345. Sections alone. 302 IPC", ["?:s3", "?:s4"], ["penal_code"]),
        ("the Code of Criminal Procedure, 1898 and s. 5", ["?:s5"], ["code_of_criminal_procedure_1898"]),
        ("SC/ST Act and NDPS s. 50; Arbitration Act, 1940; the new Act, 2020; Bank Act", ["?:s50"], ["scheduled_castes_and_scheduled_tribes_prevention_of_atrocities_act", "narcotic_drugs_and_psychotropic_substances_act", "arbitration_act"]),
        ("Article 5 of the Local Treaty Act, 1999", ["local_treaty_act:art5"], ["local_treaty_act"]),
    ],
)
def test_entity_forms(spark, text, provisions, acts):
    found, seen = _found(spark, text)
    assert found == Counter(tuple(p.split(":")) for p in provisions) and seen == Counter(acts)


def test_default_acts(spark):
    """"The Code" stands for the one Code that the document's own list names; other documents have none."""
    listed = spark.createDataFrame([(1, "penal_code", "Penal Code"), (1, "arms_act", "Arms Act"), (2, "x_act", "X Act"), (2, "y_act", "Y Act")], "doc int, act_id string, name string")
    text = "Section 3 of the Code and s. 4 of the said Act."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc int, text string")
    got = {(r.doc, r.act_id, r.ref) for r in entities.extract(docs, "doc", defaults=entities.default_act_map(listed)).where("kind = 'provision'").collect()}
    assert got == {(1, "penal_code", "s3"), (1, "arms_act", "s4"), (2, "?", "s3"), (2, "?", "s4")}


def test_act_dictionary(spark):
    names = spark.createDataFrame([(n,) for n in ("Indian Penal Code", "Cr.P.C.", "Civil Procedure Code, 1908", "Bhartiya Nyaya Sanhita", "N.I. Act", "Income-tax Act", "Indian Succession Act", "Arbitration Act, 1940", "Blue Sky", "A&C Act", "Constitution")], "n string")
    got = {r.n: (r.act_id, r.year) for r in entities.canonical_act(names, "n", entities.act_table(spark)).collect()}
    assert got == {
        "Indian Penal Code": ("penal_code", 1860), "Cr.P.C.": ("code_of_criminal_procedure", 1973), "Civil Procedure Code, 1908": ("code_of_civil_procedure", 1908),
        "Bhartiya Nyaya Sanhita": ("bharatiya_nyaya_sanhita", 2023), "N.I. Act": ("negotiable_instruments_act", 1881), "Income-tax Act": ("income_tax_act", 1961),
        "Indian Succession Act": ("indian_succession_act", 1925), "Arbitration Act, 1940": ("arbitration_act", 1940), "Blue Sky": (None, None),
        "A&C Act": ("arbitration_and_conciliation_act", 1996), "Constitution": ("constitution_of_india", None),
    }


def test_unattributed(spark):
    p = spark.createDataFrame([(1, "a", "s3", 1), (1, "?", "s3", 2), (2, "a", "s3", 1), (2, "b", "s3", 1), (2, "?", "s3", 1), (3, "?", "s9", 4)], "doc int, act_id string, ref string, n int")
    listed = spark.createDataFrame([(3, "z")], "doc int, act_id string")
    got = {(r.doc, r.act_id, r.ref): r.n for r in entities.resolve_unattributed(p, listed, "n").collect()}
    assert got == {(1, "a", "s3"): 3, (2, "a", "s3"): 1, (2, "b", "s3"): 1, (2, "?", "s3"): 1, (3, "z", "s9"): 4}


def test_polarity_collapse(spark):
    c = spark.createDataFrame([(1, "k", 0, "neutral"), (1, "k", 1, "negative"), (1, "k", 2, "neutral"), (2, "k", 0, "positive"), (2, "k", 1, "negative"), (3, "k", 0, "neutral")], "doc int, key string, pos int, polarity string")
    assert {r.doc: r.polarity for r in S.collapse_polarity(c).collect()} == {1: "negative", 2: "negative", 3: "neutral"}


def test_metrics(spark):
    import math

    run = spark.createDataFrame([("s", "q", 1, "d1"), ("s", "q", 2, "d2"), ("s", "q", 3, "d3"), ("s", "z", 1, "d1")], "system string, qid string, rank int, doc string")
    lab = spark.createDataFrame([("q", "d2", 2), ("q", "d9", 1), ("z", "d1", 0)], "qid string, doc string, grade int")
    (m,) = metrics.per_query(run, lab).collect()
    want = (3 / math.log2(3)) / (3 + 1 / math.log2(3))
    assert (m.qid, m.p5, m.r5, m.mrr5, m.judged5) == ("q", 0.2, 0.5, 0.5, 0.2) and m.ndcg5 == pytest.approx(want)


def test_weights(spark):
    w = {(r.config, r.intent, r.signal): r.weight for r in S.resolve_weights(spark).collect()}
    assert w["A3_pdf_table_equal_blend", "LEGAL_ISSUE", "bm25"] == pytest.approx(0.2)
    totals = {}
    for (c, i, _), x in w.items():
        totals[c, i] = totals.get((c, i), 0) + x
    assert all(t == pytest.approx(1) for t in totals.values())


def test_fusion_invariants(spark):
    rows = [("q", "LEGAL_ISSUE", d, s, float(v)) for d, vs in ((1, (5, 1, 0)), (2, (5, 1, 0)), (3, (1, 9, 2))) for s, v in zip(("bm25", "semantic", "legal"), vs, strict=True)]
    sig = spark.createDataFrame(rows, "qid string, intent string, doc int, signal string, raw double")
    got = {r.doc: r.score for r in S.fuse(sig, S.resolve_weights(spark).where("config = 'F1_pdf_column_mean'")).collect()}
    assert got[1] == got[2] and all(0 <= v <= 1 for v in got.values())
    top = R.top_k(spark.createDataFrame([("q", d, v) for d, v in got.items()], "qid string, doc int, score double"), 3, by="qid", tie="doc").orderBy("rank").collect()
    assert [r.doc for r in top if r.doc < 3] == [1, 2]


def test_fused_score_halfway(spark):
    """0.15 * 0.5 + 0.85 * 0.7091 is 0.677735, whose sum of doubles lies below it; the score does not depend on the order of rows."""
    raw = {"bm25": (0, 100, 50), "legal": (0, 10_000, 7_091)}
    rows = [("q", "LEGAL_ISSUE", d, s, float(v)) for s, vs in raw.items() for d, v in enumerate(vs)]
    weights = spark.createDataFrame([("c", "LEGAL_ISSUE", "bm25", 0.15), ("c", "LEGAL_ISSUE", "legal", 0.85)], "config string, intent string, signal string, weight double")
    for some in (rows, rows[::-1]):
        got = S.fuse(spark.createDataFrame(some, "qid string, intent string, doc int, signal string, raw double"), weights).withColumn("score", F.round("score", 5))
        assert {r.doc: r.score for r in got.collect()} == {0: 0.0, 1: 1.0, 2: 0.67774}


def test_corpus(spark):
    page = "[2024] 1 S.C.R. 5\n12\nRam v. State\nfirst exam-\nple text\n* Author\nRam v. State\n\nRam v. State\nan example 7"
    d = spark.createDataFrame([(1, page)], "doc int, text string")
    lines = corpus.clean_lines(d, "doc")
    assert [r.line for r in lines.orderBy("pos").collect()] == ["first exam-", "ple text", "an example 7"]
    assert corpus.join_lines(lines, "doc").first().text == "first example text an example 7"
    assert corpus.parse_bench(F.lit("x")) is not None and one(spark, corpus.extract_result(F.lit("Result of the case: Appeals partly allowed."))) == "Appeals partly allowed"
    cite = lambda t: one(spark, corpus.report_citation(F.lit(t)))
    assert cite("12\n[2024]  10 S.C.R. 77 : Ram v. State\nx") == "[2024] 10 SCR 77" and cite("1\n2\n3\n4\n5\n[2024] 1 S.C.R. 7 : x") is None and cite("[2024] 1 S.C.R. 7") is None


def test_corpus_report(spark):
    sections = spark.createDataFrame([(1, "issue", "x"), (2, "issue", " "), (2, "judgment", "y")], "doc int, section string, text string")
    assert {r.section: r.n for r in corpus.section_coverage(sections, "doc").collect() if r.n} == {"issue": 1, "judgment": 1}
    rows = spark.createDataFrame([("a", None, 3), ("b", "", 5), ("b", "x", None)], "k string, v string, n int")
    assert {r.field: r.n for r in corpus.completeness(rows, ("k", "v")).collect()} == {"k": 3, "v": 1}
    v = corpus.validate(rows, "k", ("v",), {"small": F.col("n") < 4}).first()
    assert (v.rows, v["keys"], v.duplicate_keys, v.empty_v, v.invalid_small) == (3, 2, 1, 2, 1)


def test_labels(spark):
    log = spark.createDataFrame([("q", 1, 0, 1), ("q", 1, 2, 5), ("q", 2, 1, 3)], "qid string, doc int, grade int, time int")
    assert {r.doc: r.grade for r in labels.latest(log, "qid", "doc").collect()} == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        labels.validate_search("x", "bm25", ("bm25",))


def test_bootstrap(spark):
    d = spark.createDataFrame([(i, 0.1 + i % 3 * 0.01) for i in range(20)], "qid int, d double")
    r = metrics.paired_bootstrap(d, 300).first()
    assert r.n_queries == 20 and r.wins == 20 and r.ci_low > 0 and r.p_value < 0.02
    assert metrics.paired_bootstrap(d.limit(1), 10).count() == 0

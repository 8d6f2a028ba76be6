"""Search with Acts, provisions, concepts, citations, outcomes and vectors; the registry of systems; tables behind the service."""

import math

import pytest
from pyspark.sql import functions as F

from docketry.config import INTENTS
from docketry.operators import evaluate as EV
from docketry.operators import retrieval as R
from docketry.operators import scoring as S
from docketry.operators import service as SV
from docketry.plans import search as P
from docketry.plans import systems as SY

TEXTS = [
    (0, "Section 302 IPC murder murder murder. The appellants are acquitted. Appeal allowed."),
    (1, "Section 302 of the Penal Code. Section 302 IPC and s. 302 IPC. murder. Appeal dismissed."),
    (2, "Section 438 Cr.P.C. anticipatory bail is granted. Released on bail."),
    (3, "Land acquisition and market value of the land; compensation is enhanced."),
    (4, "Tenant and landlord: eviction and rent of a shop."),
]
CITED = [(0, "ram kumar v state", 0, "positive"), (1, "ram kumar v state", 0, "negative"), (1, "x y v z", 1, "neutral"), (2, "x y v z", 0, "positive"), (3, "lone case v z", 0, "neutral")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    concepts = spark.createDataFrame([("murder", ["murder"], ["penal_code:s302"]), ("bail", ["anticipatory bail", "bail"], ["code_of_criminal_procedure:s438"])], P.NO_CONCEPTS)
    cited = spark.createDataFrame(CITED, "doc int, key string, pos int, polarity string")
    links = spark.createDataFrame([(4, 0)], "src int, dst int")
    vec = {0: (1.0, 0.0), 1: (0.8, 0.6), 2: (0.0, 1.0), 3: (-1.0, 0.0), 4: (0.6, 0.8)}
    chunks = spark.createDataFrame([(d, s, list(v)) for d, v in vec.items() for s in (-1, 0)] + [(3, 300, [1.0, 0.0])], "doc int, start int, v array<double>")
    return P.features(docs, concepts=concepts, citations=cited, links=links, chunks=chunks)


def test_features(corpus, spark, tmp_path):
    assert {(r.doc, r.act_id, r.ref, r.body) for r in corpus.provisions.collect()} == {(0, "penal_code", "s302", 1), (1, "penal_code", "s302", 3), (2, "code_of_criminal_procedure", "s438", 1)}
    assert {(r.doc, r.concept) for r in corpus.concepts.collect()} == {(0, "murder")}
    assert {(r.doc, r.act_id) for r in corpus.acts.collect()} == {(1, "penal_code")}
    assert {(r.doc, r.label) for r in corpus.outcomes.collect()} >= {(0, "acquittal"), (0, "allowed"), (1, "dismissed"), (2, "bail_granted"), (3, "compensation_enhanced")}
    corpus.write(str(tmp_path))
    back = P.Corpus.read(spark, str(tmp_path))
    assert {x: getattr(back, x).count() for x in P.Corpus.TABLES} == {x: getattr(corpus, x).count() for x in P.Corpus.TABLES}


def asked(spark, corpus, *texts):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")
    return P.analysis(corpus, q)


def test_analysis(spark, corpus):
    a = asked(spark, corpus, "Section 302 IPC murder appeal dismissed", "murder and bail", "cases following Ram Kumar v. State", "what of lone case", "rent")
    rows = {r.qid: r for r in a["queries"].collect()}
    assert [bool(rows[i].has_sections) for i in range(5)] == [True, False, False, False, False] and [bool(rows[i].has_implied) for i in range(5)] == [False, True, False, False, False]
    assert rows[0].requirements == ["dismissed"] and rows[0].has_acts and rows[0].has_concepts and not rows[4].has_concepts
    assert {(r.qid, r.ref) for r in a["implied"].collect()} == {(1, "s302"), (1, "s438")}
    assert {(r.qid, r.key) for r in a["precedents"].collect()} == {(2, "ram kumar v state"), (3, "lone case v z")}


def brute_citation(seeds, intent="LEGAL_ISSUE"):
    idf = {k: math.log(1 + 5 / n) for k, n in (("ram kumar v state", 2), ("x y v z", 2), ("lone case v z", 1))}
    pol = {"positive": 1.0, "neutral": 0.8, "negative": 0.8}
    votes = {}
    for d, k, _, _ in CITED:
        if d in seeds and k != "lone case v z":
            votes[k] = votes.get(k, 0) + 1
    out = {}
    for d, k, _, p in CITED:
        left = votes.get(k, 0) - (d in seeds)
        if left > 0:
            out[d] = out.get(d, 0) + left * idf[k] * pol[p]
    if votes:
        for a, b in ((4, 0), (0, 4)):
            if b in seeds:
                out[a] = out.get(a, 0) + 2.0
    return {d: math.log1p(x) for d, x in out.items()}


def test_citation_signal(spark, corpus):
    queries = spark.createDataFrame([(0, "LEGAL_ISSUE"), (1, "CONTRASTING_PRECEDENT"), (2, "LEGAL_ISSUE")], "qid int, intent string")
    named = spark.createDataFrame([(1, "ram kumar v state")], "qid int, key string")
    seeds = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 3)], "qid int, doc int")
    stats = S.authority_stats(corpus.authorities, spark.createDataFrame([(5,)], "n int"))
    got = {}
    for r in S.citation_signal(corpus.authorities, stats, corpus.links, queries, named, seeds).collect():
        got.setdefault(r.qid, {})[r.doc] = r.score
    assert got[1] == {0: 0.15, 1: 1.0} and 2 not in got
    want = brute_citation({0, 1})
    assert got[0] == pytest.approx(want)


def test_semantic_variants(spark, corpus):
    v = spark.createDataFrame([(7, [1.0, 0.0])], "qid int, v array<double>")
    got = {x: {r.doc: r.raw for r in P.semantic_signal(corpus, v, x).collect()} for x in ("whole", "chunked_max", "chunked_mean3")}
    assert got["whole"][3] == -1.0 and got["chunked_max"][3] == 1.0 and got["chunked_mean3"][3] == 0.0 and got["whole"][1] == 0.8
    with pytest.raises(ValueError):
        P.semantic_signal(corpus, v, "other")


def test_search(spark, corpus):
    q = spark.createDataFrame([(0, "Section 302 IPC appeal dismissed"), (1, "anticipatory bail"), (2, "cases following Ram Kumar v. State")], "item_id int, text string")
    vectors = spark.createDataFrame([(0, [0.8, 0.6]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "qid int, v array<double>")
    out = P.search(corpus, q, vectors=vectors, k=3).collect()
    best = {r.qid: r for r in out if r["rank"] == 1}
    assert best[0].doc == 1 and best[0].provisions == ["penal_code:s302"] and best[0].reason == "discusses penal_code:s302"
    assert best[1].doc == 2 and "semantic" in best[1].strongest
    assert {r.doc for r in out if r.qid == 2} >= {0, 1}
    assert all(0 <= r.score <= 1 and len(r.strongest.split("; ")) <= 2 for r in out)
    a = asked(spark, corpus, "Section 302 IPC appeal dismissed")
    signals = {(r.signal, r.doc): r.raw for r in P.compute_signals(corpus, a, vectors=spark.createDataFrame([(0, [1.0, 0.0])], "qid int, v array<double>")).collect()}
    assert signals["outcome", 1] == pytest.approx(0.95) and signals["outcome", 0] == pytest.approx(0.05)
    # all three parts apply: no issue term of it is on two documents but "appeal"
    assert 0 < signals["legal", 0] < signals["legal", 1] <= 1


def test_padding_nominates_as_many(spark):
    rows = [(0, "LEGAL_ISSUE", d, s, v) for s, d, v in (("bm25", 7, 2.0), ("semantic", 3, 0.5), ("outcome", 2, 0.9))]
    sig = spark.createDataFrame(rows, "qid int, intent string, doc int, signal string, raw double")
    docs = spark.createDataFrame([(i,) for i in range(20)], "doc int")
    pool = {r.doc for r in S.candidate_pool(S.padded(sig, docs, 4), 4).collect()}
    assert pool == {7, 0, 1, 2, 3}
    assert {r.doc for r in S.candidate_pool(sig, 4).collect()} == {7, 3}


def test_index(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS + [(9, None), (10, "")], "doc_id int, text string")
    q = spark.createDataFrame([(0, "murder appeal appeal"), (1, "rent of land"), (2, "nothing known")], "item_id int, text string")
    R.write_index(docs, str(tmp_path / "i"), buckets=4)
    a = {(r.item_id, r.doc): round(r.score, 9) for r in R.search_index(spark, str(tmp_path / "i"), q, buckets=4).collect()}
    assert a == {(r.item_id, r.doc_id): round(r.score, 9) for r in R.bm25(docs, q).collect()} and a


def test_registry(spark):
    assert len(SY.baseline_systems()) == 5 and len(SY.hybrid_systems()) == 30 and len(SY.ablation_systems("A1_pdf_table", "whole")) == 9
    ids = [x.id for x in SY.baseline_systems() + SY.hybrid_systems() + SY.ablation_systems("A3_pdf_table_equal_blend", "chunked_max")]
    assert len(set(ids)) == len(ids)
    w = SY.weights_of(spark, SY.ablation_systems("A1_pdf_table", "whole")).collect()
    mean = {r.signal: r.weight for r in w if r.config == "FULL_fixed_weights" and r.intent == INTENTS[0]}
    assert sum(mean.values()) == pytest.approx(1) and mean["bm25"] == pytest.approx(0.15)
    assert not [r for r in w if r.config == "FULL_minus_legal" and r.signal == "legal"]
    assert SY.with_defaults('{"adaptive": "A2"}')["adaptive"] == "A2" and SY.comparisons("a", ["b", "a", "c", "b"]) == [("a", "b"), ("a", "c")]
    rows = [(q, "LEGAL_ISSUE", d, s, float((d * 7 + q * 3 + len(s)) % 11)) for q in range(3) for d in range(30) for s in ("bm25", "semantic", "legal")]
    sig = spark.createDataFrame(rows, "qid int, intent string, doc int, signal string, raw double")
    systems = SY.baseline_systems() + SY.hybrid_systems(("chunked_max",))
    run = SY.run_systems({(v, "predicted"): sig for v in ("whole", "chunked_max", "chunked_mean3")}, systems)
    got = run.groupBy("system").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert {r.system for r in got} == {x.id for x in systems} and all(r.r <= 20 for r in got)
    raw = sorted(((-v, d) for q, _, d, s, v in rows if q == 1 and s == "bm25" and v > 0))[:20]
    assert [r.doc for r in run.where("system = 'B1_bm25' AND qid = 1").orderBy("rank").collect()] == [d for _, d in raw]


def test_service(spark):
    docs = spark.createDataFrame([(1, "A", "x" * 700), (2, "B", "y")], "doc int, name string, issue string")
    links = spark.createDataFrame([(1, 2), (3, 1), (1, 2)], "src int, dst int")
    c = SV.case(docs, links, 1).first()
    assert (c.cites, c.cited_by, c.name) == ([2], [3], "A")
    with pytest.raises(KeyError):
        SV.case(docs, links, 5)
    cited = spark.createDataFrame([(1, i, f"k{i}", f"n{i}", "followed", "positive" if i % 2 else "neutral") for i in range(14)], "doc int, pos int, key string, name string, treatment string, polarity string")
    pool = spark.createDataFrame([("p", 1), ("q", 1), ("q", 2)], "qid string, doc int")
    intents = spark.createDataFrame([("p", "SUPPORTING_PRECEDENT"), ("q", "LEGAL_ISSUE")], "qid string, intent string")
    named = spark.createDataFrame([("q", "k4")], "qid string, key string")
    cards = {(r.qid, r.doc): r for r in SV.label_cards(pool, docs, cited, intents, named).collect()}
    assert cards["q", 1].cited == ["n4 - followed"] and len(cards["p", 1].cited) == 5 and cards["q", 2].cited == [] and len(cards["p", 1].issue) == 600
    assert {r["table"]: r["rows"] for r in SV.health(docs, links=links).collect()} == {"docs": 2, "links": 3}
    assert SV.best_model(spark.createDataFrame([("svm", 0.9), ("logreg", 0.9), ("bayes", 0.8)], "model string, f1 double")).first().model == "logreg"


def test_snippet(spark):
    text = "The court met on Monday here. Bail was granted to the tenant under clause nine of the agreement. It was raining. Nothing else happened here."
    row = spark.createDataFrame([(1, text, ["bail", "clause"], ["court"], ["bail was granted"]), (2, "One only.", ["x"], [], [])], "k int, text string, terms array<string>, generic array<string>, phrases array<string>")
    out = {r.k: r for r in SV.snippet(row, "k", longest=110).collect()}
    assert out[1].at == 1 and out[1].snippet.startswith("Bail was granted") and len(out[1].snippet) <= 111 and out[2].snippet == "One only."


def test_recompute():
    def fails():
        raise ValueError("no table")

    r = SV.Recompute(fails)
    assert r.start() and r.state == {"status": "failed", "error": "no table"}
    seen = []
    r = SV.Recompute(lambda: seen.append(r.start()))
    assert r.start() and seen == [False] and r.state["status"] == "done"


def test_report(spark, tmp_path):
    run = spark.createDataFrame([(s, q, d, r) for s in ("a", "b") for q in range(6) for r, d in enumerate((q, q + 1, q + 2) if s == "a" else (q + 2, q + 1, q), 1)], "system string, qid int, doc int, rank int")
    labels = spark.createDataFrame([(q, q, 2) for q in range(6)], "qid int, doc int, grade int")
    queries = spark.createDataFrame([(q, "X" if q % 2 else "Y", q < 3) for q in range(6)], "qid int, intent string, explicit boolean")
    tables = EV.report(run, labels, queries, "a")
    EV.write_report(tables, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/tests")).first().mean > 0 and spark.read.parquet(str(tmp_path / "r/per_query")).count() == 12
    assert {(r.system, r.intent, r.explicit, r.n) for r in spark.read.parquet(str(tmp_path / "r/by_intent")).collect()} >= {("a", "X", None, 3), ("a", None, None, 6), (None, None, None, 12)}
    stable = EV.run_stability(spark.createDataFrame([(k, 0, d, d) for k in range(3) for d in range(1, 6)] + [(3, 0, d, d - 3) for d in range(4, 9)], "repeat int, qid int, doc int, rank int"))
    assert {(r.a, r.b): r.overlap for r in stable.collect()} == {(0, 1): 1, (0, 2): 1, (1, 2): 1, (0, 3): 0.4, (1, 3): 0.4, (2, 3): 0.4}


def test_labels_folds_and_names(spark):
    from docketry.operators import entities, intents, labels, metrics

    draft = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 5, 0)], "qid int, doc int, grade int")
    reviewed = spark.createDataFrame([(1, 6, 0), (1, 7, 2)], "qid int, doc int, grade int")
    assert {(r.doc, r.grade, r.source) for r in labels.of_query(draft, reviewed, 1).collect()} == {(5, 2, "draft"), (6, 0, "reviewed"), (7, 2, "reviewed")}
    with pytest.raises(ValueError):
        labels.validate_search("bail", "bm25", ("bm25",), intent="OTHER")
    labels.validate_search("bail", "bm25", ("bm25",), intent=INTENTS[0])

    q = spark.createDataFrame([(g, "abc"[g % 3]) for g in range(60) for _ in range(1 + g % 2)], "g int, label string")
    folds = {r.g: r.fold for r in intents.stratified_folds(q, "g", "label").collect()}
    assert len(folds) == 60
    for k in range(3):
        counts = [sum(1 for g, f in folds.items() if g % 3 == k and f == x) for x in range(5)]
        assert counts == [4] * 5

    m = spark.createDataFrame([(1, "a", "body", "Body name"), (1, "a", "listed", "Listed name"), (1, "b", "body", "B"), (2, "c", "head", "Head name"), (2, "c", "body", "Body")], "doc int, act string, place string, name string")
    assert {(r.doc, r.act): r.name for r in entities.merge_acts(m, "doc", "act", name="name").collect()} == {(1, "a"): "Listed name", (2, "c"): "Head name"}

    p = spark.createDataFrame([(1, "x", "s1"), (1, "?", "s2")], "doc int, act_id string, ref string")
    g = spark.createDataFrame([(1, "x", "s1"), (1, "y", "s2")], "doc int, act_id string, ref string")
    assert {r.variant: (r.tp, r.precision) for r in metrics.provision_scores(p, g).collect()} == {"strict": (1, 0.5), "lenient": (2, 1.0)}
    table = spark.createDataFrame([("a", *[0.5] * 7), ("b", 0.6, *[0.5] * 5, 0.4)], "system string, " + ", ".join(f"{x} double" for x in metrics.METRICS))
    best = {r.metric: (r.best, r.systems) for r in metrics.best_per_metric(table).collect()}
    assert best["p5"] == (0.6, ["b"]) and best["r5"] == (0.5, ["a", "b"]) and best["judged5"] == (0.5, ["a"])
    acts = intents.act_counts(spark.createDataFrame([(1, "Section 5 of the Arms Act and s. 3 IPC, IPC"), (2, "nothing")], "k int, text string"), "k")
    assert {r.k: r.acts for r in acts.collect()} == {1: 2, 2: 0}


def test_outcome_reasons(spark):
    req = spark.createDataFrame([(1, "dismissed", 0), (1, "bail_granted", 1)], "qid int, label string, pos int")
    held = spark.createDataFrame([(1, "allowed", 0.9), (1, "bail_granted", 0.6), (2, "allowed", 0.8), (3, "remanded", 1.0)], "doc int, label string, confidence double")
    got = {r.doc: (round(r.score, 6), r.reason) for r in S.outcome_scores(req, held, spark, held.select("doc").distinct()).collect()}
    assert got == {1: (0.8, "outcome 'bail granted' matches request"), 2: (0.1, "outcome 'allowed' conflicts with request"), 3: (0.5, "outcome could not be determined")}

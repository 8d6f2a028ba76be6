"""Steps whose work must not grow faster than their input: what is exchanged, made or trained on, and that results are the same."""

import re

from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

from docketry.functions.text import tokenize
from docketry.operators import entities, intents
from docketry.operators import retrieval as R
from docketry.operators import scoring as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


PAIRS = re.compile(r"hashpartitioning\((?:qid#\d+L?, (?:\w+#\d+L?, )*doc#|doc#\d+L?, (?:\w+#\d+L?, )*qid#)")


def asked_and_held(spark):
    asked = [(q, a, f"s{r}") for q in range(4) for a in ("x", "y", "?") for r in range(5) if (q + r + len(a) * ord(a)) % 3]
    held = [(d, a, f"s{(d + k) % 6}", int(d % 3 == k), 2 * k) for d in range(40) for k, a in enumerate(("x", "y", "?"))]
    return asked, held, spark.createDataFrame(asked, "qid int, act_id string, ref string"), spark.createDataFrame(held, "doc int, act_id string, ref string, head int, body int")


def test_sections_are_matched_once_and_pairs_stay(spark):
    asked, held, a, h = asked_and_held(spark)
    salience = lambda head, body: 1.0 if head else 0.6 if body >= 3 else 0.3 if body else 0.0
    want = {}
    for q, act, ref in asked:
        for d, held_act, held_ref, head, body in held:
            if ref == held_ref and (act == "?" or held_act in (act, "?")):
                v = (1.0 if act in ("?", held_act) else 0.7) * salience(head, body)
                want[q, d, act, ref] = max(v, want.get((q, d, act, ref), 0.0))
    for implied in (False, True):
        got = S.section_scores(a, h, implied)
        assert not PAIRS.search(plan(got))
        sums = {}
        for (q, d, *_), v in want.items():
            sums.setdefault((q, d), []).append(v)
        n = {q: sum(x[0] == q for x in asked) for q in range(4)}
        expected = {k: round(max(v) if implied else sum(v) / n[k[0]], 9) for k, v in sums.items()}
        assert {(r.qid, r.doc): round(r.score, 9) for r in got.collect()} == expected


def test_matches_are_looked_up_by_act(spark):
    asked, held, a, h = asked_and_held(spark)
    got = S.match_provisions(a, h)
    want = sorted((q, d, act, held_act, ref) for q, act, ref in asked for d, held_act, held_ref, *_ in held if ref == held_ref and (act == "?" or held_act in (act, "?")))
    assert sorted((r.qid, r.doc, r.act_id, r.d_act, r.ref) for r in got.collect()) == want
    join = next(x for x in plan(got).split("\n") if "BroadcastHashJoin" in x)
    assert "_k#" in join and " OR " not in join  # no pair is made only to be dropped


def test_asked_acts_and_concepts_go_to_the_documents(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "y")], "qid int, act_id string")
    h = spark.createDataFrame([(7, "x", False, 1, 0), (7, "y", False, 0, 3), (8, "y", False, 0, 1), (9, "z", True, 1, 1)], "doc int, act_id string, listed boolean, head int, body int")
    got = S.act_scores(a, h)
    assert not PAIRS.search(plan(got)) and {(r.qid, r.doc): round(r.score, 9) for r in got.collect()} == {(1, 7): 0.8, (1, 8): 0.15, (2, 7): 0.6, (2, 8): 0.3}
    got = S.concept_scores(a.withColumnRenamed("act_id", "concept"), h.withColumnRenamed("act_id", "concept"))
    assert not PAIRS.search(plan(got)) and {(r.qid, r.doc): round(r.score, 9) for r in got.collect()} == {(1, 7): 0.75, (1, 8): 0.25, (2, 7): 0.5, (2, 8): 0.5}


def test_bm25_reads_the_texts_once_more(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 3} common {'w1 ' * (i % 4)}naïve a_b" if i else "") for i in range(30)], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "d"))
    docs, asked = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, "w1 common w1"), (2, "w2 nothing")], "item_id long, text string")
    got = R.bm25(docs, asked)
    said = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?:split|regexp_extract_all)\(lower\(text", said)) == 3  # the documents for the postings, the queries twice; no vocabulary anew, no filter that tokenises
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L, doc_id#", plan(got))
    assert {r.item_id: r.n for r in got.groupBy("item_id").count().withColumnRenamed("count", "n").collect()} == {1: 29, 2: 10}
    R.write_index(docs, str(tmp_path / "i"))
    by_index = R.search_index(spark, str(tmp_path / "i"), asked)
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L, doc#", plan(by_index))
    assert {(r.item_id, r.doc): round(r.score, 9) for r in by_index.collect()} == {(r.item_id, r.doc_id): round(r.score, 9) for r in got.collect()}


def test_tokens(spark):
    texts = ["naïve über a_b x1 42", "", None, "A-b, c.d\ne f g_ _h íj ٣x x٣ ½ 𝒳y z𝒳 ok", "don't  stop"]
    old = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z0-9]+$"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize(F.col("t")).alias("new"), old.alias("old")).collect()
    assert all(r.new == r.old for r in rows) and rows[0].new == ["x1", "42"] and rows[2].new is None


def test_intents_train_on_distinct_texts(spark, monkeypatch):
    seen, fit = [], intents.LogisticRegression.fit
    monkeypatch.setattr(intents.LogisticRegression, "fit", lambda self, rows, *a: seen.append(rows.count()) or fit(self, rows, *a))
    said = [("scope of section one", "A"), ("my client was arrested", "B"), ("scope of section one", "B"), ("cases that differ", "C")]
    q = spark.createDataFrame([(i, *said[i % 7 % 4]) for i in range(70)], "id long, text string, intent string")
    model = intents.train_intents(q)
    assert seen == [4]  # before: every row, in each of the classifier's iterations
    idf = model.stages[5]
    assert idf.numDocs == 70 and sorted(set(idf.docFreq)) == [10, 20, 40] and model.stages[0].labels == ["A", "B", "C"]
    assert {(r.text, r.predicted) for r in intents.predict_intents(model, q).select("text", "predicted").collect()} >= {("my client was arrested", "B"), ("cases that differ", "C")}


def test_vectors_are_learnt_by_several_tasks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(intents, "Word2Vec", lambda **k: made.append(k["numPartitions"]) or Word2Vec(**k))
    docs = spark.createDataFrame([(i, "one two three four five " * 4) for i in range(40)], "doc_id long, text string")
    intents.train_vectors(docs, rounds=1)
    monkeypatch.setattr(intents, "SHARE", 200)
    model = intents.train_vectors(docs, rounds=1)
    assert made == [1, 4] and model.getVectors().count() == 5


def test_vector_scores_by_matrix(spark):
    rows = [(i, [float(i), 1.0, -0.5 * i]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [1.0, None, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.5, 0.0, 1.0]), (3, None), (4, [2.0])], "qid int, qvec array<float>")
    got = R.vector_scores(v, q)
    assert "CartesianProduct" not in plan(got) and "BroadcastNestedLoop" not in plan(got)
    held = {(r.qid, r.vec_id): r.score for r in got.collect()}
    asked = {1: [1.0, 2.0, 3.0], 2: [0.5, 0.0, 1.0], 3: None, 4: [2.0]}
    for i, x in rows:
        for k, y in asked.items():
            want = sum(a * b for a, b in zip(x, y)) if x and y and None not in x and len(x) == len(y) else None
            assert held.pop((k, i)) == want
    assert not held


def test_names_are_judged_once(spark, monkeypatch):
    seen, judge = [], entities.canonical_act
    monkeypatch.setattr(entities, "canonical_act", lambda rows, *a: seen.append(rows.count()) or judge(rows, *a))
    docs = spark.createDataFrame([(i, f"Section {i % 9 + 1} IPC and s. 3 of the Arms Act, 1959. Article 14. Section 302" if i else None) for i in range(60)], "doc long, text string")
    got = entities.extract(docs, "doc")
    assert seen == [2]  # before: every mention
    refs = {(r.act_id, r.ref) for r in got.where("doc = 5").collect()}
    assert refs == {("penal_code", None), ("arms_act", None), ("penal_code", "s6"), ("arms_act", "s3"), ("constitution_of_india", "art14"), ("?", "s302")} and got.where("kind = 'provision'").count() == 59 * 4

"""The noisy-or, its gradient and its sentences against plain loops."""

import math
import random
import re

import numpy as np

from docketry.llm import toxicity


def brute_features(sentence):
    words = re.findall(r"[^\W\d_]+", sentence.lower())
    return {w for w in words} | {(w[:k], k) for w in words for k in toxicity.STEMS if len(w) > k}


def hash_of(feature):
    x = toxicity.read([feature if isinstance(feature, str) else feature[0] + "x"])
    return x.word[0] if isinstance(feature, str) else dict(zip(toxicity.STEMS, x.stems, strict=True))[feature[1]][1][0]


def brute_score(model, text):
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    none = 1 - model.leak
    for sentence in re.split(r"(?<=[.!?\n])", text):
        known = [weights[h] for f in brute_features(sentence) if (h := int(hash_of(f))) in weights]
        if known:
            none *= 1 - 1 / (1 + math.exp(-(model.bias + sum(known))))
    x = math.log(max(1e-12, 1 - none)) - math.log(none)
    return 1 / (1 + math.exp(-(model.slope * x + model.shift)))


def model_of(features):
    found = sorted((int(hash_of(f)), w) for f, w in features.items())
    return toxicity.Model(np.array([h for h, _ in found], np.uint64), np.array([w for _, w in found]), -6.0, 0.01, 1.2, 0.3)


TEXTS = ["", "Fine words here.", "You idiot! Well done.", "idiotic idiocy? scumbag. scumbag", "no end scumbags\nidiot idiot", "A. " * 500 + "idiot"]


def test_scores_are_the_noisy_or():
    model = model_of({"idiot": 7.0, ("idio", 4): 1.5, ("scumb", 5): 5.5, "fine": 0.6})
    got = model.calibrated(toxicity.doubts(TEXTS, model))
    assert np.allclose(got, [brute_score(model, t) for t in TEXTS], rtol=1e-9)


def test_gradient():
    r = np.random.default_rng(1)
    s_id, w_id = np.array([0, 0, 1, 2, 3, 3, 4]), np.array([0, 1, 1, 2, 0, 2, 1])
    args = (w_id, s_id, np.array([0, 0, 1, 2, 3]), np.array([1, 0, 1, 0, 1]), np.array([0.1, 0.3, 0.2, 0.3, 0.1]), 1e-3)
    theta = np.append(r.uniform(0.5, 3, 3), [-2.0, -3.0])
    _, grad = toxicity.log_loss(theta, *args)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        slope = (toxicity.log_loss(theta + step, *args)[0] - toxicity.log_loss(theta - step, *args)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6


def test_long_texts_are_cut_between_sentences():
    r = random.Random(2)
    text = " ".join(r.choice(["fine", "idiot", "words.", "here!", "scumbag", "x"]) for _ in range(3000))
    model = model_of({"idiot": 7.0, ("scumb", 5): 5.5})
    whole = list(toxicity.readings([text, "idiot", text]))
    parts = list(toxicity.readings([text, "idiot", text], most=400))
    assert len(whole) == 1 and len(parts) > 30
    places = lambda found: [(o[t], b[t] + x.begin[i], b[t] + x.end[i]) for x, o, b in found for i, t in enumerate(x.text_of)]
    assert sorted(places(whole)) == sorted(places(parts))
    assert [t for _, t in toxicity._cuts("ab" * 500, 100)] == ["ab" * 50] * 10
    assert "".join(t for _, t in toxicity._cuts(text, 64)) == text
    total = lambda found: sum(np.logaddexp(0, model.sentence_logits(x)).sum() for x, _, _ in found)
    assert np.allclose(total(whole), total(parts)) and np.allclose(toxicity.doubts([text, "idiot", text], model).sum(), total(whole))


def _corpus(spark, n, sentences, seed=3):
    """Toxic words of three stems with changing endings, in one sentence of ``sentences``; 3 % of the labels are wrong."""
    r = random.Random(seed)
    rows, labels = [], []
    word = lambda: "".join(r.choice(["ba", "de", "li", "no", "ru", "st"]) for _ in range(r.randint(1, 3)))
    for i in range(n):
        said = [" ".join(word() for _ in range(6)) for _ in range(sentences if i % 7 else 2000)]
        if i % 5 == 0:
            at = r.randrange(len(said))
            said[at] += " " + r.choice(["vexor", "grumph", "scathe"]) + r.choice(["ing", "ed", "s", "ly", "ness", "al"])
        rows.append((i, ". ".join(said) + ".", "src"))
        labels.append((i, int((i % 5 == 0) != (r.random() < 0.03))))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_many_sentences_do_not_add_up(spark):
    rows, labels = _corpus(spark, 500, 12)
    copy = rows[3][1]  # a clean text that a third of all rows hold
    rows += [(10_000 + i, copy, "src") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    labels = labels.union(spark.createDataFrame([(10_000 + i, 0) for i in range(250)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    toxic = [out[i] for i in range(0, 500, 5) if out[i].held_out]
    clean = [r for i, r in out.items() if (i % 5 or i >= 10_000) and r.held_out]
    long_clean = [out[i] for i in range(0, 500, 7) if i % 5]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(1 - r.predicted for r in clean) >= 0.98 * len(clean)
    assert sum(1 - r.predicted for r in long_clean) >= 0.95 * len(long_clean)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if not r.predicted}


def test_repeated_keys_and_odd_labels(spark):
    """A key that repeats teaches by its least text, whichever row comes first; null labels and strings as keys do no harm."""
    rows, labels = _corpus(spark, 140, 4)
    rows = [(str(i), t) for i, t, _ in rows] + [("5", None), ("5", "zzz"), (None, "a"), ("7", "")]
    labels = labels.selectExpr("cast(doc_id as string) doc_id", "toxic").union(spark.createDataFrame([("5", None), (None, 1), ("5", 0)], "doc_id string, toxic int"))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    one = sorted(map(str, toxicity.report(docs.repartition(3), labels).collect()))
    two = sorted(map(str, toxicity.report(docs.orderBy(docs.text.desc()), labels.repartition(2)).collect()))
    assert one == two and len(one) == len(rows)
    only = spark.createDataFrame([("1", 1), ("2", 1)], "doc_id string, toxic int")
    assert {r.score for r in toxicity.report(docs, only).collect()} == {0.0}

"""Registered queries without SQL do the whole job."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import intents, labels, metrics
from docketry.plans import rank_queries, registry

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@tables
def test_paired_test_takes_every_query(spark):
    r = registry.QUERIES["I06_I07_paired_tests"](spark, DATA).first()
    n = metrics.paired_differences(rank_queries._per_query(spark, DATA), "a", "b").count()
    assert n > 200 and r.n_queries == r.wins + r.losses + r.ties == n
    assert abs(r.p_value * 10_001 - round(r.p_value * 10_001)) < 1e-6 and r.ci_low <= r["mean"] <= r.ci_high


def test_bootstrap_over_blocks(spark):
    d = np.random.default_rng(1).normal(0.02, 1, 3000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "qid long, d double")
    one, many = (metrics.paired_bootstrap(df, 2000, block=b).first() for b in (1 << 14, 100))
    half = 1.96 * d.std() / len(d) ** 0.5
    for r in (one, many):
        assert abs(r.ci_low - (d.mean() - half)) < 0.15 * half and abs(r.ci_high - (d.mean() + half)) < 0.15 * half
    assert abs(one.p_value - many.p_value) < 0.06
    assert many == metrics.paired_bootstrap(df.repartition(7), 2000, block=100).first() or abs(many.ci_low - metrics.paired_bootstrap(df.repartition(7), 2000, block=100).first().ci_low) < 1e-9


@tables
def test_vectors_take_the_production_rounds(spark, monkeypatch):
    seen, train = [], intents.train_vectors
    monkeypatch.setattr(intents, "train_vectors", lambda docs, text="text", rounds=5: seen.append(rounds) or train(docs, text, rounds))
    registry.QUERIES["H22_document_vectors"](spark, DATA)
    assert seen == [5]


@tables
def test_passages_of_every_item(spark):
    got = registry.QUERIES["F18_best_passage"](spark, DATA).select("qid", "doc").collect()
    top = registry.QUERIES["E03_bm25_topk"](spark, DATA).select("item_id", "doc_id").collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} <= {tuple(x) for x in top}
    assert max(x.qid for x in got) >= 7 and len({x.qid for x in got}) > 0.9 * len({x.item_id for x in top})


def test_passage_expands_round_the_match(spark):
    filler = " ".join(f"Some words of no import stand here in line {i} of it all." for i in range(20))
    docs = [(1, 1, f"{filler} The needle lies hidden in this place. {filler}"), (1, 2, "A first paragraph about the needle of some eighty characters or more, so it counts.\n" + "Another paragraph under Section 302 of the Code, with the grave offence of house breaking named in it."), (2, 3, "short")]
    df = spark.createDataFrame(docs, "qid long, doc long, text string")
    terms = spark.createDataFrame([(1, "needle", 2.0)], "qid long, term string, idf double")
    plain = {r.doc: r for r in labels.best_passage(df, terms).collect()}
    assert set(plain) == {1, 2} and "needle lies hidden" in plain[1].paragraph and len(plain[1].paragraph) < 700
    assert plain[1].paragraph.startswith("… ") and plain[1].paragraph.endswith(" …") and plain[2].pos == 0
    assert {r.doc: (r.pos, r.paragraph) for r in labels.best_passage(df, terms, fallback=True).collect()}[3] == (-1, "short")
    more = labels.best_passage(df, terms, spark.createDataFrame([(1, "house breaking")], "qid long, phrase string"), spark.createDataFrame([(1, "302"), (1, "30")], "qid long, number string"))
    r = {r.doc: r for r in more.collect()}[2]
    words = 18
    assert r.pos == 1 and abs(r.score - 7.0 / (1 + 0.15 * np.log(1 + words))) < 1e-9


def plain_around(sentences, best, longest):
    lo = hi = best
    size = len(sentences[best])
    for _ in sentences:
        if hi + 1 < len(sentences) and size + len(sentences[hi + 1]) < longest:
            hi += 1
            size += len(sentences[hi])
        if lo > 0 and size + len(sentences[lo - 1]) < longest:
            lo -= 1
            size += len(sentences[lo])
    said = " ".join(sentences[lo : hi + 1])
    said = said[:longest].rsplit(" ", 1)[0] if len(said) > longest + 40 else said
    return ("… " if lo else "") + said + (" …" if hi + 1 < len(sentences) else "")


def test_around(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(80):
        s = [" ".join("ab" * int(k) for k in r.integers(1, 6, int(n))) for n in r.integers(1, 12, int(r.integers(1, 9)))]
        rows.append((i, s, int(r.integers(0, len(s)))))
    df = spark.createDataFrame(rows, "k int, s array<string>, at int")
    got = {x.k: x.p for x in df.select("k", labels.around(F.col("s"), F.col("at"), 70).alias("p")).collect()}
    assert got == {k: plain_around(s, at, 70) for k, s, at in rows}

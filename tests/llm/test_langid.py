"""Naive Bayes against plain counting, and very long texts in parts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from docketry.llm import langid


def plain_folded(text):
    out = []
    for ch in text.lower().replace("\0", " "):
        if ch.isalpha():
            out.append(ch)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def plain_bucket(gram):
    h = 0
    for ch in gram:
        h = (h + ord(ch)) * 0x9E3779B1 & 0xFFFFFFFF
        h ^= h >> 15
    return h % langid.BUCKETS


def plain_counts(text):
    c = plain_folded(text)
    return {n: Counter(plain_bucket(c[i : i + n]) for i in range(len(c) - n + 1)) for n in langid.ORDERS}


TEXTS = ["", "a", "ab!  cd", "  Ünïcode — ß? 12 x", "x\0y", "İstanbul", "日本語 テスト", "aaaa " * 30, "!!"]


def test_grams():
    got = [{n: Counter() for n in langid.ORDERS} for _ in TEXTS]
    for n, buckets, starts in langid.grams(TEXTS):
        for i, part in enumerate(np.split(buckets, starts[1:])):
            got[i][n].update(x for x in part.tolist() if x != langid.BUCKETS)
    assert got == [plain_counts(t) for t in TEXTS]


@pytest.mark.parametrize("most", [7, 50, 1000])
def test_long_texts_in_parts(most):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdé.,  \n1ß") for _ in range(r.randint(0, 900))) for _ in range(40)] + ["." * 300 + "ab" + " " * 400 + "cd", "x" * 500, "?" * 700]
    got = [{n: Counter() for n in langid.ORDERS} for _ in texts]
    for who, parts, own in langid.readings(texts, most):
        for n, buckets, starts in langid.grams(parts, own):
            for i, part in zip(who, np.split(buckets, starts[1:]), strict=True):
                got[i][n].update(x for x in part.tolist() if x != langid.BUCKETS)
    assert got == [plain_counts(t) for t in texts]


def test_scores(spark):
    r = random.Random(2)
    kinds = {"xx": "abcab", "yy": "bcdd", "zz": "eabd"}
    rows = [(i, "".join(r.choice(kinds[k] + " ") for _ in range(40)), k) for i in range(60) for k in [list(kinds)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, per_language=1000)
    totals, seen = {k: {n: Counter() for n in langid.ORDERS} for k in kinds}, Counter()
    for _, t, k in rows:
        seen[k] += 1
        for n, c in plain_counts(t).items():
            totals[k][n].update(c)
    out = {x.doc_id: x for x in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        logs = {}
        for k in kinds:
            x = math.log(seen[k] / len(rows))
            for n, c in plain_counts(t).items():
                whole = sum(totals[k][n].values()) + 0.05 * langid.BUCKETS
                x += sum(m * math.log((totals[k][n][b] + 0.05) / whole) for b, m in c.items())
            logs[k] = x
        top = max(logs, key=logs.get)
        p = 1 / sum(math.exp(x - logs[top]) for x in logs.values())
        assert out[i].lang_pred == top and abs(out[i].score - p) < 1e-4

"""Weak supervision against a plain EM document by document, and against labels."""

import math
import random
from collections import Counter

import numpy as np
from docketry.llm import quality
from docketry.llm.common import table

DATA = "/root/testdata/sf0.01"


def plain_votes(m):
    c = dict(zip(quality.COUNTS, m, strict=True))
    w, lines, chars = max(c["n_words"], 1), max(c["n_lines"], 1), max(c["n_chars"], 1)
    enough, mean, stops = w >= 20, c["word_chars"] / w, c["n_stops"] / w
    rules = [
        (c["n_words"] < 8, w >= 50),
        (mean < 3 or mean > 7, 4 <= mean <= 6),
        (c["n_symbols"] > 0.2 * w, c["n_symbols"] <= 0.02 * w),
        (c["n_letters"] < 0.68 * chars, c["n_letters"] >= 0.76 * chars),
        (c["n_dup_lines"] > 0.25 * lines, lines >= 4 and c["n_dup_lines"] <= 0.05 * lines),
        (c["n_repeat_words"] > 0.15 * w, enough and c["n_repeat_words"] <= 0.03 * w),
        (enough and c["n_distinct"] < min(0.5 * w, 4 * math.sqrt(w)), enough and c["n_distinct"] >= min(0.6 * w, 8 * math.sqrt(w))),
        (c["n_upper"] > 0.2 * c["word_chars"], c["n_upper"] <= 0.08 * c["word_chars"]),
        (c["n_digits"] > 0.15 * chars, c["n_digits"] <= 0.03 * chars),
        (c["n_bars"] > 0.05 * w, enough and c["n_bars"] == 0),
        (c["n_exclaims"] > 0.1 * w, enough and c["n_exclaims"] <= 0.01 * w),
        (enough and (stops < 0.01 or stops > 0.5), 0.03 <= stops <= 0.25),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def plain_em(votes, rounds=500):
    """One row a document, loops only."""
    post = [0.05 if sum(v == -1 for v in d) >= 2 else 0.6 if -1 in d else 0.95 for d in votes]
    for _ in range(rounds):
        share = (sum(post) + 8) / (len(post) + 10)
        p = [[(sum(w for d, w in zip(votes, ws, strict=True) if d[r] == 1) + 1) / (sum(w for d, w in zip(votes, ws, strict=True) if d[r]) + 2) for ws in ([1 - x for x in post], post)] for r in range(12)]
        new = []
        for d in votes:
            bad, good = math.log(1 - share), math.log(share)
            for r, v in enumerate(d):
                if v:
                    bad += math.log(p[r][0] if v == 1 else 1 - p[r][0])
                    good += math.log(p[r][1] if v == 1 else 1 - p[r][1])
            new.append(1 / (1 + math.exp(max(-500, min(500, bad - good)))))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-10
        post = new
        if done:
            break
    return post


def test_posterior_and_verdict(docs, texts):
    measured = [quality.measure(t) for _, t in texts]
    post = plain_em([plain_votes(m) for m in measured])
    want = Counter()
    for (i, _), m, p in zip(texts, measured, post, strict=True):
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        want[i, failed, not failed and p >= 0.5, round(p, 6)] += 1
    assert Counter((r.doc_id, r.base_failed, r.kept, round(r.posterior, 6)) for r in quality.judge(docs).collect()) == want


def test_agrees_with_labels_and_is_not_all_must_pass(spark):
    out = quality.judge(table(spark, DATA.replace("sf0.01", "sf0.1"), "documents", "doc_id", "text"))
    rows = out.join(table(spark, DATA.replace("sf0.01", "sf0.1"), "labels", "doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.98 * len(good) and sum(not r.kept for r in bad) > 0.97 * len(bad)
    assert any(r.kept and r.n_bad for r in rows)


def test_repeated_words_by_words():
    r = random.Random(3)
    for _ in range(300):
        ids = np.array([r.randint(0, r.choice([1, 3, 30])) for _ in range(r.randint(0, 60))], np.int64)
        win = Counter(tuple(ids[k : k + 5]) for k in range(len(ids) - 4))
        mark = {p for k in range(len(ids) - 4) if win[tuple(ids[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert quality.repeated_words(ids) == len(mark)


def test_one_vote_can_be_outvoted():
    kinds = {(1,) * 12: 8000, (1, 1, -1, -1, 1, 1, 1, 1, 1, 1, 1, 1): 400, (1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1, 1): 400, (1, 1, 1, 1, 1, 1, 1, -1, 1, 1, -1, 1): 200, (1, 1, 1, 1, -1, 1, 1, 1, 1, 1, 1, 1): 60}
    post = dict(zip(kinds, quality.learn(np.array([*kinds]), np.array([*kinds.values()], float))[2], strict=True))
    assert {k: p >= 0.5 for k, p in post.items()} == {k: sum(x == -1 for x in k) < 2 for k in kinds}

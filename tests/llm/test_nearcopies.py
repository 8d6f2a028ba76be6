"""The near_dedup stage against exact Jaccard similarity on planted pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from docketry.llm import nearcopies


def brute(texts):
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def brute_any(rows):
    """Smallest key reachable for rows (key, text) of any kind: word-less texts are one set, short ones one shingle."""
    sets = {}
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        sets[t] = frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()
    root = {x: x for x in sets.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for k, t in rows:
        if k is not None:
            r = find(sets[t])
            least[r] = min(least.get(r, k), k)
    return {(k, t): least.get(find(sets[t])) for k, t in rows}


def planted(r, pairs):
    """Pairs of 120 to 250 words; 1 to 5 words of the second are changed (similarity 0.6 to 0.95)."""
    out = []
    for k in range(pairs):
        ws = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(120, 250))]
        ys = list(ws)
        for at in r.sample(range(10, len(ws) - 10), r.randint(1, 5)):
            ys[at] = "changed"
        out += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(ys))]
    return out


def test_stage_finds_planted_pairs(spark):
    texts = planted(random.Random(9), 150)
    root = brute(texts)
    assert sum(root[i] != i for i in root) > 80
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i}


@pytest.mark.parametrize("rounds", [0, 2])
def test_crowded_bands(spark, rounds):
    """Many copies of one text, each changed elsewhere: linked by chains, in bands over the limit."""
    r = random.Random(10)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    texts = [(0, " ".join(base))]
    for i in range(1, 60):
        ws = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 8])):
            ws[at] = f"x{i}"
        texts.append((i, " ".join(ws)))
    root = brute(texts)
    out = nearcopies.near_copies(spark.createDataFrame(texts, "doc_id long, text string"), pairs_up_to=4, rounds=rounds).collect()
    assert {x.doc_id: x.component_id for x in out} == root


def test_groups_with_few_and_many_changes(spark):
    """A base with members of 1 to 12 changed words, some linked to each other only, in crowded bands; and a second group near the first."""
    r = random.Random(11)
    base = [f"w{r.randint(0, 5000)}" for _ in range(140)]
    other = [f"o{i}" if i % 9 == 0 else w for i, w in enumerate(base)]
    texts = [(None, " ".join(base)), (500, ""), (501, None), (502, "few words"), (503, "Few  words")]
    for i in range(90):
        ws = list(other if i % 3 == 0 else base)
        for at in r.sample(range(140), r.randint(1, 12)):
            ws[at] = f"x{i}"
        texts.append((i, " ".join(ws)))
        if i % 10 == 0:
            ws[r.randrange(140)] = "again"
            texts.append((100 + i, " ".join(ws)))
    root = brute_any(texts)
    for limit in (4, 24):
        out = nearcopies.near_copies(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), pairs_up_to=limit).collect()
        assert sorted((str(x.doc_id), str(x.component_id)) for x in out) == sorted((str(k), str(root[k, t])) for k, t in texts)


def test_pigeonring_lets_similar_sets_pass():
    """The chains drop no pair within the budget, and the budget holds for sets at 0.8, small ones too."""
    r = np.random.default_rng(4)
    held = passed = 0
    for n in (5, 9, 20, 60, 200, 800):
        for _ in range(60):
            shared = int(np.ceil(8 * n / 9))  # of two sets of n: similarity of 0.8
            both, x, y = (np.sort(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in (shared, n - shared, n - shared))
            a, b = (nearcopies.wide_fingerprint(np.sort(np.concatenate([both, z]))).view(np.uint64) for z in (x, y))
            d = np.bitwise_count(a ^ b).astype(int)
            ring = np.concatenate([d, d])
            chain = any(all(ring[i : i + size].sum() <= size * nearcopies.MOST // 4 for size in range(1, 4)) for i in range(4))
            assert chain or d.sum() > nearcopies.MOST
            held += 1
            passed += d.sum() <= nearcopies.MOST
    assert passed >= 0.995 * held


def test_shingles_of_blocks_of_words(monkeypatch):
    """Shingle sets are equal just where the words are, in texts over a block, in words over a block, and in any company."""
    r = random.Random(12)
    monkeypatch.setattr(nearcopies, "BLOCK", 1 << 10)
    texts = [None, "", " \n ", "A b", "a  B\x0b", "one two three four five", "ONE two three four five six", "\x85é\xa0b \x1c q", "É b", "é b"]
    texts += ["x" * 3000 + " tail of it goes on here", "y " * 1000, " ".join(f"w{r.randrange(9**6)}" for _ in range(6000)), " " * 5000 + "a b c d e f g", "Z" * 1024 + " ", "z" * 1023 + "\t"]
    texts += ["q" * 64, "Q" * 64, "q" * 65, "Q" * 65]
    texts += [" ".join(r.choice(["ab", "Ba", "c", "é", "dd", "\t", "x" * 70]) for _ in range(r.randrange(40))) for _ in range(800)]
    for k in (1, 3, 5):
        seen = {}
        for t, g in zip(texts, nearcopies.gram_sets(texts, k), strict=True):
            ws = (t or "").encode().lower().split()
            want = frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()
            assert len(g) == len(want) and np.array_equal(g, nearcopies.grams(t, k))
            assert seen.setdefault(want, g.tobytes()) == g.tobytes()
        assert len(set(seen.values())) == len(seen)


def test_words_are_not_hashed_one_by_one(monkeypatch):
    """A text's shingles take no call for each of its words."""
    calls = []
    real = nearcopies.xxhash.xxh64_intdigest
    monkeypatch.setattr(nearcopies.xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or real(*a))
    g = nearcopies.grams(" ".join(f"w{i}" for i in range(5000)))
    assert len(g) == 4996 and len(calls) < 50


def test_bands_are_shared_as_often_as_similarity_says():
    r, a, b = np.random.default_rng(5), [], []
    for n in r.integers(5, 200, 1500).tolist():
        both, x, y = (r.integers(0, 1 << 63, k).astype(np.uint64) * np.uint64(2) for k in (8 * n, n, n))
        a.append(nearcopies.minima(np.concatenate([both, x])))
        b.append(nearcopies.minima(np.concatenate([both, y])))
    same = nearcopies.band_hashes(np.array(a)) == nearcopies.band_hashes(np.array(b))
    assert abs(same.mean() - 0.8**nearcopies.ROWS) < 0.02 and same.any(axis=1).all()

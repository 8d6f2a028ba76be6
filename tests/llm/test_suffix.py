"""Copies, crowded minimizers and keys of other types against brute force; memory of a shard far over its budget."""

import random
from collections import Counter

import numpy as np
import pytest
from docketry.llm import suffix

from .test_operators import brute_repeats


@pytest.mark.parametrize("hot", [2, 10, 50_000])
def test_crowded_minimizers(spark, hot):
    """One passage in all documents, with other words round it, whole copies, copies with a change, and repeated keys."""
    r = random.Random(1)
    say = lambda n: " ".join("".join(r.choice("abcdeéf") for _ in range(r.randint(2, 7))) for _ in range(n))
    shared, copy = say(9), say(60)
    texts = [(i, f"{say(r.randint(0, 20))} {shared[r.randint(0, 9):]} {say(r.randint(0, 20))}") for i in range(120)]
    texts += [(200 + i, copy) for i in range(30)] + [(300 + i, copy[:100] + "x" + copy[100:]) for i in range(5)]
    texts += [(200, say(30)), (210, copy), (210, texts[5][1]), (5, copy), (400, "short"), (401, "short"), (None, copy), (402, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, suffix.report(docs, hot=hot).collect())) == brute_repeats(texts)


def test_halves_hold_equal_windows_together():
    """Whatever surrounds a window, it goes where its equals go."""
    r = random.Random(2)
    shared = bytes(r.choice(b"abc") for _ in range(120))
    dealt = {}
    for _ in range(60):
        raw = bytes(r.choice(b"abc") for _ in range(r.randint(0, 80))) + shared[r.randint(0, 60) : r.randint(61, 120)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 80)))
        a = np.frombuffer(raw, np.uint8)
        at, place, h = suffix.minimizers(a, np.array([len(a)]))
        if not len(at):
            continue
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        end = np.append(begin[1:], len(at)) - 1
        code = suffix._short(h[place[begin]], 8)
        b, e, more = suffix._halves(begin, end, code, place, at, a, np.unique(code), 50, 20)
        assert sorted(x for p, q in zip(b.tolist(), e.tolist(), strict=True) for x in range(p, q + 1)) == list(range(len(at)))
        for p, q, m in zip(b.tolist(), e.tolist(), more.tolist(), strict=True):
            for x in range(p, q + 1):
                assert dealt.setdefault(raw[at[x] : at[x] + 50], (int(h[place[x]]), m)) == (int(h[place[x]]), m)


def test_keys_of_other_types(spark, texts):
    rows = [(None if i is None else f"{i:05d}", t) for i, t in texts]
    want = Counter((None if i is None else f"{i:05d}", *x) for (i, *x), n in brute_repeats(texts).items() for _ in range(n))
    assert Counter(map(tuple, suffix.report(spark.createDataFrame(rows, "doc_id string, text string")).collect())) == want


def test_many_occurrences_lie_on_disk():
    """Occurrences beyond the budget are spooled: a shard of few strings takes little memory however often they occur."""
    found = suffix._Occurrences(1 << 12)
    for i in range(50):
        found.add(np.arange(1000) + i, np.zeros(1000, int), np.full(1000, i))
    assert found.file._rolled
    blocks = list(found.blocks(1 << 10))
    assert sum(len(k) for k, _, _ in blocks) == 50_000 and max(len(k) for k, _, _ in blocks) == 1 << 10
    assert np.concatenate([s for _, _, s in blocks]).tolist() == [i for i in range(50) for _ in range(1000)]


_SHARD = """
import resource, sys
import numpy as np
from docketry.llm import suffix

r = np.random.default_rng(1)
strings = [bytes(r.integers(97, 101, 90).astype(np.uint8)) for _ in range(60)]
def rows(times):
    for i in range(times):
        n = 50_000
        key, start, which = np.arange(n) + i * n, np.zeros(n, np.int64), (np.arange(n) % len(strings)).astype(np.uint32)
        head = np.array([n, len(strings)], np.uint32)
        yield 0, suffix._press(b"".join(x.tobytes() for x in (head, key.astype(np.int64), start, which, np.array([90] * len(strings), np.uint32), np.zeros(len(strings), np.uint32))) + b"".join(strings))
def peak(times):
    n = sum(len(suffix._open(b)) for batch in suffix._sort_shard(50, 1 << 16, 101)(rows(times)) for b in batch.column(1).to_pylist())
    return n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
few, low = peak(16)
many, high = peak(160)
print(few, many, (high - low) // 1024)
"""


def test_memory_of_a_shard_does_not_grow_with_its_occurrences():
    """Ten times the occurrences, 192 MB of them at a budget of 64 KB: their spans come out, and the peak stays where it was."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", _SHARD], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    few, many, more = map(int, out)
    assert few == 8 * (16 * 50_000 - 60) and many == 8 * (160 * 50_000 - 60) and more < 40


def _facts_of(batches):
    """How many rows there are, and their pairs of key and value."""
    n, pairs = 0, []
    for b in batches:
        n += b.num_rows
        for bucket, keys, vals in zip(*[c.to_pylist() for c in b.columns], strict=True):
            keys = np.frombuffer(suffix._open(keys), np.int64)
            assert (suffix._bucket(keys, 7) == bucket).all()
            pairs += zip(keys.tolist(), np.frombuffer(suffix._open(vals), np.uint64).tolist(), strict=True)
    return n, sorted(pairs)


def test_facts_of_a_task_travel_together():
    """What 60 parts and 60 blocks tell of 40 documents goes in a row for each of 7 buckets, not for each part's or block's buckets."""
    press = lambda x, kind: suffix._press(np.array(x, kind).tobytes())
    codes = lambda part: np.arange(20, dtype=np.uint32) + part
    rows = [(-1 - i, press([5, 1, 1], np.int64), press([1, 2, 1], np.uint32), np.arange(4, dtype=np.uint64).tobytes()) for i in range(60)]
    for part in range(60):  # each code is held by two documents
        rows += [(part, press([first, *[1] * 19], np.int64), press([1] * 20, np.uint32), codes(part).tobytes()) for first in (0, 20)]
    n, pairs = _facts_of(suffix._look_up(1000, 7)(iter(rows)))
    want = [(key, i) for _ in range(60) for i, key in enumerate((5, 6, 6, 7))]
    want += [(first + i, part << 32 | int(code)) for part in range(60) for first in (0, 20) for i, code in enumerate(codes(part))]
    assert n <= 7 and pairs == sorted(want)


def test_blocks_of_hashes_span_batches():
    """Small batches of one task are sent as one block: rows for each part, not for each part and batch."""
    import pyarrow as pa

    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(60)) for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"k": [i], "t": [t]}) for i, t in enumerate(texts)]
    out = list(suffix._repeats(8, 50, 20)(iter(batches)))
    assert len(out) == 1 and sum(p >= 0 for p in out[0].column(0).to_pylist()) <= 16


@pytest.mark.parametrize("most", [1, 5_000, 1 << 20])
def test_strings_are_sorted_in_whole_groups(monkeypatch, most):
    """Groups are sorted some at a time, without what none shares; the least keys of all windows are those of brute force."""
    r = random.Random(4)
    say = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    strings, groups = {}, []
    for _ in range(60):
        middle = say(70)
        for _ in range(r.randint(1, 6)):
            raw = say(r.randint(0, 40)) + middle[r.randint(0, 10) : r.randint(55, 70)] + say(r.randint(0, 40))
            a = np.frombuffer(raw, np.uint8)
            at, place, h = suffix.minimizers(a, np.array([len(a)]))
            begin = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(at) else []
            for x, y in zip(begin, [*begin[1:], len(at)], strict=True):
                s = raw[at[x] : at[y - 1] + 50]
                if strings.setdefault(s, len(strings)) == len(groups):
                    groups.append(int(h[place[x]]) >> 32)
    strings, groups = list(strings), np.array(groups, np.uint32)
    least = np.array([r.randint(0, 50) for _ in strings])
    calls, real = [], suffix.repeated_windows
    monkeypatch.setattr(suffix, "repeated_windows", lambda some, *more: calls.append(some) or real(some, *more))
    monkeypatch.setattr(suffix, "SORT_BYTES", most)
    low, offset = suffix._least_keys(strings, least, groups, 50, 1 << 20)
    best = {}
    for s, k in zip(strings, least.tolist(), strict=True):
        for i in range(len(s) - 49):
            best[s[i : i + 50]] = min(k, best.get(s[i : i + 50], k))
    assert [low[a:b].tolist() for a, b in zip(offset[:-1], offset[1:], strict=True)] == [[best[s[i : i + 50]] for i in range(len(s) - 49)] for s in strings]
    largest = max(sum(len(s) for s, g in zip(strings, groups, strict=True) if g == x) for x in set(groups.tolist()))
    assert all(sum(map(len, some)) <= max(most, largest) for some in calls) and sum(len(some) for some in calls) < len(strings)

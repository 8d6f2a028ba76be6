"""Each operator against brute force on texts with nulls, ties, repeats, long texts and clashing columns; and on no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from docketry.llm import bpe, graph, induced, langid, linededup, media, packing, quality, shards, simhash, suffix, toxicity
from docketry.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(x):
    return (x is None, x if x is not None else 0)


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("limit", [2, 4096])
def test_simhash(docs, texts, limit):
    got = simhash.near_duplicates(docs, file_limit=limit).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    root = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_links_of_crowded_files(spark):
    """Thousands of fingerprints round one centre, far over the file limit: the same components as brute force."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(700)} | {r.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    comp = {r.node: r.root for r in graph.components(simhash.links(df, scratch, file_limit=20), scratch).collect()}
    mine, want = defaultdict(set), defaultdict(set)
    for f, root in brute_components(fps).items():
        mine[comp.get(simhash._signed(f), simhash._signed(f))].add(f)
        want[root].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_masks_leave_no_pair_out():
    r = random.Random(3)
    masks = simhash.first_masks()
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(x & m == y & m for m in masks)
        assert simhash.linked(np.array([x], np.uint64), np.array([y], np.uint64))[0]


def test_one_of_each(docs, texts):
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert kept.count(None) == 2 and kept.count(10) == 1 and not {11, 12, 13} & set(kept)
    assert {1, 40, 41, 80, 81} <= set(kept) and 2 not in kept


def brute_lines(rows, min_sites=10, min_words=1):
    """(key, n_lines, n_spread, what is left) of rows (key, text, site)."""
    sites, first = defaultdict(set), {}
    for k, t, site in rows:
        for x in (t or "").split("\n"):
            if len(WORD.findall(x)) >= min_words:
                sites[x].add(site or "")
                first[x] = min(first.get(x, k), k, key=lambda v: (v is None, v))
    out = Counter()
    for k, t, _ in rows:
        lines = (t or "").split("\n")
        gone = [x in first and len(sites[x]) >= min_sites and first[x] is not None and (k is None or k > first[x]) for x in lines]
        out[k, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)] += 1
    return out


def test_line_dedup(docs, texts):
    got = Counter((r.doc_id, r.n_lines, r.n_spread, r.n_removed, r.kept_chars, r.kept_sha256) for r in linededup.report(docs).collect())
    want = Counter()
    for (k, n, s, rest), c in brute_lines([(i, t, f"site{n % 13}") for n, (i, t) in enumerate(texts)]).items():
        want[k, n, s, s, len(rest), hashlib.sha256(rest.encode()).hexdigest()] += c
    assert got == want and sum(r[2] for r in want) > 20


@pytest.mark.parametrize("most", [3, 50_000])
@pytest.mark.parametrize("near", [0.2, 0.9])
def test_line_dedup_near_the_limit(spark, most, near):
    """Lines on 7 to 13 sites, of which the sketch settles none (near = 0.9) or few; hot lines dealt to several tasks."""
    r = random.Random(8)
    rows = []
    for n in range(7, 14):
        for i in range(4 * n):
            rows.append((len(rows), f"own {r.random()}\nLine of {n} sites\n\n x{n} \nlast {i}", f"s{i % n}"))
    rows += [(None, "Line of 12 sites\nLine of 9 sites", "s1"), (3, "Line of 12 sites", None), (0, "Line of 11 sites\nLine of 11 sites", "s0")]
    out = linededup.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), most=most, near=near).collect()
    assert Counter((x.row.doc_id, x.n_lines, x.n_spread, x.kept) for x in out) == brute_lines(rows)


def test_line_dedup_leaves_copies_if_asked(spark):
    rows = [(i, "the same few words\nagain the same words", f"s{i}") for i in range(15)] + [(99, "the same few words\n" + "unlike all others here " * 5, "s99")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.row.doc_id: (r.n_spread, r.n_removed) for r in linededup.clean_lines(df, leave=0.5).collect()}
    assert out == {0: (0, 0)} | {i: (2, 0) for i in range(1, 15)} | {99: (1, 1)}
    out = {r.row.doc_id: (r.n_removed, r.kept) for r in linededup.clean_lines(df, min_words=4).collect()}
    assert out[0] == (0, rows[0][1]) and out[5] == (2, "") and out[99][0] == 1


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["scumbag", "moronic", "vileness"]
    rows, labels = [], []
    for i in range(900):
        ws = [f"w{chr(97 + r.randint(0, 25))}{chr(97 + r.randint(0, 25))}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            ws[r.randint(0, 59)] = r.choice(bad)
        rows.append((i, ". ".join(" ".join(ws[k : k + 6]) for k in range(0, 60, 6)) + "."))
        labels.append((i, int(toxic if r.random() > 0.04 else not toxic)))
    rows += [(9001, None), (9002, ""), (None, "scumbag")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.report(d, lab).collect()
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 9000]
    assert len(out) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert sum((x.predicted == 1) == (x.doc_id % 5 == 0) for x in held) > 0.97 * len(held)
    model = toxicity.train(d, lab)
    spot = toxicity.locate(spark.createDataFrame([(1, "All is well. You scumbag here. Fine.")], "doc_id long, text string"), model).first()
    assert ["All is well. You scumbag here. Fine."[s.begin : s.end].strip() for s in spot.offending] == ["You scumbag here."]
    kept = toxicity.reject(d, lab)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} >= {9001, 9002}


def test_quality_counts(docs, texts):
    got = Counter(tuple(r[:7]) for r in quality.judge(docs).collect())
    want = Counter()
    for i, t in texts:
        t = t or ""
        ws = WORD.findall(t)
        win = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        mark = {p for k in range(len(ws) - 4) if win[tuple(ws[k : k + 5])] > 1 for p in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = len(ws)
        want[i, n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(mark), n < 10 or 100 * len(mark) > 20 * n] += 1
    assert got == want


def test_sharding(docs, texts):
    out = shards.assign(docs, 16, bucket_rows=2).collect()
    again = shards.assign(docs.repartition(5), 16, bucket_rows=2).collect()
    assert Counter(out) == Counter(again) and len(out) == len(texts)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want


def test_write_shards(docs, tmp_path, spark):
    shards.write_shards(docs, str(tmp_path / "s"), 4, bucket_bytes=20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {"slot", "shard", "text"} <= set(back.columns)


def test_packing(docs, texts):
    tok, by, seqs = Tokenizer.from_file(bpe.default_path()), defaultdict(list), Counter()
    out = packing.pack(docs, max_tokens=64, ids=True).collect()
    for r in out:
        by[r.doc_id].append(r)
        seqs[r.sequence_id] += 1
        assert r.offset == 0 and r.length == r.bucket and r.length & (r.length - 1) == 0 and r.length <= 64
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert set(seqs.values()) == {1}
    for i, t in texts:
        if [x for x, _ in texts].count(i) == 1:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
            mine = sorted(by[i], key=lambda r: r.start)
            assert [x for r in mine for x in r.ids] == ids and {r.doc_tokens for r in mine} == {len(ids)}


def test_language(spark):
    r = random.Random(6)
    kinds = {"en": ["the", "ing", "with", "tion"], "fr": ["eau", "é", "oi", "les"], "de": ["sch", "ü", "ein", "ung"]}
    rows = [(i, " ".join("".join(r.choice(kinds[k]) for _ in range(2)) for _ in range(30)), k) for i in range(300) for k in [list(kinds)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "123 !? ½", None), (903, "thetion", None), (None, "schein", None)]
    out = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred == "en" and len(out) == len(rows)
    held = [(x, k) for i, _, k in rows[:300] if (x := out[i]).held_out]
    assert held and sum(x.lang_pred == k for x, k in held) >= 0.97 * len(held)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out.values())


def brute_repeats(texts):
    first, out = {}, []
    for i, t in sorted(texts, key=lambda x: key(x[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        if i is not None:
            for p in range(len(raw) - 49):
                if first.setdefault(raw[p : p + 50], i) < i:
                    gone[p] += 1
                    gone[p + 50] -= 1
        cover = np.cumsum(gone)[: len(raw)] > 0
        runs = int((np.diff(np.append(0, cover.astype(int))) == 1).sum())
        out.append((i, len(raw), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cover])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("budget", [1 << 12, 64 << 20])
def test_suffix(docs, texts, budget):
    assert Counter(map(tuple, suffix.report(docs, budget=budget).collect())) == brute_repeats(texts)


def test_suffix_clean(docs):
    out = suffix.clean(docs).collect()
    assert len(out) == docs.count() and {r.row.doc_id: r.kept for r in out}[11] == "" and all(r.row.k == "x" for r in out)


@pytest.mark.parametrize("budget", [64, 1 << 20])
@pytest.mark.parametrize("cap", [3, 50])
def test_suffix_array(budget, cap, monkeypatch):
    r = random.Random(7)
    for n in range(240):
        monkeypatch.setattr(induced, "BLOCK", r.choice([1, 2, 7, 1 << 18]))
        t = []
        for _ in range(r.randint(1, 9)):
            t += [r.randint(1, r.choice([1, 2, 256])) for _ in range(r.randint(0, 40))] * r.choice([1, 1, 2]) + [0]
        if n % 3 == 0:
            t = t + t
        tail = lambda i: t[i : t.index(0, i) + 1]  # noqa: B023, E731
        blocks = list(induced.suffix_array(np.array(t), budget, cap))
        sa, common = (np.concatenate(x).tolist() for x in zip(*blocks, strict=True))
        assert sorted(sa) == list(range(len(t))) and [tail(i) for i in sa] == sorted(map(tail, range(len(t))))

        def shared(a, b):
            k = 0
            while a[k] == b[k] != 0:
                k += 1
            return min(k, cap)

        assert common == [0] + [shared(tail(a), tail(b)) for a, b in zip(sa, sa[1:], strict=False)]


def test_range_min():
    r = np.random.default_rng(2)
    for n in (1, 5, 2048, 2049, 9000):
        x = r.integers(0, 50, n)
        a, b = np.sort(r.integers(0, n, (2, 300)), axis=0)
        assert induced._range_min(x, a, b).tolist() == [x[i : j + 1].min() for i, j in zip(a, b, strict=True)]


def test_media(docs, texts):
    out = media.payload_report(docs).collect()
    want = Counter()
    for i, t in texts:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter(tuple(r[:5]) for r in out) == want
    same = defaultdict(set)
    for r in out:
        same[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_interleaving(spark):
    page = '<p>First <b>part</b>.</p><figure><img src="sha256:AB" alt="no"><figcaption>A cap&amp;tion</figcaption></figure>tail<img src="http://x/y.png" alt="why"><script>no</script><p>end'
    items = media.parse(page)
    assert [(x["position"], x["kind"], x["text"], x["caption"]) for x in items] == [(0, "text", "First part.", None), (1, "media", None, "A cap&tion"), (2, "text", "tail", None), (3, "media", None, "why"), (4, "text", "end", None)]
    assert media.parse(None) == [] == media.parse("")
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("ab", 7)], "digest string, size int")
    got = {(r.page_id, r.position): (r.caption, r["size"]) for r in media.resolve(media.interleave(pages), store).collect()}
    assert got == {(1, 1): ("A cap&tion", 7), (1, 3): ("why", None)}


def test_bpe(docs, texts):
    tok = Tokenizer.from_file(bpe.default_path())
    got = Counter(map(tuple, bpe.encode_decode(docs).collect()))
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


@pytest.mark.parametrize("guess", [False, True])
def test_bpe_odd_texts(guess):
    tok, mine, r = Tokenizer.from_file(bpe.default_path()), bpe.Bpe(bpe.default_path(), guess), random.Random(8)
    odd = ["Hello World's <|endoftext|> <|endOFtext|> ǆ İΣ ΑΣ a\x1cb a\x85b a\xa0b naïve 12½ ²", "a<|endoftext|>b", "x.,. y_, z%. ,", "ﬀ ẞ ß µ × Å̧  x　y", "!!" * 40, "é x﻿y"]
    odd += ["".join(r.choice("abcdefghthin reingERTION!!'s.,  \n\t<|>1é日Σß½_") for _ in range(r.randint(0, 90))) for _ in range(800)]
    for t, raw in zip(odd, mine.encode_batch(odd), strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        back = np.frombuffer(raw, "<u4")
        assert back.tolist() == ids, t
        assert mine.decode(back.astype(np.int64)).decode() == tok.decode(ids, skip_special_tokens=False)


def test_bpe_keeps_no_long_chunks():
    mine, tok = bpe.Bpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    texts = ["ab" * 40_000 + " end", "word " + "Zq" * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_batch(texts * 2)] == [tok.encode(t, add_special_tokens=False).ids for t in texts * 2]
    assert max(map(len, mine.known)) <= mine.LONGEST and "word" in mine.known


def test_bpe_keeps_as_many_chunks_as_asked():
    mine, tok = bpe.Bpe(bpe.default_path(), keep=100), Tokenizer.from_file(bpe.default_path())
    texts = [" ".join(f"w{i * 7 + k}" for k in range(7)) for i in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.encode_batch(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(mine.known) < 1500  # what is asked for, and one round's


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        simhash.near_duplicates(empty), simhash.one_of_each(empty), linededup.report(empty), toxicity.report(empty, labels), toxicity.reject(empty, labels),
        quality.judge(empty), shards.assign(empty), packing.pack(empty), langid.identify(empty), suffix.report(empty), suffix.clean(empty), media.payload_report(empty), bpe.encode_decode(empty),
    ):
        assert out.count() == 0

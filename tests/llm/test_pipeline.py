"""Every stage of the pipeline against plain Python on its own input, on small corpora with all that is odd."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from docketry.llm import bpe, toxicity
from docketry.llm.common import Scratch
from tokenizers import Tokenizer

from .conftest import SCHEMA, rows_of
from .test_nearcopies import brute_any
from .test_operators import brute_lines
from .test_toxicity import brute_score


def corpus():
    """Nulls, blanks, copies on many sites, near copies, shared passages, toxic sentences, short and long texts."""
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ti", "on", "er", "th", "an", "é", "st", "ro"]) for _ in range(r.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    line, passage, base = "All rights reserved by this very site.", say(60), [say(60) for _ in range(5)]
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, say(3000))]
    texts += [(10 + i, "\n".join(base)) for i in range(12)]
    for i in range(6):
        ws = " ".join(base).split()
        ws[r.randrange(len(ws))] = "changed"
        texts.append((30 + i, " ".join(ws)))
    texts += [(50 + i, f"{say(40)}\n{line}\n{say(10)} {passage} {say(25)}") for i in range(30)]
    for i in range(120):
        t = ". ".join(say(7) for _ in range(6)) + "."
        texts.append((100 + i, f"{t} You vexor{r.choice(['ing', 'ed', ''])} grumph! Go." if i % 4 == 0 else t))
    texts += [(None, "\n".join(base)), (None, None), (4, "one"), (4, "another text by far")]
    return texts


def run_stage(spark, stage, df, sf, scratch):
    out = scratch.put(stage(spark, df, sf))
    return out, sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages_against_brute_force(spark, tmp_path, kind):
    sf, scratch = str(tmp_path), Scratch(spark, "t")
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"k{i:04d}")
    rows = [(name(i), *rest) for i, *rest in rows_of(corpus())]
    labels = [(name(100 + i), int(i % 4 == 0)) for i in range(120)] + [(name(50 + i), 0) for i in range(30)] + [(name(1), None), (None, 1)]
    spark.createDataFrame(rows, SCHEMA.replace("doc_id long", f"doc_id {kind}")).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, f"doc_id {kind}, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    held = sorted(map(tuple, df.collect()), key=str)

    model = toxicity.train(df, spark.read.parquet(f"{sf}/labels.parquet"))
    df, out = run_stage(spark, stages["toxicity"], df, sf, scratch)
    assert out == [x for x in held if round(brute_score(model, x[1] or ""), 9) < 0.7] and 20 <= len(held) - len(out) <= 32
    held = out

    df, out = run_stage(spark, stages["line_dedup"], df, sf, scratch)
    cleaned = [brute_lines([(x[0], x[1], x[3]) for x in held])]
    left = Counter()
    for (k, n, spread, rest), c in cleaned[0].items():
        left[k, n, spread, rest] += c
    want = []
    for x in held:
        lines = (x[1] or "").split("\n")
        (rest,) = {rest for (k, n, _, rest) in left if k == x[0] and n == len(lines) and set(rest.split("\n")) <= set(lines) | {""} and is_left(rest, lines)} or {x[1]}
        keep = x[1] is None or len(x[1]) - len(rest) > 0.5 * len(x[1])
        text = x[1] if keep else rest
        want.append((x[0], text, *x[2:4], x[4] if text == x[1] else len(text), *x[5:]))
    assert out == sorted(want, key=str) and sum(a != b for a, b in zip(held, out, strict=True)) >= 20
    held = out

    df, out = run_stage(spark, stages["near_dedup"], df, sf, scratch)
    root = brute_any([(x[0], x[1]) for x in held])
    assert out == [x for x in held if x[0] is None or x[0] == root[x[0], x[1]]] and len(held) - len(out) >= 15
    held = out

    df, out = run_stage(spark, stages["suffix_dedup"], df, sf, scratch)
    assert out == sorted(((*x[:1], t, *x[2:4], x[4] if t == x[1] else len(t), *x[5:]) for x, t in zip(held, cut([(x[0], x[1]) for x in held]), strict=True)), key=str)
    held = out

    _, out = run_stage(spark, stages["packing"], df, sf, scratch)
    tok, pieces = Tokenizer.from_file(bpe.default_path()), Counter()
    for x in held:
        ids, at = [*tok.encode(x[1] or "", add_special_tokens=False).ids, 2], 0
        for size in [4096] * (len(ids) // 4096) + [1 << b for b in range(11, -1, -1) if len(ids) % 4096 >> b & 1]:
            pieces[x[0], at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()), len(ids)] += 1
            at += size
    assert Counter(tuple(x[:5]) for x in out) == pieces
    assert corpus_pipeline.run(spark, sf).count() == len(out)


def is_left(rest, lines):
    """Whether ``rest`` is what is left of ``lines`` by leaving some out."""
    at = iter(lines)
    return rest == "" or all(x in at for x in rest.split("\n"))


def cut(rows):
    """Texts without the bytes that 50-byte strings of smaller keys cover; bytes that are no UTF-8 any more go too."""
    first = {}
    for k, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49) if k is not None else ():
            w = raw[p : p + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, t in rows:
        raw = (t or "").encode()
        keep = np.ones(len(raw), bool)
        for p in range(len(raw) - 49) if k is not None else ():
            if first[raw[p : p + 50]] < k:
                keep[p : p + 50] = False
        out.append(t if keep.all() else bytes(np.frombuffer(raw, np.uint8)[keep]).decode("utf-8", "ignore"))
    return out


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0

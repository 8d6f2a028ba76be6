"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on an aspect of its own; several see the same kind of junk from two sides,
and between its two limits each rule abstains.  Accuracies of the rules, given good and given bad, come from expectation-maximisation
over the votes of every document: the documents are counted by vote pattern (at most 3 ** rules rows), and the
pattern counts hold all that the model needs.  The posterior probability of quality replaces
all-must-pass filtering: one accusing vote can be outvoted, two that agree seldom are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch

RULES = ("length", "word_length", "symbols", "letters", "dup_lines", "repeats", "variety", "capitals", "digits", "separators", "exclaims", "sentences")
#: PRIOR: pseudo-documents that are good and bad.
KEEP_AT, PRIOR = 0.5, (8.0, 2.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_distinct", "n_letters", "n_upper", "n_digits", "n_bars", "n_exclaims", "n_stops")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: Which bytes are symbols, letters (every character beyond ASCII by its first byte), capitals, digits, bars, exclamation marks, sentence ends.
_KINDS = np.zeros((256, 7), np.int64)
for _i, _bytes in enumerate((b"#*$%&|<>", [*range(65, 91), *range(97, 123), *range(192, 256)], range(65, 91), range(48, 58), b"|", b"!", b".?")):
    _KINDS[list(_bytes), _i] = 1


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more, the first included; equal words have equal ``ids``."""
    if len(ids) <= n:
        return 0
    k = len(ids) - n + 1
    h, win = ids.astype(np.uint64), np.zeros(k, np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    for i in range(n):
        win += h[i : i + k] * _ODD[i]
    order = np.argsort(win, kind="stable")
    s = win[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    if any((ids[left + i] != ids[right + i]).any() for i in range(n)):  # two windows of one hash: by the words themselves
        rows = np.lib.stride_tricks.sliding_window_view(ids, n)
        _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which.ravel()] > 1)
    else:
        at = order[np.append(False, same) | np.append(same, False)]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; a null one has none."""
    text = text or ""
    raw = text.encode()
    ws = raw.split()  # ASCII white space, as the words are defined
    number = dict(zip(ws, range(len(ws)), strict=True))
    ids = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols, letters, upper, digits, bars, exclaims, stops = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS).tolist()
    seen, dups, lines = set(), 0, 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line.strip(b" \t\v\f\r"):
                lines += 1
                dups += line in seen
                seen.add(line)
    else:
        lines = int(bool(ws))
    return len(ws), chars, symbols, dups, repeated_words(ids), lines, len(text), len(number), letters, upper, digits, bars, exclaims, stops


def measurements(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of counts for each row of ``docs``; null texts have no words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([measure(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(COUNTS))]], names=["k", *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return by_batch(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, " + ", ".join(f"{n} long" for n in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> list[Column]:
    """The rules, in the order of RULES, over the columns of ``measurements``."""
    n = F.col
    words, lines, chars = F.greatest(n("n_words"), F.lit(1)), F.greatest(n("n_lines"), F.lit(1)), F.greatest(n("n_chars"), F.lit(1))
    mean, stops, enough = n("word_chars") / words, n("n_stops") / words, n("n_words") >= 20

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    return [
        rule(n("n_words") < 8, n("n_words") >= 50),
        rule((mean < 3) | (mean > 7), (mean >= 4) & (mean <= 6)),
        rule(n("n_symbols") > 0.2 * words, n("n_symbols") <= 0.02 * words),
        rule(n("n_letters") < 0.68 * chars, n("n_letters") >= 0.76 * chars),
        rule(n("n_dup_lines") > 0.25 * lines, (lines >= 4) & (n("n_dup_lines") <= 0.05 * lines)),
        rule(n("n_repeat_words") > 0.15 * words, enough & (n("n_repeat_words") <= 0.03 * words)),
        rule(enough & (n("n_distinct") < F.least(0.5 * words, 4 * F.sqrt(words))), enough & (n("n_distinct") >= F.least(0.6 * words, 8 * F.sqrt(words)))),
        rule(n("n_upper") > 0.2 * n("word_chars"), n("n_upper") <= 0.08 * n("word_chars")),
        rule(n("n_digits") > 0.15 * chars, n("n_digits") <= 0.03 * chars),
        rule(n("n_bars") > 0.05 * words, enough & (n("n_bars") == 0)),
        rule(n("n_exclaims") > 0.1 * words, enough & (n("n_exclaims") <= 0.01 * words)),
        rule(enough & ((stops < 0.01) | (stops > 0.5)), (stops >= 0.03) & (stops <= 0.25)),
    ]


def learn(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over votes: (rules x 2) probabilities that a cast vote is good, given bad and given good; the share of good; posteriors.

    An abstention says nothing of the class.  It starts from agreement: texts that two rules accuse are likely bad, so that good
    stays good; one pseudo-vote a side and the pseudo-documents of PRIOR smooth it.
    """
    accused = (patterns == -1).sum(axis=1)
    post = np.select([accused >= 2, accused == 1], [0.05, 0.6], 0.95)
    up, cast = (patterns == 1).astype(float), (patterns != 0).astype(float)
    good_vote, share = np.zeros((patterns.shape[1], 2)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        share = float((weight[1].sum() + PRIOR[0]) / (counts.sum() + sum(PRIOR)))
        good_vote = ((weight @ up + 1) / (weight @ cast + 2)).T
        log = np.log([1 - share, share])[:, None] + np.log(good_vote).T @ up.T + np.log(1 - good_vote).T @ (cast - up).T
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-10
        post = new
        if done:
            break
    return good_vote, share, post


def judge(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the counts, base_failed, kept (not base_failed and posterior at least 0.5), posterior, n_good, n_bad (votes).

    Null and empty texts have no words and fail the base rule; repeated rows and null keys pass through; equal texts are
    judged alike; other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    measured = Scratch(spark, "quality").put(measurements(docs, text=text, key=key))
    voted = measured.withColumn("votes", F.array(*votes()))
    voted = voted.withColumn("pattern", sum((F.col("votes")[i] + 1) * F.lit(3**i) for i in range(len(RULES))))
    found = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()  # at most 3 ** 12 rows
    code = found["pattern"].to_numpy(np.int64)
    patterns = np.stack([code // 3**i % 3 - 1 for i in range(len(RULES))], axis=1)
    post = learn(patterns, found["n"].to_numpy(float))[2]
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(code, post, strict=True)], "pattern int, posterior double")
    failed = base_failed()
    cast = lambda v: F.size(F.filter("votes", lambda x: x == v)).cast("int")
    return voted.join(F.broadcast(table), "pattern").select(
        F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"), F.round("posterior", 9).alias("posterior"), cast(1).alias("n_good"), cast(-1).alias("n_bad"),
    )

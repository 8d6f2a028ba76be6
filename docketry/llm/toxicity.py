"""Toxicity by multiple-instance learning: a text is toxic if some sentence is.

A sentence's probability is a logistic function of the weights of its words and of their beginnings (4 to 6
letters, so that a stem counts whatever its ending); the document's is the leaky noisy-or of its sentences,
1 - (1 - leak) * prod(1 - p), where the leak stands for labels that no sentence explains and a sentence without
a weighted feature has p = 0.  Weights are learned from document labels alone, so the gradient of a toxic document
goes to the sentences that explain its label; these are what ``locate`` returns.

Many sentences of small p must not add up to a toxic text: weights are not negative, an absolute penalty takes
those of chance features to 0, where the feature is dropped, and the bias keeps at or under ``BIAS``.  What is left is
calibrated across inner folds of the training texts, score = logistic(slope * logit(noisy-or) + shift).
Words are runs of letters, lower-cased, known by a 64-bit hash; sentences end at . ! ? and line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_remainder
from .langid import _fold

#: SAMPLE: labelled rows of each class to learn from; all else covers every row.
SAMPLE, MIN_DOCS, SIGNIFICANT, LIMIT, BIAS, PENALTY = 2500, 4, 5.0, 0.7, -6.0, 1e-5
#: Characters that are read at once; a reading takes about a hundred bytes for each.
CHARS = 1 << 18
STEMS = (4, 5, 6)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.zeros(0x110000, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Instances:
    """Words of some texts: hash, hashes of their beginnings, sentence (numbered over all texts), and each sentence's text and place."""

    word: np.ndarray
    stems: list[tuple[np.ndarray, np.ndarray]]  # for each length: which words have that beginning, its hash
    sentence: np.ndarray
    text_of: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and sentence of every word and beginning."""
        return np.concatenate([self.word, *[h for _, h in self.stems]]), np.concatenate([self.sentence, *[self.sentence[at] for at, _ in self.stems]])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0xFF51AFD7ED558CCD)


def read(texts: list[str]) -> Instances:
    codes = np.frombuffer("\0".join(t.lower() if len(t.lower()) == len(t) else t for t in (t.replace("\0", " ") for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where(codes == 0, 32, _fold()[codes])
    inside = letters != 32
    first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
    last = np.flatnonzero(inside & ~np.append(inside[1:], False))
    size = last - first + 1
    c = letters[inside].astype(np.uint64)
    start = np.cumsum(size) - size
    place = np.arange(len(c)) - np.repeat(start, size)
    mixed = (c + np.uint64(0x1F123BB5)) * (_ODD * (2 * (place.astype(np.uint64) + np.uint64(1)) + np.uint64(1)))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    word = _mixed(total[start + size] - total[start])
    stems = []
    for k in STEMS:
        at = np.flatnonzero(size > k)
        stems.append((at, _mixed((total[start[at] + k] - total[start[at]]) ^ np.uint64(k))))
    text_ends = np.append(np.flatnonzero(codes == 0), len(codes))
    ends = np.unique(np.append(np.flatnonzero(_ENDS[codes]), text_ends))
    at, sentence = np.unique(np.searchsorted(ends, first), return_inverse=True)
    text_of = np.searchsorted(text_ends, ends[at])
    base = np.append(0, text_ends[:-1] + 1)[text_of]
    begin = np.maximum(np.append(0, ends[:-1] + 1)[at], base)
    return Instances(word, stems, sentence, text_of, begin - base, np.minimum(ends[at] + 1, text_ends[text_of]) - base)


def _cuts(text: str, most: int) -> Iterator[tuple[int, str]]:
    """A text in pieces of at most ``most`` characters, cut after a sentence if there is one, else after a non-letter."""
    at = 0
    while len(text) - at > most:
        end = 1 + max(text.rfind(c, at, at + most) for c in ".!?\n")
        if end <= at:
            end = next((i for i in range(at + most, at, -1) if not text[i - 1].isalpha()), at + most)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def readings(texts: list[str], most: int = CHARS) -> Iterator[tuple[Instances, np.ndarray, np.ndarray]]:
    """Readings of whole texts, about ``most`` characters at a time: instances, and for each piece its text's number and its place there."""
    pieces, owner, base, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at, piece in _cuts(t, most):
            pieces.append(piece)
            owner.append(i)
            base.append(at)
            held += len(piece) + 1
            if held >= most:
                yield read(pieces), np.array(owner), np.array(base)
                pieces, owner, base, held = [], [], [], 0
    if pieces:
        yield read(pieces), np.array(owner), np.array(base)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of words and beginnings
    weights: np.ndarray
    bias: float
    leak: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def sentence_logits(self, x: Instances) -> np.ndarray:
        z = np.full(len(x.text_of), -np.inf)
        if not len(self.words):
            return z
        feature, sentence = x.features()
        at = np.minimum(np.searchsorted(self.words, feature), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == feature)
        pair = np.unique(sentence[hit] * len(self.words) + at[hit])  # a feature counts once in a sentence
        some = np.unique(pair // len(self.words))
        z[some] = self.bias + np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], minlength=len(z))[some]
        return z

    def calibrated(self, doubt: np.ndarray) -> np.ndarray:
        """Scores from -log(1 - p) summed over each text's sentences."""
        miss = -(doubt + _leak_doubt(self.leak))
        p = np.clip(-np.expm1(miss), 1e-12, 1.0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (np.log(p) - miss) + self.shift, -500, 500)))


def _leak_doubt(leak: float) -> float:
    return float(-np.log1p(-leak))


def doubts(texts: list[str], model: Model) -> np.ndarray:
    """By text, -log of the probability that no sentence is toxic; 0 without sentences."""
    out = np.zeros(len(texts))
    for x, owner, _ in readings(texts):
        np.add.at(out, owner[x.text_of], np.logaddexp(0, model.sentence_logits(x)))
    return out


def _screen(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Features that occur with the label significantly more often than by chance (labels are noisy)."""
    seen, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for x, owner, _ in readings(texts):
        feature, sentence = x.features()
        doc = owner[x.text_of[sentence]]
        order = np.lexsort((doc, feature))
        feature, doc = feature[order], doc[order]
        new = np.append(True, (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        seen.append(feature[new])
        docs.append(doc[new].astype(np.int32))
    feature, doc = np.concatenate(seen), np.concatenate(docs)
    del seen, docs
    order = np.argsort(feature, kind="stable")
    feature, doc = feature[order], doc[order]
    if not len(feature):
        return feature
    at = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
    base, df = float(labels.mean()), np.diff(np.append(at, len(feature)))  # of the sample: chance follows its shares
    excess = np.add.reduceat((labels - base)[doc], at)
    return feature[at[(df >= MIN_DOCS) & (excess > SIGNIFICANT * np.sqrt(base * (1 - base) * df))]]


def log_loss(theta: np.ndarray, w_id: np.ndarray, s_id: np.ndarray, text_of: np.ndarray, labels: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Loss and gradient in (weights, bias, logit of the leak); pairs of feature and sentence, each sentence's text."""
    w, b, leak = theta[:-2], theta[-2], 1 / (1 + np.exp(-theta[-1]))
    n_s, n_t = len(text_of), len(labels)
    z = b + np.bincount(s_id, w[w_id], minlength=n_s)
    q = (1 - leak) * np.exp(-np.bincount(text_of, np.logaddexp(0, z), minlength=n_t))
    p = np.maximum(1 - q, 1e-9)
    loss = float(-(weight * np.where(labels == 1, np.log(p), np.log(np.maximum(q, 1e-300)))).sum() + penalty * np.abs(w).sum())
    scale = np.where(labels == 1, -q / p, 1.0) * weight
    g_s = scale[text_of] / (1 + np.exp(-z))
    return loss, np.append(np.bincount(w_id, g_s[s_id], minlength=len(w)) + penalty * np.sign(w), [g_s.sum(), (scale * leak).sum()])


def fit(texts: list[str], labels: np.ndarray, weight: np.ndarray, *, rounds: int = 300, rate: float = 0.1, penalty: float = PENALTY) -> Model:
    """Screens features by their association with the label, then Adam on the weighted log loss of the noisy-or."""
    keep = _screen(texts, labels)
    base = float(np.average(labels, weights=weight))
    none = [np.zeros(0, np.int64)]
    pairs, sent_text, n_s, n_w = list(none), list(none), 0, max(1, len(keep))
    for x, owner, _ in readings(texts):
        if not len(keep):
            break
        feature, sentence = x.features()
        at = np.minimum(np.searchsorted(keep, feature), len(keep) - 1)
        hit = np.flatnonzero(keep[at] == feature)
        pairs.append(np.unique((sentence[hit] + n_s) * n_w + at[hit]))
        sent_text.append(owner[x.text_of])
        n_s += len(x.text_of)
    pair, sent_text = np.concatenate(pairs), np.concatenate(sent_text)
    some, s_id = np.unique(pair // n_w, return_inverse=True)  # sentences with a screened feature
    w_id, text_of = pair % n_w, sent_text[some]
    theta = np.append(np.full(len(keep), 1.0), [BIAS, np.log(base / (1 - base)) - 2])  # weights, bias, leak
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        _, g = log_loss(theta, w_id, s_id, text_of, labels, weight, penalty)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[:-2] = np.maximum(theta[:-2], 0)
        theta[-2] = min(theta[-2], BIAS)
    told = theta[:-2] > 0.5
    return Model(keep[told], theta[:-2][told], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def log_odds(texts: list[str], model: Model) -> np.ndarray:
    """Of the noisy-or, before calibration."""
    miss = -(doubts(texts, model) + _leak_doubt(model.leak))
    return np.clip(np.log(np.clip(-np.expm1(miss), 1e-12, 1.0)) - miss, -30, 30)


def calibrate(x: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of log odds ``x``: Newton steps on the log loss with a weak pull to (1, 0)."""
    weight = weight / weight.sum()
    cols, theta, pull = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0]), np.array([1e-3, 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(cols @ theta, -500, 500)))
        g = cols.T @ (weight * (p - labels)) + pull * (theta - [1.0, 0.0])
        h = (cols * (weight * p * (1 - p))[:, None]).T @ cols + np.diag(pull)
        step = np.linalg.solve(h, g)
        theta = theta - step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def learn(texts: list[str], labels: np.ndarray, weight: np.ndarray, *, inner: int = 3) -> Model:
    """A model of all texts, calibrated on the log odds of each of ``inner`` folds by a model of the others.

    Where a fold or its rest lacks a class the calibration is left out.
    """
    model = fit(texts, labels, weight)
    folds = [np.arange(len(texts)) % inner == i for i in range(inner)]
    if all(0 < labels[s].sum() < s.sum() for f in folds for s in (f, ~f)):
        part = lambda s: ([texts[i] for i in np.flatnonzero(s)], labels[s], weight[s])
        x = np.zeros(len(texts))
        for f in folds:
            x[f] = log_odds(part(f)[0], fit(*part(~f)))
        model.slope, model.shift = calibrate(x, labels, weight)
    return model


NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """Learns from about ``sample`` labelled rows of each class (by a hash of the key) outside the held-out fold.

    The classes' true shares are restored by weights.  Equal texts teach once, by the label that most of them have
    (a tie: toxic); of a repeated key the least text teaches, and it is toxic if any of its labels is.  Null keys,
    labels and texts teach nothing.  Without labelled rows of both classes every sentence and text has score 0.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (id_remainder(F.col(key), folds) != held)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return NOTHING
    share = {y: min(1.0, sample / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("k")), F.lit(1_000_000)) / F.lit(1e6)
    chosen = known.where(draw < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))  # distinct keys, about 2 * sample at most
    named = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    rows = named.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).toPandas().sort_values("k")
    same = rows.groupby("t", sort=False)["y"].mean()
    texts, y = [str(t) for t in same.index], (same.to_numpy() >= 0.5).astype(int)
    if not 0 < y.sum() < len(y):
        return NOTHING
    return learn(texts, y, np.where(y == 1, 1 / share[1], 1 / share[0]))


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", limit: float = LIMIT, sentences: bool = False) -> DataFrame:
    """key, score, predicted (score at least ``limit``), n_offending; with ``sentences`` their places and scores.

    An offending sentence has probability 0.5 or more.  Null, empty and word-less texts have the score of a text in
    which no sentence offends.  Repeated rows and null keys pass through; equal texts get equal scores; other columns are
    not read.  An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        doubt, bad, found = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [[] for _ in texts]
        for x, owner, base in readings(texts):
            z = shared.value.sentence_logits(x)
            np.add.at(doubt, owner[x.text_of], np.logaddexp(0, z))
            worst = np.flatnonzero(z >= 0)
            np.add.at(bad, owner[x.text_of[worst]], 1)
            if sentences:
                for s in worst.tolist():
                    piece = x.text_of[s]
                    found[owner[piece]].append({"begin": int(base[piece] + x.begin[s]), "end": int(base[piece] + x.end[s]), "score": float(1 / (1 + np.exp(-z[s])))})
        total = shared.value.calibrated(doubt).round(9)
        cols = {key: b.column(0), "score": pa.array(total), "predicted": pa.array((total >= limit).astype(np.int32)), "n_offending": pa.array(bad)}
        if sentences:
            cols["offending"] = pa.array(found, place)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = ", offending array<struct<begin:long,end:long,score:double>>" if sentences else ""
    return by_batch(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int, n_offending long{more}")


def locate(docs: DataFrame, model: Model, **options) -> DataFrame:
    """Scores with the offending sentences of every text (character offsets); rows as in ``score``."""
    return score(docs, model, sentences=True, **options)


def report(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """key, held_out, score, predicted, n_offending for every row; a null key is not held out.  Rows as in ``score``."""
    out = score(docs, train(docs, labels, key=key, **options), key=key, text=options.get("text", "text"))
    return out.select(key, F.coalesce(id_remainder(F.col(key), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_offending")


def reject(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", limit: float = LIMIT, **options) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose score is under ``limit``: each is scored where it lies.

    Null and empty texts, null keys and repeated rows are scored like any other; an empty table gives an empty one.
    """
    model = train(docs, labels, text=text, key=key, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        total = shared.value.calibrated(doubts([t or "" for t in b.column(at).to_pylist()], shared.value))
        return b.filter(pa.array(total.round(9) < limit))

    return by_batch(docs, run, docs.schema)

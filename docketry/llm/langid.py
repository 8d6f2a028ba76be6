"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from a bounded sample of labelled rows and are summed by Spark; the matrix
of log probabilities (languages x buckets, a fixed size) is broadcast; texts are scored in numpy, a
batch of about a million characters at a time.  Letters are lower-cased, everything else is one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_remainder

ORDERS, BUCKETS, PER_LANGUAGE, CHARS, MOST_LANGUAGES = (1, 2, 3, 4), 1 << 16, 2000, 1 << 20, 1000
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """By code point: itself if a letter, else a space."""
    global _FOLD
    if _FOLD is None:
        points = np.arange(0x110000, dtype=np.uint32)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _FOLD = np.where(letter, points, 32).astype(np.uint32)
    return _FOLD


def grams(texts: list[str], own: list[int | None] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the buckets of all n-grams of the texts, and where each text's begin.

    Bucket BUCKETS stands for n-grams that reach into the next text, or begin behind the first ``own`` folded characters of
    theirs (None: all count).  Every text has at least one.
    """
    codes = np.frombuffer("\0".join(t.lower().replace("\0", " ") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.append(np.where(codes == 0, 0, _fold()[codes]), np.uint32(0))
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    stops = np.flatnonzero(c == 0)
    starts = np.append(0, stops[:-1] + 1)
    h, over = np.zeros(len(c), np.uint32), np.zeros(len(c), bool)
    for i, n in enumerate(own or ()):
        if n is not None:
            over[starts[i] + n : stops[i]] = True
    for n in range(1, max(ORDERS) + 1):
        ahead = np.zeros_like(c)
        ahead[: max(0, len(c) - n + 1)] = c[n - 1 :]
        over |= ahead == 0
        h = (h + ahead) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            yield n, np.where(over, BUCKETS, h % np.uint32(BUCKETS)).astype(np.int64), starts


def _folded(text: str) -> int:
    """How many characters of the folded text: letters, and one for each run of others."""
    codes = np.frombuffer(text.lower().replace("\0", " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _fold()[codes]
    return int(len(c) - ((c[1:] == 32) & (c[:-1] == 32)).sum()) if len(c) else 0


def pieces(text: str, most: int = CHARS) -> Iterator[tuple[str, int | None]]:
    """A very long text in parts that have its n-grams, each once: the part with what the n-grams at its end reach into, and its own folded length.

    A part ends behind a letter, so that no run of other characters is cut.
    """
    at, reach = 0, max(ORDERS) - 1
    while len(text) - at > most:
        end = at + most
        while end < len(text) and not text[end - 1].isalpha():
            end += 1
        far = end
        while far < len(text) and _folded(text[end:far]) <= reach:
            far += 64
        yield text[at:far], _folded(text[at:end])
        at = end
    yield text[at:], None


def readings(texts: list[str], most: int = CHARS) -> Iterator[tuple[list[int], list[str], list[int | None]]]:
    """All texts, about ``most`` characters at a time: the text's number, the part, its own folded length."""
    who, parts, own, held = [], [], [], 0
    for i, t in enumerate(texts):
        for part, n in pieces(t, most):
            who.append(i)
            parts.append(part)
            own.append(n)
            held += len(part) + 1
            if held >= most:
                yield who, parts, own
                who, parts, own, held = [], [], [], 0
    if parts:
        yield who, parts, own


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, smoothing: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (orders x (BUCKETS + 1) x languages), log priors.

    Learns from about ``per_language`` rows of each language, chosen by a hash of the key; rows without
    text or language teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of {lang}: that is no column of languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(ORDERS), BUCKETS + 1, 0), np.float32), np.zeros(0)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(7), "k"), F.lit(1_000_000)) < share[F.col("l")] * 1_000_000)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        names, texts = np.array(b.column(1).to_pylist()), b.column(0).to_pylist()
        out = {"l": [], "o": [], "b": [], "n": []}
        for name in np.unique(names):
            mine = [t for t, x in zip(texts, names, strict=True) if x == name]
            for _, parts, own in readings(mine):
                for n, buckets, _ in grams(parts, own):
                    got = np.bincount(buckets, minlength=BUCKETS + 1)[:BUCKETS]
                    at = np.flatnonzero(got)
                    out["l"] += [str(name)] * len(at)
                    out["o"].append(np.full(len(at), n))
                    out["b"].append(at)
                    out["n"].append(got[at])
        cols = {k: pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for k, v in out.items() if k != "l"}
        return pa.RecordBatch.from_pydict({"l": pa.array(out["l"], pa.string())} | cols)

    counts = by_batch(chosen.select("t", "l"), count, "l string, o long, b long, n long").groupBy("l", "o", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(ORDERS), BUCKETS + 1, len(langs)), smoothing)
    where = {n: i for i, n in enumerate(ORDERS)}
    col = {x: i for i, x in enumerate(langs)}
    table[counts.o.map(where).to_numpy(int), counts.b.to_numpy(), counts.l.map(col).to_numpy(int)] += counts.n.to_numpy()
    logp = np.log(table / table[:, :BUCKETS].sum(axis=1, keepdims=True))
    logp[:, BUCKETS] = 0
    total = sum(sizes.values())
    return langs, logp.astype(np.float32), np.log([sizes[x] / total for x in langs])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score (the posterior of lang_pred) for every whole text.

    Null texts and texts without a letter, and all texts if no language was learned, are ``und`` with score
    0.  Equal texts get equal results; repeated rows and null keys pass through.
    """
    langs, logp, prior = model
    shared = docs.sparkSession.sparkContext.broadcast((logp, prior))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        table, first = shared.value
        texts = b.column(1).to_pylist()
        at = [i for i, t in enumerate(texts) if langs and has_letter(t)]
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        total = np.tile(first, (len(at), 1))
        for who, parts, own in readings([texts[i] for i in at]):
            for k, (_, buckets, starts) in enumerate(grams(parts, own)):
                np.add.at(total, who, np.add.reduceat(table[k].take(buckets, axis=0), starts, axis=0, dtype=np.float64))
        if at:
            total -= total.max(axis=1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(axis=1, keepdims=True)
            for i, j, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).round(9).tolist(), strict=True):
                pred[i], score[i] = langs[j], s
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return by_batch(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, *, key: str = "doc_id", folds: int = 5, **options) -> DataFrame:
    """``predict`` with a model of the rows whose key's crc32 modulo ``folds`` is not 0; adds ``held_out``.

    A null key is not held out and teaches nothing.  Null, empty and letterless texts are ``und``; repeated rows stay; equal texts
    get equal results; an empty table gives an empty one; other columns are not read.
    """
    model = train(docs.where(id_remainder(F.col(key), folds) != 0), key=key, **options)
    out = predict(docs, model, key=key, text=options.get("text", "text"))
    return out.select(key, F.coalesce(id_remainder(F.col(key), folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

"""SimHash near copies at a Jaccard similarity of word shingles.

At similarity 0.8 a SimHash differs in about 15 % of its bits, so fingerprints have 256 bits and the budget is
``MOST`` of them: at 0.8 a pair differs in 39 on average, with a deviation of 6, at 0.5 in 69, unlike texts in 128.
The bits lie on a ring of four segments; a pair is dropped unless from some segment on every chain of l segments differs
in at most l / 4 of the budget (pigeonring filter), before its full distance is taken.  What passes is decided by the
exact shingle sets.  Files of exact bits, as ``simhash`` has for 3 bits, cannot find pairs at this distance: those that leave no pair
out would hold 3 or 4 bits.  Pairs that are put to the filter share a MinHash band instead: one of 32 bands of
6 minima is shared at 0.8 with probability 1 - (1 - 0.8^6)^32 = 0.99994, at 0.9 in all but 1 of 10^10 cases.

Equal shingle sets are one node.  In bands of up to ``PAIRS_UP_TO`` nodes all meet.  In larger ones, which hold large groups
of near copies, all meet one leader, the node that is in most large bands, as the original of a group is; then those that
did not join the band's largest component meet a leader of theirs.  The links between what is still apart are found by an
exact prefix filter: of two sets of similarity s, ordered by one global order, the first n - ceil(s n) + 1 shingles have one in
common, with enough shingles behind it in both.  With the rarest first, members with many shingles of their own meet no one by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, spread_join
from .graph import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
LONGS, MOST = 4, 68
PAIRS_UP_TO, ROUNDS = 24, 2
#: Shingle counts by which the prefix filter orders; a chance agreement only costs work.
COUNTERS = 1 << 18
_ODD = np.random.default_rng(42).integers(0, 1 << 63, 64 + BANDS * ROWS + LONGS, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_32 = (_ODD[64 : 64 + BANDS * ROWS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Bytes whose words are hashed at once; most bytes of a word that has a polynomial hash.
BLOCK, WORD = 1 << 17, 64
_GAP = np.isin(np.arange(256), [*range(9, 14), 32])
_LETTER = np.where(_GAP, np.uint64(0), np.random.default_rng(43).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1))
_LETTER[65:91] = _LETTER[97:123]
_TO_GAP, _TO_NEXT_GAP = re.compile(rb".*[\t-\r ]", re.S), re.compile(rb"[^\t-\r ]*")
_FP = [f"f{i}" for i in range(LONGS)]


def _powers(p: int) -> np.ndarray:
    out = np.full(BLOCK, p, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(0x9E3779B97F4A7C15), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of up to ``BLOCK`` bytes (or of one word) and where they begin.

    A word's hash is the polynomial of its bytes' numbers, taken from one running sum over all bytes; words of over ``WORD`` bytes, for
    which a polynomial modulo 2^64 gets weak, have an XXH64.
    """
    letters = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_GAP[letters], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if len(raw) > BLOCK:
        h = np.zeros(len(start), np.uint64)
    else:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTER[letters] * _UP[: len(raw)], out=total[1:])
        h = _mixed((total[end] - total[start]) * _DOWN[start])
    for i in np.flatnonzero(end - start > WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].lower(), 42)
    return h, start


def _cut(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of up to ``BLOCK`` bytes that end between words; a longer word is a piece of its own."""
    at = 0
    while len(raw) - at > BLOCK:
        m = _TO_GAP.match(raw, at, at + BLOCK) or _TO_NEXT_GAP.match(raw, at)
        yield raw[at : m.end()].strip()
        at = m.end()
    yield raw[at:]


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for every ``k`` words in a row."""
    out = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _ODD[i % 64]
    return _mixed(out)


def gram_sets(texts: list[str | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (ASCII case and white space); a shorter text is one shingle."""
    raws = [t.encode() if t else b"" for t in texts]
    at = 0
    while at < len(raws):
        to, size = at + 1, len(raws[at])
        while to < len(raws) and (size := size + 1 + len(raws[to])) <= BLOCK:
            to += 1
        if to == at + 1:
            h = np.concatenate([_word_hashes(piece)[0] for piece in _cut(raws[at])])
            ends = [len(h)]
        else:
            h, start = _word_hashes(b" ".join(raws[at:to]))
            ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in raws[at:to]])).tolist()
        found = _shingles(h, shingle)
        for a, b in zip([0, *ends], ends, strict=False):
            g = np.sort(found[a : b - shingle + 1] if b - a >= shingle else _shingles(h[a:b], max(1, b - a)))
            yield g[np.append(True, g[1:] != g[:-1])] if len(g) else g
        at = to


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return next(gram_sets([text], shingle))


def minima(g: np.ndarray) -> np.ndarray:
    """The least of each MinHash function over a shingle set, of 32 bits."""
    low, x = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (g >> _SHIFT).astype(np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(low, (x[at : at + 128, None] * _ODD_32).min(axis=0), out=low)
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    """One hash for each band of minima; a row for each set."""
    total = np.arange(BANDS, dtype=np.uint64) * _MIX
    return _mixed(total + (low.reshape(-1, BANDS, ROWS) * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def wide_fingerprint(g: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a shingle set, as four longs."""
    total = np.zeros(64 * LONGS, np.int64)
    for at in range(0, len(g), 255):  # so many bits add up in a byte
        h = g[at : at + 255, None] * _ODD[64 + BANDS * ROWS :]
        h ^= h >> _SHIFT
        h *= _MIX
        total += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(g), bitorder="little").view("<i8")


def near(most: int = MOST) -> Column:
    """Whether fingerprints f0.. and g0.. differ in at most ``most`` bits: pigeonring chains, then the whole distance."""
    d = [F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"g{i}"))) for i in range(LONGS)]
    chains = lambda at: [sum(d[(at + k) % LONGS] for k in range(size)) <= size * most // LONGS for size in range(1, LONGS)]
    some = reduce(Column.__or__, [reduce(Column.__and__, chains(at)) for at in range(LONGS)])
    return some & (sum(d) <= most)


def _node(g: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(g.tobytes(), 7)


def sketches(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """key, th (hash of the text), node (of the shingle set), n, bands, the fingerprint's longs."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(2).to_pylist()
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        row = np.array([place[t] for t in texts], np.int64)
        of_text = [(_node(g), len(g), minima(g), wide_fingerprint(g)) for g in gram_sets([*place], shingle)]
        node, n, low, fps = (np.array(x, kind)[row] for x, kind in zip(zip(*of_text, strict=True), (np.uint64, np.int64, np.uint32, np.int64), strict=True))
        bands = pa.ListArray.from_arrays(np.append(0, np.cumsum((n > 0) * BANDS)).astype(np.int32), band_hashes(low[n > 0]).ravel())
        cols = [b.column(0), b.column(1), pa.array(node.view(np.int64)), pa.array(n), bands]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(fps[:, i])) for i in range(LONGS)]], names=["k", "th", "node", "n", "bands", *_FP])

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    return by_batch(named, run, f"k {kind}, th long, node long, n long, bands array<long>, " + ", ".join(f"{f} long" for f in _FP))


def _sets(docs: DataFrame, nodes: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """``node``, ``grams`` of the given nodes, read from the row of the least key that has the text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [g.view(np.int64) for g in gram_sets(b.column(1).to_pylist(), shingle)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    named = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    wanted = nodes.select("node", F.col("least").alias("k"), "th")
    found = named.where("k IS NOT NULL").join(wanted.where("k IS NOT NULL"), ["k", "th"]).select("node", "t")
    unnamed = named.where("k IS NULL").select("th", "t").dropDuplicates(["th"]).join(wanted.where("k IS NULL").drop("k"), "th").select("node", "t")
    return by_batch(found.union(unnamed).dropDuplicates(["node"]), run, "node long, grams array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Of pairs ``a, b`` those whose exact similarity is reached."""
    x, y = (sets.select(F.col("node").alias(end), F.col("grams").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    pairs = scratch.put(pairs)
    both = spread_join(pairs, x, "a").join(y, "b")  # a is the leader's end wherever many rows share one
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return scratch.put(shared.where(F.col("shared") + 1e-9 >= similarity * (F.col("total") - F.col("shared"))).select("a", "b"))


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``node``, ``place``, ``token``: of each set the shingles of which two similar sets must share one, the rarest first."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            g = b.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((g % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    counted = sets.select("grams").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()  # at most COUNTERS rows
    often = np.zeros(COUNTERS, np.int64)
    often[counted.c.to_numpy(int)] = counted.n.to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def first(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for g in b.column(1).to_pylist():
            g = np.array(g, np.int64).view(np.uint64)
            order = np.lexsort((g, shared.value[(g % np.uint64(COUNTERS)).astype(np.int64)]))
            out.append(g[order[: len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1]].view(np.int64))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "tokens"])

    return by_batch(sets.select("node", "grams"), first, "node long, tokens array<long>").select("node", F.posexplode("tokens").alias("place", "token"))


def near_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, pairs_up_to: int = PAIRS_UP_TO, rounds: int = ROUNDS) -> DataFrame:
    """key, component_id (the smallest key reachable over pairs of at least ``similarity``) for every row.

    Null, empty and word-less texts are one set, equal to each other; a text of fewer words than a shingle is one shingle.
    Repeated rows stay.  A null key counts as no key.  An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies")
    rows = scratch.put(sketches(docs, text, key, shingle))
    first = [F.first(c).alias(c) for c in ("n", "bands", *_FP)]
    named = F.min(F.when(F.col("k").isNotNull(), F.struct("k", "th")))  # the row that the text is read from
    nodes = rows.groupBy("node").agg(named.alias("m"), F.min("th").alias("th"), *first)
    nodes = scratch.put(nodes.select("node", F.col("m.k").alias("least"), F.coalesce("m.th", "th").alias("th"), "n", "bands", *_FP))
    one = ["node", "n", *_FP]
    filed = nodes.select("node", F.explode("bands").alias("band"))
    sizes = filed.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    # most bands hold one node, so they travel without its fingerprint
    filed = scratch.put(filed.join(sizes, "band").join(nodes.select(*one), "node"))
    as_other = dict(zip(["band", "root", "token", "place", *one], ["_band", "side", "_token", "_place", "other", "m", *[f"g{i}" for i in range(LONGS)]], strict=True))
    other = lambda df: df.withColumnsRenamed({k: v for k, v in as_other.items() if k in df.columns})
    may = (F.least("n", "m") + 1e-9 >= similarity * F.greatest("n", "m")) & near(most)

    def to_leaders(members: DataFrame, candidates: DataFrame, extra=F.lit(True)) -> DataFrame:
        """Pairs of a leader (``a``) for each band and the members of the band."""
        lead = candidates.groupBy("band").agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in ("band", "deg")]), F.struct("deg", F.xxhash64("node"))).alias("l")).select("band", "l.*")
        lead = other(lead).withColumnRenamed("_band", "band")
        met = spread_join(members, lead, "band").where((F.col("node") != F.col("other")) & may & extra)
        return met.select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()

    few = filed.where(f"many <= {pairs_up_to}").select("band", *one)
    met = few.join(other(few), (F.col("band") == F.col("_band")) & (F.col("node") < F.col("other")) & may)
    pairs = scratch.put(met.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    crowd = filed.where(f"many > {pairs_up_to}").select("band", *one)
    crowd = scratch.put(crowd.join(crowd.groupBy("node").agg(F.count(F.lit(1)).alias("deg")), "node"))
    crowded = not crowd.isEmpty()
    if crowded:
        pairs = scratch.put(pairs.union(to_leaders(crowd, crowd)))
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()
    sets = scratch.put(_sets(docs, nodes.join(met, "node").select("node", "least", "th"), text, key, shingle))
    edges = _similar(pairs, sets, similarity, scratch)
    comp = components(edges, scratch)

    def still_open() -> tuple[DataFrame, DataFrame]:
        """Members of bands with more than one component; those of them outside the band's largest."""
        rooted = scratch.put(crowd.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")))
        by_root = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
        major = by_root.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
        members = scratch.put(spread_join(rooted, major, "band"))
        return members.drop("major"), members.where("root <> major").drop("major")

    if crowded:
        for _ in range(rounds - 1):
            members, strays = still_open()
            if strays.isEmpty():
                break
            found = _similar(to_leaders(members, strays, F.col("root") != F.col("side")), sets, similarity, scratch)
            if not found.isEmpty():
                edges = scratch.put(edges.union(found))
                comp = components(edges, scratch)
        members, strays = still_open()
        if not strays.isEmpty():
            members, strays = (x.select("root", *one).distinct() for x in (members, strays))
            tokens = scratch.put(_prefixes(sets.join(members.select("node"), "node", "left_semi"), similarity).join(members, "node"))
            # the first shingle in common lies so far ahead in both that enough others can follow; so no pair meets by a later one,
            # and a shingle that a whole group shares is dropped where even the token's smallest set would be too large a partner
            share = similarity / (1 + similarity)
            shared = tokens.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("n").alias("least_n")).where("x <> y").select("token", "least_n")
            tokens = tokens.join(shared, "token").where(F.col("n") - F.col("place") + 1e-9 >= share * (F.col("n") + F.col("least_n"))).drop("least_n")
            left = tokens.join(strays.select("node"), "node", "left_semi")
            enough = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("_place")) + 1e-9 >= share * (F.col("n") + F.col("m"))
            met = left.join(other(tokens), (F.col("token") == F.col("_token")) & (F.col("root") != F.col("side")) & enough & may)
            found = _similar(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), sets, similarity, scratch)
            if not found.isEmpty():
                comp = components(edges.union(found), scratch)
    rooted = scratch.put(nodes.join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"))
    least = spread_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return spread_join(rows.select("k", "node"), least, "node").select(F.col("k").alias(key), "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows whose key is the smallest of its component; rows without a key, and repeats of a kept key, stay."""
    kept = near_copies(docs, key=key, **options).where(f"`{key}` = component_id").select(key).distinct()
    return docs.join(kept, key, "left_semi").unionByName(docs.where(F.col(key).isNull()))

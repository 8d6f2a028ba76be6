"""Suffix-array dedup of repeated byte strings across documents, far beyond one machine's memory.

A string of ``length`` bytes that starts in a document with a smaller key is removed wherever it occurs later.

1. A text that a smaller key has too goes as a whole; such copies are found by their SHA-256 and take no part in what follows.
2. Every window has a minimizer, the k bytes in it of least hash; equal windows have the same one.
   Only minimizers that occur in two documents or more can matter.  Their hashes are sent in blobs by
   hash range; those that repeat within a block of documents are settled there, so a hash held by a
   third of all documents is sent once for each block.
3. Runs of windows that share such a minimizer are cut out of the texts and dealt by it, so all equal windows
   meet in one shard.  Runs of a minimizer that very many documents share are cut in two and dealt by it and the bytes before
   or after it, of which each window holds one side whole: equal windows still meet, others no longer do.
4. Each shard sorts the suffixes of its distinct strings, a few groups of a minimizer at a time and without what no other string of a
   group can share, by external induced sorting (``induced``), whose queues
   lie on disk beyond a budget, as the occurrences of the strings do.  Neighbours in suffix order with a common prefix of ``length``
   or more form a group, whose least key is known; windows of later documents become spans.
5. Spans are joined to their documents, merged and cut.

Keys that are no integers are numbered in their order first.  Rows with a null key have no order: they are left alone
and remove nothing.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, by_batch, small_batches, spread_join
from .induced import suffix_array

#: SHARD_BYTES: text for each shard on average.  SORT_BYTES: strings of a shard that are sorted at once, but for a group that holds more.
#: SLICE_BYTES: what minimizers are taken of at once, so that the arrays stay in a core's cache.
#: LOOK_BYTES: the same for each part in which hashes are looked up, which takes about two bytes for each byte of text.
#: CODES, FACTS: hashes and facts that a task gathers before it sends them on, so that rows stay large however many parts and buckets there are.
#: HOT: documents that share a minimizer from which on its runs are cut in two.  COPIES: equal texts that one task compares.
LENGTH, K, SHARD_BYTES, LOOK_BYTES, SLICE_BYTES, BLOCK_ROWS, HOT, COPIES = 50, 20, 6 << 20, 12 << 20, 1 << 16, 2000, 50_000, 1000
SORT_BYTES, CODES, FACTS = 1 << 20, 1 << 20, 1 << 19
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = (1 << 24) - 1


def _kmer_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position on (positions without k bytes ahead: any)."""
    n, h, width = len(a), (a.astype(np.uint64) + np.uint64(1)) * _M2, 1
    h ^= h >> np.uint64(31)
    out, have = np.zeros(n, np.uint64), 0
    while width <= k:
        if k & width:
            moved = np.zeros(n, np.uint64)
            moved[: n - have] = h[have:]
            out = out * np.uint64(pow(int(_M1), width, 1 << 64)) + moved
            have += width
        twice = np.zeros(n, np.uint64)
        twice[: n - width] = h[width:]
        h, width = h * np.uint64(pow(int(_M1), width, 1 << 64)) + twice, width * 2
    out ^= out >> np.uint64(32)
    out *= _M2
    out ^= out >> np.uint64(29)
    return out


def minimizers(a: np.ndarray, stops: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over concatenated texts (``stops``: their ends): window starts, each one's minimizer place, k-byte hashes."""
    n, w = len(a), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _kmer_hashes(a, k)
    best = (h & ~np.uint64(_POS)) | np.arange(n, dtype=np.uint64)
    have, power = 1, best
    while have * 2 <= w:
        power = np.minimum(power[: len(power) - have], power[have:])
        have *= 2
    m = n - length + 1
    low = np.minimum(power[:m], power[w - have : w - have + m])
    ok = np.ones(n + 1, bool)
    starts = np.append(0, stops[:-1])
    edge = np.zeros(n + 2, np.int64)  # windows that would cross the end of their text
    np.add.at(edge, np.maximum(stops - length + 1, starts), 1)
    np.add.at(edge, stops, -1)
    ok = np.cumsum(edge)[:m] == 0
    at = np.flatnonzero(ok)
    return at, (low[at] & np.uint64(_POS)).astype(np.int64), h


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > SLICE_BYTES:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _whole(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a very long text that overlap by all but one byte of a window."""
    step = 1 << 20
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + step + length - 1]


def _pieces(texts: list[bytes], length: int) -> tuple[list[bytes], list[int], list[int]]:
    parts, owner, base = [], [], []
    for i, t in enumerate(texts):
        for at, p in _whole(t, length):
            parts.append(p)
            owner.append(i)
            base.append(at)
    return parts, owner, base


def _short(h: np.ndarray, parts: int) -> np.ndarray:
    """A hash's part (high half) and 32 bits of it; a chance agreement only costs work."""
    return h % np.uint64(parts) << np.uint64(32) | h >> np.uint64(32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


_PRESS, _OPEN = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _press(data: bytes) -> bytes:
    return _PRESS.compress(data)


def _open(data: bytes) -> bytes:
    return _OPEN.decompress(data)


_ROWS = "part long, keys binary, counts binary, codes binary"


def _repeats(parts: int, length: int, k: int):
    """Texts to rows (part, keys, counts, codes): for each key its count of codes, to be looked up in that part.

    Without keys: codes that repeat in a block of some ``CODES`` codes, and how often.  Part under 0: settled codes of their keys.
    """

    def codes_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts, owner, _ = _pieces([(t or "").encode() for t in b.column(1).to_pylist()], length)
        codes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in _slices(texts):
            a = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
            stops = np.cumsum([len(t) for t in texts[lo:hi]])
            _, place, h = minimizers(a, stops, length, k)
            place = np.unique(place)
            codes.append(_short(h[place], parts))
            docs.append(np.array(owner[lo:hi])[np.searchsorted(stops, place, side="right")])
        return np.concatenate(codes), keys[np.concatenate(docs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                held.append(codes_of(b.slice(at, BLOCK_ROWS)))
                n += len(held[-1][0])
                if n >= CODES:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(code)
        code, doc = code[order], doc[order]
        same = code[1:] == code[:-1]
        many = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(code) else np.zeros(0, np.int64)
        doc[many] = doc[many][np.lexsort((doc[many], code[many]))]  # most codes stand alone; the others' keys ascend
        fresh = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])) if len(code) else np.zeros(0, bool)
        code, doc = code[fresh], doc[fresh]
        new = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
        once = new & np.append(new[1:], True) if len(code) else new
        out: dict[str, list] = {"part": [], "keys": [], "counts": [], "codes": []}

        def add(part: int, key: np.ndarray, codes: bytes) -> None:
            at, n = _runs(key)
            first = np.diff(key[at], prepend=0)  # ascending keys as differences
            for name, v in zip(out, (part, _press(first.tobytes()), _press(n.astype(np.uint32).tobytes()), codes), strict=True):
                out[name].append(v)

        mine = np.flatnonzero(once)
        part = (code[mine] >> np.uint64(32)).astype(np.int64)
        at, n = _runs(part)
        for x, size in zip(at.tolist(), n.tolist(), strict=True):
            i = mine[x : x + size]
            i = i[np.argsort(doc[i], kind="stable")]
            add(int(part[x]), doc[i], code[i].astype(np.uint32).tobytes())
        head = np.flatnonzero(new & ~once)
        known, times = code[head], np.diff(np.append(np.flatnonzero(new), len(code)))[~once[new]].astype(np.uint32)
        at, n = _runs(known >> np.uint64(32))
        for x, size in zip(at.tolist(), n.tolist(), strict=True):
            for name, v in zip(out, (int(known[x] >> np.uint64(32)), _press(b""), _press(times[x : x + size].tobytes()), known[x : x + size].astype(np.uint32).tobytes()), strict=True):
                out[name].append(v)
        rest = np.flatnonzero(~once)
        rest = rest[np.argsort(doc[rest], kind="stable")]
        if len(rest):
            add(-1 - int(doc[rest[0]]) % parts, doc[rest], code[rest].tobytes())
        return pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int64())} | {n: pa.array(out[n], pa.binary()) for n in ("keys", "counts", "codes")})

    return run


def _by_row(settle):
    """Runs ``settle`` over a task's rows, which are read as they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from settle(row for b in batches for at in range(0, b.num_rows, 100) for row in zip(*[c.to_pylist() for c in b.slice(at, 100).columns], strict=True))

    return run


def _by_part(settle, buckets: int):
    """Runs ``settle`` (rows, where facts go) over the rows of one part after the other; rows come sorted by part."""

    def run(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered(buckets)
        for _, mine in itertools.groupby(rows, lambda row: row[0]):
            yield from settle(mine, gathered)
        yield from gathered.rest()

    return run


def _prime(n: int) -> int:
    """The least prime of at least n."""
    n = max(2, n)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket; ``_bucket_column`` gives the same."""
    u = k.view(np.uint64)
    return (u ^ (u >> np.uint64(20)) ^ (u >> np.uint64(41))).view(np.int64) % buckets


def _bucket_column(k: Column, buckets: int) -> Column:
    mixed = k.bitwiseXOR(F.shiftrightunsigned(k, 20)).bitwiseXOR(F.shiftrightunsigned(k, 41))
    return F.coalesce(F.pmod(mixed, F.lit(buckets)), F.lit(0)).cast("int")


_FACTS = "bucket int, keys binary, vals binary"


def _facts(key: np.ndarray, value: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys, values) from pairs in any order: one for each bucket, however many keys it has."""
    where = _bucket(key, buckets)
    order = np.lexsort((key, where))
    key, value, where = key[order], value[order], where[order]
    at, n = _runs(where)
    if len(at):
        cut = lambda x: pa.array([_press(x[a : a + m].tobytes()) for a, m in zip(at.tolist(), n.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(where[at].astype(np.int32)), cut(key), cut(value)], names=["bucket", "keys", "vals"])


class _Gathered:
    """Facts of several parts or shards, which go on together: a task's rows are as many as its buckets, not its parts' buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.n = buckets, 0
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def add(self, key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sends what is gathered once it is ``FACTS`` or more."""
        if len(key):
            self.keys.append(key)
            self.values.append(value)
            self.n += len(key)
        if self.n >= FACTS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            key, value = np.concatenate(self.keys), np.concatenate(self.values)
            self.keys, self.values, self.n = [], [], 0
            yield from _facts(key, value, self.buckets)


class _Known:
    """What is known of the keys of one bucket: values of ``dtype``, and hashes of texts that are copies."""

    def __init__(self, dtype, width: int):
        self.dtype, self.width = dtype, width
        self.reset(None)

    def reset(self, bucket: int | None) -> None:
        self.bucket, self.keys, self.vals, self.ready = bucket, [np.zeros(0, np.int64)], [np.zeros((0, self.width), self.dtype)], False
        self.copies: set[tuple[int, int]] = set()

    def add(self, b: pa.RecordBatch) -> None:
        for k, th, keys, vals in zip(*[b.column(c).to_pylist() for c in ("k", "th", "keys", "vals")], strict=True):
            if keys is None:
                self.copies.add((k, th))
            else:
                self.keys.append(np.frombuffer(_open(keys), np.int64))
                self.vals.append(np.frombuffer(_open(vals), self.dtype).reshape(-1, self.width))

    def of(self, keys: list[int | None]) -> list[np.ndarray]:
        """The values of each key; none for null."""
        if not self.ready:
            k, v = np.concatenate(self.keys), np.concatenate(self.vals)
            order = np.argsort(k, kind="stable")
            self.keys, self.vals, self.ready = [k[order]], [v[order]], True
        k, v = self.keys[0], self.vals[0]
        wanted = np.array([0 if x is None else x for x in keys], np.int64)
        lo, hi = np.searchsorted(k, wanted), np.searchsorted(k, wanted, side="right")
        return [v[a : a if x is None else b] for x, a, b in zip(keys, lo.tolist(), hi.tolist(), strict=True)]


def _meet(docs: DataFrame, facts: DataFrame, copies: DataFrame, settle, schema, dtype, width: int, buckets: int) -> DataFrame:
    """Rows of ``docs`` (k, th, and others) with what is known of their keys, bucket by bucket.

    Each task reads the facts of a bucket first, then streams its documents: only a bucket's facts are held.
    """
    rest = [c for c in docs.columns if c not in ("k", "th")]
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    none = [null(docs, c) for c in rest]
    told = facts.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("th"), *none, "keys", "vals")
    gone = copies.select(_bucket_column(F.col("k"), buckets).alias("bucket"), F.lit(0).alias("kind"), "k", "th", *none, null(facts, "keys"), null(facts, "vals"))
    rows = docs.select(_bucket_column(F.col("k"), buckets).alias("bucket"), F.lit(1).alias("kind"), "k", "th", *rest, null(facts, "keys"), null(facts, "vals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(dtype, width)
        for b in batches:
            where = b.column("bucket").to_numpy().astype(np.int64) * 2 + b.column("kind").to_numpy()
            for lo, n in zip(*[x.tolist() for x in _runs(where)], strict=True):
                bucket, kind = divmod(int(where[lo]), 2)
                if bucket != known.bucket:
                    known.reset(bucket)
                part = b.slice(lo, n)
                if not kind:
                    known.add(part)
                    continue
                for at in range(0, n, BLOCK_ROWS):
                    if (out := settle(part.slice(at, BLOCK_ROWS), known)) is not None:
                        yield out

    return told.union(gone).union(rows).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def _look_up(hot: int, buckets: int):
    """Rows of a part to facts: codes that occur in two documents or more, by key; settled ones pass.

    Bucket -1: codes of more than ``hot`` documents.
    """

    def settle(rows: Iterable[tuple], gathered: _Gathered) -> Iterator[pa.RecordBatch]:
        code, key, known, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part, ks, ns, cs in rows:
            first, n = np.frombuffer(_open(ks), np.int64), np.frombuffer(_open(ns), np.uint32)
            if part < 0:
                yield from gathered.add(np.repeat(np.cumsum(first), n), np.frombuffer(cs, np.uint64))
                continue
            cs = np.frombuffer(cs, np.uint32).astype(np.uint64) | np.uint64(part << 32)
            if len(first):
                key.append(np.repeat(np.cumsum(first), n))
                code.append(cs)
            else:
                known.append(cs)
                times.append(n.astype(np.int64))
        code, key, known, times = (np.concatenate(x) for x in (code, key, known, times))
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        some, which = np.unique(known, return_inverse=True)
        total = np.bincount(which, times, minlength=len(some))
        place = np.searchsorted(some, code)
        hit = np.append(some, np.uint64(0))[place] == code if len(some) else np.zeros(len(code), bool)
        hit &= place < len(some)
        np.add.at(total, place[hit], 1)
        if len(code):
            hit[order] |= np.append(False, same) | np.append(same, False)
            yield from gathered.add(key[hit], code[hit])
        alone, n = np.unique(code, return_counts=True)
        crowd = np.concatenate([some[total > hot], alone[n > hot]])
        if len(crowd):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([crowd.tobytes()], pa.binary())], names=["bucket", "keys", "vals"])

    return _by_part(settle, buckets)


def _halves(begin: np.ndarray, end: np.ndarray, code: np.ndarray, place: np.ndarray, at: np.ndarray, a: np.ndarray, crowd: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs (first and last window, code, place of the minimizer) with those of crowded codes cut in two: first, last, what to deal by."""
    hot = np.isin(code, crowd)
    if not hot.any():
        return begin, end, None
    half = (length - k) // 2
    side = _kmer_hashes(a, half)
    b, e, p = begin[hot], end[hot], place[begin[hot]]
    mid = b + np.clip(p - half - at[b] + 1, 0, e - b + 1)  # windows before it hold the bytes before the minimizer
    left, right = mid > b, mid <= e
    last = len(a) - 1
    parts = [(begin[~hot], end[~hot], np.zeros((~hot).sum(), np.uint64)), (b[left], mid[left] - 1, side[np.maximum(p[left] - half, 0)] * _M1 | np.uint64(1)), (mid[right], e[right], side[np.minimum(p[right] + k, last)] * _M2 | np.uint64(1))]
    begin, end, more = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order], more[order]


def _cut(looks: int, parts: int, length: int, k: int, crowd: np.ndarray | None = None):
    """Texts and what is known of them (repeating codes, copies) to rows (part, runs): runs of windows, by minimizer.

    A row's runs are compressed: their number, keys, starts, each one's own string, and of the distinct strings the sizes, what they are dealt by, and the bytes.
    """
    crowd = np.zeros(0, np.uint64) if crowd is None else crowd

    def settle(b: pa.RecordBatch, known: _Known) -> pa.RecordBatch | None:
        codes = known.of(b.column("k").to_pylist())
        own = [i for i, x in enumerate(zip(b.column("k").to_pylist(), b.column("th").to_pylist(), strict=True)) if len(codes[i]) and x not in known.copies]
        b = b.take(pa.array(own, pa.int64()))
        keys = b.column("k").to_numpy(zero_copy_only=False)
        texts, owner, base = _pieces([_open(t) for t in b.column("z").to_pylist()], length)
        wanted = [np.unique(codes[i]) for i in own]
        group, key, start, data = [], [], [], []
        for lo, hi in _slices(texts):
            raw = b"".join(texts[lo:hi])
            a = np.frombuffer(raw, np.uint8)
            stops = np.cumsum([len(t) for t in texts[lo:hi]])
            at, place, h = minimizers(a, stops, length, k)
            if not len(at):
                continue
            begin = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
            end = np.append(begin[1:], len(at)) - 1
            begin, end, more = _halves(begin, end, _short(h[place[begin]], looks), place, at, a, crowd, length, k)
            full = h[place[begin]]
            code = _short(full, looks)
            if more is not None:
                full = np.where(more > 0, (full ^ more) * _M2, full)
                full ^= full >> np.uint64(31)
            doc = np.searchsorted(stops, at[begin], side="right")
            edges = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                x, y = edges[i], edges[i + 1]
                mine = np.flatnonzero(np.isin(code[x:y], wanted[owner[lo + i]])) + x
                if len(mine):
                    f, t = at[begin[mine]], at[end[mine]] + length
                    group.append(full[mine])
                    key.append(np.full(len(mine), keys[owner[lo + i]]))
                    start.append(f - (stops[i] - len(texts[lo + i])) + base[lo + i])
                    data += [raw[p:q] for p, q in zip(f.tolist(), t.tolist(), strict=True)]
        if not group:
            return None
        group, key, start = np.concatenate(group), np.concatenate(key), np.concatenate(start)
        part = (group % np.uint64(parts)).astype(np.int64)
        out: dict[str, list] = {"part": [], "runs": []}
        order = np.argsort(part, kind="stable")
        for x, n in zip(*[v.tolist() for v in _runs(part[order])], strict=True):
            at = order[x : x + n]
            own: dict[bytes, int] = {}
            which = np.array([own.setdefault(data[i], len(own)) for i in at.tolist()], np.uint32)
            sizes = np.array([len(s) for s in own], np.uint32)
            groups = np.zeros(len(own), np.uint32)
            groups[which] = (group[at] >> np.uint64(32)).astype(np.uint32)
            head = np.array([n, len(own)], np.uint32)
            out["part"].append(int(part[at[0]]))
            out["runs"].append(_press(b"".join([v.tobytes() for v in (head, key[at].astype(np.int64), start[at].astype(np.int64), which, sizes, groups)] + [*own])))
        return pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int64()), "runs": pa.array(out["runs"], pa.binary())})

    return settle


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """keys, starts, each run's string number; of the distinct strings what they are dealt by, and the strings."""
    raw = _open(blob)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    key, start = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    which, sizes, groups = np.frombuffer(raw, np.uint32, n, 8 + 16 * n), np.frombuffer(raw, np.uint32, m, 8 + 20 * n), np.frombuffer(raw, np.uint32, m, 8 + 20 * n + 4 * m)
    head = 8 + 20 * n + 8 * m
    stop = (np.cumsum(sizes) + head).tolist()
    return key, start, which, groups, [raw[a:b] for a, b in zip([head, *stop], stop, strict=False)]


def repeated_windows(strings: list[bytes], least: np.ndarray, length: int = LENGTH, budget: int = 16 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For strings with a least key each: per window (string by string, in order) the least key of all equal windows.

    Returns the keys and where each string's windows begin.
    """
    size = np.array([len(x) for x in strings], np.int64)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    t = raw[: int(size.sum()) + len(strings)].astype(np.int16) + 1
    end = np.cumsum(size + 1) - 1
    t[end] = 0
    begin = end - size
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), size + 1)
    windows = np.maximum(size - length + 1, 0)
    offset = np.append(0, np.cumsum(windows))
    out = np.zeros(offset[-1], least.dtype)
    held: list[np.ndarray] = []

    def settle(pos: np.ndarray, new: np.ndarray) -> None:
        group = np.flatnonzero(new)
        low = np.minimum.reduceat(least[owner[pos]], group)
        out[offset[owner[pos]] + pos - begin[owner[pos]]] = np.repeat(low, np.diff(np.append(group, len(pos))))

    for block, common in suffix_array(t, budget, length):
        ok = end[owner[block]] - block >= length  # suffixes that hold a whole window; no shorter one stands within a group
        pos, new = block[ok], common[ok] < length
        if not len(pos):
            continue
        n = sum(map(len, held))
        pos, new = np.concatenate([*held, pos]), np.concatenate([np.zeros(n, bool), new])
        new[0] = True
        last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next block
        if last:
            settle(pos[:last], new[:last])
        held = [pos[last:]]
    if held and len(held[0]):
        settle(held[0], np.append(True, np.zeros(len(held[0]) - 1, bool)))
    return out, offset


def _shared_sides(strings: list[bytes], groups: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each string, a run of windows of one minimizer, that another string of its group can share (begin and end; empty: none).

    A window holds half of ``length - k`` bytes before its minimizer or as many after it, so of two equal windows those are equal too.
    """
    half = (length - k) // 2
    a = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(x) for x in strings], np.int64)
    stops = np.cumsum(size)
    starts = stops - size
    near = _kmer_hashes(a, k)[starts[:, None] + np.arange(length - k + 1)] & ~np.uint64(_POS)
    place = near.argmin(axis=1)  # that of the first window is that of all
    side, last = _kmer_hashes(a, half), len(a) - 1

    def met(ok: np.ndarray, at: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(ok)
        code = groups[own].astype(np.uint64) << np.uint64(32) | side[np.clip(at[own], 0, last)] >> np.uint64(32)
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        out = np.zeros(len(ok), bool)
        out[own[order]] = np.append(False, same) | np.append(same, False) if len(own) else False
        return out

    left, right = met(place >= half, starts + place - half), met(place + k + half <= size, starts + place + k)
    begin = np.where(left, 0, np.maximum(0, place + k + half - length))
    end = np.where(right, size, np.minimum(size, place - half + length))
    return begin, np.where(left | right, end, begin)


def _least_keys(strings: list[bytes], least: np.ndarray, groups: np.ndarray, length: int, budget: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """``repeated_windows`` of strings that are dealt by ``groups``: a window can recur only in a string of its group.

    A group of one string needs no sorting: its windows' least key is the string's.  Nor does
    what no other string of its group can share.  Whole groups are sorted together up to ``SORT_BYTES``.
    """
    _, which, times = np.unique(groups, return_inverse=True, return_counts=True)
    others = np.flatnonzero(times[which] > 1)
    sizes = np.array([len(x) for x in strings], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    offset = np.append(0, np.cumsum(windows))
    low = np.repeat(least, windows)
    others = others[np.argsort(which[others], kind="stable")]
    first, _ = _runs(which[others])
    before = np.append(0, np.cumsum(sizes[others]))
    at = 0
    while at < len(others):
        stops = np.append(first[first > at], len(others))
        to = int(stops[max(0, int(np.searchsorted(before[stops], before[at] + SORT_BYTES, side="right")) - 1)])
        mine, at = others[at:to], to
        some = [strings[i] for i in mine.tolist()]
        begin, end = _shared_sides(some, groups[mine], length, k)
        kept = np.flatnonzero(end > begin)
        if not len(kept):
            continue
        mine, begin, end = mine[kept], begin[kept], end[kept]
        found, _ = repeated_windows([some[i][x:y] for i, x, y in zip(kept.tolist(), begin.tolist(), end.tolist(), strict=True)], least[mine], length, budget)
        n = end - begin - length + 1
        low[np.repeat(offset[mine] + begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = found
    return low, offset


class _Occurrences:
    """Keys, starts and string numbers of a shard's runs; in a file beyond ``budget`` bytes."""

    def __init__(self, budget: int):
        self.file = tempfile.SpooledTemporaryFile(max_size=budget)  # noqa: SIM115

    def add(self, key: np.ndarray, start: np.ndarray, string: np.ndarray) -> None:
        self.file.write(np.stack([key, start, string], axis=1).astype(np.int64).tobytes())

    def blocks(self, rows: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.file.seek(0)
        while raw := self.file.read(24 * rows):
            yield tuple(np.frombuffer(raw, np.int64).reshape(-1, 3).T)

    def close(self) -> None:
        self.file.close()


def _sort_shard(length: int, budget: int, buckets: int, k: int = K):
    """Rows of shards to facts: (begin, end) pairs of bytes to remove, by key."""
    gram = k

    def settle(rows: Iterable[tuple], gathered: _Gathered) -> Iterator[pa.RecordBatch]:
        names, least, groups, found = {}, np.zeros(0, np.int64), [], _Occurrences(budget)
        for _, blob in rows:
            k, s, which, dealt, strings = _unpack(blob)
            known = len(names)
            mine = np.array([names.setdefault(x, len(names)) for x in strings], np.int64)  # copies of a string are kept once
            if len(names) > len(least):
                least = np.append(least, np.full(max(len(names), 2 * len(least)) - len(least), np.iinfo(np.int64).max))
            groups.append(dealt[mine >= known])  # new strings are numbered in their order
            np.minimum.at(least, mine[which], k)
            found.add(k, s, mine[which])
        low, offset = _least_keys(list(names), least[: len(names)], np.concatenate(groups), length, budget, gram)
        del names, least
        n = np.diff(offset)
        for k, s, i in found.blocks():
            size = n[i]
            row = np.repeat(np.arange(len(k)), size)
            where = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(low[offset[i[row]] + where] < k[row])
            if not len(hit):
                continue
            new = np.flatnonzero(np.append(True, (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)))
            end = np.append(new[1:], len(hit)) - 1
            spans = np.stack([s[row[hit[new]]] + where[hit[new]], s[row[hit[end]]] + where[hit[end]] + length], axis=1).astype(np.uint32)
            yield from gathered.add(k[row[hit[new]]], spans)
        found.close()

    return _by_part(settle, buckets)


def _pack_text(b: pa.RecordBatch) -> pa.RecordBatch:
    """Key, hash and compressed text, which is smaller to move; a null text as an empty one."""
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_press((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["k", "th", "z"])


def merged(s: np.ndarray) -> np.ndarray:
    """Maximal runs from (begin, end) pairs."""
    if not len(s):
        return np.zeros((0, 2), np.int64)
    s = s.astype(np.int64)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.flatnonzero(np.append(True, s[1:, 0] > reach[:-1]))
    return np.stack([s[new, 0], reach[np.append(new[1:], len(s)) - 1]], axis=1)


def cut_out(raw: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numbered(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``key`` and ``_no``, a long in the order of the key; an integer is its own number."""
    if isinstance(docs.schema[key].dataType, _WHOLE):
        return docs.withColumn("_no", F.col(key).cast("long"))
    order = scratch.put(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().orderBy("_key").select("_key", F.monotonically_increasing_id().alias("_no")))
    return docs.join(order, F.col(key) == F.col("_key"), "left").drop("_key")


def spans(rows: DataFrame, scratch: Scratch, *, length: int = LENGTH, k: int = K, budget: int = 16 << 20, hot: int = HOT) -> tuple[DataFrame, DataFrame, int]:
    """Of rows (k: an integer key, t: text): facts of spans to remove, ``copies`` (k, th: hashes of texts that go as a whole), the number of buckets."""
    rows = rows.where("k IS NOT NULL").select("k", F.xxhash64("t").alias("th"), "t")
    total, n = rows.select(F.sum(F.octet_length("t")), F.count(F.lit(1))).first()
    total = total or 0
    shards = int(max(8, total // SHARD_BYTES + 1))
    looks = int(max(8, total // LOOK_BYTES + 1))
    tasks = int(max(8, min(20_000, shards * 3 // 4)))
    buckets = _prime(max(7, min(n // BLOCK_ROWS, max(512, n // (2 * BLOCK_ROWS)))))
    hot = max(hot, total // (16 * 100_000))  # so that at most 100,000 minimizers can be crowded
    named = scratch.put(rows.where(F.octet_length("t") >= length).select("k", "th", F.unhex(F.sha2("t", 256)).alias("h")))
    least = named.groupBy("h").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").drop("most")
    copies = scratch.put(spread_join(named, least, "h", COPIES).where("k > least").select("k", "th").distinct())
    small_batches(rows.sparkSession)
    sent = rows.select("k", "t").mapInArrow(_repeats(looks, length, k), _ROWS)
    settled = scratch.put(sent.repartition(min(20_000, looks), "part").sortWithinPartitions("part").mapInArrow(_by_row(_look_up(hot, buckets)), _FACTS))
    crowd = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.vals, np.uint64) for r in settled.where("bucket < 0").select("vals").collect()]])  # at most 100,000 codes
    packed = by_batch(rows, _pack_text, "k long, th long, z binary")
    cut = _cut(looks, shards, length, k, np.sort(crowd))
    runs = _meet(packed, settled.where("bucket >= 0"), copies, cut, "part long, runs binary", np.uint64, 1, buckets)
    found = runs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_by_row(_sort_shard(length, budget, buckets, k)), _FACTS)
    return found, copies, buckets


def _gone(raw: bytes, spans: np.ndarray, copy: bool, length: int) -> np.ndarray:
    """Maximal runs to remove from a text."""
    if copy and len(raw) >= length:
        return np.array([[0, len(raw)]], np.int64)
    return merged(spans)


def report(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, **options) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for every row; keys may be of any type that has an order.

    Null texts count as empty; texts shorter than a window lose nothing; rows that repeat a key do not remove
    each other's strings.  An empty table gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    kind = docs.schema[key].dataType.simpleString()
    rows = numbered(docs.select(F.col(key).alias("own"), F.col(text).alias("t")), "own", scratch)
    found, copies, buckets = spans(rows.select(F.col("_no").alias("k"), "t"), scratch, length=length, **options)

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *_pack_text(b.select([1, 2, 3])).columns], names=["own", "k", "th", "z"])

    packed = by_batch(rows.select("own", "_no", F.xxhash64("t").alias("th"), "t"), pack, f"own {kind}, k long, th long, z binary")

    def settle(b: pa.RecordBatch, known: _Known) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        ks = b.column("k").to_pylist()
        for k, th, t, s in zip(ks, b.column("th").to_pylist(), b.column("z").to_pylist(), known.of(ks), strict=True):
            raw = _open(t)
            runs = _gone(raw, s, (k, th) in known.copies, length)
            for c, v in zip(cols, (len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(cut_out(raw, runs)).hexdigest()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([b.column("own"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["own", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = _meet(packed, found, copies, settle, f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", np.uint32, 2, buckets)
    return out.withColumnRenamed("own", key)


def clean(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, **options) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, whatever their names) and ``kept``, the text without the repeated strings.

    Bytes that no longer form UTF-8 at a cut go too.  Nulls, repeats and keys as in ``report``.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = numbered(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("own")), "own", scratch)
    found, copies, buckets = spans(rows.select(F.col("_no").alias("k"), F.col("row")[text].alias("t")), scratch, length=length, **options)

    def settle(b: pa.RecordBatch, known: _Known) -> pa.RecordBatch:
        kept, ks = [], b.column("k").to_pylist()
        for t, k, th, s in zip(b.column("row").field(text).to_pylist(), ks, b.column("th").to_pylist(), known.of(ks), strict=True):
            copy = (k, th) in known.copies
            if t and (len(s) or copy):
                raw = t.encode()
                t = cut_out(raw, _gone(raw, s, copy, length)).decode("utf-8", "ignore")
            kept.append(t)
        return pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType())])
    return _meet(rows.select("row", F.col("_no").alias("k"), F.xxhash64(F.col("row")[text]).alias("th")), found, copies, settle, schema, np.uint32, 2, buckets)

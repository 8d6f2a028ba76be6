"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of eight segments.  If two fingerprints differ in at most t = 3 bits,
then from some segment on every chain of l consecutive segments holds at most floor(l * t / 8) differing
bits (the pigeonring principle, Qin and Xiao 2018): 0, 0, 1, 1, 1, 2, 2, 3 for t = 3.  The first five of
these budgets are an equality: two segments equal, and of the three that follow at most one unequal.  So each
distinct fingerprint is filed under 8 starts x 3 left-out segments, 32 exact bits each; within a file
the whole chain is checked, then the full Hamming distance.

Files of over ``file_limit`` fingerprints (large groups of near copies) are split by more exact bits: the bits
not yet fixed are cut into four parts, of which one at least is equal.  After three splits at most 14 bits
are free, so no file can exceed 2**14 distinct fingerprints, and no pair is lost.  From a file only a
spanning forest of its links leaves the task.  Components come from rounds of star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, spread_join
from .graph import components

SEGMENTS, WIDTH = 8, 8
FILE_LIMIT = 4096
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text's word shingles; 0 without words."""
    ws = text.encode().lower().split() if text else []  # bytes: ASCII case and ASCII white space only
    if not ws:
        return 0
    h = xxhash.xxh64_intdigest
    if len(ws) < shingle:
        return h(b" ".join(ws), 42)
    total, n = np.zeros(64, np.int64), len(ws) - shingle + 1
    for at in range(0, n, 1 << 15):
        part = ws[at : min(n, at + (1 << 15)) + shingle - 1]
        hs = np.array([h(b" ".join(t), 42) for t in zip(*[part[k:] for k in range(shingle)], strict=False)], np.uint64)
        total += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``k`` (the key), ``fp`` (a signed long) for every row; null and word-less texts have 0."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["k", "fp"])

    return by_batch(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {docs.schema[key].dataType.simpleString()}, fp long")


def first_masks() -> list[int]:
    """Bits that are exact in each of the 24 files of a fingerprint."""
    seg = lambda j: ((1 << WIDTH) - 1) << WIDTH * (j % SEGMENTS)
    return [sum(seg(i + k) for k in (0, 1, 2, 3, 4) if k != out) for i in range(SEGMENTS) for out in (2, 3, 4)]


def finer_masks(mask: int) -> list[int]:
    """Four ways to fix a quarter more of the free bits: of 4 parts, 3 differing bits leave one equal."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), 4)]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked(x: np.ndarray, y: np.ndarray, most: int = 3) -> np.ndarray:
    """Which pairs differ in at most ``most`` bits: pigeonring chains first, then the full distance."""
    diff = x ^ y
    segs = np.stack([_bits(diff >> np.uint64(WIDTH * j) & np.uint64(255)) for j in range(SEGMENTS)]).astype(np.int16)
    ring = np.concatenate([segs, segs])
    viable = np.zeros(len(diff), bool)
    for i in range(SEGMENTS):
        ok, run = np.ones(len(diff), bool), np.zeros(len(diff), np.int16)
        for chain in range(1, SEGMENTS + 1):
            run = run + ring[i + chain - 1]
            ok &= run <= chain * most // SEGMENTS
        viable |= ok
    out = np.zeros(len(diff), bool)
    out[viable] = _bits(diff[viable]) <= most
    return out


def _forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among one file's fingerprints."""
    rest, a, b = fps.copy(), [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            parent = np.full(len(rest), -1, np.int64)
            for k in range(len(front)):
                at = np.flatnonzero(parent < 0)
                hit = at[_bits(rest[at] ^ front[k]) <= most]
                hit = hit[linked(rest[hit], np.full(len(hit), front[k], np.uint64), most)]
                parent[hit] = k
            got = parent >= 0
            a.append(front[parent[got]])
            b.append(rest[got])
            front, rest = rest[got], rest[~got]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(most: int):
    """Over rows (mask, value, fp) sorted by file: links within each file."""

    def whole(mask, value, fp) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        start = np.concatenate([[0], new])
        size = np.diff(np.concatenate([start, [len(fp)]]))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        small = size <= 16
        for step in range(1, int(size[small].max(initial=1))):  # all pairs of small files, at once
            left = np.repeat(start[small], np.maximum(size[small] - step, 0))
            n = np.maximum(size[small] - step, 0)
            left = left + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            ok = linked(fp[left], fp[left + step], most)
            a.append(fp[left][ok])
            b.append(fp[left + step][ok])
        for s, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
            x, y = _forest(fp[s : s + n], most)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if kept:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            differs = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            kept = [c[cut:] for c in cols]  # the last file may go on
            if cut:
                a, b = whole(cols[0][:cut], cols[1][:cut], cols[2][:cut].view(np.uint64))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
        if kept:
            a, b = whole(kept[0], kept[1], kept[2].view(np.uint64))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def links(fps: DataFrame, scratch: Scratch, *, most: int = 3, file_limit: int = FILE_LIMIT) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that span every component."""
    masks = F.array(*[F.lit(_signed(m)) for m in first_masks()])
    filed = fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    found = None
    for level in range(4):
        sizes = filed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if level < 3:
            sized = filed.join(sizes, ["mask", "value"])
            large = scratch.put(sized.where(f"n > {file_limit}").select("mask", "value", "fp"))
            fits = sized.where(f"n <= {file_limit}")
        else:
            large, fits = None, filed.join(sizes, ["mask", "value"])
        # dealt anew by file: a broadcast or skew-split join above would leave a file in several tasks
        pairs = fits.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_links(most), "a long, b long")
        found = pairs if found is None else found.union(pairs)
        if large is None or large.isEmpty():
            break

        def split(b: pa.RecordBatch) -> pa.RecordBatch:
            mask, fp, out = b.column(0).to_numpy(), b.column(2).to_numpy(), []
            for m in np.unique(mask):
                mine = fp[mask == m]
                out += [(np.full(len(mine), _signed(f)), mine & np.int64(_signed(f)), mine) for f in finer_masks(int(m) & _ALL)]
            return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([o[i] for o in out])) for i, k in enumerate(("mask", "value", "fp"))})

        filed = scratch.put(by_batch(large, split, "mask long, value long, fp long").distinct())
    return found.distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, most: int = 3, file_limit: int = FILE_LIMIT) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (smallest key reachable over links, its own included).

    Words are split at ASCII white space and lower-cased in ASCII.  Texts of fewer words than a shingle hash
    as one; null and word-less texts have fingerprint 0 and link like any other.  Repeated rows stay; a
    null key counts as no key, so a component of only null keys has a null component_id.  An empty table gives an empty
    one; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.put(fingerprints(docs, text=text, key=key, shingle=shingle))
    distinct = scratch.put(fps.groupBy("fp").agg(F.min("k").alias("least")))
    edges = links(distinct.select("fp"), scratch, most=most, file_limit=file_limit)
    comp = components(edges, scratch)
    rooted = scratch.put(distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    # a component or a fingerprint (0, or that of a page that is copied everywhere) may hold a third of all rows
    named = spread_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return spread_join(fps, named, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its near-duplicate component.

    Rows without a key cannot be named and stay.  Of rows that repeat a kept key all stay.
    """
    kept = near_duplicates(docs, key=key, **options).where(f"`{key}` = component_id").select(key).distinct()
    return docs.join(kept, key, "left_semi").unionByName(docs.where(F.col(key).isNull()))

"""Packing by power-of-two decomposition: every document is cut into pieces whose lengths are powers of two.

A document of L tokens gives L // max_tokens pieces of max_tokens and one piece for each binary digit of the
rest, longest first.  Pieces of one length form a bucket; each is a training sequence of exactly
its bucket's length, so there is no padding and no sequence crosses documents.  The work is one narrow
pass: nothing is shuffled, a sequence's number comes from its task and place, and a task that is run
again on the same input split gives the same numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, default_path, load
from .common import by_batch

END_ID = 2


def pieces(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, path: str | None = None, *, max_tokens: int = 4096, end_id: int = END_ID, text: str = "text", key: str = "doc_id", ids: bool = False, keep: int = Bpe.KEEP) -> DataFrame:
    """One row for each piece, which is also a sequence of ``bucket`` tokens.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), bucket (the
    sequence's length, equal to the piece's), with ``ids`` also the tokens.  Null and empty texts give the end id
    alone: one piece of one token.  Repeated rows each give their own sequences; null keys pass through.
    ``keep``: most chunks whose ids a worker keeps.
    """
    if max_tokens & (max_tokens - 1) or max_tokens < 1:
        raise ValueError("max_tokens must be a power of two")
    path = path or default_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        stop = np.uint32(end_id).astype("<u4").tobytes()
        row, start, length, crc, total, kept = [], [], [], [], [], []
        for r, raw in enumerate(load(path, True, keep).encode_batch(b.column(1).to_pylist())):
            raw += stop
            n, at = len(raw) // 4, 0
            for size in pieces(n, max_tokens):
                part = raw[4 * at : 4 * (at + size)]
                row.append(r)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part))
                total.append(n)
                if ids:
                    kept.append(np.frombuffer(part, "<i4"))
                at += size
        cols = {key: b.column(0).take(pa.array(row, pa.int64()))}
        cols |= {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
        if ids:
            cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    out = by_batch(docs.select(key, text), run, schema)
    last = ["ids"] if ids else []
    return out.select(
        key, "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), *last,
    )


def write_sequences(docs: DataFrame, to: str, **options) -> None:
    """Writes the sequences, with their tokens, in one folder for each bucket (length).

    Null and empty texts are one sequence of the end token; repeated rows and null keys give sequences of their own; an empty table
    writes no sequence.
    """
    pack(docs, ids=True, **options).write.partitionBy("bucket").parquet(to)

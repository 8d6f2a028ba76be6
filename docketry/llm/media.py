"""Media columns: interleaved document sequences.

HTML is parsed into an ordered array of structs, text and media references alike, with captions beside the
references they belong to.  Payloads lie in a media table under their SHA-256; a join on the digest
resolves the references and leaves positions and captions as they are.

The document payload of ``payload_report`` is stored as an 8-bit grey PNG of 24 pixels a row, whose stored
bytes are parsed and unfiltered again before anything is computed from them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_batch, spread_join

WIDTH, BLOCK, FILL = 24, 576, 255
#: References to one payload that one task reads.
MOST_REFS = 1000
_MAGIC = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_png(samples: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey samples, whole rows, as a PNG without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """Rows of samples of such a PNG; checks its checksums."""
    if png[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at < len(png):
        n, name = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] != zlib.crc32(name + body):
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("row filters are not used here")
    return np.ascontiguousarray(raw[:, 1:])


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 filled up with 255 to a positive multiple of 576 bytes, and its own length."""
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def features(rows: np.ndarray) -> str:
    """Size, mean, spread and a 64-bit difference hash of an 8 x 9 mean thumbnail."""
    h, flat = len(rows), rows.astype(np.float64)
    thumb = np.stack([p.mean(axis=0) for p in np.array_split(flat, 8)])
    thumb = np.stack([c.mean(axis=1) for c in np.array_split(thumb, 9, axis=1)], axis=1)
    bits = np.packbits(thumb[:, 1:] > thumb[:, :-1]).tobytes().hex()
    return f"{WIDTH}x{h};mean={flat.mean():.6f};std={flat.std():.6f};dhash={bits}"


class _Reader(HTMLParser):
    """Ordered text and media of a page, by the rules of HTML where end tags are left out.

    A caption is a figcaption's text, else the alt text; it goes to the media of its own figure alone.  A figure that
    is left open ends with the page.  A figcaption left open ends with its figure, or, if that stays open too, before the
    first block in it: what follows is the page again.
    """

    MEDIA, SILENT = {"img", "audio", "video", "source", "embed", "object"}, {"script", "style", "title", "template", "noscript"}
    BREAKS = {"p", "div", "br", "hr", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "pre", "figure", "section", "article", "aside", "nav", "header", "footer", "main", "ul", "ol", "dl", "table", "blockquote", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.silent = [], [], None
        self.figures: list[dict] = []  # open figures, the innermost last

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    @property
    def caption(self) -> dict | None:
        """The open caption of the innermost figure."""
        return self.figures[-1]["caption"] if self.figures else None

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if self.silent == "title" and tag == "body":  # a title left open
                self.silent = None
            else:
                return
        if tag in self.SILENT:
            self.silent = tag
        elif tag == "figure":
            self.flush()
            self.figures.append({"media": [], "caption": None, "said": None})
        elif tag == "figcaption":
            if self.figures:
                self.flush()
                self.end_caption()
                self.figures[-1]["caption"] = {"from": len(self.items), "first": None}
            else:
                self.flush()
        elif tag in self.MEDIA:
            at = dict(attrs)
            if src := at.get("data" if tag == "object" else "src"):
                self.flush()
                digest = src.removeprefix("sha256:").lower() if src.startswith("sha256:") else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
                self.items.append({"kind": "media", "text": None, "digest": digest, "caption": at.get("alt") or None})
                if self.figures:
                    self.figures[-1]["media"].append(self.items[-1])
        elif tag in self.BREAKS:
            self.flush()
            if self.caption and self.caption["first"] is None:
                self.caption["first"] = len(self.items)

    def end_caption(self, open_to_the_end: bool = False) -> None:
        """The text items since the caption's start (or before its first block) leave the page for its figure."""
        frame = self.figures[-1]
        if (cap := frame["caption"]) is None:
            return
        self.flush()
        end = cap["first"] if open_to_the_end and cap["first"] is not None else len(self.items)
        mine = [x for x in self.items[cap["from"] : end] if x["kind"] == "text"]
        drop = set(map(id, mine))
        self.items = [x for x in self.items if id(x) not in drop]
        if mine:
            frame["said"] = " ".join(([frame["said"]] if frame["said"] else []) + [x["text"] for x in mine])
        frame["caption"] = None

    def end_figure(self, open_to_the_end: bool = False) -> None:
        self.flush()
        self.end_caption(open_to_the_end)
        frame = self.figures.pop()
        for item in frame["media"]:
            item["caption"] = frame["said"] or item["caption"]

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent:
                self.silent = None
        elif tag == "figcaption":
            if self.figures:
                self.end_caption()
        elif tag == "figure":
            if self.figures:
                self.end_figure()
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure(open_to_the_end=True)
        self.flush()
        return self.items


def parse(html: str | None) -> list[dict]:
    """Items of one page in order; a null or empty page has none.  Comments, scripts, styles and titles are no text."""
    reader = _Reader()
    reader.feed(html or "")
    return [{"position": i} | item for i, item in enumerate(reader.finish())]


def interleave(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, ``sequence``: position, kind (text or media), text, digest, caption.

    Null and empty pages have an empty sequence; repeated rows and null keys stay; an empty table gives an empty one.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(x) for x in b.column(1).to_pylist()], kind)], names=["k", "sequence"])

    sequences = by_batch(pages.select(F.col(key).alias("k"), F.col(html).alias("h")), run, f"k {pages.schema[key].dataType.simpleString()}, sequence {SEQUENCE}")
    return sequences.withColumnRenamed("k", key)


def items(pages: DataFrame, *, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row for each item of each page: key, position, kind, text, digest, caption.  Pages without items have none."""
    return interleave(pages, html=html, key=key).select(key, F.explode("sequence").alias("_i")).select(key, "_i.*")


def resolve(sequences: DataFrame, media: DataFrame, *, key: str = "page_id") -> DataFrame:
    """One row for each media reference: key, position, caption, and what ``media`` has for its digest.

    ``media`` has one row for a ``digest``; references without one keep nulls.  The references to a payload that many share
    are dealt to several tasks.
    """
    refs = sequences.select(key, F.explode("sequence").alias("_i")).where("_i.kind = 'media'").select(key, "_i.position", "_i.caption", "_i.digest")
    return spread_join(refs, media, "digest", MOST_REFS, "left")


def payload_report(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text's payload as media, refers to it from an interleaved page, and reads it back by digest.

    Returns key, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (read back), media_bytes, media_sha256,
    feature, caption.  Null texts count as empty.  Equal texts share a digest, so they get equal values; the
    store may hold a payload once for each task, of which the join reads one.
    """
    scratch = Scratch(docs.sparkSession, "media")
    kind = docs.schema[key].dataType.simpleString()

    def store(b: pa.RecordBatch) -> pa.RecordBatch:
        blobs, pages, lengths, done = [], [], [], {}
        for t in b.column(1).to_pylist():
            if t not in done:
                full, n = payload(t)
                blob = encode_png(full)
                digest = hashlib.sha256(blob).hexdigest()
                done[t] = (n, digest)
                blobs.append(blob)
            else:
                blobs.append(None)  # its payload is in the store already
            n, digest = done[t]
            lengths.append(n)
            pages.append(f'<article><p>Document of {n} bytes.</p><figure><img src="sha256:{digest}"><figcaption>Payload, {n} bytes</figcaption></figure></article>')
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.string()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())], names=["k", "html", "n_bytes", "blob"])

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature")}
        for blob in b.column(0).to_pylist():
            rows = decode_png(blob)
            full = rows.tobytes()
            for k, v in zip(cols, (hashlib.sha256(blob).hexdigest(), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(blob), features(rows)), strict=True):
                cols[k].append(v)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)})

    stored = scratch.put(by_batch(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), store, f"k {kind}, html string, n_bytes long, blob binary"))
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    media = by_batch(stored.where("blob IS NOT NULL").select("blob"), read, schema).dropDuplicates(["digest"])
    pages = stored.select(F.struct("k", "n_bytes").alias("page"), "html")
    resolved = resolve(scratch.put(interleave(pages, key="page")), scratch.put(media), key="page")
    return resolved.select(
        F.col("page.k").alias(key), "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes",
        F.col("digest").alias("media_sha256"), "feature", "caption",
    )

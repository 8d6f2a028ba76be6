"""HTML with its freedoms: optional end tags, open captions, nested figures; the payload's stored form."""

import struct
import zlib

import numpy as np
import pytest
from docketry.llm import media


def seen(html):
    return [(x["kind"], x["text"] or x["digest"][:4], x["caption"]) for x in media.parse(html)]


T = lambda t: ("text", t, None)
M = lambda d, c=None: ("media", d, c)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>x</title><body><p>hello</p>", [T("hello")]),
        ("<head><title>x<body>hello", [T("hello")]),
        ("<title>x</title><style>p{}</style><script>var t='</p>';</script><p>a<p>b<li>c", [T("a"), T("b"), T("c")]),
        ('<figure><figcaption>cap<p>hello</p><img src="sha256:aaaa">', [M("aaaa", "cap"), T("hello")][::-1]),
        ('<figure><img src="sha256:aaaa"><figcaption>cap <p>and</p> more</figure><p>tail', [M("aaaa", "cap and more"), T("tail")]),
        ('<img src="sha256:aaaa" alt="own"><figure><img src="sha256:bbbb"><figcaption>cap</figcaption></figure>', [M("aaaa", "own"), M("bbbb", "cap")]),
        ('<figure><img src="sha256:aaaa"><figure><img src="sha256:bbbb"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>', [M("aaaa", "outer"), M("bbbb", "inner")]),
        ("<p>a</figure></figcaption>b", [T("ab")]),
        ("a<!-- no -->b &amp; c<br>d<noscript>no</noscript>", [T("ab & c"), T("d")]),
        ('<object data="sha256:cccc">x</object><img alt="no source"><embed src="">', [M("cccc"), T("x")]),
        ("", []),
        (None, []),
        ("<p", [T("<p")]),
        ("x" * 100_000, [T("x" * 100_000)]),
    ],
)
def test_parse(html, want):
    assert seen(html) == want
    assert [x["position"] for x in media.parse(html)] == list(range(len(want)))


def test_items(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b"), (2, None), (None, "c"), (1, "<p>a<p>b")], "page_id long, html string")
    got = sorted(((r.page_id, r.position, r.text) for r in media.items(pages).collect()), key=str)
    assert got == sorted([(1, 0, "a"), (1, 1, "b"), (1, 0, "a"), (1, 1, "b"), (None, 0, "c")], key=str)


def test_hot_payload(spark):
    """References to one payload on most pages keep position and caption; none is lost."""
    page = '<figure><img src="sha256:hot"><figcaption>c{0}</figcaption></figure><img src="sha256:k{1}">'
    pages = spark.createDataFrame([(i, page.format(i, i % 7)) for i in range(3000)], "page_id long, html string")
    store = spark.createDataFrame([("hot", 1), ("k3", 2)], "digest string, size int")
    got = {(r.page_id, r.position): (r.digest, r.caption, r["size"]) for r in media.resolve(media.interleave(pages), store).collect()}
    want = {(i, 0): ("hot", f"c{i}", 1) for i in range(3000)} | {(i, 1): (f"k{i % 7}", None, 2 if i % 7 == 3 else None) for i in range(3000)}
    assert got == want


def plain_feature(full):
    rows = [full[i : i + 24] for i in range(0, len(full), 24)]
    flat = [x for r in rows for x in r]
    mean = sum(flat) / len(flat)
    cuts = lambda n, k: [(i * (n // k) + min(i, n % k), (i + 1) * (n // k) + min(i + 1, n % k)) for i in range(k)]
    cell = lambda a, b, c, d: np.mean([r[c:d] and sum(r[c:d]) / len(r[c:d]) for r in map(list, rows[a:b])])
    thumb = [[cell(a, b, c, d) for c, d in cuts(24, 9)] for a, b in cuts(len(rows), 8)]
    bits = "".join("1" if r[i + 1] > r[i] + 1e-9 else "0" for r in thumb for i in range(8))
    return f"24x{len(rows)};mean={mean:.6f};std={np.std(flat):.6f};dhash={int(bits, 2):016x}"


def test_stored_form_and_feature(spark):
    texts = ["", "one", "é" * 400, "The quick brown fox. " * 90, "z" * 575 + "!", None]
    out = {r.doc_id: r for r in media.payload_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        png = media.encode_png(full)
        body = zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]])
        assert b"".join(body[k + 1 : k + 25] for k in range(0, len(body), 25)) == full and media.decode_png(png).tobytes() == full
        assert (out[i].media_bytes, out[i].media_sha256) == (len(png), __import__("hashlib").sha256(png).hexdigest())
        assert out[i].feature == plain_feature(full)
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + b"x" + png[61:])

"""Text columns: tokens, cleaning, sentences, chunks.  All built-in functions, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.config import CHUNK_OVERLAP, CHUNK_SIZE, STOPWORDS


def tokenize(text: Column) -> Column:
    """Lower-case ASCII alphanumeric words; a word with any other letter or an underscore gives nothing."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9]++(?![\p{L}\p{N}_])"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens that are no stop words, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokenize(text), lambda t: ~F.array_contains(stop, t))


def normalize_space(text: Column) -> Column:
    """Every run of white space, no-break, em and en spaces included, as one space; zero-width spaces go."""
    spaced = F.translate(text, "\u00a0\u2003\u2002\u200b", "   ")
    return F.trim(F.regexp_replace(spaced, r"(?U)[\s\x1c-\x1f]+", " "))


def split_sentences(text: Column) -> Column:
    """Cuts after . ! ? that follow three closing characters, before a capital, quote or parenthesis."""
    parts = F.split(text, "(?<=[a-z)\\]\"”’]{3}[.!?])\\s+(?=[A-Z\"“(])")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: s != "")


def round_even(x: Column, places: int) -> Column:
    """Rounded to ``places``; a tie goes to the even digit."""
    return F.bround(x.cast("decimal(38, 12)"), places).cast("double")


def slices(text: Column, body: int = 60_000, tail: int = 3000, issue: int = 600) -> dict[str, Column]:
    """body, tail, issue: the first, last and first characters that features, outcomes and listings read."""
    return {"body": F.substring(text, 1, body), "tail": F.right(text, F.lit(tail)), "issue": F.substring(text, 1, issue)}


def slug(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ", "_")


def pad_punctuation(text: Column) -> Column:
    """Pilot cleaning: single spaces, dashes padded, a space after a sentence end before a capital."""
    one = F.regexp_replace(text, r"\s+", " ")
    dashed = F.regexp_replace(one, r"\s*([–—])\s*", " $1 ")
    return F.trim(F.regexp_replace(dashed, "([.!?])([A-Z])", "$1 $2"))


def squeeze_blank(text: Column) -> Column:
    """Pilot extraction: NUL and BS go, runs of spaces and tabs become one, three line ends or more two."""
    bare = F.regexp_replace(text, "[\\x00\\x08]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[ \\t]+", " "), "\n{3,}", "\n\n"))


def assemble(*sections: Column, sep: str = "\n\n") -> Column:
    """Non-empty sections in order."""
    return F.array_join(F.filter(F.array(*sections), lambda s: s.isNotNull() & (s != "")), sep)


def segments(text: Column) -> Column:
    """Pieces between . ; : and white space, or at spaced dashes; blank ones dropped."""
    return F.filter(F.split(text, r"(?<=[.;:])\s+|\s+[–—]\s+"), lambda s: F.trim(s) != "")


def paragraphs(text: Column, longer_than: int = 80, most: int = 400) -> Column:
    cut = F.transform(F.split(text, "\n+"), lambda x: F.trim(x))
    return F.slice(F.filter(cut, lambda p: F.length(p) > longer_than), 1, most)


def chunk_count(n: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    step = size - overlap
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of structs (start, tokens): windows of ``size`` that advance by ``size - overlap``; none for no tokens."""
    step = size - overlap

    def cut(t: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.greatest(chunk_count(F.size(t), size, overlap) - 1, F.lit(0))), lambda i: i * step)
        pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(t, s + 1, size).alias("tokens")))
        return F.filter(pieces, lambda _: F.size(t) > 0)

    return once(tokens, cut)


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)

"""Byte-pair encoding by backtracking over longest token matches; decoding by an offset table.

A text is normalised and cut into words as its tokenizer file says.  Over the symbols of all new words of a
batch an Aho-Corasick automaton finds the longest tokens from left to right.  Where every two neighbours of a
word are compatible (joined, they would encode to just these two), that is the exact result of the
merges; else the last token is shortened, or taken back, until the rest fits.  Each position is tried
once, so the time is linear in the word.  Compatibility is kept in a table that fills as pairs occur.

Decoding concatenates slices of one flat table of token strings.  The vocabulary has no decoder of its own,
so tokens are joined by a space, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_batch

#: White space as the vocabulary's pattern has it; Python's also holds U+001C to U+001F.
_GAPS = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD_GAP = re.compile(r"[\x1c-\x1f]")
#: Chunks for which Python's lower() and NFC are known to agree with the file's normaliser.
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_CROWDED = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])\s").search
_ONE_WORD = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([.,]?)").fullmatch
_ENDED = [chr(256 + i) for i in range(256)]
_STOPS = {c: bytes((i, 255)) for i, c in enumerate(_ENDED)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The usual printable stand-ins for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """An encoder and decoder for one tokenizer file (BPE with word ends)."""

    #: Most chunks whose ids are kept; memory stays bounded whatever the corpus holds.
    KEEP, LONGEST = 600_000, 256

    def __init__(self, path: str, guess: bool = False, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._path, self._hf, self.keep = path, None, keep
        letters = _byte_letters()
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols: dict[str, int] = {}
        for token, i in vocab.items():
            body = token.removesuffix(self.end) if token.endswith(self.end) and token != self.end else token
            s = "".join(chr(letters[c]) for c in body)
            self.symbols[s[:-1] + _ENDED[ord(s[-1])] if body != token else s] = i
        #: rank of the merge of two tokens; the two that a token was merged from
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.made_at = dict.fromkeys(vocab.values(), -1)
        self.result: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            self.made_of.setdefault(i, (vocab[a], vocab[b]))
            self.made_at[i] = r if self.made_at[i] < 0 else self.made_at[i]
        #: by token: its length, and the next shorter token that it begins with (-1: none)
        self.size_of = dict(zip(self.symbols.values(), map(len, self.symbols), strict=True))
        self.shorter = {i: next((t for k in range(len(s) - 1, 0, -1) if (t := self.symbols.get(s[:k])) is not None), -1) for s, i in self.symbols.items()}
        self.compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.symbols.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        n = max(names) + 1
        self.ends = np.zeros(n, bool)
        self.sizes = np.zeros(n, np.int64)
        self.sizes[[*self.symbols.values()]] = [*map(len, self.symbols)]
        self.ends[[i for s, i in self.symbols.items() if ord(s[-1]) > 255]] = True
        pieces = [f"{names.get(i, '')} ".encode() for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.guess = None
        if guess:
            import tiktoken

            ranks = {t.encode("latin-1") if ord(t[-1]) < 256 else t[:-1].encode("latin-1") + bytes((ord(t[-1]) - 256, 255)): i for t, i in self.symbols.items()}
            self.guess = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks | {b"\xff": n}, special_tokens={})
        self.first_known = {t: np.uint32(i).tobytes() for t, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.first_known)
        self.passing: list[str] = []

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between tokens a and b, which are then encoded as they are.

        Walks both tokens back through the merges that made them, latest first.  The two that touch at
        the border at some time merge if their rule comes before those which took them up; of equal
        rules the left one goes first.
        """
        if (known := self.compatible.get(key := a << 32 | b)) is not None:
            return known
        x, y, taken_x, taken_y, ok = a, b, 1 << 40, 1 << 40, True
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < taken_x and r <= taken_y:
                ok = False
                break
            rx, ry = self.made_at[x], self.made_at[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                taken_x, x = rx, self.made_of[x][1]
            else:
                taken_y, y = ry, self.made_of[y][0]
        self.compatible[key] = ok
        return ok

    def backtrack(self, s: str, token: int) -> list[int]:
        """The tokens of one word; ``token``: the longest one at its start."""
        n, out, pos, dead = len(s), [], 0, set()
        size, shorter, known, fits = self.size_of, self.shorter, self.compatible, self.fits
        while True:
            end = pos + size[token]
            if end not in dead and (not out or ((ok := known.get(out[-1] << 32 | token)) is None and fits(out[-1], token)) or ok):
                out.append(token)
                if end == n:
                    return out
                pos, token = end, next(self.automaton.iter_long(s, end))[1]
                continue
            while (token := shorter[token]) < 0:  # no token is left here: the one before is shortened
                dead.add(pos)
                token = out.pop()
                pos -= size[token]

    def encode_words(self, syms: list[str]) -> list[bytes]:
        """Ids of words given as symbols (the last one with the word end)."""
        if not syms:
            return []
        joined = "".join(syms)
        if self.guess is None:
            ids = np.array([i for _, i in self.automaton.iter_long(joined)], np.int64)
        else:
            one = self.guess._encode_single_piece
            ids = np.array([i for s in syms for i in one(s[:-1].encode("latin-1") + _STOPS[s[-1]])], np.int64)
        last = np.flatnonzero(self.ends[ids])  # the last token of each word
        pair = ids[:-1] << 32 | ids[1:]
        inner = np.flatnonzero(~self.ends[ids[:-1]])
        pairs = pair[inner].tolist()
        known, fits = self.compatible, self.fits
        bad = [at for at, p in zip(inner.tolist(), pairs, strict=True) if not ((ok := known.get(p)) is None and fits(p >> 32, p & 0xFFFFFFFF) or ok)]
        raw, upto = ids.astype("<u4").tobytes(), ((last + 1) * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *upto], upto, strict=False)]
        for w in dict.fromkeys(np.searchsorted(last, bad).tolist()):
            first = next(self.automaton.iter_long(syms[w]))[1]
            out[w] = array("I", self.backtrack(syms[w], first)).tobytes()
        return out

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk without white space and special tokens, normalised, as UTF-8 in Latin-1 letters."""
        if m := _ONE_WORD(chunk) or _ONE_WORD(chunk.lower()):
            return [m[1], m[2]] if m[2] else [m[1]]
        if _PLAIN.fullmatch(chunk):
            return self.pattern.findall(chunk.lower())
        chunk = unicodedata.normalize("NFC", chunk)
        if self._hf is None:
            from tokenizers import Tokenizer

            self._hf = Tokenizer.from_file(self._path)
        return self.pattern.findall(self._hf.normalizer.normalize_str(chunk))

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks into ``known``."""
        known, words, mixed = self.known, set(), {}
        for c in chunks:
            if c.isalpha() and c.isascii() and c.islower():
                words.add(c)
                continue
            if "<|" in c and self.special_re.search(c):
                ws = [w for p in self.special_re.split(c) if p for w in ([p] if p in self.special else self.split(p))]
            else:
                ws = self.split(c)
            mixed[c] = ws
            words.update(w for w in ws if w not in known)
        new = [*words]
        syms = [(w if w.isascii() else w.encode().decode("latin-1")) for w in new]
        known.update(zip(new, self.encode_words([w[:-1] + _ENDED[ord(w[-1])] for w in syms]), strict=True))
        known.update([(c, b"".join([known[w] for w in ws])) for c, ws in mixed.items()])
        self.passing += [w for w in (*new, *mixed) if len(w) > self.LONGEST]

    def chunks(self, text: str | None) -> list[str]:
        """Pieces of a text that are encoded each for itself: no merge or word crosses their borders."""
        if not text:
            return []
        if _ODD_GAP.search(text):
            return [c for c in _GAPS.split(text) if c]
        if "<|" in text or not (text.isascii() or _PLAIN.fullmatch(text)):
            return text.split()
        text = text.lower() + " "
        if not _CROWDED(text):  # every point or comma at the end of a chunk is a word of its own
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
        return text.split()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = []
        for a in range(0, len(texts), 64):
            if len(self.known) > self.keep:
                self.known = dict(self.first_known)
            if len(self.compatible) > self.keep:
                self.compatible.clear()
            cut = [self.chunks(t) for t in texts[a : a + 64]]
            got = [[*map(self.known.get, cs)] for cs in cut]
            if new := {c for cs, ids in zip(cut, got, strict=True) if None in ids for c, i in zip(cs, ids, strict=True) if i is None}:
                self.learn(list(new))
                got = [[self.known[c] if i is None else i for c, i in zip(cs, ids, strict=True)] if None in ids else ids for cs, ids in zip(cut, got, strict=True)]
            out += map(b"".join, got)
            for w in self.passing:  # a long unbroken chunk is not kept, so that the cache is bounded in bytes too
                self.known.pop(w, None)
            self.passing.clear()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by a space, in UTF-8, gathered from the flat table."""
        out = []
        for a in range(0, len(ids), 1 << 16):
            part = ids[a : a + (1 << 16)]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            stop = np.cumsum(size)
            where = np.repeat(start - stop + size, size)
            where += np.arange(stop[-1])
            out.append(self.flat[where].tobytes())
        return b"".join(out)[:-1]


_LOADED: dict[tuple[str, bool, int], Bpe] = {}


def load(path: str, guess: bool = False, keep: int = Bpe.KEEP) -> Bpe:
    """The encoder of this worker; built once, kept between tasks.

    ``guess``: a compiled merge loop proposes each new word's tokens; where the pair table does not confirm
    them, backtracking finds them.  ``keep``: most chunks whose ids are kept.
    """
    if (path, guess, keep) not in _LOADED:
        _LOADED[path, guess, keep] = Bpe(path, guess, keep)
    return _LOADED[path, guess, keep]


def encode_decode(docs: DataFrame, path: str | None = None, *, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns key, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, and with
    ``ids`` also the ids and the decoded text.  A null or empty text has no tokens.  Repeated rows
    and null keys pass through; other columns are not read.
    """
    path = path or default_path()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, h, d, all_ids, all_texts = load(path), [], [], [], [], []
        for raw in bpe.encode_batch(b.column(1).to_pylist()):
            mine = np.frombuffer(raw, "<u4")
            back = bpe.decode(mine.astype(np.int64))
            n.append(len(mine))
            h.append(hashlib.sha256(raw).hexdigest())
            d.append(hashlib.sha256(back).hexdigest())
            if ids:
                all_ids.append(mine.astype(np.int32))
                all_texts.append(back.decode())
        cols = {"k": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(h, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
        if ids:
            cols |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_texts, pa.string())}
        return pa.RecordBatch.from_pydict({key if k == "k" else k: v for k, v in cols.items()})

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""
    return by_batch(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")

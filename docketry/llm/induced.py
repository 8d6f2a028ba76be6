"""Suffix arrays and common prefixes of many short strings by external induced sorting.

Leftmost-S suffixes are ordered through the reduced string of their named substrings; all other suffixes are
induced from them in one ascending and one descending scan.  The queues that carry the induced suffixes are priority queues by first
character: within a character suffixes are induced in their order, so first in is first out.  They flow to disk when they exceed the
memory budget, and are read back in blocks.  What they carry are tuples of a position and the length of the prefix in common with
the suffix before in the queue, which is induced too: one more than the least of the common prefixes between the two
suffixes that induced them.  Each block is induced with array operations.

The reduced string is ordered by doubling instead of a further induction: strings end at separators after at
most some dozens of names, so a few rounds settle it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18


class DiskQueues:
    """First-in, first-out queues of packed tuples by character; over ``budget`` bytes the longest go to disk."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.held, self.serial = folder, budget, 0, 0
        self.mem: dict[int, list[np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.files: dict[int, list[str]] = {}
        self.spilled = 0

    def push(self, c: int, block: np.ndarray) -> None:
        self.mem.setdefault(c, []).append(block)
        self.size[c] = self.size.get(c, 0) + block.nbytes
        self.held += block.nbytes
        while self.held > self.budget:
            worst = max(self.size, key=self.size.get)
            path = os.path.join(self.folder, f"{self.serial}.q")
            self.serial += 1
            with open(path, "wb") as f:
                for b in self.mem.pop(worst):
                    f.write(b.tobytes())
            self.files.setdefault(worst, []).append(path)
            self.spilled += self.size[worst]
            self.held -= self.size.pop(worst)

    def drain(self, c: int) -> Iterator[np.ndarray]:
        """Blocks of ``c`` in order, those pushed meanwhile too."""
        while self.files.get(c) or self.mem.get(c):
            if self.files.get(c):
                path = self.files[c].pop(0)
                with open(path, "rb") as f:
                    while len(b := np.fromfile(f, np.int64, BLOCK)):
                        yield b
                os.remove(path)
            else:
                blocks = self.mem.pop(c)
                self.held -= self.size.pop(c)
                whole = np.concatenate(blocks)
                for at in range(0, len(whole), BLOCK):
                    yield whole[at : at + BLOCK]

    def backwards(self, c: int) -> Iterator[np.ndarray]:
        """Blocks of ``c`` from the last to the first, each reversed; the queue is left empty."""
        if blocks := self.mem.pop(c, None):
            self.held -= self.size.pop(c)
            for b in reversed(blocks):
                yield b[::-1]
        for path in reversed(self.files.pop(c, [])):
            end = os.path.getsize(path) // 8
            with open(path, "rb") as f:
                while end:
                    start = max(0, end - BLOCK)
                    f.seek(8 * start)
                    yield np.fromfile(f, np.int64, end - start)[::-1]
                    end = start
            os.remove(path)


def _types(t: np.ndarray) -> np.ndarray:
    """True for S: smaller than the suffix one further on.  Separators (0) and the end are S."""
    n = len(t)
    changes = np.flatnonzero(t[1:] != t[:-1])
    s = np.ones(n, bool)
    if len(changes):  # a run of one character has the type of its last
        s[: changes[-1] + 1] = np.repeat(t[changes] < t[changes + 1], np.diff(changes, prepend=-1))
    s[t == 0] = True
    return s


def _refine(rank: np.ndarray, at: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Splits groups of equal ``rank`` (the number of smaller elements) by ``key`` (below 2 ** width).

    ``at``: all elements of the groups to split.  Returns those that are still tied with another.
    """
    both = rank[at].astype(np.uint64) << np.uint64(width) | key.astype(np.uint64)
    order = np.argsort(both)
    at, both = at[order], both[order]
    new = np.append(True, both[1:] != both[:-1])
    first = np.flatnonzero(new)
    group = np.append(True, (both[1:] >> np.uint64(width)) != (both[:-1] >> np.uint64(width))) if width < 64 else np.append(True, np.zeros(len(at) - 1, bool))
    heads = np.flatnonzero(group)
    within = first - heads[np.searchsorted(heads, first, side="right") - 1]
    size = np.diff(np.append(first, len(at)))
    rank[at] += np.repeat(within, size)
    return at[np.repeat(size > 1, size)]


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each LMS position to the next, by characters and types: how many are smaller."""
    symbol = (t.astype(np.int64) << 1 | s) + 1
    size = np.append(np.diff(lms), 0) + 1
    size[t[lms] == 0] = 1  # a separator's name is itself
    rank, tied, done = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    bits = max(1, int(len(lms)).bit_length())
    while len(tied) and done < size[tied].max():
        per = 6 if not done else min(6, (64 - bits) // 10)
        word = np.zeros(len(tied), np.int64)
        for k in range(done, done + per):
            ok = k < size[tied]
            word <<= 10
            word[ok] |= symbol[lms[tied[ok]] + k]
        tied, done = _refine(rank, tied, word, 10 * per), done + per
    return rank


def _order_reduced(names: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """Positions of the reduced string in suffix order, by doubling; suffixes end at separators.

    Only names that are still tied are looked at again.
    """
    n, rank, step = len(names), names.copy(), 1
    ends = np.flatnonzero(is_end)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the separator
    many = np.bincount(rank, minlength=n)
    tied, bits = np.flatnonzero(many[rank] > 1), max(1, int(n + 1).bit_length())
    while len(tied):
        ahead = np.zeros(len(tied), np.int64)
        ok = left[tied] >= step
        if not ok.any():
            break
        ahead[ok] = rank[tied[ok] + step] + 1
        tied, step = _refine(rank, tied, ahead, bits), step * 2
    return np.argsort(rank, kind="stable")


def _range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of x[first] to x[last], both included, for each pair."""
    size = last - first + 1
    if len(x) <= 2048:
        return np.minimum.reduceat(np.append(x, x[-1]), np.stack([first, last + 1], axis=1).ravel())[::2]
    level = np.frexp(size)[1] - 1  # the greatest power of two within
    out, table = np.empty(len(first), x.dtype), x
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


class _Inducer:
    """Sends the suffixes one place ahead of scanned ones to their queues, with the prefix in common with the one sent before."""

    def __init__(self, t: np.ndarray, s: np.ndarray, queues: DiskQueues, kind: bool, cap: int):
        self.t, self.s, self.queues, self.kind, self.cap = t, s, queues, kind, cap
        self.least = np.full(257, cap, np.int64)  # by character: over what was scanned since the last one was sent
        self.sent = np.zeros(257, bool)

    def scan(self, pos: np.ndarray, common: np.ndarray) -> None:
        """``common``: the prefix of each scanned suffix in common with the one scanned before."""
        at = np.flatnonzero(pos > 0)
        before = pos[at] - 1
        mine = self.s[before] == self.kind
        if not self.kind:
            mine &= self.t[before] > 0
        at, before = at[mine], before[mine]
        if not len(at):
            np.minimum(self.least, common.min(), out=self.least)
            return
        chars = self.t[before].astype(np.int64)
        order = np.argsort(chars, kind="stable")
        c, i, moved = chars[order], at[order], before[order]
        new = np.append(True, c[1:] != c[:-1])
        low = _range_min(common, np.where(new, 0, np.append(0, i[:-1] + 1)), i)
        head = np.flatnonzero(new)
        low[head] = np.minimum(low[head], self.least[c[head]])
        value = np.minimum(low + 1, self.cap)
        value[head[~self.sent[c[head]]]] = 0
        value[c == 0] = 0  # separators have nothing in common
        stop = np.append(head[1:], len(c))
        rest = np.append(np.minimum.accumulate(common[::-1])[::-1], self.cap)
        np.minimum(self.least, rest[0], out=self.least)
        self.least[c[head]] = rest[i[stop - 1] + 1]
        self.sent[c[head]] = True
        packed = moved << 16 | value
        for x, y in zip(head.tolist(), stop.tolist(), strict=True):
            self.queues.push(int(c[x]), packed[x:y])


def _common(t: np.ndarray, left: np.ndarray, right: np.ndarray, cap: int) -> np.ndarray:
    """The prefix in common of the suffixes at ``left`` and ``right``, to their separators, at most ``cap``."""
    ends = np.flatnonzero(t == 0)
    end = np.repeat(ends.astype(np.int32), np.diff(ends, prepend=-1))  # of each position's string
    limit = np.minimum(np.minimum(end[left] - left, end[right] - right), cap)
    raw = np.append(t.astype(np.uint16), np.zeros(4, np.uint16)).tobytes()
    words = np.ndarray((len(raw) - 6) // 2, "<u8", raw, strides=(2,))  # four characters from each position on
    out, going, done = np.zeros(len(left), np.int64), np.arange(len(left)), 0
    while len(going):
        x = words[left[going] + done] ^ words[right[going] + done]
        same = np.where(x == 0, 4, np.bitwise_count((x & -x) - np.uint64(1)) >> 4)
        out[going] += same
        done += 4
        going = going[(x == 0) & (done < limit[going])]
    return np.minimum(out, limit)


def _run(t: np.ndarray, p: int, cap: int) -> int:
    """How often the character at p repeats from there, at most ``cap``."""
    part = t[p : p + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def suffix_array(t: np.ndarray, budget: int = 64 << 20, cap: int = 255) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions of ``t`` (0: separator, also at its end; else 1 to 256) in suffix order, and of the prefix that
    each suffix has in common with the one before, at most ``cap``.

    Suffixes are compared up to their separator.
    """
    if not len(t):
        return
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        s = _types(t)
        is_lms = s.copy()
        is_lms[0] = t[0] == 0
        is_lms[1:] &= ~s[:-1]
        is_lms[t == 0] = True
        lms = np.flatnonzero(is_lms)
        seeds = lms[_order_reduced(_names(t, s, lms), t[lms] == 0)]
        first = np.searchsorted(t[seeds], np.arange(258))
        seed_common = np.zeros(len(seeds), np.int64)
        pair = np.flatnonzero((t[seeds[1:]] == t[seeds[:-1]]) & (t[seeds[1:]] > 0)) + 1
        seed_common[pair] = _common(t, seeds[pair - 1], seeds[pair], cap)
        queue = lambda: DiskQueues(tempfile.mkdtemp(dir=folder), budget)
        larger, out_l = queue(), queue()
        ascending = _Inducer(t, s, larger, False, cap)
        seam = np.full(257, -1)  # by character: the last suffix induced ascending
        for c in range(257):
            for block in larger.drain(c):
                out_l.push(c, block)
                ascending.scan(block >> 16, block & 0xFFFF)
                seam[c] = block[-1] >> 16
            for at in range(first[c], first[c + 1], BLOCK):
                end = min(at + BLOCK, first[c + 1])
                common = seed_common[at:end]
                if at == first[c] and seam[c] >= 0:  # a run of c that falls meets one that rises
                    common = common.copy()
                    common[0] = min(_run(t, int(seam[c]), cap), _run(t, int(seeds[at]), cap))
                ascending.scan(seeds[at:end], common)
        del seeds, lms, seed_common
        smaller, result_s, result_l = queue(), queue(), queue()
        descending = _Inducer(t, s, smaller, True, cap)
        smaller.push(0, np.array([(len(t) - 1) << 16], np.int64))
        seams = {}
        for c in range(256, -1, -1):
            last, lowest = 0, -1  # the common prefix with the one scanned before
            for block in smaller.drain(c):
                result_s.push(c, block)
                pos, common = block >> 16, (block & 0xFFFF).copy()
                if lowest < 0:
                    common[0] = 0
                descending.scan(pos, common)
                lowest = int(pos[-1])
            if seam[c] >= 0 and lowest >= 0:
                last = seams[c] = min(_run(t, int(seam[c]), cap), _run(t, lowest, cap)) if c else 0
            for block in out_l.backwards(c):
                pos, own = block >> 16, block & 0xFFFF
                descending.scan(pos, np.append(last, own[:-1]))
                last = int(own[-1])
                result_l.push(c, block)
        for c in range(257):
            for block in result_l.backwards(c):
                yield block >> 16, block & 0xFFFF
            last = seams.get(c, 0)
            for block in result_s.backwards(c):
                own = block & 0xFFFF
                yield block >> 16, np.append(last, own[:-1])
                last = int(own[-1])

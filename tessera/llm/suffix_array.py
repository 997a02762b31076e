"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text of small numbers whose last one, 0, occurs nowhere else.

    Suffixes are S (smaller than the next suffix) or L. The leftmost S of each run are sorted as substrings by inducing
    L and then S from them in text order, named, and sorted as suffixes recursively; a last induction then gives
    all suffixes. An induction visits buckets of first characters in order and handles a bucket's suffixes as arrays;
    a suffix whose predecessor falls into the same bucket takes one more turn there.
    """
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    text = np.ascontiguousarray(text)
    is_s = _types(text)
    is_left = np.zeros(n, bool)
    is_left[1:] = is_s[1:] & ~is_s[:-1]
    left = np.flatnonzero(is_left)
    inducing = _Inducing(text, is_s)
    order = inducing.induce(left)
    by_substring = order[is_left[order]]
    names, distinct = _names(text, is_s, left, by_substring)
    if distinct < len(left):
        inner = np.array(_sorted_names(names.tolist(), distinct), np.int64)
    else:
        inner = np.empty(len(left), np.int64)
        inner[names] = np.arange(len(left))
    return inducing.induce(left[inner])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the last one is."""
    n = len(text)
    is_s = np.ones(n, bool)
    differs = text[:-1] != text[1:]
    at = np.where(differs, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal characters ends
    rising = np.zeros(n, bool)
    rising[:-1] = text[:-1] < text[1:]
    rising[n - 1] = True
    is_s[:-1] = rising[at]
    return is_s


class _Inducing:
    def __init__(self, text: np.ndarray, is_s: np.ndarray):
        self.text, self.is_s = text, is_s
        size = int(text.max()) + 1
        self.size = size
        self.n_l = np.bincount(text[~is_s], minlength=size)
        self.n_s = np.bincount(text[is_s], minlength=size)
        self.present = np.flatnonzero(self.n_l + self.n_s).tolist()

    def induce(self, left: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the order of the leftmost S suffixes induces (within a bucket, as given)."""
        text, is_s = self.text, self.is_s
        first = text[left]
        stable = left[np.argsort(first, kind="stable")]
        edges = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=self.size))]).tolist()
        # L suffixes, from the smallest bucket on
        starts = np.concatenate([[0], np.cumsum(self.n_l)])
        begin, to = starts.tolist(), starts[:-1].copy()
        large = np.empty(starts[-1], np.int64)
        for c in self.present:
            done = begin[c]
            while done < to[c]:
                here = large[done : to[c]]
                done = int(to[c])
                self._place(large, to, here, False)
            if edges[c] < edges[c + 1]:
                self._place(large, to, stable[edges[c] : edges[c + 1]], False)
        # S suffixes, from the largest bucket on, each bucket from its end
        ends = np.cumsum(self.n_s)
        begin_s, to = (ends - self.n_s).tolist(), ends.copy()
        small = np.empty(ends[-1] if len(ends) else 0, np.int64)
        n = len(text)
        for c in reversed(self.present):
            if c == 0:
                small[0] = n - 1  # the end of the text has no bucket mate
                continue
            done = int(ends[c])
            while to[c] < done:
                here = small[to[c] : done][::-1]
                done = int(to[c])
                self._place(small, to, here, True)
            self._place(small, to, large[begin[c] : begin[c + 1]][::-1], True)
        out = np.empty(n, np.int64)
        at = 0
        for c in self.present:
            for part in (large[begin[c] : begin[c + 1]], small[begin_s[c] : ends[c]]):
                out[at : at + len(part)] = part
                at += len(part)
        return out

    def _place(self, into: np.ndarray, to: np.ndarray, suffixes: np.ndarray, kind: bool) -> None:
        """Puts the predecessors of suffixes that are S (kind) or L next in their buckets: at `to`, from the end for S."""
        before = suffixes - 1
        before = before[before >= 0]
        before = before[self.is_s[before] == kind]
        if not len(before):
            return
        chars = self.text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        counts = np.bincount(chars, minlength=self.size)
        rank = np.arange(len(chars)) - (np.cumsum(counts) - counts)[chars]
        if kind:
            into[to[chars] - 1 - rank] = before
            to -= counts
        else:
            into[to[chars] + rank] = before
            to += counts


def _names(text: np.ndarray, is_s: np.ndarray, left: np.ndarray, by_substring: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of the substrings between leftmost S suffixes (both ends included), and how many differ."""
    n, m = len(text), len(left)
    number = np.empty(n, np.int64)
    number[left] = np.arange(m)
    size = np.diff(left, append=n) + 1
    size[-1] = 1
    at = number[by_substring]
    length = size[at]
    same = np.flatnonzero(length[1:] == length[:-1])
    a, b, rest = by_substring[same], by_substring[same + 1], length[same]
    equal = np.zeros(m - 1, bool)
    k = 0
    while len(same):
        over = rest <= k
        equal[same[over]] = True
        go = ~over
        same, a, b, rest = same[go], a[go], b[go], rest[go]
        alike = text[a + k] == text[b + k]
        same, a, b, rest = same[alike], a[alike], b[alike], rest[alike]
        k += 1
    named = np.concatenate([[0], np.cumsum(~equal)])
    out = np.empty(m, np.int64)
    out[at] = named
    return out, int(named[-1]) + 1 if m else 0


def _sorted_names(text: list[int], size: int) -> list[int]:
    """Suffix array of a text over many names (0 ... size-1; the last is 0 and occurs nowhere else): the same induction,
    suffix by suffix, for alphabets whose buckets are too small for arrays."""
    n = len(text)
    if n == 1:
        return [0]
    is_s = [True] * n
    for i in range(n - 2, -1, -1):
        a, b = text[i], text[i + 1]
        if a > b or a == b and not is_s[i + 1]:
            is_s[i] = False
    counts = [0] * size
    for c in text:
        counts[c] += 1
    heads, tails, total = [0] * size, [0] * size, 0
    for c, k in enumerate(counts):
        heads[c] = total
        total += k
        tails[c] = total
    left = [i for i in range(1, n) if is_s[i] and not is_s[i - 1]]

    def induce(ordered: list[int]) -> list[int]:
        out = [-1] * n
        to = tails[:]
        for i in reversed(ordered):
            c = text[i]
            to[c] -= 1
            out[to[c]] = i
        to = heads[:]
        for i in out:
            if i > 0 and not is_s[i - 1]:
                c = text[i - 1]
                out[to[c]] = i - 1
                to[c] += 1
        to = tails[:]
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0 and is_s[i - 1]:
                c = text[i - 1]
                to[c] -= 1
                out[to[c]] = i - 1
        return out

    following = dict(zip(left, left[1:]))
    names, name, last = {}, -1, None
    for i in induce(left):
        if i > 0 and is_s[i] and not is_s[i - 1]:
            here = text[i : following[i] + 1] if i in following else text[i:]
            if here != last:
                name += 1
                last = here
            names[i] = name
    inner = [names[i] for i in left]
    if name + 1 < len(left):
        order = _sorted_names(inner, name + 1)
    else:
        order = [0] * len(left)
        for k, c in enumerate(inner):
            order[c] = k
    return induce([left[k] for k in order])


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, its predecessor in the suffix array (-1 for the first) and their longest common prefix.

    Where the characters before both agree, the length is one less than the position before has (or that position's
    predecessor is the same shift); only at other positions are characters compared, eight and then one at a time.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (text[np.maximum(before[1:], 1) - 1] == text[:-1])
    start = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n, np.int64)
    live, a, b = start, start.copy(), before[start]
    while len(live):
        room = n - np.maximum(a, b)
        whole = room >= 8
        equal = np.zeros(len(live), bool)
        equal[whole] = (words[a[whole]] == words[b[whole]]).all(axis=1)
        stop = ~equal
        if stop.any():
            tail = words[np.minimum(a[stop], n)] != words[np.minimum(b[stop], n)]
            extra = np.where(tail.any(axis=1), tail.argmax(axis=1), 8)
            length[live[stop]] = a[stop] - live[stop] + np.minimum(extra, room[stop])
        live, a, b = live[equal], a[equal] + 8, b[equal] + 8
    anchor = np.where(reducible, 0, at + length)
    reach = np.maximum.accumulate(anchor)
    length = np.where(before >= 0, np.maximum(reach - at, 0), 0)
    return before, length

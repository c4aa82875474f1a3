"""Suffix arrays by induced sorting, with the induction done bucket by bucket on whole arrays.

A suffix is of type S if it is smaller than the one after it, else L; an S suffix after an L one
is a leftmost S (LMS). Sorted LMS suffixes fix the order of all L suffixes in one pass over the
buckets from the left, and these that of all S suffixes in one pass from the right. LMS
substrings are sorted by the same two passes; where some are equal, their ranks form a shorter
text whose suffixes are sorted by recursion, or by doubling where it has very many symbols.
"""

from __future__ import annotations

import numpy as np

from replyloom.llm.common import carry_along

carry_along(__name__)

# A pass costs something for each symbol; a shorter text with more of them is ranked by doubling.
MAX_SYMBOLS = 2048


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last one is S by convention of an end symbol."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32)).astype(np.int8)
    # Runs of equal symbols take the type of what follows them.
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    out = np.zeros(n, bool)
    some = following < n
    out[:-1][some] = step[following[some]] > 0
    return out


def _put(sa: np.ndarray, s: np.ndarray, ends: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append ``items`` in order to their buckets, whose ends move by ``step``."""
    c = s[items]
    order = np.argsort(c, kind="stable")
    c, items = c[order], items[order]
    new = np.empty(len(c), bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(c)))
    rank = np.arange(len(c)) - np.repeat(first, size)
    sa[np.repeat(ends[c[first]], size) + step * rank] = items
    ends[c[first]] += step * size


def _induce(s: np.ndarray, is_s: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS ones in order."""
    n, symbols = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int32)
    heads = starts[:-1].copy()
    lms_count = np.bincount(s[lms], minlength=symbols)
    lms_first = np.concatenate([[0], np.cumsum(lms_count)])
    present = np.flatnonzero(np.diff(starts))
    # From the left: L suffixes go to the heads of their buckets. The end symbol comes first.
    if not is_s[n - 1]:
        _put(sa, s, heads, np.array([n - 1]), 1)
    for c in present:
        at = starts[c]
        while at < heads[c]:
            upto = heads[c]
            before = sa[at:upto] - 1
            at = upto
            before = before[before >= 0]
            before = before[~is_s[before]]
            if len(before):
                _put(sa, s, heads, before, 1)
        before = lms[lms_first[c] : lms_first[c + 1]] - 1
        before = before[before >= 0]
        if len(before):
            _put(sa, s, heads, before, 1)
    # From the right: S suffixes go to the tails of their buckets.
    tails = starts[1:] - 1
    for c in present[::-1]:
        at = starts[c + 1] - 1
        while at > tails[c]:
            downto = tails[c]
            before = sa[downto + 1 : at + 1][::-1] - 1
            at = downto
            before = before[before >= 0]
            before = before[is_s[before]]
            if len(before):
                _put(sa, s, tails, before, -1)
        before = sa[starts[c] : heads[c]][::-1] - 1
        before = before[before >= 0]
        before = before[is_s[before]]
        if len(before):
            _put(sa, s, tails, before, -1)
    return sa


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes by ranks of 1, 2, 4, ... symbols, for texts with very many symbols."""
    n, width = len(s), 1
    rank = s.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Order of the suffixes of ``s``, whose values are below ``symbols``; a prefix comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = _types(s)
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))]).astype(np.int64)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) < 2:
        return _induce(s, is_s, starts, lms)
    first = lms[np.argsort(s[lms], kind="stable")]
    sa = _induce(s, is_s, starts, first)
    ordered = sa[is_lms[sa]]
    # Rank the LMS substrings: equal ones share a rank.
    end = np.full(n, n - 1, np.int64)
    end[lms[:-1]] = lms[1:]
    length = end[ordered] - ordered + 1
    same = length[1:] == length[:-1]
    # Only the last one meets the end of the text, so it equals none.
    last = lms[-1]
    same &= (ordered[1:] != last) & (ordered[:-1] != last)
    live = np.flatnonzero(same)
    offset = 0
    while len(live):
        a, b = ordered[live] + offset, ordered[live + 1] + offset
        equal = s[a] == s[b]
        same[live[~equal]] = False
        offset += 1
        live = live[equal]
        live = live[offset < length[live]]
    rank = np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)
    kinds = int(rank[-1]) + 1
    if kinds < len(lms):
        names = np.zeros(n, np.int32)
        names[ordered] = rank
        text = names[lms]
        order = suffix_array(text, kinds) if kinds <= MAX_SYMBOLS else _by_doubling(text)
        ordered = lms[order]
    return _induce(s, is_s, starts, ordered)


def common_prefixes(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Per place in ``sa`` the symbols that the suffix shares with the one before it, up to ``limit``.

    They are computed in text order. Where the symbols before a suffix and before its neighbour
    are equal, the value is that of the previous place less one; only the others are compared.
    """
    n = len(s)
    neighbour = np.full(n, -1, np.int64)
    neighbour[sa[1:]] = sa[:-1]
    place = np.arange(n)
    follows = (place > 0) & (neighbour > 0)
    follows[follows] = s[place[follows] - 1] == s[neighbour[follows] - 1]
    todo = np.flatnonzero(~follows & (neighbour >= 0))
    out = np.zeros(n, np.int64)
    offset, cap = 0, 4 * limit
    live = todo
    while len(live) and offset < cap:
        a, b = live + offset, neighbour[live] + offset
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        live = live[s[a] == s[b]]
        out[live] += 1
        offset += 1
    # A value that met the cap stands for any larger one.
    start = np.maximum.accumulate(np.where(~follows, place, 0))
    inherited = out[start] - (place - start)
    capped = out[start] >= cap
    again = np.flatnonzero(follows & capped & (inherited < limit))
    result = np.where(follows, np.maximum(inherited, 0), out)
    if len(again):  # far behind a capped value: compare afresh
        result[again] = 0
        live = again
        for offset in range(limit):
            a, b = live + offset, neighbour[live] + offset
            ok = (a < n) & (b < n)
            live, a, b = live[ok], a[ok], b[ok]
            live = live[s[a] == s[b]]
            result[live] += 1
    return np.minimum(result, limit)[sa]

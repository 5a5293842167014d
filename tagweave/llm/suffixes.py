"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one; the
substrings between leftmost S suffixes are sorted and named; where names
repeat, their order is found by recursion; and all suffixes are induced from
it in two scans. This holds at every size and for every alphabet.

The scans go by stretches: what a stretch of the array induces is grouped by
character, in order, and appended to its buckets at once. A stretch is one
bucket, or several small ones, gone through again until they induce nothing
more into each other; so a few large buckets and many small ones alike take
few steps.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that a stretch of several buckets holds at most, and how often it is gone through before it is halved.
STRETCH, ROUNDS = 1 << 14, 8


def append_groups(sa: np.ndarray, at: np.ndarray, ch: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """Appends suffixes j, in order, to the buckets of their characters ch, which go on at at[character]. Gives their places."""
    order = np.argsort(ch, kind="stable")
    ch, j = ch[order], j[order]
    edges = np.flatnonzero(np.append(True, ch[1:] != ch[:-1]))
    counts = np.diff(np.append(edges, len(ch)))
    rank = np.arange(len(ch)) - np.repeat(edges, counts)
    to = at[ch] + rank if forward else at[ch] - 1 - rank
    sa[to] = j
    at[ch[edges]] += counts if forward else -counts
    return to


def runs_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether the next character is the same, where each place's run begins, which characters have runs)."""
    in_run = np.append(text[1:] == text[:-1], False)
    start = np.arange(len(text), dtype=np.int32)
    start[1:][in_run[:-1]] = 0
    return in_run, np.maximum.accumulate(start), np.unique(text[in_run])


def scan(sa: np.ndarray, text: np.ndarray, s_type: np.ndarray, runs: tuple, starts: np.ndarray, ends: np.ndarray, fill: np.ndarray, forward: bool) -> None:
    """Induces the L suffixes (forward) or the S ones (backward) from what stands in sa; fill: where their buckets go on.

    Suffixes of the type lie in [starts, fill) of a bucket, or [fill, ends); places without one hold -1.
    """
    used = np.flatnonzero(ends > starts)[:: 1 if forward else -1]
    far = np.cumsum(ends[used] - starts[used])
    # Suffixes of a run of one character follow from its last one's place. Numbers of buckets count in the order of the scan.
    in_run, run_start, of_runs = runs
    with_runs = np.append(np.flatnonzero(np.isin(used, of_runs, assume_unique=True)), len(used))

    def induced(a: int, b: int) -> np.ndarray:
        stretch = sa[a:b] if forward else sa[a:b][::-1]
        j = stretch[stretch > 0] - 1
        return j[(s_type[j] != forward) & ~in_run[j]]

    def unroll(c: int) -> None:
        """Puts the other suffixes of runs behind the last ones, all that are one character longer after all that are shorter."""
        last = sa[starts[c] : fill[c]] if forward else sa[fill[c] : ends[c]][::-1]
        times = last - run_start[last] + 1
        which = np.repeat(np.arange(len(last)), times)
        more = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        order = np.argsort(more, kind="stable")
        whole = (last[which] - more)[order]
        fill[c] = starts[c] + len(whole) if forward else ends[c] - len(whole)
        if forward:
            sa[starts[c] : fill[c]] = whole
        else:
            sa[fill[c] : ends[c]] = whole[::-1]

    def several(i: int, k: int) -> bool:
        """Buckets i to k at once: what they induce into each other is put there until nothing is new."""
        a, b = (starts[used[i]], ends[used[k - 1]]) if forward else (starts[used[k - 1]], ends[used[i]])
        before, known, to = None, None, None
        for _ in range(ROUNDS):
            j = induced(a, b)
            ch = text[j]
            inside = ch <= used[k - 1] if forward else ch >= used[k - 1]
            own = j[inside]
            if not len(own) or (known is not None and len(own) == len(known) and (own == known).all()):
                if len(own) < len(j):
                    append_groups(sa, fill, ch[~inside], j[~inside], forward)
                return True
            if before is None:
                before = fill[used[i:k]]
            else:
                fill[used[i:k]] = before
            known, to = own, append_groups(sa, fill, ch[inside], own, forward)
        sa[to] = -1
        fill[used[i:k]] = before
        return False

    i, size = 0, STRETCH
    while i < len(used):
        k = int(np.searchsorted(far, (far[i - 1] if i else 0) + size, side="right"))
        k = min(k, int(with_runs[np.searchsorted(with_runs, i)]))
        if k > i + 1:
            if several(i, k):
                i, size = k, min(2 * size, STRETCH)
            else:
                size //= 2
            continue
        c = used[i]
        if i == with_runs[np.searchsorted(with_runs, i)]:
            unroll(c)
        if len(j := induced(starts[c], ends[c])):
            append_groups(sa, fill, text[j], j, forward)
        i, size = i + 1, min(2 * size, STRETCH)


def induce(text: np.ndarray, s_type: np.ndarray, runs: tuple, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes sorted as far as the order of the leftmost smaller ones, lms, tells."""
    sa = np.full(len(text), -1, np.int32)
    ch = text[lms]
    order = np.argsort(ch, kind="stable")
    counts = np.bincount(ch, minlength=len(starts))
    slots = (ends - counts - (np.cumsum(counts) - counts))[ch[order]] + np.arange(len(lms))
    sa[slots] = lms[order]
    scan(sa, text, s_type, runs, starts, ends, starts.copy(), True)
    # The S suffixes are induced anew, all of them; the end mark stays, and what it follows is none.
    sa[slots] = -1
    sa[0] = len(text) - 1
    tails = ends.copy()
    tails[text[-1]] = 0
    scan(sa, text, s_type, runs, starts, ends, tails, False)
    return sa


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each character on, as a number whose lowest bits are the first."""
    return np.ndarray((len(text) + 1,), "<u8", np.concatenate([text, np.zeros(8, text.dtype)]), strides=(text.itemsize,))


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """text: numbers below alphabet that end with the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    text = np.ascontiguousarray(text, np.uint8 if alphabet <= 1 << 8 else np.uint16 if alphabet <= 1 << 16 else np.uint32)
    # S: smaller than the next suffix. Equal neighbours take the type of what follows.
    differs = np.append(text[:-1] != text[1:], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
    s_type = np.append(text[:-1] < text[1:], True)[nxt]
    del nxt
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]).astype(np.int32) + 1
    counts = np.bincount(text, minlength=alphabet)
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = runs_of(text)
    sa = induce(text, s_type, runs, starts, ends, lms)
    # Name the leftmost-smaller substrings in their order.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_rank = sa[is_lms[sa]]
    length = np.zeros(n, np.int32)
    length[lms] = np.append(np.diff(lms), 0) + 1
    same = np.append(False, length[by_rank[1:]] == length[by_rank[:-1]])
    left = np.flatnonzero(same)
    words, step, wide = eight_bytes(text), 0, 8 // text.itemsize
    while len(left):
        rest = length[by_rank[left]] - step
        unused = (np.maximum(wide - rest, 0) * 8 * text.itemsize).astype(np.uint64)
        equal = ((words[by_rank[left] + step] ^ words[by_rank[left - 1] + step]) << unused) == 0
        same[left[~equal]] = False
        left = left[equal & (rest > wide)]
        step += wide
    name = np.zeros(n, np.int32)
    name[by_rank] = np.cumsum(~same) - 1
    names = int((~same).sum())
    if names == len(lms):
        lms = by_rank
    else:
        reduced = name[lms]
        del sa, by_rank, length, name
        lms = lms[suffix_array(reduced, names)]
    return induce(text, s_type, runs, starts, ends, lms)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the characters shared with the suffix sorted before it; text ends with the only 0.

    If the characters before two neighbours are equal, the position's prefix
    is one shorter than the one before it. The others are compared, eight
    characters at a time.
    """
    n = len(text)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    here = np.arange(1, n, dtype=np.int32)
    reducible = np.append(False, (phi[1:] > 0) & (text[here - 1] == text[np.maximum(phi[1:], 1) - 1]) & (phi[:-1] >= 0))
    plcp = np.zeros(n, np.int32)
    left = np.flatnonzero(~reducible & (phi >= 0)).astype(np.int32)
    words, size, step = eight_bytes(text), text.itemsize, 0
    while len(left):
        x = words[np.minimum(left + step, n)] ^ words[np.minimum(phi[left] + step, n)]
        plcp[left] = step + (np.bitwise_count((x & -x) - np.uint64(1)) // (8 * size)).astype(np.int32)
        left = left[x == 0]
        step += 8 // size
    # A reducible position follows the last other one.
    last = np.maximum.accumulate(np.where(reducible, 0, np.arange(n, dtype=np.int32)))
    return np.maximum(plcp[last] - (np.arange(n, dtype=np.int32) - last), 0)

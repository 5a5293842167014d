"""Substring dedup by compact windows: near-duplicate passages across documents.

A text is a row of 5-word shingles. Under each of HASHES hash functions, all
subsequences with the same smallest shingle form a compact window (l, c, r):
those that begin in [l, c] and end in [c, r], the range of the shingle's
subtree in the Cartesian tree over the hashes. Windows that hold no passage of
LEAST_WORDS words are left out, which leaves about two windows for so many
words.

1. Two passes over blocks of documents find the minima that several blocks
   hold (see blocks). A block links its windows of a minimum among each other
   and sends them to the minimum's shard, which does so across the corpus. Up to
   FEW windows are all paired. Of more, those that agree in their clip (all
   shingles that a passage of LEAST may hold beside the minimum) are a class: its
   members share a passage, are linked to its first, and only that one is sent.
   Each class's windows of a text, joined to a stretch where they lie close, are
   linked to the first text of the minimum, its hub; no clip goes to a shard.
   Pieces of PIECE shingles, chosen by hash out of every APART in a row, are linked
   alike. Any LEAST equal shingles hold a chosen piece, and texts that share one
   share a passage where both go on at the same end: so classes are those with
   equal room at either end, linked to one with room at both, or all paired.
2. A document's linked windows are joined: stretches must be covered by windows
   of enough hash functions. Each document that a stretch is linked to by some
   of them, at about one distance between the two texts, is a candidate, as is each that
   it shares a piece with.
   What is linked to a hub is sent to it in any case.
3. Each candidate goes, with the shingles around its windows, to the block of the
   other document, where the passages are found and verified: at least
   LEAST_WORDS words and a Jaccard similarity of SIMILARITY. Members of a hub's
   group that share no passage with it at their minimum are compared there by
   their clips, each with all that no chain of like passages joins to it yet:
   whatever clips share a passage hang together, however many they are.

Texts that a block holds twice are compared once; the copies are linked to
the first of them.

Defined results: null texts and texts of under LEAST_WORDS words give no
passages; texts of any length are taken whole; rows with equal ids are one
document here and aren't compared with each other; rows without an id are
documents of their own, whose id in the result is null; repeated rows of one
id give what one of them does; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import hold_memory, modest_batches, partitions

SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, how many of them must cover a stretch, and how many link it to a candidate.
HASHES, ENOUGH, EACH = 8, 4, 2
#: Words by which the distance between two texts may change within a candidate, and shingles that a stretch may miss in a row.
SLACK, GAP = 40, 12
#: Bytes of the corpus for each shard.
SHARD_BYTES = 4_000_000
LEAST = LEAST_WORDS - SHINGLE + 1
#: Shingles that a stretch may reach beyond its windows.
ASIDE = LEAST // 2
#: Equal shingles in a row that are enough for a passage if the texts go on, and how many such pieces LEAST equal ones hold.
PIECE = -int(-2 * LEAST * SIMILARITY // (1 + SIMILARITY))
APART = LEAST - PIECE + 1
#: Bits of a place beside a hash; more than LEAST shingles must have different ones.
PLACE_BITS = 24
LOW = np.uint64((1 << PLACE_BITS) - 1)
#: Shingles whose hashes are computed at once.
STEP = 1 << 14
#: Bytes of texts whose words are told apart at once.
AT_ONCE = 1 << 17
IS_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32)).astype(np.int8)
LOWER = np.arange(256, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 33, 1).astype(np.uint64)
#: Windows of a minimum that are all paired.
FEW = 12
#: In place of a hash function: links that need no other (by clips and pieces), and those of a large group to its hub.
SURE, HUB = HASHES, HASHES + 1
WINDOW = np.dtype([("v", "<u8"), ("doc", "<i8"), ("block", "<i8"), ("row", "<i4"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4"), ("k", "<i4"), ("back", "<u4"), ("ahead", "<u4"), ("n", "u1")])
LINK = np.dtype([("block", "<i8"), ("row", "<i4"), ("k", "<i4"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4"), ("to_doc", "<i8"), ("to_block", "<i8"), ("to_row", "<i4"), ("to_c", "<i4"), ("e", "<i4"), ("to_e", "<i4")])
WINDOWS, LINKS = "shard long, block long, windows binary, links binary", "block long, links binary"
CANDIDATES = "block long, to_row long, to_at long, to_end long, doc_id long, text long, at long, shingles binary, members binary"
RESULT = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, similarity double"


class Shingled:
    """A block's texts as hashes of word shingles; of equal texts only the first."""

    def __init__(self, f: pd.DataFrame, only: set[int] | None = None):
        """only: the rows to compute besides those that have copies, if not all."""
        hold_memory()
        self.block = B.Block(f)
        first: dict[bytes, int] = {}
        self.copies = [(d, k) for d, t in enumerate(self.block.texts) if (k := first.setdefault(t, d)) != d]
        copied, needed = {d for d, _ in self.copies}, None if only is None else only | {k for _, k in self.copies}
        rows = [d for d in range(len(self.block.texts)) if d not in copied and (needed is None or d in needed)]
        data = np.frombuffer(b"".join(self.block.texts[d] + b" " for d in rows), "u1")
        text_ends = np.cumsum([len(self.block.texts[d]) + 1 for d in rows], dtype=np.int64)
        # Some texts at a time, so that what is computed for them stays in the processor's cache.
        cuts = np.append(0, text_ends[np.searchsorted(text_ends, np.arange(AT_ONCE, len(data) + AT_ONCE, AT_ONCE).clip(max=len(data)))]) if len(rows) else np.zeros(1, np.int64)
        counts, shingles = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            edge = np.flatnonzero(np.diff(IS_SPACE[data[a:b]], prepend=1, append=1))
            start, end = edge[::2], edge[1::2]
            # Prefix sums of byte * B^i, taken back by B^-i, give each word's hash.
            power, back = (powers(p, b - a + 1) for p in POWERS)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(LOWER[data[a:b]] * power[:-1], out=sums[1:])
            word = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
            # Shingles, document after document.
            words = np.diff(np.searchsorted(start, text_ends[slice(*np.searchsorted(text_ends, (a, b), side="right"))] - a), prepend=0)
            x = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
            for i in range(SHINGLE):
                x *= np.uint64(0x9E3779B97F4A7C15)
                x += word[i : i + len(x)]
            n = np.maximum(words - SHINGLE + 1, 0)
            counts.append(n)
            shingles.append(mix(x)[np.arange(n.sum()) + np.repeat(np.cumsum(words) - words - np.cumsum(n) + n, n)])
        n = np.concatenate(counts)
        #: Row of each compared text, where its shingles start, and all shingles.
        self.rows = np.array(rows, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.x = np.concatenate(shingles)
        self.text = np.repeat(np.arange(len(rows)), n)
        self.at = {int(d): i for i, d in enumerate(rows)}
        self.kept: dict[int, tuple] = {}
        self.places: tuple | None = None
        self.sums: np.ndarray | None = None

    def shingles(self, row: int) -> np.ndarray:
        i = self.at[row]
        return self.x[self.starts[i] : self.starts[i + 1]]

    def spots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the text as their PLACE_BITS lower bits, ends of texts by place, places that LEAST shingles follow, with them)."""
        if self.places is None:
            n = np.diff(self.starts)
            place = (np.arange(len(self.x)) - np.repeat(self.starts[:-1], n)).astype(np.uint64) & LOW
            ends = np.repeat(self.starts[1:], n)
            n = max(0, len(place) - LEAST + 1)
            self.places = place, ends, np.flatnonzero(np.arange(n) + LEAST <= ends[:n])
        return self.places

    def minima(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of every shingle, its place in the text as the PLACE_BITS lower bits, over again in longer texts; places that are the smallest of some LEAST in a row; ends of texts by place)."""
        if k in self.kept:
            return self.kept[k]
        place, ends, whole = self.spots()
        keys = np.empty(len(self.x), np.uint64)
        if len(keys) < LEAST:
            whole = whole[:0]
        # Step by step, so that what is computed for a step stays in the processor's cache.
        for a in range(0, len(keys), STEP):
            part = mix(self.x[a : a + STEP] + np.uint64((k + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            part &= ~LOW
            part |= place[a : a + STEP]
            keys[a : a + STEP] = part
        far = np.empty(max(0, len(keys) - LEAST + 1), np.int64)
        for a in range(0, len(far), STEP):
            n = min(STEP, len(far) - a)
            least = runs(np.minimum, keys[a : a + n + LEAST - 1], LEAST)
            least -= place[a : a + n]
            least &= LOW
            far[a : a + n] = least
        # Places come in order, each in one run.
        at = whole + far[whole]
        self.kept[k] = keys, at[np.append(True, at[1:] != at[:-1])[: len(at)]], ends
        return self.kept[k]

    def values(self, k: int, at: np.ndarray) -> np.ndarray:
        return mix(self.x[at] ^ np.uint64((k + 1) * 0xA0761D6478BD642F % (1 << 64)))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of chosen pieces: the smallest of some APART in a row, of each hash a text's first."""
        if HASHES in self.kept:
            return self.kept[HASHES]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.x) < LEAST:
            return none
        value = np.empty(len(self.x) - PIECE + 1, np.uint64)
        chosen = np.zeros(len(value), bool)
        # Step by step, as in minima.
        for a in range(0, len(value), STEP):
            # Of 2^n shingles, by doubling; a piece is put together from the bits of its length.
            power, size, part, done = self.x[a : a + STEP + PIECE - 1], 1, None, 0
            while size <= PIECE:
                if PIECE & size:
                    part = power if part is None else part[: len(power) - done] * np.uint64(0x9E3779B97F4A7C15) + power[done:]
                    done += size
                if 2 * size <= PIECE:
                    power = power[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + power[size:]
                size *= 2
            value[a : a + STEP] = mix(part)
        # A piece is the smallest of some APART if the greatest of their smallest ones, as far as they stand in one text, is its own.
        n, (_, ends, _) = len(value) - APART + 1, self.spots()
        for a in range(0, len(value), STEP):
            lo, hi = max(0, a - APART + 1), min(n, a + STEP)
            least = np.zeros(min(a + STEP, len(value)) - a + APART - 1, np.uint64)
            if lo < hi:
                least[lo - a + APART - 1 :][: hi - lo] = np.where(np.arange(lo, hi) + LEAST <= ends[lo:hi], runs(np.minimum, value[lo : hi + APART - 1], APART), 0)
            chosen[a : a + STEP] = runs(np.maximum, least, APART) == value[a : a + STEP]
        place = np.flatnonzero(chosen)
        value = value[place]
        order = np.argsort(value, kind="stable")
        v, text = value[order], self.text[place[order]]
        order = np.sort(order[np.append(True, (v[1:] != v[:-1]) | (text[1:] != text[:-1]))[: len(v)]])
        self.kept[HASHES] = value[order], place[order]
        return self.kept[HASHES]

    def hashes(self) -> np.ndarray:
        return np.concatenate([self.pieces()[0], *(self.values(k, self.minima(k)[1]) for k in range(HASHES))])

    def told(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A hash of the shingles [lo, hi) and of where at stands among them."""
        if self.sums is None:
            power, _ = (powers(b, len(self.x) + 1) for b in POWERS)
            self.sums = np.zeros(len(self.x) + 1, np.uint64)
            np.cumsum(self.x * power[:-1], out=self.sums[1:])
        _, back = (powers(b, len(self.x) + 1) for b in POWERS)
        return mix(mix((self.sums[hi] - self.sums[lo]) * back[lo]) + ((at - lo) * 2 * LEAST + hi - lo).astype(np.uint64))

    def windows(self, key: int, shared: np.ndarray) -> np.ndarray:
        """Compact windows of shared minima, by minimum, then place."""
        out = [np.zeros(0, WINDOW)]
        ids = np.array(self.block.order_ids, np.int64)
        for k in range(HASHES):
            keys, every, ends = self.minima(k)
            v = self.values(k, every)
            chosen = np.flatnonzero(B.is_in(v, shared))
            at, v = every[chosen], v[chosen]
            if not len(at):
                continue
            base = self.starts[self.text[at]]
            left, right = among_minima(keys, every, chosen, base, ends[at])
            w = np.zeros(len(at), WINDOW)
            w["v"], w["row"], w["k"], w["block"] = v, self.rows[self.text[at]], k, key
            w["doc"] = ids[w["row"]]
            w["l"], w["c"], w["r"] = left - base, at - base, right - base
            lo, hi = np.maximum(at - LEAST + 1, base), np.minimum(at + LEAST, ends[at])
            w["n"] = hi - lo
            told = self.told(at, lo, hi)
            w["ahead"], w["back"] = told >> np.uint64(32), told & np.uint64(0xFFFFFFFF)
            out.append(w)
        v, at = self.pieces()
        chosen = B.is_in(v, shared)
        at, v = at[chosen], v[chosen]
        w = np.zeros(len(at), WINDOW)
        base = self.starts[self.text[at]]
        w["v"], w["row"], w["k"], w["block"] = v, self.rows[self.text[at]], HASHES, key
        w["doc"] = ids[w["row"]] if len(w) else 0
        w["l"] = w["c"] = at - base
        w["r"] = w["c"] + PIECE - 1
        # Those come first that go on far enough at either end to make a passage with any other; others by the room at each end.
        room = LEAST - PIECE
        before, behind = np.minimum(at - base, room), np.minimum(self.starts[self.text[at] + 1] - at - PIECE, room)
        w["back"] = np.where((before == room) & (behind == room), 0, 1 + before * (room + 1) + behind)
        out.append(w)
        w = np.concatenate(out)
        # Each part stands in the order of places already, which sorting keeps.
        return w[np.lexsort((later(w), w["v"]))]


def planes(w: np.ndarray) -> bytes:
    """Rows' first bytes, then their second ones, and so on, compressed: like bytes stand side by side. Their number goes before."""
    data = w.view("u1").reshape(len(w), w.dtype.itemsize).T.tobytes()
    return len(w).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def rows_of(blobs, dtype: np.dtype) -> np.ndarray:
    parts = [np.zeros(0, dtype)]
    for x in blobs:
        if len(x):
            n = int.from_bytes(x[:8], "little")
            data = pa.decompress(x[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
            parts.append(np.ascontiguousarray(np.frombuffer(data, "u1").reshape(dtype.itemsize, n).T).view(dtype).ravel())
    return np.concatenate(parts)


def later(w: np.ndarray) -> np.ndarray:
    """1 for pieces at a text's edge."""
    return np.where(w["k"] == HASHES, w["back"], 0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


POWERS = {b: np.ones(1, np.uint64) for b in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64))}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base of POWERS; a worker keeps those that a block takes, not those of very long ones."""
    if len(POWERS[base]) >= n:
        return POWERS[base][:n]
    power = np.full(n, base, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    if n <= 2 * B.BLOCK_BYTES:
        POWERS[base] = power
    return power


def subtree(keys: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of places' subtrees in the Cartesian tree of keys: up to the next smaller one to either side, within [first, end)."""
    tables = [keys]
    while 2 << (len(tables) - 1) <= int((end - first).max()):
        t, size = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.minimum(t[:-size], t[size:]))
    left, right, own = at.copy(), at.copy(), keys[at]
    for level in range(len(tables) - 1, -1, -1):
        size, t = 1 << level, tables[level]
        to = left - size
        left = np.where((to >= first) & (t[np.maximum(to, 0)] > own), to, left)
        to = right + 1
        right = np.where((to + size <= end) & (t[np.minimum(to, len(t) - 1)] > own), right + size, right)
    return left, right


def among_minima(keys: np.ndarray, every: np.ndarray, chosen: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As subtree, of the places every[chosen], where every holds the smallest of each LEAST in a row.

    The next smaller key beside one of these is the smallest of the LEAST that end, or begin, with it: no other place is looked at.
    """
    a, b = np.searchsorted(every, first), np.searchsorted(every, end)
    left, right = subtree(keys[every], chosen, a, b)
    return np.where(left > a, every[left - 1] + 1, first), np.where(right + 1 < b, every[np.minimum(right + 1, len(every) - 1)], end) - 1


def runs(least, x: np.ndarray, n: int) -> np.ndarray:
    """The least (or greatest) of each n values in a row, by doubling."""
    m, size = len(x) - n + 1, 1
    while 2 * size <= n:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[:m], x[n - size :][:m])


def to_first(w: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which windows stand for all: all of FEW of a minimum or piece, of more those of each class; links).

    w is sorted by minimum, then place. Links to a hub are made where whole says that all of a minimum's windows are there;
    they also tell of its own document's other windows. Else links within a document are left out.
    """
    apart = lambda a, b: (w["doc"][a] != w["doc"][b]) | ((w["doc"][a] == B.NO_ID) & ((w["block"][a] != w["block"][b]) | (w["row"][a] != w["row"][b])))
    pairs, sure, hubs_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
    put = lambda to, a, b: to.append((a * len(w) + b)[apart(a, b)])
    group = np.cumsum(np.append(True, w["v"][1:] != w["v"][:-1])[: len(w)]) - 1
    few = np.bincount(group)[group] <= FEW if len(w) else np.zeros(0, bool)
    some, of = np.flatnonzero(few), group[few]
    for i in range(1, min(FEW, len(some))):
        near = np.flatnonzero(of[i:] == of[:-i])
        if not len(near):
            break
        put(pairs, some[near + i], some[near])
    stands = few.copy()
    rest = np.flatnonzero(~few)
    if len(rest):
        order = rest[np.lexsort((rest, w["ahead"][rest], w["back"][rest], w["v"][rest]))]
        new = np.append(True, np.any([w[x][order[1:]] != w[x][order[:-1]] for x in ("v", "back", "ahead")], axis=0))
        starts, part, place = np.flatnonzero(new), np.cumsum(new) - 1, np.arange(len(order))
        first = order[starts[part]]
        other = apart(order, first)
        # The second is the first one of another document; what is in the first's document is linked to that.
        second = np.minimum.reduceat(np.where(other, place, len(order)), starts)[part]
        put(sure, order[other], first[other])
        own = ~other & (second < len(order)) & ~new
        put(sure, order[own], order[second[own]])
        # Any window has the first or the second in another document. Of a class in one text, its first and last tell where it stands, and one in every SLACK // 2 places between, so that links to them stay one candidate.
        again = ~new & np.append(False, (w["block"][order[1:]] == w["block"][order[:-1]]) & (w["row"][order[1:]] == w["row"][order[:-1]]))
        step = w["c"][order] // (SLACK // 2)
        inner = again & np.append(again[1:], False) & np.append(False, step[1:] == step[:-1])
        stands[order[new | (second == place) | ((second == len(order)) & ~inner)]] = True
        rest = rest[stands[rest] & whole[rest]]
        edges = np.flatnonzero(np.diff(group[rest], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            heads = rest[a:b]
            own = ~apart(heads, heads[0])
            if own.all():
                continue
            if w["k"][heads[0]] == HASHES:
                hubs = heads if w["back"][heads[0]] else heads[own]
                x, y = np.repeat(hubs, len(heads)), np.tile(heads, len(hubs))
                put(pairs, np.maximum(x, y), np.minimum(x, y))
                continue
            # Windows of a text that lie within a passage's reach of each other, or are of one class, are a stretch.
            x, y = heads[1:], heads[:-1]
            part = (w["block"][x] != w["block"][y]) | (w["row"][x] != w["row"][y])
            part |= (w["c"][x] - w["c"][y] >= LEAST) & ((w["back"][x] != w["back"][y]) | (w["ahead"][x] != w["ahead"][y]))
            first, last = heads[np.append(True, part)], heads[np.append(part, True)]
            hubs_of.append(np.stack([first[1:], last[1:], np.full(len(first) - 1, first[0]), np.full(len(first) - 1, last[0])], 1))
            # Stretches of other lengths are also linked at their ends.
            ends = np.abs(w["c"][last[1:]] - w["c"][first[1:]] - w["c"][last[0]] + w["c"][first[0]]) > SLACK
            put(sure, last[1:][ends], np.full(int(ends.sum()), last[0]))
    links = []
    for certain, found in enumerate((pairs, sure)):
        found = np.stack(np.divmod(B.distinct(np.concatenate(found)), max(1, len(w))), 1)
        own, first = w[found[:, 0]], w[found[:, 1]]
        link = np.zeros(len(own), LINK)
        for x in ("row", "block", "k", "l", "c", "r"):
            link[x] = own[x]
        link["to_doc"], link["to_block"], link["to_row"], link["to_c"] = first["doc"], first["block"], first["row"], first["c"]
        if certain:
            # Links that hold by the clips need no other hash function, like those by pieces.
            minima = link["k"] < HASHES
            lo = np.maximum(0, link["c"] - LEAST + 1)
            link["l"], link["r"] = np.where(minima, lo, link["l"]), np.where(minima, lo + own["n"] - 1, link["r"])
            link["k"] = SURE
        links.append(link)
    first, last, hub, hub_last = np.concatenate(hubs_of).T
    link = np.zeros(len(first), LINK)
    for x in ("row", "block", "c"):
        link[x] = w[x][first]
    link["k"], link["e"], link["l"] = HUB, w["c"][last], np.maximum(0, w["c"][first] - LEAST + 1)
    link["r"] = np.maximum(0, w["c"][last] - LEAST + 1) + w["n"][last] - 1
    link["to_doc"], link["to_block"], link["to_row"], link["to_c"], link["to_e"] = w["doc"][hub], w["block"][hub], w["row"][hub], w["c"][hub], w["c"][hub_last]
    links.append(link)
    return stands, np.concatenate(links)


def joined(clips: list[np.ndarray], at: np.ndarray, apart, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (clip, the one that it is looked for in) of clips that share a passage, enough that they join all that a chain of such joins.

    at: each clip's place of the minimum (its first, in a stretch). known: which are joined already. Each other clip is compared
    with all that nothing joins to it yet and that may share a passage: those that hold one of its rarest shingles, as many of
    them as a passage needs, and in a stretch of it where they are dense enough.
    """
    every = np.arange(len(clips))
    known = np.zeros(len(clips), bool) if known is None else known
    part_of, links = np.where(known, len(clips), every), []
    # If the first has nobody to be compared with, all are one document's.
    if not len(clips) or not (apart(0, every).any() or apart(every[-1], every).any()):
        return links
    members = {int(x): [int(x)] for x in np.flatnonzero(~known)} | ({len(clips): np.flatnonzero(known).tolist()} if known.any() else {})

    def join(x: int, y: int) -> None:
        """Their parts become one: the smaller takes the other's number."""
        small, large = sorted((int(part_of[x]), int(part_of[y])), key=lambda k: len(members[k]))
        part_of[members[small]] = large
        members[large] += members.pop(small)

    at, size = at.astype(np.int64), np.array([len(c) for c in clips])
    # Each shingle, 32 bits long, once a clip: whose it is and where it stands, and by shingles where those of its kind are.
    starts = np.append(0, np.cumsum(size))
    owner = np.repeat(every, size)
    keys = np.concatenate(clips).astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    again = np.append(False, keys[1:] == keys[:-1])
    plain = np.bincount(owner[order[again]], minlength=len(clips)) == 0
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(np.append(False, keys[1:] >> np.uint64(32) != keys[:-1] >> np.uint64(32)))
    # Side by side at their minima; stretches of several minima are compared by their shingles alone.
    side = plain & (at < LEAST) & (size - at <= LEAST)
    none = int(kind.max()) + 1
    table = np.full((len(clips), 2 * LEAST - 1), none, np.int32)
    for i in np.flatnonzero(side).tolist():
        table[i, LEAST - 1 - at[i] : LEAST - 1 - at[i] + size[i]] = kind[starts[i] : starts[i + 1]]
    spot = np.full(none + 1, -1, np.int8)
    order = order[~again]
    first = np.append(0, np.cumsum(np.bincount(kind[order])))
    owner, place = owner[order], order - starts[owner[order]]
    #: Distinct shingles that any passage holds at least.
    least = np.array([LEAST if alike else fewest(c) for c, alike in zip(clips, plain)])
    smallest = int(least.min())
    for x in np.flatnonzero(~known).tolist():
        if len(members) == 1:
            return links
        own = kind[starts[x] : starts[x + 1]]
        own = own if plain[x] else B.distinct(own)
        lo, hi = first[own], first[own + 1]
        rare = np.argsort(hi - lo, kind="stable")[: max(0, len(own) - int(np.ceil(fewest_shared(least[x], smallest))) + 1)]
        near = B.distinct(owner[spans(lo[rare], hi[rare])])
        # What comes before it has been compared with it.
        near = near[(part_of[near] != part_of[x]) & (known[near] | (near > x))]
        near = near[apart(x, near)]
        if side[x] and len(near):
            begin, left = LEAST - 1 - int(at[x]), ~side[near]
            spot[own] = np.arange(len(own))
            for a in range(0, len(near), STEP):
                some = a + np.flatnonzero(~left[a : a + STEP])
                some = some[runs_alike(spot[table[near[some]]])]
                # Most share one in their places as they stand, which tells unless shingles repeat.
                part = near[some]
                sums = np.zeros((len(part), size[x] + 1), np.int16)
                np.cumsum(table[part, begin : begin + size[x]] == own, axis=1, out=sums[:, 1:])
                # Only stretches that both clips hold whole.
                begins = np.arange(begin, begin + size[x] - LEAST + 1)
                whole = (begins >= LEAST - 1 - at[part, None]) & (begins + LEAST <= LEAST - 1 + (size - at)[part, None])
                equal = np.where(whole, sums[:, LEAST:] - sums[:, :-LEAST], 0).max(1)
                for y in part[equal / (2 * LEAST - equal) >= SIMILARITY].tolist():
                    if part_of[y] != part_of[x]:
                        join(x, y)
                        links.append((y, x))
                left[some] = True
            spot[own] = -1
            near = near[left]
        near = near[part_of[near] != part_of[x]]
        if not len(near):
            continue
        entry = spans(lo, hi)
        near = near[np.bincount(owner[entry], minlength=len(clips))[near] >= fewest_shared(least[x], least[near])]
        for a in range(0, len(near), STEP):
            part = near[a : a + STEP]
            for y in part[may_share(len(own), plain[x], part, plain[part], lo, hi, owner, place, entry)].tolist():
                if part_of[y] == part_of[x]:
                    continue
                forth = passages(clips[y].astype(np.uint64), clips[x].astype(np.uint64))
                # Where shingles repeat, which is looked for in which may tell.
                if forth or not (plain[x] and plain[y]) and passages(clips[x].astype(np.uint64), clips[y].astype(np.uint64)):
                    join(x, y)
                    links.append((y, x) if forth else (x, y))
    return links


def fewest_shared(a, b):
    """Distinct shingles that two stretches of no fewer than a and b must share to be a passage: both / (a + b - both) >= SIMILARITY."""
    return np.maximum(SIMILARITY * np.maximum(a, b), SIMILARITY / (1 + SIMILARITY) * (a + b)) - 1e-9


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The places of all [lo, hi), one after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def fewest(clip: np.ndarray) -> int:
    """Distinct shingles of the LEAST in a row that hold fewest."""
    order = np.argsort(clip, kind="stable")
    before, place, last = np.full(len(clip), -1), np.arange(len(clip)), len(clip) - LEAST
    same = clip[order[1:]] == clip[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # A place counts in the stretches that start behind the one before it and reach it.
    lo, hi = np.maximum(before + 1, place - LEAST + 1), np.minimum(place, last)
    some = lo <= hi
    steps = np.bincount(lo[some], minlength=last + 2) - np.bincount(hi[some] + 1, minlength=last + 2)
    return int(np.cumsum(steps)[: last + 1].min())


def runs_alike(spots: np.ndarray) -> np.ndarray:
    """The rows that may be of a passage: places in one clip, -1 for none, in the order of another. As in longest, some run must be similar enough, if in one order."""
    held = spots >= 0
    run = int(np.ceil(fewest_shared(LEAST, LEAST))) - 1
    rows = np.flatnonzero(np.count_nonzero(held, axis=1) > run)
    spots, held = spots[rows], held[rows]
    value = np.add.accumulate(held.view(np.int8), axis=1, dtype=np.int8) * np.float32(1 + SIMILARITY)
    value -= (spots + np.arange(spots.shape[1], dtype=np.int16)) * np.float32(SIMILARITY)
    last = np.where(held, value, np.float32(-np.inf))[:, run:]
    first = np.minimum.accumulate(np.where(held, value, np.float32(np.inf))[:, : spots.shape[1] - run], axis=1)
    like = (last >= first - np.float32(1 - SIMILARITY + 1e-3)).any(1)
    return rows[like | (held & (np.maximum.accumulate(spots, axis=1) > spots)).any(1)]


def may_share(size: int, plain: bool, near: np.ndarray, plains: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, place: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which of near may share a passage with a clip of so many distinct shingles, held by the owners [lo, hi), entry in all, at their places. Leaves out none that does."""
    may = np.ones(len(near), bool)
    some = np.flatnonzero(plains) if plain else np.zeros(0, np.int64)
    if some.size:
        row = np.full(int(near.max()) + 1, -1)
        row[near[some]] = np.arange(len(some))
        at, x = owner[entry], np.repeat(np.arange(size), hi - lo)
        known = at < len(row)
        known[known] = row[at[known]] >= 0
        # What each shares with the clip, in the order of that.
        of, x, y = row[at[known]], x[known], place[entry[known]]
        order = np.argsort(of * size + x)
        of, x, y = of[order], x[order], y[order]
        n = np.bincount(of, minlength=len(some))
        rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        # As in longest: of shingles in one order, some run of enough of them must be similar enough; either stretch has LEAST at least.
        back = np.zeros(len(some), bool)
        back[of[1:][(of[1:] == of[:-1]) & (y[1:] < y[:-1])]] = True
        ends = np.full((len(some), int(n.max(initial=0))), -np.inf)
        ends[of, rank] = rank * (1 + SIMILARITY) - (x + y) * SIMILARITY
        run = int(np.ceil(fewest_shared(LEAST, LEAST))) - 1
        if ends.shape[1] > run:
            first = np.minimum.accumulate(ends[:, : ends.shape[1] - run], axis=1)
            last = ends[:, run:]
            like = ((last > -np.inf) & (last >= first - (1 + SIMILARITY) + 2 * SIMILARITY - 1e-9)).any(1)
        else:
            like = np.zeros(len(some), bool)
        may[some] = like | back
    return may


def send_windows(key: int, f: pd.DataFrame, masks: pd.DataFrame, hash_shards: int, shards: int) -> pd.DataFrame:
    s = Shingled(f)
    h = s.hashes()
    shared, _ = B.shared_hashes(h, masks, hash_shards)
    order = np.sort(h)
    w = s.windows(key, B.distinct(np.concatenate([shared, order[1:][order[1:] == order[:-1]]])))
    sent = B.is_in(w["v"], shared)
    stands, links = to_first(w, ~sent)
    first = w[stands & sent]
    shard = (first["v"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    first, shard = first[order], shard[order]
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    rows = [(int(shard[a]), key, planes(first[a:b]), b"") for a, b in zip(edges[:-1], edges[1:])]
    if len(links):
        rows.append((key % shards, key, b"", planes(links)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in WINDOWS.split(", ")])


def link_windows(f: pd.DataFrame) -> pd.DataFrame:
    w = rows_of(f["windows"], WINDOW)
    w = w[np.lexsort((w["c"], w["row"], w["block"], w["doc"], later(w), w["v"]))]
    rows = [(b, x) for b, x in zip(f["block"], f["links"]) if len(x)]
    _, links = to_first(w, np.ones(len(w), bool))
    links = links[np.argsort(links["block"], kind="stable")]
    edges = np.flatnonzero(np.diff(links["block"], prepend=-1, append=-1))
    rows += [(int(links["block"][a]), planes(links[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    return pd.DataFrame(rows, columns=["block", "links"])


def send_candidates(key: int, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
    """Stretches of a block's documents, and where in other documents they are looked for."""
    links = rows_of(g["links"], LINK)
    s = Shingled(f, set(np.unique(links["row"]).tolist()))
    order = np.lexsort((links["to_c"] - links["c"], links["to_row"], links["to_block"], links["to_doc"], links["row"]))
    # By columns from here on, which lie side by side.
    links = {c: np.ascontiguousarray(links[c][order]) for c in LINK.names if c != "block"}
    links["off"] = links["to_c"] - links["c"]
    kind, sizes = links["k"], {row: len(s.shingles(row)) for row in np.unique(links["row"]).tolist()}
    by_kind = [{c: x[some] for c, x in links.items()} for some in (kind == HUB, kind < HASHES, kind == SURE)]
    members = members_of(by_kind[0], sizes)
    stretches: dict[int, list[tuple]] = {}
    for a, b in row_parts(by_kind[1]["row"]):
        stretches[int(by_kind[1]["row"][a])] = stretches_of({c: x[a:b] for c, x in by_kind[1].items()})
    own = by_kind[2]
    sure: dict[int, list[tuple[int, int]]] = {}
    new = changes(own["row"], own["to_doc"], own["to_block"], own["to_row"])
    new[1:] |= np.diff(own["off"]) > SLACK
    parts = np.append(np.flatnonzero(new), len(new)).tolist()
    for x, y in zip(parts[:-1], parts[1:]):
        sure.setdefault(int(own["row"][x]), []).append((x, y))
    out = []
    for row in sizes:
        shingles = narrow(s.shingles(row))
        #: By other document: (stretch, least and greatest distance) that are candidates already.
        known: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}

        def send(to_block: int, to_row: int, lo: int, hi: int, least: int, most: int, members: bytes = b"") -> None:
            known.setdefault((to_block, to_row), []).append((lo, hi, least - SLACK, most + SLACK))
            out.append((to_block, to_row, max(0, lo + least - SLACK), max(0, hi + most + SLACK), s.block.order_ids[row], key << 32 | row, lo, shingles[lo:hi].tobytes(), members))

        for x in members.get(row, []) + stretches.get(row, []):
            send(*x)
        for x, y in sure.get(row, []):
            # Pieces that no candidate holds, with room for a passage around them.
            to = int(own["to_block"][x]), int(own["to_row"][x])
            l, r, o = own["l"][x:y], own["r"][x:y], own["off"][x:y]
            if to in known:
                lo, hi, left = np.maximum(0, l - LEAST + PIECE), np.minimum(len(shingles), r + 1 + LEAST - PIECE), np.ones(y - x, bool)
                for at, end, least, most in known[to]:
                    left &= (lo < at) | (hi > end) | (o < least) | (o > most)
                l, r, o = l[left], r[left], o[left]
            if len(l):
                send(*to, max(0, int(l.min()) - LEAST), min(len(shingles), int(r.max()) + 1 + LEAST), int(o.min()), int(o.max()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in CANDIDATES.split(", ")])


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def row_parts(rows: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(changes(rows)).tolist()
    return list(zip(starts, [*starts[1:], len(rows)]))


def members_of(own: dict[str, np.ndarray], sizes: dict[int, int]) -> dict[int, list[tuple]]:
    """What documents of so many shingles send of large groups to their hubs, each time with its places there and here. own: links by row, other text and distance."""
    found: dict[int, list[tuple]] = {}
    if not len(own["row"]):
        return found
    new = changes(own["row"], own["to_block"], own["to_row"])
    new[1:] |= np.diff(own["off"]) > SLACK
    of = np.cumsum(new)
    order = np.lexsort((own["l"], of))
    of, own = of[order], {c: x[order] for c, x in own.items()}
    # What lies far apart in the text goes by itself.
    reach = np.maximum.accumulate(own["r"] + of * (1 << 40)) - of * (1 << 40)
    new = changes(of)
    new[1:] |= own["l"][1:] > reach[:-1] + LEAST
    starts = np.flatnonzero(new)
    columns = [*(own[c][starts].tolist() for c in ("row", "to_block", "to_row")), *(f.reduceat(own[c], starts).tolist() for f, c in ((np.minimum, "l"), (np.maximum, "r"), (np.minimum, "off"), (np.maximum, "off")))]
    # The places of each part in order, each once.
    places, part = [own[c] for c in ("c", "e", "to_c", "to_e")], np.cumsum(new) - 1
    order = np.lexsort((*places[::-1], part))
    once = order[changes(part[order], *(x[order] for x in places))]
    places, ends = np.stack([x[once] for x in places], 1).astype("<i4"), np.cumsum(np.bincount(part[once])).tolist()
    for row, to_block, to_row, l, r, least, most, a, b in zip(*columns, [0, *ends], ends):
        found.setdefault(row, []).append((to_block, to_row, max(0, l - ASIDE), min(sizes[row], r + 1 + ASIDE), least, most, places[a:b].tobytes()))
    return found


def stretches_of(own: dict[str, np.ndarray]) -> list[tuple]:
    """What a document sends of candidates by minima. own: its links, by other text and distance."""
    stretches = covered(own["l"], own["r"], own["k"])
    if not stretches:
        return []
    # The stretch of each link; windows outside them have none.
    at = np.searchsorted([x for x, _ in stretches], own["c"], side="right") - 1
    inside = (at >= 0) & (own["c"] < np.array([e for _, e in stretches])[at])
    if not inside.all():
        own, at = {c: x[inside] for c, x in own.items()}, at[inside]
    if not len(at):
        return []
    if len(stretches) > 1:
        order = np.argsort(at, kind="stable")
        own, at = {c: x[order] for c, x in own.items()}, at[order]
    off = own["off"]
    new = changes(at, own["to_doc"], own["to_block"], own["to_row"])
    new[1:] |= np.diff(off) > SLACK
    starts = np.flatnonzero(new)
    enough = np.bitwise_count(np.bitwise_or.reduceat(1 << own["k"].astype(np.uint64), starts)) >= EACH
    ends = np.append(starts[1:], len(at)) - 1
    found = []
    for x, y, l, r in zip(starts[enough].tolist(), ends[enough].tolist(), np.minimum.reduceat(own["l"], starts)[enough].tolist(), np.maximum.reduceat(own["r"], starts)[enough].tolist()):
        lo, hi = stretches[at[x]]
        found.append((int(own["to_block"][x]), int(own["to_row"][x]), max(lo, l - ASIDE), min(hi, r + 1 + ASIDE), int(off[x]), int(off[y])))
    return found


def narrow(x: np.ndarray) -> np.ndarray:
    """The upper half of shingles' hashes: enough to tell those of two passages apart."""
    return (x >> np.uint64(32)).astype(np.uint32)


def covered(l: np.ndarray, r: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
    """Joined stretches [at, end) in which windows of ENOUGH hash functions overlap; each is as long as the windows over it."""
    first, n = int(l.min()), int(r.max()) - int(l.min()) + 2
    k = k.astype(np.int64) * n - first
    steps = np.bincount(k + l, minlength=HASHES * n)
    steps -= np.bincount(k + r + 1, minlength=HASHES * n)
    # Each hash function's steps add up to none.
    over = (np.cumsum(steps, out=steps) > 0).view(np.int8).reshape(HASHES, n)
    enough = np.concatenate([[False], np.add.reduce(over, axis=0, dtype=np.int8) >= ENOUGH, [False]])
    edges = (np.flatnonzero(enough[1:] != enough[:-1]) + first).tolist()
    out: list[tuple[int, int]] = []
    for at, end in zip(edges[::2], edges[1::2]):
        if out and at - out[-1][1] <= GAP:
            out[-1] = (out[-1][0], end)
        else:
            out.append((at, end))
    return [(a, b) for a, b in out if b - a >= LEAST]


def verify(key: int, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
    s = Shingled(f, set(g["to_row"].astype(int)))
    out = []
    for d, k in s.copies:  # whole texts
        n = len(s.shingles(k))
        if n >= LEAST and (s.block.order_ids[d] != s.block.order_ids[k] or s.block.order_ids[d] == B.NO_ID):
            out.append((s.block.order_ids[d], 0, n + SHINGLE - 1, s.block.order_ids[k], 0, n + SHINGLE - 1, 1.0))
    hubs: dict[int, list[Sent]] = {}
    x = narrow(s.x)
    starts = {row: (int(s.starts[i]), int(s.starts[i + 1])) for row, i in s.at.items()}
    pairs = []
    for row, at, end, doc_id, text, own_at, data, members in zip(*(g[c].tolist() for c in ("to_row", "to_at", "to_end", "doc_id", "text", "at", "shingles", "members"))):
        sent = Sent(doc_id, text, own_at, np.frombuffer(data, np.uint32))
        first, last = starts[row]
        hub = Sent(s.block.order_ids[row], key << 32 | row, at, x[first + at : min(first + end, last)])
        if not sent.alike(hub):
            pairs.append((sent, hub))
        if len(members):
            sent.members = np.frombuffer(members, "<i4").reshape(-1, 4)
            hubs.setdefault(row, []).append(sent)
    for (sent, hub), found in zip(pairs, passages_of([(a.shingles, b.shingles) for a, b in pairs])):
        sent.found = sent.places(hub, found)
        out += [sent.result(hub, x) for x in sent.found]
    for row, sent in hubs.items():
        out += among(Sent(s.block.order_ids[row], key << 32 | row, 0, x[slice(*starts[row])]), sent)
    return pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])


class Sent:
    """A stretch of a document, from a place on."""

    def __init__(self, doc_id: int, text: int, at: int, shingles: np.ndarray):
        self.doc_id, self.text, self.at, self.shingles = doc_id, text, at, shingles
        self.found: list[tuple] = []
        self.members = np.zeros((0, 4), "<i4")

    def alike(self, other: Sent) -> bool:
        """Of one document."""
        return self.doc_id == other.doc_id and (self.doc_id != B.NO_ID or self.text == other.text)

    def part(self, c: int, e: int) -> Sent:
        """The clips of the places from c to e."""
        lo = max(self.at, c - LEAST + 1)
        return Sent(self.doc_id, self.text, lo, self.shingles[lo - self.at : e + LEAST - self.at])

    def passages(self, other: Sent) -> list[tuple]:
        """Passages in places of the two documents."""
        return self.places(other, passages(self.shingles, other.shingles))

    def places(self, other: Sent, found: list[tuple]) -> list[tuple]:
        return [(self.at + i, self.at + j, other.at + p, other.at + q, similarity) for i, j, p, q, similarity in found]

    def result(self, other: Sent, x: tuple) -> tuple:
        i, j, p, q, similarity = x
        return self.doc_id, i, j + SHINGLE - 1, other.doc_id, p, q + SHINGLE - 1, similarity


def holds(found: list[tuple], c: int, e: int, to_c: int, to_e: int) -> bool:
    """Whether a passage touches the places [c, e] and [to_c, to_e]."""
    return any(i <= e and j > c and p <= to_e and q > to_c for i, j, p, q, _ in found)


def among(hub: Sent, sent: list[Sent]) -> list[tuple]:
    """Passages that members of large groups share with each other, enough that all that a chain of like passages joins hang together.

    Those that share one with the hub at its minimum hang together already; each other one is compared with all of its group.
    """
    groups: dict[int, dict[tuple[int, int], tuple]] = {}
    for x in sent:
        for c, e, to_c, to_e in x.members.tolist():
            groups.setdefault(to_c, {}).setdefault((x.text, c), (x, c, e, to_e))
    out, known = [], {}
    for to_c, members in groups.items():
        to_e = max(m[3] for m in members.values())
        # The hub is one of them.
        of = [(hub, to_c, to_e), *(m[:3] for m in members.values())]
        done = np.array([True, *(holds(x.found, c, e, to_c, to_e) for x, c, e in of[1:])])
        if done.all():
            continue
        parts = [x.part(c, e) for x, c, e in of]
        docs, texts = np.array([x.doc_id for x in parts]), np.array([x.text for x in parts])
        apart = lambda a, b: (docs[a] != docs[b]) | ((docs[a] == B.NO_ID) & (texts[a] != texts[b]))  # noqa: B023, E731
        for y, x in joined([p.shingles for p in parts], np.array([c - p.at for p, (_, c, _) in zip(parts, of)]), apart, done):
            (a, c, e), (b, to, to_end) = of[y], of[x]
            found = []
            if hub not in (a, b):
                if (id(a), id(b)) not in known:
                    known[id(a), id(b)] = a.passages(b)
                    out += [a.result(b, z) for z in known[id(a), id(b)]]
                found = known[id(a), id(b)]
            if not holds(found, c, e, to, to_end):
                out += [a.result(b, z) for z in parts[y].passages(parts[x])]
    return out


def passages(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(start, end in a, start, end in b, similarity) of verified passages. Ends are exclusive, counted in shingles."""
    if len(b) < LEAST * SIMILARITY or np.count_nonzero(B.is_in(a, known := np.sort(b))) < LEAST * SIMILARITY:
        return []
    hit, in_b = aligned(a, b)
    # Without repeats and in one order, the longest run that is similar enough tells whether there is any.
    return among_hits(a, b, hit, in_b, bool((in_b[1:] > in_b[:-1]).all()) and not (known[1:] == known[:-1]).any() and len(B.distinct(a)) == len(a))


def passages_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple]]:
    """As passages, of shingles of 32 bits, for each pair; what two texts share is found for some pairs at once."""
    size = np.cumsum([len(a) + len(b) for a, b in pairs], dtype=np.int64)
    cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1] + 4 * STEP, 4 * STEP), side="left")) if pairs else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = pairs[lo:hi]
        own, of = pair_keys([a for a, _ in some])
        other, to = pair_keys([b for _, b in some])
        order = np.argsort(other)
        known = other[order]
        spot = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        same = known[spot] == own if len(known) else np.zeros(len(own), bool)
        shared, sizes = np.bincount(of[same], minlength=len(some)), np.bincount(to, minlength=len(some))
        again = lambda keys: np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(some)) > 0  # noqa: B023, E731
        twice, twice_in_own = again(known), again(np.sort(own))
        hits, found = np.flatnonzero(same), order[spot[same]]
        hit_ends, starts, to_starts = np.cumsum(shared), np.searchsorted(of, np.arange(len(some))), np.cumsum(sizes) - sizes
        for k, (a, b) in enumerate(some):
            if min(shared[k], sizes[k]) < LEAST * SIMILARITY:
                yield []
            elif twice[k]:
                yield among_hits(a, b, *aligned(a, b), False)
            else:
                x = slice(hit_ends[k] - shared[k], hit_ends[k])
                hit, in_b = hits[x] - starts[k], found[x] - to_starts[k]
                yield among_hits(a, b, hit, in_b, not twice_in_own[k] and bool((in_b[1:] > in_b[:-1]).all()))


def pair_keys(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all parts, each with its part's number before it, the numbers)"""
    of = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return of.astype(np.uint64) << np.uint64(32) | np.concatenate(parts), of


def among_hits(a: np.ndarray, b: np.ndarray, hit: np.ndarray, in_b: np.ndarray, plain: bool) -> list[tuple[int, int, int, int, float]]:
    """Passages by the places in a that b has, and their places in b. plain: none repeats, and all are in one order."""
    gap, sets = None, None
    score = run_score(hit, in_b)
    todo, out = [(0, len(hit))], []
    while todo:
        x, y = todo.pop()
        if y - x < LEAST * SIMILARITY:
            continue
        found = None
        u, v = longest_run(score, x, y)
        for u, v in [(x, y)] * (not plain and (u, v) != (x, y)) + [(u, v)]:
            part = in_b[u:v]
            p, q = (part[0], part[-1]) if plain else (part.min(), part.max())
            i, j, p, q = extended(int(hit[u]), int(hit[v - 1]) + 1, int(p), int(q) + 1, len(a), len(b))
            if min(j - i, q - p) < LEAST:
                continue
            if plain:
                both = int(np.count_nonzero((hit >= i) & (hit < j) & (in_b >= p) & (in_b < q)))
                similarity = both / (j - i + q - p - both)
            else:
                sets = sets or Distinct(a, b)
                similarity = sets.jaccard(i, j, p, q)
            if similarity >= SIMILARITY:
                found = u, v
                out.append((i, j, p, q, similarity))
                break
        if found:
            todo += [(x, found[0]), (found[1], y)]
        elif y - x > 1 and not (plain and v - u < LEAST * SIMILARITY):
            # Either side of its widest break may do.
            gap = np.maximum(np.diff(hit), np.abs(np.diff(in_b))) if gap is None else gap
            z = x + int(gap[x : y - 1].argmax()) + 1
            todo += [(x, z), (z, y)]
    return out


class Distinct:
    """Which shingles of two texts are equal, to compare many stretches of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        x = np.concatenate([a, b])
        order = np.argsort(x, kind="stable")
        same = x[order[1:]] == x[order[:-1]]
        kind = np.empty(len(x), np.int64)
        kind[order] = np.cumsum(np.append(False, ~same))
        #: The place of the like one before each in its text, if there is any.
        before = np.full(len(x), -1)
        before[order[1:][same]] = order[:-1][same]
        self.a, self.b, self.before_a, self.before_b = kind[: len(a)], kind[len(a) :], before[: len(a)], before[len(a) :] - len(a)
        self.held = np.zeros(len(x), bool)

    def jaccard(self, i: int, j: int, p: int, q: int) -> float:
        """Of [i, j) in a and [p, q) in b."""
        new = self.before_a[i:j] < i
        n, m = np.count_nonzero(new), np.count_nonzero(self.before_b[p:q] < p)
        self.held[self.b[p:q]] = True
        both = np.count_nonzero(self.held[self.a[i:j]] & new)
        self.held[self.b[p:q]] = False
        return both / (n + m - both)


def longest(hit: np.ndarray, in_b: np.ndarray, x: int, y: int) -> tuple[int, int]:
    """The longest run of hits within [x, y) that would be similar enough if all were distinct and in order."""
    return longest_run(run_score(hit, in_b), x, y)


def run_score(hit: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    # hits / (both lengths - hits) >= SIMILARITY, as a difference of what stands at the run's two ends.
    return np.arange(len(hit)) * (1 + SIMILARITY) - (hit + in_b) * SIMILARITY


def longest_run(score: np.ndarray, x: int, y: int) -> tuple[int, int]:
    at = score[x:y]
    # The whole, if it is similar enough.
    if at[-1] >= at[0] - (1 + SIMILARITY) + 2 * SIMILARITY - 1e-9:
        return x, y
    least = np.minimum.accumulate(at)
    most = np.maximum.accumulate(at[::-1])
    # For each last hit that no later one beats, the earliest first one; most falls, so each start has one farthest end.
    bound = least - (1 + SIMILARITY) + 2 * SIMILARITY - 1e-9
    ends = len(most) - np.searchsorted(most, bound, side="left")
    size = ends - np.arange(len(at))
    size[at > least] = 0
    u = int(size.argmax())
    return x + u, x + max(u + 1, int(ends[u]))


def extended(i: int, j: int, p: int, q: int, n: int, m: int) -> tuple[int, int, int, int]:
    """A run under LEAST with what stands beside it, where both texts (n and m shingles) go on at the same end.

    Changed words near a passage's end leave no equal shingle there.
    """
    own, other = max(0, LEAST - (j - i)), max(0, LEAST - (q - p))
    need, left_room, right_room = max(own, other), min(i, p), min(n - j, m - q)
    if need > left_room + right_room:
        return i, j, p, q
    left = min(left_room, max((need + 1) // 2, need - right_room))
    a, b = min(left, own), min(left, other)
    return i - a, j + own - a, p - b, q + other - b


def ranked(x: np.ndarray) -> np.ndarray:
    """Each value with its number among equals."""
    order = np.argsort(x, kind="stable")
    new = np.append(True, x[order[1:]] != x[order[:-1]])
    rank = np.empty(len(x), np.uint64)
    rank[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return mix(x + rank * np.uint64(0x9E3779B97F4A7C15))


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a that b has, their places in b): repeats of a shingle one after the other, those that b has fewer of at its first."""
    found = np.full(len(a), -1)
    if not len(b):
        return found[:0], found[:0]
    for again in (False, True):
        x, y = (ranked(a), ranked(b)) if again else (a, b)
        order = np.argsort(y, kind="stable")
        y = y[order]
        spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = y[spot] == x
        found[same] = order[spot[same]]
        if not again and not (y[1:] == y[:-1]).any():
            break
    hit = np.flatnonzero(found >= 0)
    return hit, found[hit]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = B.distinct(a), B.distinct(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT: passages of doc_id and the like ones of other_id, in words."""
    modest_batches(docs.sparkSession)
    size, parts = B.total_bytes(docs, text_col), partitions(docs.sparkSession)
    hash_shards, shards = max(parts, size // (4 * SHARD_BYTES)), max(parts, size // SHARD_BYTES)
    blocks = B.blocked(docs, id_col, text_col, size, parts)
    blobs = B.map_blocks(blocks, lambda k, f: B.shard_blobs(k, Shingled(f).hashes(), hash_shards, B.tight), "block long, shard long, blob binary")
    masks = B.shared_masks(blobs, unpack=B.loose)
    windows = B.map_blocks_with(blocks, masks, lambda k, f, g: send_windows(k, f, g, hash_shards, shards), WINDOWS)
    links = windows.groupBy("shard").applyInPandas(link_windows, LINKS)
    candidates = B.map_blocks_with(blocks, links, send_candidates, CANDIDATES)
    found = B.map_blocks_with(blocks, candidates, verify, RESULT)
    known = lambda c: F.nullif(F.col(c), F.lit(B.NO_ID)).alias(c)
    return found.select(known("doc_id"), "start_word", "end_word", known("other_id"), "other_start", "other_end", "similarity").distinct()

import random

import numpy as np
import pandas as pd
import pytest

from tagweave.llm import blocks as B
from tagweave.llm import passages as P


def test_subtree_is_the_cartesian_tree():
    r = np.random.default_rng(5)
    for _ in range(100):
        n = int(r.integers(1, 60))
        keys = r.permutation(n).astype(np.uint64)
        at = np.arange(n)
        left, right = P.subtree(keys, at, np.zeros(n, np.int64), np.full(n, n))
        for c in range(n):
            i = j = c
            while i > 0 and keys[i - 1] > keys[c]:
                i -= 1
            while j + 1 < n and keys[j + 1] > keys[c]:
                j += 1
            assert (left[c], right[c]) == (i, j)


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(P.B, "BLOCK_BYTES", 4000)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 8)))
    words = lambda n: [word() for _ in range(n)]
    exact, near, hot = words(60), words(120), words(70)
    rows = {i: words(r.randint(0, 250)) for i in range(60)}
    clean = set(range(60))

    def put(i, passage):
        k = r.randint(0, len(rows[i]))
        rows[i][k:k] = passage
        clean.discard(i)

    changed = list(near)
    for k in (30, 80):
        changed[k] = "changed"
    put(3, exact), put(40, exact)
    put(7, near), put(22, changed)
    for i in range(10, 20):
        put(i, hot)
    rows[50] = rows[51] = words(90)
    clean -= {50, 51}
    # 45 words alike are too few.
    few = words(45)
    rows[55] += few
    rows[56] = few + rows[56]
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows.items()] + [(None, " ".join(exact), "x"), (70, None, "x")], "doc_id long, text string, block string")
    rows[None] = exact
    found = P.near_duplicates(df).collect()
    pairs = {(x.doc_id, x.other_id) for x in found}
    named = {d for p in pairs for d in p}
    assert not named & clean and 70 not in named
    linked = lambda a, b: (a, b) in pairs or (b, a) in pairs
    assert linked(3, 40) and linked(7, 22) and linked(50, 51) and (linked(None, 3) or linked(None, 40))
    assert set(range(10, 20)) <= named
    for x in found:
        assert x.similarity >= 0.8 and x.end_word - x.start_word >= 50
        a = rows[x.doc_id][x.start_word : x.end_word]
        b = rows[x.other_id][x.other_start : x.other_end]
        sets = [{" ".join(t[i : i + 5]).lower() for i in range(len(t) - 4)} for t in (a, b)]
        assert abs(len(sets[0] & sets[1]) / len(sets[0] | sets[1]) - x.similarity) < 1e-9
    assert P.near_duplicates(df.limit(0)).count() == 0


def group_recall(spark, sizes, seed=9):
    """(recall of pairs, of documents) for groups of near copies between random words, against all pairs: found if linked through whatever links."""
    r = np.random.default_rng(seed)
    word = lambda n: [format(int(x), "x") for x in r.integers(1, 1 << 40, n)]
    rows, groups = [], []
    for groups_of, members, n, changes in sizes:
        for _ in range(groups_of):
            passage, own = word(n), []
            for _ in range(members):
                copy = list(passage)
                for k in r.choice(n, changes, replace=False):
                    copy[k] = word(1)[0]
                own.append((len(rows), copy))
                rows.append(" ".join(word(int(r.integers(20, 60))) + copy + word(int(r.integers(20, 60)))))
            groups.append(own)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    named = set()
    for x in P.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect():
        up[top(x.doc_id)] = top(x.other_id)
        named |= {x.doc_id, x.other_id}
    due, found, docs = 0, 0, set()
    for own in groups:
        sets = [(i, {tuple(c[k : k + 5]) for k in range(len(c) - 4)}) for i, c in own]
        for a, (i, x) in enumerate(sets):
            for j, y in sets[:a]:
                if len(x & y) / len(x | y) >= 0.8:
                    due, found, docs = due + 1, found + (top(i) == top(j)), docs | {i, j}
    return due, found / due, len(docs & named) / len(docs)


@pytest.mark.parametrize("size", [(15, 2, 50, 0), (40, 2, 120, 1), (30, 2, 200, 2), (10, 12, 200, 2), (6, 40, 80, 1), (25, 12, 60, 1)])
def test_recall_against_all_pairs(spark, size):
    due, pairs, docs = group_recall(spark, [size])
    print(size, due, pairs, docs)
    assert due >= 15 and pairs >= 0.9 and docs >= 0.9, (due, pairs, docs)


@pytest.mark.parametrize("block_bytes", [3000, P.B.BLOCK_BYTES])
def test_pairs_within_a_large_group_that_shares_too_little(spark, monkeypatch, block_bytes):
    """All documents share 46 words around one of their own, too little for a passage; pairs of them share six more."""
    monkeypatch.setattr(P.B, "BLOCK_BYTES", block_bytes)
    r = np.random.default_rng(4)
    word = lambda n: [format(int(x), "x") for x in r.integers(1, 1 << 40, n)]
    left, right, rows = word(23), word(23), []
    for _ in range(40):
        before, behind = word(3), word(3)
        rows += [" ".join(word(30) + before + left + word(1) + right + behind + word(30)) for _ in range(2)]
    found = {frozenset((x.doc_id, x.other_id)) for x in P.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    due = {frozenset((i, i + 1)) for i in range(0, 80, 2)}
    assert found <= due and len(found) >= 0.95 * len(due), len(found)


def test_joined_joins_what_chains_of_passages_join():
    r = np.random.default_rng(6)
    for kinds in [91] * 15 + [1, 2, 6, 11, 30, 50]:
        base, clips, at, docs = np.resize(r.integers(0, 1 << 32, kinds), 91), [], [], r.integers(0, 25, 30)
        for _ in docs:
            clip, lo = base.copy(), int(r.integers(0, 30))
            for k in r.integers(0, 87, r.integers(0, 5)):
                clip[k : k + 5] = r.integers(0, 1 << 32, 5)
            clips.append(clip[lo : 91 - int(r.integers(0, 16))].astype(np.uint32))
            at.append(45 - lo)
            held = [len(set(clips[-1][k : k + P.LEAST].tolist())) for k in range(len(clips[-1]) - P.LEAST + 1)]
            assert P.fewest(clips[-1]) == min(held)
        like = lambda x, y: P.passages(clips[x].astype(np.uint64), clips[y].astype(np.uint64))  # noqa: B023, E731
        up = {True: list(range(30)), False: list(range(30))}

        def top(t, i):
            while t[i] != i:
                i = t[i]
            return i

        for x, y in P.joined(clips, np.array(at), lambda x, y: docs[x] != docs[y]):
            assert docs[x] != docs[y] and like(x, y)
            up[True][top(up[True], x)] = top(up[True], y)
        for x in range(30):
            for y in range(30):
                if docs[x] != docs[y] and like(x, y):
                    up[False][top(up[False], x)] = top(up[False], y)
        same = lambda t: {frozenset(i for i in range(30) if top(t, i) == top(t, j)) for j in range(30)}
        assert same(up[True]) == same(up[False])


def test_a_piece_at_either_end_of_texts(spark):
    """Texts that begin with 45 words and texts that end with them: each kind shares passages, but nothing goes on at the same end of both."""
    r = np.random.default_rng(8)
    word = lambda n: [format(int(x), "x") for x in r.integers(1, 1 << 40, n)]
    piece = word(45)
    rows = [" ".join(piece + word(8)) for _ in range(20)] + [" ".join(word(8) + piece) for _ in range(20)]
    up = list(range(40))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in P.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect():
        up[top(x.doc_id)] = top(x.other_id)
    assert len({top(i) for i in range(20)}) == 1 and len({top(i) for i in range(20, 40)}) == 1


def test_what_a_block_sends_of_near_copies():
    """Large groups of near copies: their minima go to the shards, texts only to the hub, so what is sent is a small multiple of the texts."""
    r = np.random.default_rng(10)
    word = lambda n: [format(int(x), "x") for x in r.integers(1, 1 << 40, n)]
    base, rows = word(400), []
    for _ in range(40):
        copy = list(base)
        for k in r.choice(400, 16, replace=False):
            copy[k] = word(1)[0]
        rows.append(" ".join(copy).encode())
    f = pd.DataFrame({"doc_id": range(40), "has_id": True, "data": rows, "tie": 0})
    hashes = B.distinct(P.Shingled(f).hashes())
    all_of = np.packbits(np.ones(len(hashes), bool)).tobytes()
    sent = P.send_windows(0, f, pd.DataFrame({"block": [0], "shard": [0], "mask": [all_of], "hot": [all_of]}), 1, 1)
    assert sum(len(x) for c in sent.columns for x in sent[c] if isinstance(x, bytes)) < 1.5 * sum(map(len, rows))


def test_hashes_sent_in_four_bytes_or_less():
    hashes = B.distinct(np.random.default_rng(11).integers(0, 1 << 64, 9000, dtype=np.uint64))
    assert (B.loose(B.tight(hashes)) == hashes >> np.uint64(32)).all() and len(B.tight(hashes)) < 3 * len(hashes)
    assert len(B.loose(B.tight(hashes[:0]))) == 0

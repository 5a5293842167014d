"""Steps of passage dedup that look at less than all: the same results, for less work."""

import numpy as np
import pandas as pd

from tagweave.llm import blocks as B
from tagweave.llm import passages as P


def texts(r, sizes):
    return pd.DataFrame({"doc_id": range(len(sizes)), "has_id": True, "data": [" ".join(format(int(x), "x") for x in r.integers(1, 1 << 40, n)).encode() for n in sizes], "tie": 0})


def test_subtrees_are_told_by_minima_alone(monkeypatch):
    s = P.Shingled(texts(np.random.default_rng(14), (3000, 20, 51, 700, 0, 49, 50)))
    whole = []
    for k in range(P.HASHES):
        keys, at, ends = s.minima(k)
        first = s.starts[s.text[at]]
        left, right = P.subtree(keys, at, first, ends[at])
        whole += zip(s.values(k, at).tolist(), (left - first).tolist(), (right - first).tolist())
    seen = []
    subtree = P.subtree
    monkeypatch.setattr(P, "subtree", lambda keys, *x: seen.append(len(keys)) or subtree(keys, *x))
    w = s.windows(0, B.distinct(s.hashes()))
    w = w[w["k"] < P.HASHES]
    assert sorted(zip(w["v"].tolist(), w["l"].tolist(), w["r"].tolist())) == sorted(whole)
    # Two of LEAST places or so are minima.
    assert len(seen) == P.HASHES and max(seen) < len(s.x) / 8


def test_pieces_against_brute_force():
    r = np.random.default_rng(15)
    f = texts(r, (400, 30, 50, 51, 49))
    f.loc[5] = [5, True, b"one two three " * 40, 0]
    s = P.Shingled(f)
    values, places = s.pieces()
    known = dict(zip(places.tolist(), values.tolist()))
    for a, b in zip(s.starts[:-1].tolist(), s.starts[1:].tolist()):
        like = {tuple(s.x[p : p + P.PIECE].tolist()) for p in known if a <= p < b}
        # Any LEAST shingles of a text hold one of its pieces.
        for i in range(a, b - P.LEAST + 1):
            assert any(tuple(s.x[p : p + P.PIECE].tolist()) in like for p in range(i, i + P.APART))
        assert len(like) == len({known[p] for p in known if a <= p < b}) == sum(a <= p < b for p in known)
        assert all(p + P.PIECE <= b for p in known if a <= p < b)


def some_pairs(r, n):
    """Pairs of texts that share much, little or nothing, some with repeats or in another order."""
    for i in range(n):
        a = r.integers(0, 1 << 32 if i % 3 else 40, int(r.integers(0, 400)))
        b = a.copy()
        for k in r.integers(0, len(b) + 1, r.integers(0, 6)):
            b = np.concatenate([b[:k], r.integers(0, 1 << 32, r.integers(0, 9)), b[k + r.integers(0, 9) :]])
        if i % 4 == 1:
            b = np.roll(b, 90)
        if i % 5 == 2:
            b = np.tile(b, 2)
        yield a.astype(np.uint32), b.astype(np.uint32) if i % 7 else r.integers(0, 1 << 32, 60).astype(np.uint32)


def test_pairs_at_once_are_as_one_by_one(monkeypatch):
    pairs = list(some_pairs(np.random.default_rng(16), 600))
    monkeypatch.setattr(P, "STEP", 1 << 10)
    found = list(P.passages_of(pairs))
    assert found == [P.passages(a, b) for a, b in pairs] and sum(map(bool, found)) > 200
    assert all(x[4] == P.jaccard(a[x[0] : x[1]], b[x[2] : x[3]]) for (a, b), own in zip(pairs, found) for x in own)
    assert list(P.passages_of([])) == []


def test_distinct_is_jaccard():
    r = np.random.default_rng(17)
    for kinds in (3, 30, 1 << 32):
        a, b = (r.integers(0, kinds, n).astype(np.uint32) for n in (90, 120))
        sets = P.Distinct(a, b)
        for _ in range(100):
            i, p = int(r.integers(0, 45)), int(r.integers(0, 60))
            j, q = i + int(r.integers(1, 45)), p + int(r.integers(1, 60))
            assert sets.jaccard(i, j, p, q) == P.jaccard(a[i:j], b[p:q])


def test_members_are_told_for_a_block_at_once(monkeypatch):
    """Candidates of many documents take no sorting of rows for each of them."""
    r = np.random.default_rng(18)
    f = texts(r, [200] * 30)
    links = np.zeros(30 * 40, P.LINK)
    links["row"], links["k"], links["c"] = np.repeat(np.arange(30), 40), P.HUB, r.integers(0, 190, 1200)
    links["e"], links["l"], links["r"] = links["c"], np.maximum(0, links["c"] - 45), np.minimum(195, links["c"] + 45)
    links["to_block"], links["to_row"], links["to_doc"], links["to_c"] = 7, 3, 900, links["c"] + r.integers(0, 5, 1200)
    links["to_e"] = links["to_c"]
    sorted_rows = []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda x, **more: sorted_rows.append(1) or unique(x, **more))
    got = P.send_candidates(0, f, pd.DataFrame({"links": [P.planes(links)]}))
    assert len(sorted_rows) < 5
    assert got["text"].nunique() == 30 and (got["block"] == 7).all()
    for row, own in got.groupby("text"):
        places = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 4) for x in own["members"]])
        want = links[links["row"] == row]
        assert {tuple(x) for x in places.tolist()} == set(zip(*(want[c].tolist() for c in ("c", "e", "to_c", "to_e"))))

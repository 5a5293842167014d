"""What is compared within large groups."""

import numpy as np

from tagweave.llm import passages as P


def test_runs_too_short_for_a_passage_are_not_verified(monkeypatch):
    """Clips that share runs of 38 shingles, as a group of near copies has many: no two of them hold a passage."""
    r = np.random.default_rng(12)
    base, clips = r.integers(0, 1 << 32, 91), []
    for shift in range(40):
        own = r.integers(0, 1 << 32, 15 + shift % 2)
        clips.append(np.concatenate([base[:38], own, base[53:]])[:91].astype(np.uint32))
    verified = []
    passages = P.passages
    monkeypatch.setattr(P, "passages", lambda a, b: verified.append(1) or passages(a, b))
    docs = np.arange(40)
    assert not any(passages(a.astype(np.uint64), b.astype(np.uint64)) for a in clips for b in clips if a is not b)
    assert P.joined(clips, np.full(40, 45), lambda a, b: docs[a] != docs[b]) == []
    assert not verified


def test_runs_alike_leaves_out_no_passage():
    r = np.random.default_rng(13)
    found = 0
    for _ in range(400):
        a, b = np.arange(91), np.arange(91)
        for k in r.integers(0, 87, r.integers(0, 4)):
            a[k : k + 5] = r.integers(1000, 1 << 32, 5)
        cut = int(r.integers(0, 91))
        b = np.concatenate([b[:cut], r.integers(1000, 1 << 32, r.integers(0, 9)), b[cut + int(r.integers(0, 9)) :]])[:91]
        spot = {int(x): i for i, x in enumerate(a)}
        spots = np.full((1, 91), -1, np.int8)
        spots[0, : len(b)] = [spot.get(int(x), -1) for x in b]
        if P.passages(b.astype(np.uint64), a.astype(np.uint64)):
            found += 1
            assert P.runs_alike(spots).tolist() == [0]
    assert found > 100

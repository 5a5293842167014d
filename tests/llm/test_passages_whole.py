"""Passages that a shorter way of looking would miss."""

import numpy as np
import pandas as pd

from tagweave.llm import passages as P


def shingled(words):
    return np.array([hash(tuple(words[i : i + 5])) & 0xFFFFFFFF for i in range(len(words) - 4)], np.uint64)


def some(r, n):
    return [int(x) for x in r.integers(1, 1 << 40, n)]


def similarity(a, b):
    a, b = set(shingled(a).tolist()), set(shingled(b).tolist())
    return len(a & b) / len(a | b)


def test_longest_run_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(1, 40))
        hit, in_b = np.sort(r.choice(80, n, replace=False)), np.sort(r.choice(80, n, replace=False))
        like = lambda u, v: (v - u) / ((hit[v - 1] - hit[u]) + (in_b[v - 1] - in_b[u]) + 2 - (v - u)) >= P.SIMILARITY  # noqa: B023, E731
        best = max([v - u for u in range(n) for v in range(u + 1, n + 1) if like(u, v)], default=1)
        u, v = P.longest(hit, in_b, 0, n)
        assert v - u == max(1, best)


def test_words_inserted_in_the_middle():
    r = np.random.default_rng(4)
    for n, more in ((98, 9), (98, 14), (120, 15), (400, 30)):
        a = some(r, n)
        b = a[: n // 2] + some(r, more) + a[n // 2 :]
        for around in (0, 70):
            x, y = some(r, around) + a + some(r, around), some(r, around) + b + some(r, around)
            found = P.passages(shingled(x), shingled(y))
            assert [(i, j, p, q) for i, j, p, q, _ in found] == [(around, around + n - 4, around, around + n + more - 4)]
            assert abs(found[0][4] - similarity(a, b)) < 1e-9


def test_an_edit_at_each_word():
    r = np.random.default_rng(5)
    for n in range(50, 55):
        for k in range(n):
            a = some(r, n)
            b = [*a[:k], 0, *a[k + 1 :]]
            assert similarity(a, b) >= P.SIMILARITY
            for around in (0, 60):
                x, y = some(r, around) + a + some(r, around), some(r, around) + b + some(r, around)
                found = P.passages(shingled(x), shingled(y))
                assert len(found) == 1
                i, j, p, q, s = found[0]
                assert min(j - i, q - p) >= P.LEAST and s == P.jaccard(shingled(x)[i:j], shingled(y)[p:q]) >= P.SIMILARITY


def test_short_parts_do_not_part_a_passage(spark, monkeypatch):
    """Lower ids that hold only a passage's first or last words; each pair of documents that shares 50 words exactly hangs together."""
    monkeypatch.setattr(P.B, "BLOCK_BYTES", 6000)
    r = np.random.default_rng(6)
    word = lambda n: [format(x, "x") for x in some(r, n)]
    rows, pairs = [], []
    for size in (50, 51, 53, 55, 60, 70, 90):
        for _ in range(12):
            passage = word(size)
            cut = [size * 4 // 5, 44]
            for n in (cut[0], min(cut)):
                rows += [word(20) + passage[:n] + word(20) for _ in range(8)] + [word(20) + passage[-n:] + word(20) for _ in range(8)]
            pairs.append((len(rows), len(rows) + 1))
            rows += [word(30) + passage + word(30), word(25) + passage + word(35)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in P.near_duplicates(df).collect():
        assert similarity(rows[x.doc_id][x.start_word : x.end_word], rows[x.other_id][x.other_start : x.other_end]) >= P.SIMILARITY
        up[top(x.doc_id)] = top(x.other_id)
    assert [p for p in pairs if top(p[0]) != top(p[1])] == []


def test_places_beyond_their_bits(monkeypatch):
    """Minima of texts with more shingles than places have bits, against brute force."""
    monkeypatch.setattr(P, "LOW", np.uint64(0xFF), raising=False)
    monkeypatch.setattr(P, "PLACE_BITS", 8, raising=False)
    r = np.random.default_rng(7)
    texts = [" ".join(format(x, "x") for x in some(r, n)) for n in (300, 1000, 30, 700)]
    s = P.Shingled(pd.DataFrame({"doc_id": range(4), "has_id": True, "data": [t.encode() for t in texts], "rest": ""}))
    for k in range(P.HASHES):
        keys, at, _ = s.minima(k)
        hashes = P.mix(s.x + np.uint64((k + 1) * 0xD1342543DE82EF95 % (1 << 64))) >> np.uint64(8)
        want = {i + int(np.argmin(hashes[i : i + P.LEAST])) for a, b in zip(s.starts[:-1], s.starts[1:]) for i in range(a, b - P.LEAST + 1)}
        assert at.tolist() == sorted(want) and (keys >> np.uint64(8) == hashes).all()

import hashlib
import random

import pytest

from tagweave.llm import substrings


def brute(rows, width=100):
    """rows: [(doc_id, bytes)] in order."""
    first, out = {}, []
    for doc_id, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - width + 1):
            s = text[i : i + width]
            if s in first:
                gone[i : i + width] = b"\x01" * width
            else:
                first[s] = True
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7)))
    shared = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(5)]
    rows = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            x = r.choice(shared)
            a = r.randint(0, len(x) // 3)
            parts += [x[a:], word()]
        rows.append((i * 7 % 90, " ".join(parts)))
    rows += [(200, "x" * 1500), (201, "y" * 99), (202, "x" * 100), (203, "ab" * 400), (204, ""), (205, rows[3][1]), (206, None), (207, "€" * 80)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substrings.B, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substrings, "PIECE_SHARD_BYTES", 2000)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, n_removed long")
        got = sorted((tuple(r) for r in substrings.removed(df, hot_blocks=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
        assert got == brute(sorted((d, (t or "").encode()) for d, t in rows))


def test_nulls_ties_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text, "a", "k"), (1, text, None, "k"), (1, text, "c", None), (2, None, "d", "k")], "doc_id long, text string, source string, kept string")
    out = {(r.doc_id, r.source): (r.text, r.kept) for r in substrings.deduplicated(df).collect()}
    assert out[(None, "a")][0] == "" and out[(2, "d")][0] == ""
    assert sorted(out[(1, x)][0] for x in (None, "c")) == ["", text]
    assert substrings.deduplicated(df).columns == df.columns
    assert substrings.removed(df.limit(0)).count() == 0


def test_other_columns_as_they_are(spark):
    from datetime import date, datetime
    from decimal import Decimal

    text = " ".join(f"w{i}" for i in range(80))
    schema = "doc_id int, text string, at timestamp, `a.b` double, m map<int,string>, s struct<x:array<date>,`y.z`:decimal(20,5)>, rest0 binary, n_bytes string"
    rows = [(i, text, datetime(2024, 1, 2, 3, 4, 5, 123456 + i), 0.1 * i, {i: "v", -1: None}, ([date(2020, 1, 1 + i), None], Decimal("1.23456")), bytes([i, 255]), None) for i in range(4)] + [(None,) * 8]
    df = spark.createDataFrame(rows, schema)
    out = substrings.deduplicated(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r.doc_id: r for r in out.collect()}
    for r in df.collect():
        want = r.asDict(recursive=True) | {"text": text if r.doc_id == 0 else ""}
        assert got[r.doc_id].asDict(recursive=True) == want


def test_a_very_long_text(spark, monkeypatch):
    r = random.Random(4)
    line = " ".join(str(r.randint(0, 10**9)) for _ in range(20))
    body = " ".join(str(r.randint(0, 10**9)) for _ in range(120_000))
    texts = [(1, body + line + body[:5000]), (2, line)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in substrings.removed(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (len(texts[0][1]), 5000, 1), 2: (len(line), len(line), 1)}


def levels(text, alphabet, monkeypatch):
    from tagweave.llm import suffixes

    seen, whole = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t, a: seen.append((len(t), a)) or whole(t, a))
    return suffixes.suffix_array(text, alphabet), seen


def test_a_shard_is_sorted_by_recursion(monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    words = [bytes(r.integers(97, 123, r.integers(2, 9)).astype("u1")) for _ in range(3000)]
    raw = b" ".join(words[i] for i in (r.zipf(1.3, 180_000) % 3000))[:1_000_000]
    text = np.append(np.frombuffer(raw, "u1"), np.uint8(0))
    sa, seen = levels(text, 256, monkeypatch)
    assert len(text) == 1_000_001 and len(seen) >= 4 and seen[1][1] > 2048 and all(b[0] * 2 <= a[0] + 1 for a, b in zip(seen, seen[1:]))
    assert (np.sort(sa) == np.arange(len(text))).all()
    for a, b in zip(sa[1:-1][::97].tolist(), sa[2:][::97].tolist()):
        assert raw[a:] < raw[b:]


def test_suffix_arrays_by_sorting(monkeypatch):
    import numpy as np

    from tagweave.llm import suffixes

    r = np.random.default_rng(1)
    for stretch in (3, 1 << 14):
        monkeypatch.setattr(suffixes, "STRETCH", stretch)
        for n in (1, 2, 7, 60, 700):
            for k in (1, 2, 5, 300, 70_000):
                for t in (r.integers(1, k + 1, n), np.tile(r.integers(1, k + 1, n // 6 + 1), 7)[:n], np.sort(r.integers(1, k + 1, n)), np.sort(r.integers(1, k + 1, n))[::-1]):
                    t = np.append(t, 0)
                    sa = suffixes.suffix_array(t, k + 1)
                    assert sa.tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
                    plcp = suffixes.permuted_common_prefixes(np.ascontiguousarray(t, np.uint32), sa)
                    for a, b in zip(sa[:-1], sa[1:]):
                        x, y = t[a:].tolist(), t[b:].tolist()
                        assert plcp[b] == next(i for i, (p, q) in enumerate(zip(x, y)) if p != q)

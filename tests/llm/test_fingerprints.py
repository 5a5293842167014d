import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from tagweave.llm import fingerprints as P


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=seed)
    return signed(seed)


def brute(text, k):
    words = [signed(xxhash.xxh64_intdigest(w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w), seed=42)) for w in (text or "").encode().split()]
    if not words:
        return []
    grams = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else None
    if grams is None:
        return None
    return sorted({chained(g) for g in grams})[:k]


def test_edited(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["Aé", "b", "CC", "dd", "eee", "f", "ÀB"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "one"), (503, texts[4]), (504, "é" * 9)]
    for n in (P.BLOCK_ROWS, 4):
        P_rows, P.BLOCK_ROWS = P.BLOCK_ROWS, n
        try:
            df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, a string")
            got = {x.doc_id: x for x in P.edited(df, k=16).collect()}
        finally:
            P.BLOCK_ROWS = P_rows
        assert len(got) == len(rows)
        down = sorted(rows, reverse=True)
        for (d, t), (_, nxt) in zip(down, down[1:] + down[:1]):
            t, nxt = t or "", nxt or ""
            m = len(t) // 2
            edit = t[: len(t) - m] + nxt[:m]
            x = got[d]
            assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            a, b, c = brute(t, 16), brute(edit, 16), brute(nxt, 16)
            for have, want in ((x.fingerprint, a), (x.edited_fingerprint, b)):
                if want is not None:
                    assert have == "".join(f"{h & (1 << 64) - 1:016x}" for h in want)
            for near, other in ((x.near_edited, b), (x.near_next, c)):
                assert 0 <= near <= 1
                if a is not None and other is not None:
                    both = sorted({*a, *other})[:16]
                    assert near == (len({*both} & {*a} & {*other}) / len(both) if both else 1.0)
        assert got[503].fingerprint == got[12].fingerprint
    assert P.edited(df.limit(0)).count() == 0


def test_ties_and_missing_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "c d"), (1, "c d"), (1, "e f"), (None, None)], "doc_id long, text string")
    got = P.edited(df).collect()
    assert len(got) == 5 and len({x.fingerprint for x in got if x.n_chars == 3}) == 3


def test_any_ids_and_hot_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(P, "BLOCK_ROWS", 4)
    r = random.Random(8)
    ids = [-(1 << 63), -5, -1, 0, 1, 2, 3, 1 << 40, (1 << 63) - 1] + [7] * 60 + [None] * 40
    rows = [(d, "".join(r.choice("aé,. \x00b") for _ in range(r.randint(0, 9)))) for d in ids] + [(9, "same")] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    down = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = sorted((repr(d), t, nxt) for (d, t), (_, nxt) in zip(down, down[1:] + down[:1]))
    assert sorted((repr(x.doc_id), x.text, x.next_text) for x in P.with_next(df, 8).collect()) == want
    keys = df.select(P.order_key(F.col("doc_id"), F.col("text")).alias("_key")).cache()
    bounds = P.bounds_of(keys, len(rows))
    sizes = [x["count"] for x in keys.groupBy(P.block_of(F.col("_key"), bounds).alias("b")).count().collect()]
    assert P.edited(df, k=8).count() == len(rows)
    # No block holds a hot id, or all copies of a row, whole.
    assert len(sizes) > 8 and max(sizes) < 40
    bounds = sorted(bounds)
    for x in keys.select("_key", P.block_of(F.col("_key"), bounds).alias("b")).collect():
        assert x.b == sum(b <= x["_key"] for b in bounds)


def test_merging_and_estimates(spark):
    words = [f"w{i}" for i in range(4000)]
    a, b, c = " ".join(words[:2000]), " ".join(words[2000:]), " ".join(words[1000:3000])
    df = spark.createDataFrame([("k", a), ("k", b), ("j", c)], "key string, text string").withColumn("s", P.sketch(F.col("text")))
    merged = {x.key: x.s for x in P.merge_groups(df, ["key"], "s").collect()}
    rows = {x.text: x.s for x in df.collect()}
    assert merged["k"] == sorted({*rows[a], *rows[b]})[:128] and merged["j"] == rows[c]
    one = df.where(F.col("text") == a).select(F.col("s").alias("a")).crossJoin(df.where(F.col("text") == c).select(F.col("s").alias("c")))
    x = one.select(P.resemblance(F.col("a"), F.col("c")), P.containment(F.col("a"), F.col("c")), P.distinct_shingles(F.col("a"))).first()
    assert abs(x[0] - 1 / 3) < 0.15 and abs(x[1] - 0.5) < 0.2 and abs(x[2] - 1996) < 500

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tagweave.llm import simhash
from tagweave.llm.components import components


def brute_components(fps):
    labels = list(range(len(fps)))
    def find(i):
        while labels[i] != i:
            i = labels[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                a, b = find(i), find(j)
                labels[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_documents(spark):
    r = random.Random(4)
    base = [[f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 300))] for _ in range(25)]
    texts = ["", None, " \t\n", "one", "two Words", "TWO words"]
    for b in base:
        for _ in range(4):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                if c:
                    c[r.randrange(len(c))] = r.choice(["X", "éa", "zz"])
            texts.append(" ".join(c))
    rows = [(i * 13 % len(texts), t) for i, t in enumerate(texts)] + [(None, "one"), (3, texts[10]), (3, texts[10])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.grouped(df).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    labels = brute_components(fps)
    least = {}
    for (d, _), k in zip(rows, labels):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    assert got == sorted(((d, f, least[k]) for (d, _), f, k in zip(rows, fps, labels)), key=str)
    kept = simhash.keep_first(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(least.values()))
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1
    assert simhash.grouped(df.limit(0)).count() == 0


def test_links_in_clumps(spark):
    r = random.Random(8)
    for spots in (40, 9):
        centre = [r.getrandbits(64) for _ in range(4)]
        bits = r.sample(range(64), spots)
        fps = {c ^ sum(1 << b for b in r.sample(bits, r.randint(0, 5))) for c in centre for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
        fps = sorted(fps)
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        root = {r.node: r.root for r in components(simhash.links(df)).collect()}
        labels = brute_components(fps)
        groups = {}
        for f, k in zip(signed, labels):
            groups.setdefault(k, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def same_groups(got, want):
    pairs = set(zip(got, want))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_keys_of_any_size_go_one_way(spark, monkeypatch):
    """All fingerprints agree in the key of segment 3: its chain is what may link them; keys are parted within tasks and before."""
    r = random.Random(5)
    shift = 64 - 24
    rotate = lambda f, n: (f << n | f >> (64 - n)) & (1 << 64) - 1 if n else f
    for half in range(2):
        fixed = 0xABCD << 48 | 0x5A5 << (36 - 12 * half)
        free = [b for b in range(48) if not 36 - 12 * half <= b < 48 - 12 * half]
        rings = {fixed ^ sum(1 << b for b in r.sample(free, r.randint(0, 4))) for _ in range(220)} | {fixed ^ sum(1 << b for b in r.sample(free, 9)) for _ in range(60)}
        fps = sorted(rotate(f, shift) for f in rings)
        x = np.array(fps, np.uint64)
        labels = brute_components(fps)
        key = (3 * 2 + half) << 28 | 0xABCD << 12 | 0x5A5
        assert sorted(b for bits in simhash.open_bits(key, 0) for b in bits) == [b for b in range(64) if not fixed_bit(half, b)]
        for small in (64, 8):
            monkeypatch.setattr(simhash, "SMALL", small)
            a, b = simhash.link_keys(np.full(len(x), key), np.zeros(len(x), np.int64), x)
            root = dict(zip(a.tolist(), b.tolist()))
            linked = [root.get(f, f) for f in fps]
            # Links of one key are never wrong, and pairs whose chain begins there aren't missed.
            assert all(labels[fps.index(p)] == labels[fps.index(q)] for p, q in root.items())
            i, j = (v.ravel() for v in np.meshgrid(np.arange(len(x)), np.arange(len(x))))
            near = simhash.ring_diff(x[i], x[j], np.full(len(i), 3))
            assert all(linked[p] == linked[q] for p, q in zip(i[near].tolist(), j[near].tolist()))
        monkeypatch.setattr(simhash, "SMALL", 64)
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        df = spark.createDataFrame([(f,) for f in signed], "fp long")
        for hot in (4096, 5):
            monkeypatch.setattr(simhash, "HOT_ROWS", hot)
            found = {q.node: q.root for q in components(simhash.links(df)).collect()}
            assert same_groups([found.get(f, f) for f in signed], labels)


def fixed_bit(half, bit):
    """Whether a key of segment 3 fixes a bit."""
    ring = (bit + 24) % 64
    return ring >= 48 or 36 - 12 * half <= ring < 48 - 12 * half


def test_columns_with_any_name_and_repeated_ids(spark):
    rows = [(1, "one two three four", 5, "x", {1: "a"}), (1, "quite another text of it", 6, "y", None), (1, "one two three four", 5, "x", {2: "b"}), (2, None, None, "z", None), (None, "", 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, _kept int, `a.b` string, m map<int,string>").withColumn("digest", F.lit("d")).withColumn("found", F.lit(1))
    a, b = (simhash.keep_first(x).collect() for x in (df, df.repartition(3)))
    assert simhash.keep_first(df).schema.simpleString() == df.schema.simpleString()
    assert sorted((str(r.doc_id), r._kept, r["a.b"], r.digest) for r in a) == sorted((str(r.doc_id), r._kept, r["a.b"], r.digest) for r in b)
    assert sorted(str(r.doc_id) for r in a) == ["1", "2", "None"] or sorted(str(r.doc_id) for r in a) == ["1", "None"]


def test_chain_of_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100}

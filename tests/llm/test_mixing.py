import random
import re

from tagweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, share, epochs):
    """Targets by repeated clamping."""
    total, targets, free = share * sum(sizes), {}, set(range(len(sizes)))
    while free:
        rest = total - sum(targets.values())
        w = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > epochs * sizes[i]]
        for i in over or free:
            targets[i] = epochs * sizes[i] if over else rest * weights[i] / w
        free -= set(over) if over else free
    return [targets[i] for i in range(len(sizes))]


def test_targets_by_repeated_clamping(spark):
    r = random.Random(3)
    for n in (1, 2, 5, 9):
        sizes = [r.choice([0, 5, 50, 1000, 20000]) for _ in range(n)]
        names = sorted(f"s{i}é" for i in range(n - 1))
        rows = [*zip(names, sizes), (None, sizes[-1])]
        got = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2.0)
        for (name, _), t in zip(rows, want):
            assert abs(got[name] - t) < 1e-6 * max(1, t)


def test_mix_and_repeat(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{j}" for j in range(r.randint(0, 40))) + r.choice(["", " ", "\n"]), r.choice(["a", "b", "c", None]), i) for i in range(400)]
    rows += [(400, None, "a", 1), (None, "x y", "a", 2), (5, rows[5][1], rows[5][2], 3), (5, rows[5][1], rows[5][2], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.mix(df)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(x.size == len(WORD.findall(x.text or "")) and 0 <= x.taken <= 2 * x.size for x in got)
    by = {}
    for x in got:
        by.setdefault(x.source, []).append(x)
    for xs in by.values():
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= 0.5 and xs[0].source_size == sum(x.size for x in xs)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    mixed = mixing.repeat(out).collect()
    words = {}
    for x in mixed:
        words[x.doc_id, x.source] = words.get((x.doc_id, x.source), 0) + len(WORD.findall(x.text))
    want = {}
    for x in got:
        if x.taken:
            want[x.doc_id, x.source] = want.get((x.doc_id, x.source), 0) + x.taken
    assert words == want
    assert mixing.mix(df.limit(0)).count() == 0


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(x.taken, x.target) for x in mixing.mix(df).collect()} == {(0, 0.0)}


def plain_taken(rows, weights=(5, 2, 1)):
    """What the mix takes of (source, place) rows, all in one list."""
    import hashlib

    sizes = {}
    for i, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda x: (x is None, x))
    targets = dict(zip(names, fill([sizes[n] for n in names], [weights[i % 3] for i in range(len(names))], 1.5, 2.0)))
    out = []
    for n in names:
        whole = int(targets[n] // sizes[n]) if sizes[n] else 0
        left = round(targets[n] - whole * sizes[n])
        own = [(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest(), len(WORD.findall(t or "")), i) for i, t, s in rows if s == n]
        for _, size, i in sorted(own, key=lambda r: r[:2]):
            out.append((str(i), str(n), size, whole * size + max(0, min(size, left))))
            left -= size
    return sorted(out)


def test_repeated_rows_and_null_ids_by_brute_force(spark):
    r = random.Random(8)
    text = lambda n: " ".join(["w"] * n)
    rows = [(None, text(r.randint(0, 9)), "hot") for _ in range(150)] + [(7, text(5), "copies")] * 90 + [(i, text(r.randint(1, 9)), "rest") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in got) == plain_taken(rows)


def test_pieces_are_looked_into_digit_by_digit(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 7)), "ab"[i % 3 == 0]) for i in range(300)]
    monkeypatch.setattr(mixing, "PIECE_ROWS", 0)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in got) == plain_taken(rows)


def test_columns_with_any_name(spark):
    rows = [(i, "a b c", "s", i, str(i), -i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int, `a.b` string, _take int").withColumnRenamed("place", "of")
    out = mixing.mix(df)
    assert out.columns[:6] == df.columns and sorted((x.doc_id, x.of, x["a.b"], x._take) for x in out.collect()) == [(i, i, str(i), -i) for i in range(9)]
    assert {(x.of, x["a.b"], x._take) for x in mixing.repeat(out).collect()} <= {(i, str(i), -i) for i in range(9)}


def test_words_are_counted_as_by_the_pattern(spark):
    from tagweave.llm.common import word_count

    texts = ["", " ", "a", " a ", "a\tb\nc\x0bd\x0ce\rf", "é x  y", "\n\nx", "x\n", "𝄞 𝄞𝄞 ", None, "w " * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.n for x in df.select("i", word_count(df.t).alias("n")).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}

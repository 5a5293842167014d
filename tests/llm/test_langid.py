from pyspark.sql import functions as F

from tagweave.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = L.held_out(F.col("doc_id"))
    model = L.fit(docs.where(~held))
    rows = L.identify(docs, model).where(held).collect()
    assert all(L.held_out_py(r.doc_id) for r in rows) and len(rows) > 150
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert right > 0.93 and all(0 <= r.score <= 1 for r in rows)


def test_defined_results(spark):
    words = {"en": "the house and the water were there with", "de": "das haus und der garten ist nicht schön", "fr": "la maison et les eaux étaient très belles", "es": "la casa y el agua están muy señor niño"}
    rows = [(i, " ".join(w.split()[k % 5 :] * 3), g, "s") for g, w in words.items() for i, k in enumerate(range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.fit(df)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "x" * 200_000), (5, words["de"]), (5, words["de"]), (None, words["fr"] + "\x00"), (7, "ДОМ"), (8, words["en"] + "\ud7ff")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[5][0] == "de" and got[None][0] == "fr" and got[8][0] == "en" and got[7][0] in words
    assert L.identify(df, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert L.identify(odd.limit(0), model).count() == 0
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.identify(odd, none).collect()} == {"und"}
    kept = L.keep_known(df.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("score"))))
    assert kept.columns == df.columns and kept.where("text is null or text = '' or text = '123 !!'").count() == 0 and kept.count() == len(rows) + 6


def test_one_text_counts_the_same_anywhere():
    texts = ["Das Haus", "la maison été", "x", "The end\n of it"]
    single, triple, starts = L.binned(texts)
    for i, t in enumerate(texts):
        a, b = starts[i], starts[i + 1] if i + 1 < len(texts) else len(single)
        one_s, one_t, _ = L.binned([t])
        assert list(single[a:b]) == list(one_s[: b - a]) and list(triple[a : b - 1]) == list(one_t[: b - a - 1])


def test_columns_with_any_name(spark):
    from datetime import datetime

    rows = [(i, w, g, 5, "x", datetime(2024, 1, 1, 0, 0, 0, 7 + i), {i: "v"}) for i, (w, g) in enumerate([("the house and the water", "en"), ("das haus und der garten", "de"), ("the people of the town", "en"), ("die leute in der stadt", "de"), (None, "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string, `a.b` timestamp, m map<int,string>")
    kept = L.keep_known(df, least=0.0)
    assert kept.schema.simpleString() == df.schema.simpleString() and sorted(map(str, kept.collect())) == sorted(map(str, df.where("text is not null").collect()))


def plain_decide(classes, margins):
    """Votes of all pairs, one row at a time; ties go to the larger sum of margins, then to the smaller name."""
    out = []
    for row in margins:
        votes, sums = {c: 0 for c in classes}, {c: 0.0 for c in classes}
        for m, (a, b) in zip(row, [(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]]):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        out.append(min(classes, key=lambda c: (-votes[c], -sums[c], c)))
    return out


def test_decisions_and_predictions_by_brute_force():
    import numpy as np

    r = np.random.default_rng(3)
    for k in (1, 2, 3, 5):
        classes = [f"l{i}" for i in range(k)]
        m = L.Machines(classes, np.zeros((L.BINS, k * (k - 1) // 2), np.float32), np.zeros(k * (k - 1) // 2))
        margins = np.concatenate([r.normal(0, 2, (200, k * (k - 1) // 2)), r.integers(-1, 2, (100, k * (k - 1) // 2))])
        best, sure = m.decide(margins)
        assert [classes[b] for b in best] == plain_decide(classes, margins) and ((0 <= sure) & (sure <= 1)).all()
    words = {"en": "the house and water were there", "de": "das haus und der garten nicht", "fr": "la maison et les eaux étaient", "es": "la casa y el agua están", "xx": "qwz kkj zzt vvp"}
    rng = np.random.default_rng(4)
    texts, langs = zip(*[(" ".join(rng.choice(w.split(), 8)), g) for g, w in words.items() for _ in range(30)])
    model = L.Model.fit(np.stack([L.features(t) for t in texts]), list(langs))
    asked = [" ".join(rng.choice(" ".join(words.values()).split(), 9)) for _ in range(60)] + ["", "1 2", None]
    got, score = model.predict(asked)
    for t, g, s in zip(asked, got, score):
        if not L.has_letter(t):
            assert (g, s) == ("und", 0.0)
            continue
        x = L.features(t).astype(np.float64)
        name = plain_decide(model.families.classes, [x @ model.families.weights + model.families.bias])[0]
        within = model.within[name]
        assert g == plain_decide(within.classes, [x @ within.weights + within.bias])[0]

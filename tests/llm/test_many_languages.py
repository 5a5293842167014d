from tagweave.llm import langid as L


def test_each_labelled_language_is_learned(spark):
    """60 languages, each of its own letter; those of few rows too."""
    langs = [f"x{i:02d}" for i in range(60)]
    text = {g: chr(0x0561 + i if i < 38 else 0x10D0 + i - 38) * 12 for i, g in enumerate(langs)}
    rows = [(100 * i + k, text[g], g) for i, g in enumerate(langs) for k in range(2 if i >= 48 else 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert sorted({c for m in model.within.values() for c in m.classes}) == langs
    got = {(r.lang, r.lang_pred) for r in L.identify(df, model).collect()}
    assert got == {(g, g) for g in langs}

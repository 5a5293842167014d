import random

import corpus_pipeline as P


def docs(spark):
    r = random.Random(12)
    vocabulary = {"en": "the and with house water there would people".split(), "de": "der und mit haus wasser nicht würde schön".split()}
    rows = []
    for i in range(120):
        lang = r.choice(["en", "de"])
        words = [r.choice(vocabulary[lang]) + str(r.randint(0, 99)) for _ in range(r.randint(5, 150))]
        rows.append([i, " ".join(words), lang, r.choice(["a", "b", None]), 7])
    for i in range(120, 140):
        rows.append([i, rows[i - 120][1] + (" extra" if i % 2 else ""), "en", "a", 7])
    rows += [[140, None, "en", "a", None], [141, "12 34", None, None, 5], [142, "", "de", "b", 0], [None, rows[0][1], "en", "a", 1]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    from tagweave.llm import simhash

    d = docs(spark)
    assert [s for s, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "token_packing"]
    kept = P.language_id(spark, d, "").cache()
    assert kept.columns == d.columns and {x.doc_id for x in d.collect()} - {x.doc_id for x in kept.collect()} == {140, 141, 142}
    one = P.simhash_near_dedup(spark, kept, "").cache()
    groups = {x.doc_id: x.component_id for x in simhash.grouped(kept).collect()}
    assert sorted(x.doc_id for x in one.collect() if x.doc_id is not None) == sorted({v for v in groups.values()})
    cut = P.suffix_array_dedup(spark, one, "").cache()
    assert cut.columns == d.columns and cut.count() == one.count() and all(x.n_chars == len(x.text) for x in cut.collect())
    mixed = P.source_mixing(spark, cut, "").cache()
    words = lambda rows: sum(len(x.text.split()) for x in rows)
    assert mixed.columns == d.columns and abs(words(mixed.collect()) - 1.5 * words(cut.collect())) <= 2
    pieces = P.token_packing(spark, mixed, "").collect()
    assert sum(x.length for x in pieces) >= mixed.count()


def test_empty(spark):
    d = docs(spark).limit(0)
    for _, stage in P.STAGES:
        d = stage(spark, d, "")
        assert d.count() == 0

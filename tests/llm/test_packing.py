import zlib

import numpy as np
import pytest

from tagweave.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Héllo WORLD, it's fine.\nNew line\ttab  two spaces %%% $$$!! <|endoftext|> x<|startoftext|>y",
    "", None, "İstanbul ΣΑΣ ǅ ﬁ é ́x ½ a.b,c 12345 don't we'll", " wide space\x1fz", "short", "short",
    " ".join(f"Word{i}x lorem, IPSUM. Straße" for i in range(4000)), "a" * 5000, "。日本語 テスト",
]


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(TEXTS)] + [(None, "none", 5)], "doc_id long, text string, length long")
    rows = packing.pack(df, path).collect()
    for i, text in [*enumerate(TEXTS), (None, "none")]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == parts[0][2] and at & (at - 1) == 0 and at <= 4096
    assert packing.pack(df.limit(0), path).count() == 0


def test_plan_is_whole_for_any_lengths():
    r = np.random.default_rng(3)
    for _ in range(300):
        lengths = r.integers(1, r.choice([3, 40, 300]), r.integers(1, 30)).tolist()
        parts = sorted((d, s, n) for _, w in packing.plan_block(lengths, 64, 8) for d, s, n in w)
        at = {}
        for d, s, n in parts:
            assert s == at.get(d, 0) and n > 0
            at[d] = s + n
        assert at == dict(enumerate(lengths))
        assert all(sum(n for _, _, n in w) == size and size & (size - 1) == 0 and size <= 64 for size, w in packing.plan_block(lengths, 64, 8))

import hashlib
import tarfile
import zlib

from tagweave.llm import media as M


def test_stored_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 20_000)
    texts = ["", None, "a", "é" * 40, "x" * 64, "y" * 100_000, "same", "same"] + [f"text {i} " * i for i in range(60)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "same", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = M.media_columns(df).collect()
    assert len(got) == len(rows)
    by_text = {}
    for x in got:
        text = "same" if x.doc_id is None else texts[x.doc_id] or ""
        data = text.encode()
        payload = M.padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert (x.n_bytes, x.payload_bytes) == (len(data), len(payload))
        assert x.payload_sha256 == x.digest == hashlib.sha256(payload).hexdigest() and x.tail_crc32 == zlib.crc32(payload[-64:])
        assert (x.width, x.height) == (64, len(payload) // 64)
        assert by_text.setdefault(text, (x.media_sha256, x.feature, x.shard, x.offset)) == (x.media_sha256, x.feature, x.shard, x.offset)
    assert M.media_columns(df.limit(0)).count() == 0
    stored, folder = M.store(df)
    files, root = M.file_system(folder)
    row = stored.where("doc_id = 5").first()
    with tarfile.open(f"{root}/{row.shard}") as tar:
        entry = tar.getmember(f"{row.digest}.png")
        assert (entry.offset_data, entry.size) == (row.offset, row.media_bytes)
        assert M.decode_png(tar.extractfile(entry).read()) == M.padded(b"y" * 100_000)


def test_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(M, "MANY_ROWS", 3)
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(60)] + [(None, "hot"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = M.media_columns(df).collect()
    want = sorted((str(i), hashlib.sha256(M.padded((t or "").encode())).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), x.payload_sha256) for x in got) == want
    for x in got:
        media = M.encode_png(M.padded(("hot" if x.payload_sha256 == hashlib.sha256(M.padded(b"hot")).hexdigest() else (f"t{x.doc_id}" if x.doc_id is not None else "")).encode()))
        assert x.media_sha256 == hashlib.sha256(media).hexdigest() and x.media_bytes == len(media)
        p = M.decode_png(media)
        mean = sum(p) / len(p)
        bands = [sum(b >> 4 == k for b in p) * 1000 // len(p) for k in range(16)]
        deviation = (sum((b - mean) ** 2 for b in p) / len(p)) ** 0.5
        assert x.feature == f"{mean:.3f},{deviation:.3f}," + ",".join(map(str, bands))

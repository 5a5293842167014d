"""Media columns: content-addressed payloads in tar shards.

Every task writes its distinct payloads, as 8-bit grey PNG images 64 samples
wide, to tar shards in the shared folder. Rows carry the payload's digest and
the shard, offset and length at which its bytes stand. A shard holds a payload
once; if several shards do, one copy becomes the canonical one that all rows
name (to store one copy in all would move every payload once more). Shards
stand in the shared folder for as long as the rows are to be read: removing
the folder that store() gives is the caller's. Metadata columns are filled by
range reads of the first 33 bytes (signature and IHDR), features by reading
whole payloads, each once.

Defined results: a null text is empty; an empty text is one row of 64 zeros;
texts of any length are stored whole; equal texts share a payload; repeated
rows and null ids give rows of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, modest_batches, partitions, shared_dir

WIDTH = 64
#: A shard is closed at this size, and a worker gathers as much before it writes.
SHARD_BYTES = 16_000_000
#: Digests of more rows are joined by a broadcast, MOST_HOT of them at most: with more rows the bound rises.
MANY_ROWS, MOST_HOT = 256, 10_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, media_bytes long"
READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string, width int, height int"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Grey 8-bit PNG; every row has filter 0."""
    import numpy as np

    rows = np.frombuffer(payload, "u1").reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), "u1")
    raw[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int]:
    """(width, height) from the first HEADER_BYTES."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">II", data[16:24])


def decode_png(data: bytes) -> bytes:
    import numpy as np

    width, height = png_header(data)
    at, body = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(height, width + 1)[:, 1:].tobytes()


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def write_shards(batches: Iterator, folder: str) -> Iterator:
    """Each distinct payload of a shard once. Attempts at a task write shards of their own; rows only name shards that were closed."""
    import pandas as pd

    files, root = file_system(folder)
    rows: list = []
    tar_bytes = io.BytesIO()
    tar, known, name, count = tarfile.open(fileobj=tar_bytes, mode="w", format=tarfile.GNU_FORMAT), {}, "", 0

    def close():
        nonlocal tar_bytes, tar, known, rows, name, count
        name = f"shard-{TaskContext.get().partitionId():06d}-{count:05d}-{TaskContext.get().taskAttemptId()}.tar"
        count += 1
        tar.close()
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(tar_bytes.getbuffer())
        done = pd.DataFrame([(*r[:3], name, *known[r[2]]) for r in rows], columns=[x.split()[0] for x in STORED.split(", ")])
        done["doc_id"] = done["doc_id"].astype("Int64")
        tar_bytes, known, rows = io.BytesIO(), {}, []
        tar = tarfile.open(fileobj=tar_bytes, mode="w", format=tarfile.GNU_FORMAT)
        return done

    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = data.as_py() or b""
            digest = hashlib.sha256(padded(data)).hexdigest()
            if digest not in known:
                media = encode_png(padded(data))
                entry = tarfile.TarInfo(f"{digest}.png")
                entry.size = len(media)
                tar.addfile(entry, io.BytesIO(media))
                size = len(media)
                known[digest] = (tar.offset - size - (-size % tarfile.BLOCKSIZE), size)
            rows.append((doc_id, len(data), digest))
            if tar.offset >= SHARD_BYTES or len(rows) >= 100_000:
                yield close()
    if rows:
        yield close()


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """(rows of STORED, the folder of their shards). Written once, at the call."""
    import pyarrow as pa

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)

    def work(batches):
        for done in write_shards(batches, folder):
            yield pa.RecordBatch.from_pandas(done, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("media_bytes", pa.int64())]), preserve_index=False)

    modest_batches(spark)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(work, STORED)
    return cut(rows), folder


def canonical(stored: DataFrame) -> DataFrame:
    """One place for each digest, and how many rows have it."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "media_bytes")).alias("at"), F.count(F.lit(1)).alias("copies")).select("digest", "at.*", "copies")


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """READ for each of canonical()'s rows: the header by a range read, then the payload and its features."""

    def work(frames):
        import numpy as np
        import pandas as pd

        files, root = file_system(folder)
        opened, name = None, None
        for f in frames:
            rows = []
            for digest, shard, offset, size in zip(f["digest"], f["shard"], f["offset"], f["media_bytes"]):
                if shard != name:
                    opened, name = files.open_input_file(f"{root}/{shard}"), shard
                width, height = png_header(opened.read_at(min(HEADER_BYTES, int(size)), int(offset)))
                media = opened.read_at(int(size), int(offset))
                payload = decode_png(media)
                x = np.frombuffer(payload, "u1")
                # Shares of 16 grey bands, in thousandths, after mean and deviation.
                bands = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
                feature = f"{x.mean():.3f},{x.std():.3f}," + ",".join(map(str, bands))
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest(), feature, width, height))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])

    dealt = places.repartition(partitions(places.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    return dealt.mapInPandas(work, READ)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its payload's place, header and features."""
    stored, folder = store(docs, id_col=id_col, text_col=text_col)
    places = canonical(stored)
    bound = max(MANY_ROWS, stored.count() // MOST_HOT)
    hot = cut(places.where(F.col("copies") > bound))
    rows = stored.select("doc_id", "n_bytes", "digest")
    told = lambda some: some.drop("copies").join(read_back(some.drop("copies"), folder), "digest")
    if hot.isEmpty():
        rows = rows.join(told(places), "digest")
    else:  # over bound rows each, so MOST_HOT digests at most: what is read of them is broadcast, and their rows stay in place
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(told(places.where(F.col("copies") <= bound)), "digest")
        rows = rows.join(F.broadcast(told(hot)), "digest").unionByName(rest)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset")

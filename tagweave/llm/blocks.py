"""Blocks of documents and the hashes that several of them hold.

Two passes over the same blocks find what recurs in a corpus without moving
what doesn't: each block sends the distinct hashes of its anchors, six bytes
each, to the hashes' shards; a shard answers each block with a mask of those
that other blocks hold too. A hash crosses once a block, however often it
occurs there.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, release_memory

#: Bytes of text a block is planned for.
BLOCK_BYTES = 2_000_000
#: A hash in more blocks than this is hot: what hangs on it is spread over shards in finer parts.
HOT_BLOCKS = 20_000
#: Stands for a missing id, after all ids.
NO_ID = (1 << 63) - 1
MASKS = "block long, shard long, mask binary, hot binary"


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(column(text_col)) + F.lit(1))).first()[0] or 0


def blocked(docs: DataFrame, id_col: str, text_col: str, size: int, partitions: int, rest: list[str] = ()) -> DataFrame:
    """(block, doc_id, has_id, data, tie, rest0, rest1 and so on): rows with equal ids share a block, rows without an id are dealt by their text.

    rest: other columns, which are passed on as they are; tie: a digest of them, which orders rows that are alike.
    """
    data, doc_id = F.coalesce(column(text_col).cast("binary"), F.lit(b"")), column(id_col).cast("long")
    blocks = max(1, -(-size // BLOCK_BYTES))
    at = F.pmod(F.xxhash64(F.coalesce(doc_id, F.xxhash64(data))), F.lit(blocks)).cast("long")
    told = [column(c) for c in rest if "map<" not in docs.schema[c].dataType.simpleString()]
    tie = F.xxhash64(*told) if told else F.lit(0).cast("long")
    others = [column(c).alias(f"rest{i}") for i, c in enumerate(rest)]
    return docs.select(at.alias("block"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), doc_id.isNotNull().alias("has_id"), data.alias("data"), tie.alias("tie"), *others).repartition(partitions, "block")


class Block:
    """A block's documents in the order of ids (none last), then texts, in one buffer. order: their rows in the table."""

    def __init__(self, f: pd.DataFrame):
        rows = sorted(zip(f["doc_id"].tolist(), (not x for x in f["has_id"]), map(bytes, f["data"]), f["tie"].tolist() if "tie" in f else repeat(0), count()))
        self.order_ids = [r[0] for r in rows]
        self.doc_ids = [None if r[1] else r[0] for r in rows]
        self.texts = [r[2] for r in rows]
        self.order = [r[4] for r in rows]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)])
        self.buffer = b"".join(self.texts)


def shard_blobs(block: int, hashes: np.ndarray, shards: int, pack: Callable[[np.ndarray], bytes] | None = None) -> pd.DataFrame:
    """A row for each shard that has some of the block's distinct hashes. pack: how they are written, if not as short does."""
    pack = pack or (lambda h: short(h).tobytes())
    parts = split_shards(hashes, shards)
    return pd.DataFrame({"block": block, "shard": [s for s, _ in parts], "blob": [pack(h) for _, h in parts]}, columns=["block", "shard", "blob"])


def distinct(x: np.ndarray) -> np.ndarray:
    """Values in order, each once; sorting takes less here than a table of hashes."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def split_shards(hashes: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """[(shard, its distinct hashes, sorted)]"""
    hashes = distinct(hashes)
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    # Numbers of 16 bits are sorted by radix.
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [(int(shard[order[a]]), hashes[order[a:b]]) for a, b in zip(edges, np.append(edges[1:], len(order)))]


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper six bytes of each; two that agree in them and the shard only pass for shared."""
    return hashes.astype(">u8").view("u1").reshape(-1, 8)[:, :6]


def long(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), "u1")
    wide[:, 2:] = np.frombuffer(blob, "u1").reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def tight(hashes: np.ndarray) -> bytes:
    """The upper four bytes of sorted hashes as steps, compressed. Of a shard of 4 million, one in a thousand passes for shared by them alone."""
    steps = np.diff((hashes >> np.uint64(32)).astype("<u4"), prepend=np.uint32(0))
    return len(steps).to_bytes(8, "little") + pa.compress(steps.view("u1").reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def loose(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    steps = np.frombuffer(pa.decompress(blob[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), "u1").reshape(4, n).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint64)


def shared_masks(blobs: DataFrame, hot_blocks: int = HOT_BLOCKS, unpack: Callable[[bytes], np.ndarray] = long) -> DataFrame:
    """MASKS for (block, shard, blob): which of a blob's hashes other blocks hold too, and which of them are hot."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        known, counts = np.unique(np.concatenate([distinct(unpack(b)) for b in f["blob"]]), return_counts=True)
        n = [counts[np.searchsorted(known, unpack(b))] for b in f["blob"]]
        return pd.DataFrame({"block": f["block"], "shard": f["shard"], "mask": [np.packbits(x > 1).tobytes() for x in n], "hot": [np.packbits(x > hot_blocks).tobytes() if (x > hot_blocks).any() else b"" for x in n]})

    return blobs.groupBy("shard").applyInPandas(work, MASKS)


def shared_hashes(hashes: np.ndarray, masks: pd.DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes that other blocks hold, those of them that are hot) from a block's hashes and its answers."""
    answers = {s: (m, h) for s, m, h in zip(masks["shard"], masks["mask"], masks["hot"])}
    found, hot = [hashes[:0]], [hashes[:0]]
    for shard, part in split_shards(hashes, shards):
        mask, hots = answers[shard]
        found.append(part[np.unpackbits(np.frombuffer(mask, "u1"), count=len(part)).astype(bool)])
        if len(hots):
            hot.append(part[np.unpackbits(np.frombuffer(hots, "u1"), count=len(part)).astype(bool)])
    return np.sort(np.concatenate(found)), np.sort(np.concatenate(hot))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def arrow_schema(schema: T.StructType | str) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return schema, to_arrow_schema(schema)


def documents(table: pa.Table) -> pd.DataFrame:
    """What Block takes of a block's table; other columns stay where they are."""
    return table.select(["doc_id", "has_id", "data", "tie"]).to_pandas()


def map_blocks(blocks: DataFrame, work: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    returned, types = arrow_schema(schema)

    def one(key, table):
        return tidy(pa.Table.from_pandas(work(key[0].as_py(), documents(table)), schema=types, preserve_index=False))

    return blocks.groupBy("block").applyInArrow(one, returned)


def map_blocks_with(blocks: DataFrame, more: DataFrame, work: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rest: T.StructType = T.StructType()) -> DataFrame:
    """Each block with its rows of more. With rest, work also gives, as a second result, the rows of the block's table whose other columns go with its own."""
    returned, types = arrow_schema(schema)
    others = [f"rest{i}" for i in range(len(rest))]

    def one(key, table, g):
        f = documents(table)
        if not others:
            return tidy(pa.Table.from_pandas(work(key[0].as_py(), f, g.to_pandas()), schema=types, preserve_index=False))
        found, order = work(key[0].as_py(), f, g.to_pandas())
        out = pa.Table.from_pandas(found, schema=types, preserve_index=False)
        for name, values in zip(others, table.select(others).take(pa.array(order, pa.int64())).columns):
            out = out.append_column(name, values)
        return tidy(out)

    fields = [T.StructField(n, x.dataType) for n, x in zip(others, rest.fields)]
    return blocks.groupBy("block").cogroup(more.groupBy("block")).applyInArrow(one, T.StructType([*returned.fields, *fields]))


GROUPS = count(1)


def tidy(result):
    """A group's result; after some groups, what it took to make them goes back to the system."""
    if next(GROUPS) % 4 == 0:
        release_memory()
    return result


def empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")})

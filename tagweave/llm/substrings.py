"""Suffix-array dedup: removal of long byte strings that occurred before.

A byte goes if some string of WIDTH bytes over it also starts earlier: in a
document with a smaller id, or earlier in its own. Strings never cross
documents and are judged on the input.

1. Each string of WIDTH bytes has an anchor: its GRAM bytes with the smallest
   hash, the first of equals. Equal strings have equal anchors, so a string
   can only recur where its anchor's hash does. Two passes over blocks of
   documents find those hashes (see blocks).
2. The strings that share an anchor are one piece of text. A block removes
   pieces that it has had before and sends the others, if their hash recurs,
   to the hash's shard. Pieces of hot anchors go string by string.
3. A shard joins its distinct pieces and sorts their suffixes by induced
   sorting. Neighbours whose permuted common prefix has WIDTH bytes are the
   same string; all but its first place are removed.
4. The spans go back to the blocks, which cut them from the texts.

Only the hashes of anchors, shared pieces and spans move, and the texts once,
to the blocks. Equal pieces are pre-aggregated, within a block and again
within a shard: a text stands once in what is sorted, for all of its places,
so that thousands of copies weigh no more than one. What of different pieces
is equal, the suffix array tells.

Defined results: a null text is empty and keeps nothing; texts shorter than
WIDTH are kept; very long texts are cut into stretches for hashing only, which
overlap, so they are treated as any other; rows with equal ids follow each
other in the order of texts, then of a digest of other columns, rows without
an id stand after all others; repeated rows lose what the first of them keeps;
an empty table gives no rows; other columns are passed on by deduplicated(),
of any name and type that Arrow has, and ignored by removed().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .common import modest_batches, partitions
from .suffixes import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 100, 32
#: Bytes of the corpus for each shard of pieces and of hashes.
PIECE_SHARD_BYTES, HASH_SHARD_BYTES = 1_000_000, 16_000_000
#: Places are ordered by document (ids, of blocks where there is none, and rows in their block), then start.
PLACE = [("doc", "<i8"), ("block", "<i8"), ("row", "<i4"), ("start", "<i4")]
SPAN = np.dtype([*PLACE, ("end", "<i4")])
PIECE = np.dtype([*PLACE, ("size", "<i4")])
PIECES = "pshard long, pieces binary, data binary, spans binary"
SPANS = "block long, spans binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def gram_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position on."""
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h, size, factor = table[np.frombuffer(data, "u1")], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        if len(h) <= size:
            return h[:0]
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if width > size else keys


def anchored(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string's start, number of strings, anchor's hash) of a block's pieces; starts count from the buffer's."""
    docs, firsts, counts, hashes = [], [], [], []
    # Stretches are short enough for 24 bits of position in the keys.
    step = 1 << 21
    n = len(block.buffer)
    for at in range(0, n, step):
        part = block.buffer[at : at + step + WIDTH - 1]
        if len(part) < WIDTH:
            break
        h = gram_hashes(part)
        keys = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        anchor = (window_minima(keys, WIDTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(anchor), dtype=np.int64) + at
        doc = np.searchsorted(block.starts, start, side="right") - 1
        valid = start + WIDTH <= block.starts[doc + 1]
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:] == doc[:-1]))
        first = np.flatnonzero(new)
        # A piece ends before the next or at its document's last string.
        end = np.minimum(np.append(first[1:], len(anchor)), block.starts[doc[first] + 1] - WIDTH + 1 - at)
        docs.append(doc[first])
        firsts.append(first + at)
        counts.append(end - first)
        hashes.append(h[anchor[first]])
    if not docs:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in (docs, firsts, counts, hashes))


def send_hashes(key: int, f: pd.DataFrame, shards: int) -> pd.DataFrame:
    return B.shard_blobs(key, anchored(B.Block(f))[3], shards)


def send_pieces(key: int, f: pd.DataFrame, masks: pd.DataFrame, shards: int, piece_shards: int) -> pd.DataFrame:
    block = B.Block(f)
    doc, first, count, h = anchored(block)
    shared, hot = B.shared_hashes(h, masks, shards)
    # Hashes that the block holds twice are shared within it.
    order = np.sort(h)
    shared = np.union1d(shared, order[1:][order[1:] == order[:-1]])
    chosen = np.flatnonzero(B.is_in(h, shared))
    is_hot = B.is_in(h[chosen], hot)
    seen: set[bytes] = set()
    spans: list[tuple] = []
    out: dict[int, tuple[list, list]] = {}
    data = block.buffer
    for i, many in zip(chosen.tolist(), is_hot.tolist()):
        d, a, n = int(doc[i]), int(first[i]), int(count[i])
        base, order_id = int(block.starts[d]), block.order_ids[d]
        for at, strings in zip(range(a, a + n), (1,) * n) if many else ((a, n),):
            text = data[at : at + strings + WIDTH - 1]
            if text in seen:
                spans.append((order_id, key, d, at - base, at - base + len(text)))
                continue
            seen.add(text)
            shard = (int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") if many else int(h[i])) % piece_shards
            pieces, texts = out.setdefault(shard, ([], []))
            pieces.append((order_id, key, d, at - base, len(text)))
            texts.append(text)
    rows = [(s, np.array(p, PIECE).tobytes(), b"".join(t), b"") for s, (p, t) in out.items()]
    if spans:  # on their way through a shard that has no work with them
        rows.append((key % piece_shards, b"", b"", merged(np.array(spans, SPAN)).tobytes()))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])


def by_place(x: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """The order of places, or of those within equal values of before."""
    return np.lexsort((x["start"], x["row"], x["block"], x["doc"], *before))


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each row, overlapping and touching ones joined."""
    spans = spans[by_place(spans)]
    if not len(spans):
        return spans
    row = np.cumsum(np.append(False, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["block"][1:] != spans["block"][:-1]) | (spans["row"][1:] != spans["row"][:-1])))
    # Each row's spans are moved behind those of the row before it, so that ends grow from row to row.
    far = np.int64(1 << 33)
    reach = np.maximum.accumulate(spans["end"] + row * far)
    new = np.append(True, spans["start"][1:] + row[1:] * far > reach[:-1])
    out = spans[new].copy()
    out["end"] = (reach - row * far)[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    return out


def repeated_strings(texts: list[bytes], places: np.ndarray) -> np.ndarray:
    """SPANs of all strings in distinct texts that also start at an earlier place. places: PIECE for each text."""
    joined = np.frombuffer(b"\xff".join(texts) + b"\xff", "u1")
    # UTF-8 has no 0xF8 to 0xFF: one byte separates, one ends. Other bytes need wider characters.
    if np.frombuffer(b"".join(texts), "u1").max() < 0xF8:
        text, alphabet = np.where(joined == 0xFF, 1, joined.astype(np.uint16) + 2).astype(np.uint8), 256
        text = np.append(text, np.uint8(0))
    else:
        text, alphabet = joined.astype(np.uint16) + 2, 258
        text[np.cumsum([len(t) + 1 for t in texts]) - 1] = 1
        text = np.append(text, np.uint16(0))
    sa = suffix_array(text, alphabet)
    plcp = permuted_common_prefixes(text, sa)
    sizes = places["size"].astype(np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    which = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    at = np.arange(len(which)) - starts[which]
    whole = np.append(at + WIDTH <= sizes[which], False)
    ranked = sa[whole[sa]]
    group = np.cumsum(plcp[ranked] < WIDTH)
    # Groups of more than one string, each sorted by its places.
    many = np.bincount(group)[group] > 1
    ranked, group = ranked[many], group[many]
    piece = which[ranked]
    found = np.zeros(len(piece), SPAN)
    for x in ("doc", "block", "row"):
        found[x] = places[x][piece]
    found["start"] = places["start"][piece] + at[ranked]
    found["end"] = found["start"] + WIDTH
    order = by_place(found, group)
    return found[order[1:][group[order[1:]] == group[order[:-1]]]]


def sort_pieces(f: pd.DataFrame) -> pd.DataFrame:
    """One shard: its pieces' repeated strings, as spans for their blocks."""
    texts: dict[bytes, int] = {}
    places: list[np.ndarray] = [np.zeros(0, PIECE)]
    number: list[int] = []
    for pieces, data in zip(f["pieces"], f["data"]):
        p = np.frombuffer(pieces, PIECE)
        number += [texts.setdefault(data[e - n : e], len(texts)) for e, n in zip(np.cumsum(p["size"]).tolist(), p["size"].tolist())]
        places.append(p)
    spans = [np.frombuffer(s, SPAN) for s in f["spans"] if len(s)]
    if texts:
        place, numbers = np.concatenate(places), np.array(number)
        # A text's first place stands for it; all others are removed whole.
        order = by_place(place, numbers)
        is_first = np.append(True, numbers[order[1:]] != numbers[order[:-1]])
        rest = place[order[~is_first]]
        whole = np.zeros(len(rest), SPAN)
        for x, _ in PLACE:
            whole[x] = rest[x]
        whole["end"] = rest["start"] + rest["size"]
        spans += [whole, repeated_strings(list(texts), place[order[is_first]])]
    found = merged(np.concatenate([np.zeros(0, SPAN), *spans]))
    blocks = np.unique(found["block"])
    return pd.DataFrame({"block": blocks, "spans": [found[found["block"] == b].tobytes() for b in blocks]})


def cut_spans(f: pd.DataFrame, g: pd.DataFrame, keep: bool, rest: bool):
    """RESULT for a block's documents; with rest, also their rows in its table."""
    block = B.Block(f)
    spans = np.concatenate([np.zeros(0, SPAN), *(np.frombuffer(s, SPAN) for s in g["spans"])])
    spans = merged(spans)
    spans = spans[np.argsort(spans["row"], kind="stable")]
    edges = np.searchsorted(spans["row"], np.arange(len(block.texts) + 1))
    rows = []
    for d, text in enumerate(block.texts):
        at, kept, own = 0, [], spans[edges[d] : edges[d + 1]]
        for a, b in zip(own["start"].tolist(), own["end"].tolist()):
            kept.append(text[at:a])
            at = b
        kept = b"".join([*kept, text[at:]])
        rows.append((block.doc_ids[d], len(text), len(text) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep else None))
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return (out, block.order) if rest else out


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, rest: list[str] = (), hot_blocks: int = B.HOT_BLOCKS) -> DataFrame:
    """RESULT for every row; kept, the remaining text, only where asked for; then columns rest0, rest1 and so on for those named in rest, as they are."""
    modest_batches(docs.sparkSession)
    size, parts = B.total_bytes(docs, text_col), partitions(docs.sparkSession)
    shards, piece_shards = max(parts, size // HASH_SHARD_BYTES), max(parts, size // PIECE_SHARD_BYTES)
    blocks = B.blocked(docs, id_col, text_col, size, parts, rest)
    blobs = B.map_blocks(blocks, lambda k, f: send_hashes(k, f, shards), "block long, shard long, blob binary")
    masks = B.shared_masks(blobs, hot_blocks)
    pieces = B.map_blocks_with(blocks, masks, lambda k, f, g: send_pieces(k, f, g, shards, piece_shards), PIECES)
    spans = pieces.groupBy("pshard").applyInPandas(lambda f: B.tidy(sort_pieces(f)), SPANS)
    types = T.StructType([docs.schema[c] for c in rest])
    return B.map_blocks_with(blocks, spans, lambda k, f, g: cut_spans(f, g, keep_text, bool(rest)), RESULT, types)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what remains of their texts; characters that a cut broke go. Null texts become empty."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    kept = removed(docs, id_col=id_col, text_col=text_col, keep_text=True, rest=others)
    cols = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("kept")} | {c: F.col(f"rest{i}") for i, c in enumerate(others)}
    return kept.select(*[cols[c].alias(c) for c in docs.columns])

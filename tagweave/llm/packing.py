"""Packing documents into training sequences: hierarchical multi-length packing.

A document's ids, closed by an end id, are cut into windows of the longest
context. What is left is routed to the smallest context tier that holds it.
Tiers are packed from the longest down: every window opens with the tier's
longest piece, its gap is filled best-fit from the same and shorter tiers, and
what no whole piece fits is filled by cutting one. A window of a shorter tier
has that tier's length, a power of two, so nothing is padded; the last window
of a block falls into powers of two. Windows of a tier are dealt to step
groups of equal numbers of tokens.

Blocks of documents are packed independently inside the task that tokenises
them, so no text or id is shuffled.

Defined results: a null or empty text is its end id alone; documents of any
length are cut; repeated rows are documents of their own; an empty table gives
no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, release_memory

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_id long"
#: ASCII marks that stand at the end of words; the tokenizer splits them from letters.
MARKS = ".,;:!?%*$&#)"
#: Words kept with their ids by each worker before it starts anew, and characters packed at once.
CACHE, BLOCK_CHARS = 1_300_000, 6_000_000


class WordIds:
    """Ids, as little-endian 32-bit bytes, of documents.

    The tokenizer never joins over white space and splits letters from marks,
    so each text without a space is encoded once. Words of letters, of which
    each gives one run of ids up to an end-of-word id, are encoded together.
    """

    def __init__(self, path: str):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_letters(self, some: list[str]) -> None:
        import numpy as np

        for at in range(0, len(some), 500):
            part = some[at : at + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(part):
                data, start = ids.tobytes(), 0
                for word, end in zip(part, ends.tolist()):
                    self.words[word] = data[start:end]
                    start = end
            else:  # a tokenizer without ends of words
                for word in part:
                    self.words[word] = self.encode(word)

    def learn(self, new: list[str], simple: bool) -> None:
        words = self.words
        rest = set(new)
        if simple:
            letters = {w for w in rest if w.isalpha()}
            rest -= letters
            marked = [(w, bare) for w in rest if (bare := w.rstrip(MARKS)).isalpha()]
            letters.update(bare for _, bare in marked if bare not in words)
            self.learn_letters(list(letters))
            for w, bare in marked:
                marks = w[len(bare) :]
                if marks not in words:
                    words[marks] = self.encode(marks)
                words[w] = words[bare] + words[marks]
            rest.difference_update(w for w, _ in marked)
        for w in rest:
            words[w] = self.encode(w)

    def documents(self, texts: list[str]) -> list[bytes]:
        """Arrow splits and numbers the words; numpy lays their ids out."""
        import numpy as np
        import pyarrow.compute as pc

        try:  # Latin-1 has neither letters that fold in company nor marks that join others
            "".join(texts).encode("latin-1")
            simple = True
        except UnicodeEncodeError:
            simple = False
        plain = pa.array([(t.lower() if simple else t).replace("\n", " ") for t in texts], pa.string())
        split = pc.split_pattern(plain, " ")
        coded = split.values.dictionary_encode()
        distinct, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.words) > CACHE:
            self.words = {"": b""}
        words = self.words
        self.learn([w for w in distinct if w not in words], simple)
        ids = [words[w] for w in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        sizes = size[number]
        ends = np.cumsum(sizes)
        laid = flat[np.repeat(first[number] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [laid[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def plan_block(lengths: list[int], longest: int, shortest: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of these lengths: (window length, [(document, start, length)]), without padding."""
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start), sorted
    for d, n in enumerate(lengths):
        for at in range(0, n - longest + 1, longest):
            windows.append((longest, [(d, at, longest)]))
        if n % longest:
            rest.append((n % longest, d, n - n % longest))
    rest.sort()
    while rest:
        n, d, start = rest.pop()
        tier = max(shortest, 1 << (n - 1).bit_length())
        pieces, gap = [(d, start, n)], tier - n
        while gap and rest:
            k = bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if k >= 0:
                n, d, start = rest.pop(k)
            else:  # none is short enough: cut the shortest
                m, d, start = rest.pop(0)
                n = gap
                insort(rest, (m - n, d, start + n))
            pieces.append((d, start, n))
            gap -= n
        if not gap:
            windows.append((tier, pieces))
            continue
        total = tier - gap  # the last window: its binary digits are full windows
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            want, part = 1 << bit, []
            while want:
                d, start, n = pieces.pop(0)
                part.append((d, start, min(n, want)))
                if n > want:
                    pieces.insert(0, (d, start + want, n - want))
                want -= part[-1][2]
            windows.append((1 << bit, part))
    return windows


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, longest: int, shortest: int, step_tokens: int) -> Iterator[pa.RecordBatch]:
    words, end = WordIds(path), int(end_id).to_bytes(4, "little")
    partition = TaskContext.get().partitionId() if TaskContext.get() else 0
    sequence, step_of = partition << 36, {}
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
        nonlocal sequence
        docs = [x + end for x in words.documents(texts)]
        cols: list[list] = [[] for _ in names]
        for length, pieces in plan_block([len(x) >> 2 for x in docs], longest, shortest):
            # A step group holds windows of one length and step_tokens tokens.
            n = step_of[length] = step_of.get(length, -1) + 1
            step, at = (partition << 36) + (length.bit_length() << 30) + n * length // step_tokens, 0
            for d, start, n in pieces:
                x = docs[d]
                for c, v in zip(cols, (ids[d], start, n, zlib.crc32(x[4 * start : 4 * (start + n)]), len(x) >> 2, sequence, at, length, step)):
                    c.append(v)
                at += n
            sequence += 1
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names)

    ids: list = []
    docs: list[str] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc_id)
            docs.append(text)
            held += len(text) + 64
            if held >= BLOCK_CHARS:
                yield flush(ids, docs)
                ids, docs, held = [], [], 0
    if docs:
        yield flush(ids, docs)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, longest: int = 4096, shortest: int = 256, step_tokens: int = 65_536) -> DataFrame:
    """The pieces of SCHEMA. longest and shortest: context tiers, powers of two; tokenizer: a file that every executor has."""
    for x in (longest, shortest):
        if x & (x - 1) or x < 1:
            raise ValueError("tiers are powers of two")

    def work(batches):
        try:
            yield from pack_batches(batches, tokenizer, end_id, longest, shortest, step_tokens)
        finally:
            release_memory()

    modest_batches(docs.sparkSession)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, SCHEMA)

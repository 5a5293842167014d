"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's bit is set if it is set in over half of the hashes (XXH64,
seed 42) of the text's word shingles, repeats included. Fingerprints of at
most DISTANCE differing bits are linked.

Candidates: the 64 bits are a ring of 8 segments. If two fingerprints differ
in at most 3 bits, then from some segment on, every chain of n consecutive
segments differs in at most 3 n / 8 bits (the pigeonring principle): not at
all in the first two, at most once up to the fifth. One half of the third to
fifth segment is therefore equal too, so the two agree in one of 16 keys of 28
bits. A key that many hold is parted by the same principle, as often as it
takes: of the 12 open bits of the third to fifth segment one half is equal,
since one bit may differ, and of four groups of the others one is, since three
may. Pairs in a key must pass the chain's budgets before the full count.

Only distinct fingerprints are compared, and a key's task emits a spanning
forest of its links in place of all pairs.

Defined results: null and wordless texts have fingerprint 0 and are linked
like any other; texts of any length are read whole, their shingles' bits being
counted in steps; repeated rows are documents of their own; a null id stands
for no component but belongs to one; an empty table gives no rows; other
columns, of any name, are passed on by keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, modest_batches, partitions, release_memory, unused
from .components import components

DISTANCE, SEGMENTS, SEED = 3, 8, 42
#: Up to so many fingerprints that agree in a key are compared pair by pair; more are parted by a further group of bits.
#: Eight at least, so that those of more have four bits that vary.
SMALL = 64
#: Keys of more rows are parted before they are dealt to tasks, MOST_HOT of them at most: with more rows the bound rises.
HOT_ROWS, MOST_HOT = 4096, 100_000
#: Bits that a chain of so many segments may differ in.
BUDGETS = [n * DISTANCE // SEGMENTS for n in range(1, SEGMENTS + 1)]


def simhash(text: bytes, shingle: int, digest) -> int:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashed = np.frombuffer(b"".join(map(digest, grams)), "u1").reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 65_536):
        ones += np.unpackbits(hashed[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed)).tobytes(), "big", signed=True)


def row_digest(docs: DataFrame) -> Column:
    """A digest of a row's columns, but for maps."""
    return F.xxhash64(*[column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, digest long: of the whole row)"""

    def work(batches: Iterator[pa.RecordBatch]):
        import xxhash

        digest = partial(xxhash.xxh64_digest, seed=SEED)
        for batch in batches:
            fps = [simhash(t.as_py() or b"", shingle, digest) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], ["doc_id", "fp", "digest"])
        release_memory()

    modest_batches(docs.sparkSession)
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("binary"), row_digest(docs).alias("digest")).mapInArrow(work, "doc_id long, fp long, digest long")


def keys(fp: Column) -> Column:
    """The 16 keys: segment, half, its first two segments and one half of the next three."""
    out = []
    for i in range(SEGMENTS):
        ring = F.shiftleft(fp, 8 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * i)) if i else fp
        head = F.shiftleft(F.shiftrightunsigned(ring, 48), 12)
        for half in range(2):
            part = F.shiftrightunsigned(ring, 36 - 12 * half).bitwiseAND(F.lit(0xFFF))
            out.append(head.bitwiseOR(part).bitwiseOR(F.lit((i * 2 + half) << 28)))
    return F.array(*out)


def ring_diff(a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which pairs keep the budgets of all chains from their key's segment; the last is the full distance."""
    x = a ^ b
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n, budget in enumerate(BUDGETS):
        shift = (56 - 8 * ((segment + n) % SEGMENTS)).astype(np.uint64)
        total += np.bitwise_count((x >> shift) & np.uint64(0xFF))
        ok &= total <= budget
    return ok


def spread(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Each node's smallest connected node. labels: what is connected already, likewise."""
    labels = np.arange(n) if labels is None else labels.copy()
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        # Roots hang on smaller ones, and all nodes on roots again.
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def open_bits(key: int, sub: int) -> tuple[list[int], list[int]]:
    """(bits of which one may differ, bits of which three may) that a key, or a part of one, leaves open."""
    segment, half = (key >> 29) & 7, (key >> 28) & 1
    at = lambda lo, hi: [(r - 8 * segment) % 64 for r in range(lo, hi)]
    other = 24 if half == 0 else 36
    if not sub:
        return at(other, other + 12), at(0, 24)
    p, g = divmod((sub - 1) >> 12, 4)
    rest = at(other, other + 6) if p == 0 else at(other + 6, other + 12)
    return [], rest + [b for i in range(4) if i != g for b in at(6 * i, 6 * i + 6)]


def mask_of(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def link_runs(fps: np.ndarray, run: np.ndarray, segment: np.ndarray, labels: np.ndarray, large) -> np.ndarray:
    """labels with what is linked within runs. fps is sorted by run; large(rows, labels) goes on with runs of over SMALL."""
    edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]])) if len(run) else np.zeros(1, int)
    size = np.diff(edges)
    number = np.repeat(np.arange(len(size)), size)
    rows = np.flatnonzero((size <= SMALL)[number]) if len(size) else np.zeros(0, int)
    for step in range(1, int(size[size <= SMALL].max(initial=1))):
        a = rows[:-step]
        a = a[(rows[step:] == a + step) & (number[rows[step:]] == number[a])]
        a = a[labels[a] != labels[a + step]]
        a = a[ring_diff(fps[a], fps[a + step], segment[a])]
        if len(a):
            labels = spread(len(fps), a, a + step, labels)
    for r in np.flatnonzero(size > SMALL):
        labels = large(np.arange(edges[r], edges[r + 1]), labels)
    return labels


def refined(fps: np.ndarray, segment: int, one: list[int], three: list[int]) -> np.ndarray:
    """Components of distinct fingerprints that agree in all but some bits: one of the first may differ, three of the others.

    They are taken in parts that also agree in one of two groups of the first bits and in one of four of the others.
    Only bits that vary are grouped, so every part is smaller.
    """
    labels = np.arange(len(fps))
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    vary = lambda bits: [b for b in bits if varying >> b & 1]
    one, three = vary(one), vary(three)
    if len(one) < 2 or len(three) < 4:  # too few for groups of their own
        one, three = [], one + three
    groups = [[list(map(int, g)) for g in np.array_split(bits, n)] for bits, n in ((one, 2), (three, 4)) if bits]
    for chosen in product(*(range(len(g)) for g in groups)):
        part = fps & mask_of([b for g, i in zip(groups, chosen) for b in g[i]])
        order = np.argsort(part, kind="stable")
        rest = [b for g, i in zip(groups, chosen) for j, bits in enumerate(g) if j != i for b in bits]

        def large(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
            own = refined(fps[order[rows]], segment, [], rest)
            moved = np.flatnonzero(own != np.arange(len(own)))
            return spread(len(fps), rows[moved], rows[own[moved]], known)

        # Labels name rows of fps; link_runs counts in the order of parts.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = np.full(len(order), len(order))
        np.minimum.at(first, labels[order], np.arange(len(order)))
        found = link_runs(fps[order], part[order], np.full(len(fps), segment), first[labels[order]], large)
        labels = canonical(found[place])
    return labels


def canonical(labels: np.ndarray) -> np.ndarray:
    """Labels by the first row that has each."""
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    return first[which]


def link_keys(key: np.ndarray, sub: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each key or part of one. Rows are sorted by both and come with all of theirs."""
    if not len(fps):
        return fps[:0], fps[:0]
    run = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])))

    def large(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
        own = refined(fps[rows], int(key[rows[0]] >> 29) & 7, *open_bits(int(key[rows[0]]), int(sub[rows[0]])))
        moved = np.flatnonzero(own != np.arange(len(own)))
        return spread(len(fps), rows[moved], rows[own[moved]], known)

    # One forest for all keys at hand: rows of a fingerprint are one node.
    nodes, first, which = np.unique(fps, return_index=True, return_inverse=True)
    root = link_runs(fps, run, (key >> 29) & 7, first[which], large)[first]
    least = np.full(len(fps), len(nodes))
    np.minimum.at(least, root, np.arange(len(nodes)))
    root = least[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def parted(hot: DataFrame) -> DataFrame:
    """(key, sub, fp) for the rows of hot keys: the eight parts of each, in which one more group of either kind is equal."""
    segment, half = F.shiftright("key", 29).cast("int"), F.shiftright("key", 28).bitwiseAND(F.lit(1)).cast("int")
    rows = hot.select("key", "fp", segment.alias("at"), half.alias("half"))
    ring = rows.withColumn("ring", F.expr("CASE WHEN at = 0 THEN fp ELSE shiftleft(fp, 8 * at) | shiftrightunsigned(fp, 64 - 8 * at) END"))
    parts = [f"{(p * 4 + g) << 12}L + 1L + shiftleft(shiftrightunsigned(ring, {30 if p == 0 else 24} + 12 * half) & 63L, 6) + (shiftrightunsigned(ring, {6 * g}) & 63L)" for p in range(2) for g in range(4)]
    return ring.select("key", F.explode(F.array(*map(F.expr, parts))).alias("sub"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints fp: enough links to connect all that differ in at most 3 bits."""
    keyed = fps.select(F.explode(keys(F.col("fp"))).alias("key"), "fp")
    sizes = keyed.groupBy("key").count()
    bound = max(HOT_ROWS, (16 * fps.count()) // MOST_HOT)
    hot = cut(sizes.where(F.col("count") > bound).select(F.col("key").alias("hot")))
    if hot.isEmpty():
        keyed = keyed.select("key", F.lit(0).cast("long").alias("sub"), "fp")
    else:  # over bound rows each, so MOST_HOT keys at most
        marked = keyed.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
        keyed = marked.where(F.col("hot").isNull()).select("key", F.lit(0).cast("long").alias("sub"), "fp").union(parted(marked.where(F.col("hot").isNotNull())))
    dealt = keyed.repartition(partitions(fps.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "fp")

    def work(batches: Iterator[pa.RecordBatch]):
        key, sub, fp = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(n: int):
            a, b = link_keys(key[:n], sub[:n], fp[:n])
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key, sub = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, sub)))
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            # The last part may go on.
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            whole = last + int(np.searchsorted(sub[last:], sub[-1])) if len(key) else 0
            if whole:
                yield out(whole)
                key, sub, fp = key[whole:], sub[whole:], fp[whole:]
        if len(key):
            yield out(len(key))
        release_memory()

    return dealt.mapInArrow(work, "a long, b long")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, digest, component_id) for every row."""
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    rooted = cut(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(found, "fp", "left")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs, of each component the row with the smallest id; of rows that share it, the one with the smallest digest of its columns. Rows without an id stay."""
    firsts = grouped(docs, id_col=id_col, text_col=text_col, shingle=shingle).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.min("digest").alias("digest"))
    found, least, digest = unused(docs.columns, "found", "least", "digest")
    firsts = firsts.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(found), F.col("digest").alias(least))
    rows = docs.withColumn(digest, row_digest(docs)).join(firsts, (column(id_col) == F.col(found)) & (F.col(digest) == F.col(least)), "left_semi")
    # What is left of repeated rows is alike; it stands together after the join.
    return rows.dropDuplicates([id_col, digest]).select(*map(column, docs.columns)).unionByName(docs.where(column(id_col).isNull()))

"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a
text's shingles. Sketches of parts merge into the sketch of the whole, and two
sketches estimate resemblance, containment and numbers of distinct shingles.
All of it is DataFrame functions.

Words are runs of anything but ASCII white space, with A-Z in lower case; a
text of fewer words than a shingle has one shingle of all its words.

Defined results: a null text is empty; texts of any length are taken whole;
any ids will do, null ones, repeated ones and those far apart included; texts without a word have an empty
sketch, and two empty sketches resemble each other fully (1), an empty and
another not at all (0); repeated rows have equal sketches; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, let

SHINGLE, SIZE = 5, 128
#: Blocks of neighbours are planned for this many rows, with at most MOST_BLOCKS of them, whose bounds come from OVERSAMPLE keys each.
BLOCK_ROWS, MOST_BLOCKS, OVERSAMPLE = 500, 20_000, 16
#: Characters of a text that order rows with equal ids.
KEY_CHARS = 32
#: The blocks' first texts and sketches are broadcast up to this size, else joined by a shuffle.
EDGE_BYTES = 64_000_000


def sketch(text: Column, k: int = SIZE, shingle: int = SHINGLE) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending."""
    words = F.transform(F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        whole = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n < shingle, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)])))

    return F.slice(F.array_sort(F.array_distinct(let(words, hashes))), 1, k)


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(sketches: Column, k: int = SIZE) -> Column:
    """Aggregate: the sketch of a group of parts. Groups are kept small by merging in steps, see merge_groups()."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches)))), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = SIZE, fan_in: int = 64) -> DataFrame:
    """(keys, sketch): hashes are ranked within salted parts first, so that no task holds more than k hashes of a part and fan_in parts."""
    hashes = df.select(*keys, F.explode_outer(sketch_col).alias("_h")).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(fan_in))).dropDuplicates([*keys, "_h"])
    parts = hashes.groupBy(*keys, "_salt").agg(F.slice(F.array_sort(F.collect_set("_h")), 1, k).alias("_part"))
    return parts.groupBy(*keys).agg(merge_all(F.col("_part"), k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """The share of the k smallest hashes of both together that both have."""

    def of(both: Column) -> Column:
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))

    return let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.size(a) - 1) / span)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def order_key(doc_id: Column, text: Column) -> Column:
    """A string whose order is that of ids from the last to the first, none last, then of the texts' first KEY_CHARS characters, then of digests.

    Of rows that agree in all this each has another number at the end, so that any number of them can be parted.
    """
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    down = F.coalesce(doc_id.bitwiseXOR(F.lit((1 << 63) - 1)), F.lit(0))  # as unsigned digits, the greatest id has the smallest
    missing = F.when(doc_id.isNull(), "1").otherwise("0")
    return F.concat(missing, digits(down), F.hex(F.left(text, F.lit(KEY_CHARS))), F.lit("."), digits(F.xxhash64(text)), digits(F.monotonically_increasing_id()))


def bounds_of(keys: DataFrame, n: int) -> list[str]:
    """Keys that part n rows into blocks of about BLOCK_ROWS, at most MOST_BLOCKS: every OVERSAMPLE-th of a sample chosen by hash."""
    blocks = min(MOST_BLOCKS, n // BLOCK_ROWS)
    if blocks < 2:
        return []
    sample = keys.where(F.pmod(F.xxhash64("_key"), F.lit(max(1, n // (blocks * OVERSAMPLE)))) == 0)
    place = F.row_number().over(Window.orderBy("_key"))  # over the sample, some OVERSAMPLE * MOST_BLOCKS keys at most
    step = max(2, min(OVERSAMPLE, n // blocks))
    return sorted(x["_key"] for x in sample.withColumn("_place", place).where(F.col("_place") % step == 0).collect())


def block_of(key: Column, bounds: list[str]) -> Column:
    """The number of bounds up to key, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(bounds)), ",")  # folded to one array when the plan is made
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    fits = lambda n, own: (n <= len(bounds)) & (F.get(known, n - 1) <= own)
    # let() keeps the column itself out of the inner lambda, from where the planner would carry it into other filters.
    return let(key, lambda own: F.aggregate(steps, F.lit(0), lambda n, step: F.when(fits(n + step, own), n + step).otherwise(n)))


def with_next(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """(doc_id, text) with a, the text's sketch, and next_text and next_a of the row with the next lower id; after the last comes the first.

    Rows are dealt to blocks of neighbours by quantiles of their order, whatever
    the ids are, and a block's last row gets its values from the first row of
    the next block that isn't empty: a table of one row a block. Null ids come
    last. Rows with equal ids follow each other in the order of their texts'
    first KEY_CHARS characters, then of their digests. Rows alike in all are
    numbered by their places in the table, which must be read in the same order
    each time, as files are. The text is shuffled once; both windows and the
    sketch between them use that order.
    """
    rows = docs.withColumn("_key", order_key(F.col("doc_id"), F.col("text")))
    rows = rows.withColumn("_block", block_of(F.col("_key"), bounds_of(rows.select("_key"), docs.count())))
    top = cut(rows.groupBy(F.col("_block").alias("_top_block")).agg(F.min("_key").alias("_top")))  # one row a block
    # Null-safe, so that the planner derives no filter on top from how the block is computed.
    is_first = F.col("_block").eqNullSafe(F.col("_top_block")) & F.col("_key").eqNullSafe(F.col("_top"))
    firsts = cut(rows.join(F.broadcast(top), is_first).select("_block", F.col("text").alias("_text")))
    around = Window.orderBy("_block")  # over one row a block
    first_block = F.first("_block").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follows = firsts.select("_block").withColumn("_after", F.coalesce(F.lead("_block").over(around), first_block))
    edge = cut(follows.join(firsts.withColumnRenamed("_block", "_after"), "_after").select("_block", "_text", sketch(F.col("_text"), k).alias("_a")))
    if (edge.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) + 8 * k * MOST_BLOCKS <= EDGE_BYTES:
        edge = F.broadcast(edge)
    order = Window.partitionBy("_block").orderBy("_key")
    inside = rows.withColumn("_last", F.lead(F.lit(False), 1, True).over(order)).withColumn("next_text", F.lead("text").over(order))
    inside = inside.withColumn("a", sketch(F.col("text"), k)).withColumn("next_a", F.lead("a").over(order))
    out = inside.join(edge, "_block", "left")
    return out.select("doc_id", "text", "a", F.when(F.col("_last"), F.col("_text")).otherwise(F.col("next_text")).alias("next_text"), F.when(F.col("_last"), F.col("_a")).otherwise(F.col("next_a")).alias("next_a"))


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SIZE) -> DataFrame:
    """Fingerprints of every text, and of the text with its last floor(n/2) characters replaced by the first of the next document."""
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), k)
    n = F.length("text")
    head = F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(head, F.expr("left(next_text, cast(floor(length(text) / 2) as int))")).alias("edited_text"), "a", "next_a")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited_text"), 256).alias("edited_sha256"), "a", sketch(F.col("edited_text"), k).alias("b"), "next_a")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("next_a"), k).alias("near_next"))

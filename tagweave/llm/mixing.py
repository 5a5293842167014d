"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated for a number of epochs at most.
Targets start in proportion to the weights; a source above its cap is clamped
and the excess goes to the others by weight until none is above. The fixed
point has a closed form: with sources sorted by cap / weight, target =
min(cap, level * weight), and the level follows from prefix sums over sources.

A source's documents are taken whole floor(target / size) times; what is left
of the target is filled by documents in the order of a seeded digest, the last
of them in part.

Defined results: null or wordless texts have size 0 and are taken 0 times; a
null source is a source of its own, after all others; repeated rows count as
documents of their own, a partial repetition falling on any of equal ones;
null ids are one id, in the order of size and text; texts of any length are
counted whole; an empty table gives an empty result; other columns are passed
on whatever their names, but for size, source_size, target and taken, which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, unused, word_count

#: More sources than this are joined by a shuffle in place of a broadcast.
BROADCAST_ROWS = 100_000
#: Characters of a place that a scan looks further, of a size, and of a place; pieces of so few rows are looked at row by row.
DIGITS, SIZE_CHARS, PLACE_CHARS, PIECE_ROWS = 3, 12, 60, 10_000
#: Columns of the result that replace others so named.
COMPUTED = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target. One row a source; the windows here hold one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    s = (
        sizes.withColumn("_weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("long"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_ratio", F.col("source_size").cast("double") / F.col("_weight"))
    )
    s = s.withColumn("_sizes_before", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("_weights_before", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    level = (F.col("_all").cast("double") * share - F.col("_sizes_before").cast("double") * epochs) / (F.col("_weights") - F.col("_weights_before")).cast("double")
    s = s.withColumn("_level", level)
    # The level is that of the first source, by ratio, that isn't clamped.
    s = s.withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio") * epochs, F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_level"))).over(everything)["_level"])
    cap = F.col("source_size").cast("double") * epochs
    return s.select("source", "source_size", F.least(cap, F.coalesce(F.col("_water") * F.col("_weight"), cap)).alias("target"))


def edges_of(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, edge, before, rows): of each source the piece of its order in which the fraction ends.

    pieces: (source, piece, size, rows, before), before being the words ahead of the first piece. A source's pieces are few.
    """
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(plan.select(F.col("source").alias("of"), "extra"), F.col("source").eqNullSafe(F.col("of")))
    return placed.where((F.col("before") <= F.col("extra")) & (F.col("before") + F.col("size") > F.col("extra"))).select("source", F.col("piece").alias("edge"), "before", "rows")


def bounded(df: DataFrame) -> DataFrame:
    """df, computed and kept, for a broadcast where its size allows that."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fractions(places: DataFrame, weights, share: float, epochs: float) -> DataFrame:
    """(source, source_size, target, whole, extra, edge, before, copies) for places (source, place, size).

    Rows whose place is below edge are taken once more, those at it as far as extra goes, those above not. The edge is
    found digit by digit: a scan sums what the pieces of the last edge hold, until a piece holds few rows. Only sums are
    ever put in order.
    """
    length = DIGITS
    pieces = cut(places.groupBy("source", F.substring("place", 1, length).alias("piece")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).withColumn("before", F.lit(0).cast("long")))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.when(F.col("source_size") > 0, F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    plan = bounded(targets.withColumn("whole", whole).withColumn("extra", extra))
    while True:
        edges = bounded(edges_of(pieces, plan))
        if length == PLACE_CHARS:
            break
        length = PLACE_CHARS if (edges.agg(F.max("rows")).first()[0] or 0) <= PIECE_ROWS else min(PLACE_CHARS, length + DIGITS)
        at = edges.select(F.col("source").alias("of"), "edge", "before")
        pieces = places.join(at, F.col("source").eqNullSafe(F.col("of")) & F.col("place").startswith(F.col("edge"))).groupBy("source", F.substring("place", 1, length).alias("piece")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.first("before").alias("before"))
    found = edges.select(F.col("source").alias("of"), "edge", "before", F.col("rows").alias("copies"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix", keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes of the row)."""
    kept = [c for c in docs.columns if c.lower() not in COMPUTED and (keep_text or c != text_col)]
    of, place, whole, extra, edge, before, copies, rank, source = unused([*kept, *COMPUTED], "of", "place", "whole", "extra", "edge", "before", "copies", "rank", "source_of")
    text, size = column(text_col), word_count(column(text_col))
    # A row's place: a seeded digest of the id, then size and text.
    digits = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column(id_col).cast("string"), F.lit("null")))), F.lpad(size.cast("string"), SIZE_CHARS, "0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    places = cut(docs.select(column(source_col).alias("source"), digits.alias("place"), size.alias("size")))
    plan = cut(fractions(places, weights, share, epochs))
    tied = plan.where("copies > 1").count()
    plan = plan.select(F.col("source").alias(of), "source_size", "target", *[F.col(x).alias(y) for x, y in (("whole", whole), ("extra", extra), ("edge", edge), ("before", before), ("copies", copies))])
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rows = docs.select(*[column(c) for c in kept], size.alias("size"), column(source_col).alias(source), digits.alias(place))
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col(of)), "left")
    left = F.col(extra) - F.col(before)
    out = joined.withColumn(rank, F.lit(0).cast("long"))
    if tied:
        # Only repeated rows, alike in id, size and text, have one place: where a fraction ends among them, they are counted.
        among = (F.col(copies) > 1) & (F.col(place) == F.col(edge))
        counted = joined.where(among).withColumn(rank, (F.row_number().over(Window.partitionBy(of, place).orderBy(place)) - 1).cast("long"))
        out = out.where(~F.coalesce(among, F.lit(False))).unionByName(counted)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col(rank) * F.col("size")))
    more = F.when(F.col(edge).isNull() | (F.col(place) < F.col(edge)), F.when(F.col(extra) > 0, F.col("size")).otherwise(F.lit(0).cast("long"))).when(F.col(place) > F.col(edge), F.lit(0).cast("long")).otherwise(part)
    return out.select(*[column(c) for c in kept], "size", "source_size", "target", (F.col(whole) * F.col("size") + more).cast("long").alias("taken"))


def repeat(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each whole repetition and one with the first words for a part of one. Takes what mix() gives."""
    size, taken = F.col("size"), F.col("taken")
    part = taken - F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("long") * size
    times = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    # No repetition may be empty: rows without words aren't part of a mix.
    takes = F.concat(F.array_repeat(size, times), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    (take,) = unused(mixed.columns, "take")
    out = mixed.withColumn(take, F.explode(takes))
    text = column(text_col)
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col(take).cast("int"))
    return out.select(*[F.when(F.col(take) == size, text).otherwise(F.array_join(words, "")).alias(c) if c == text_col else column(c) for c in mixed.columns])

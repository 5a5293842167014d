"""URL filters: host rules first, then a character language-model ratio.

Rules name a host, which covers its subdomains, and the start of a path; the
longest rule that fits a URL decides. The URLs that rules decide are the
examples of two variable-order Markov models over characters, one of accepted
and one of rejected URLs, with Witten-Bell smoothing from the longest context
down to a uniform distribution. A URL that no rule fits is judged by the
difference of its log-likelihoods over its length, against a threshold that
lies equally many standard deviations from either class's mean on examples
that the models didn't count.

Everything is DataFrame functions: counts are pre-aggregated by n-gram, the
smoothed ratio is computed once for each distinct n-gram, and distinct URLs
are scored. Hosts that hold many rows shuffle as counts only.

Defined results: a null URL and one without '://' have an empty host and path
and are scored as an empty text; ties of equally long rules go to the one that
blocks; without examples of either class the ratio is 0 and the verdict allow;
repeated rows are judged each; an empty table gives no rows; other columns are
passed on by judge(), those with the names of computed columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

ALLOW, BLOCK = "allow", "block"
#: Characters of an n-gram, its last one included, and the number of characters that the uniform distribution spreads over.
ORDER, ALPHABET = 5, 256
#: More distinct n-grams than this (some 40 MB) are joined by a shuffle in place of a broadcast.
BROADCAST_GRAMS = 400_000
#: Examples whose digest begins with one of these, a quarter, calibrate the threshold in place of being counted.
HELD = ("0", "1", "2", "3")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(urls: DataFrame, url_col: str, rules) -> DataFrame:
    """urls with host, path, rule and rule_verdict. rules: (host, path's start, verdict)."""
    host, path = host_and_path(F.col(url_col))
    df = urls.drop("host", "path", "rule", "rule_verdict").withColumns({"host": host, "path": path})
    # The longest comes first; of equals, the one that blocks.
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != BLOCK, r))
    fits = [((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)], F.lit(None).cast("string"))
    return df.withColumns({"rule": pick([h + p for h, p, _ in ordered]), "rule_verdict": pick([v for _, _, v in ordered])})


def grams(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of text, and its end, with the ORDER characters that end there."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("text"), F.lit("\x03"))
    return texts.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: padded.substr(i, F.lit(ORDER)))).alias("gram"))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for wanted's grams. counts: (gram, accepted, rejected) of whole n-grams."""
    out = wanted.select("gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in (ALLOW, BLOCK)])
    for k in range(1, ORDER + 1):
        n = counts.groupBy(F.substring("gram", ORDER + 1 - k, k).alias("tail")).agg(*[F.sum(c).alias(f"n_{c}") for c in (ALLOW, BLOCK)])
        context = n.groupBy(F.col("tail").substr(1, k - 1).alias("context") if k > 1 else F.lit("").alias("context")).agg(*[x for c in (ALLOW, BLOCK) for x in (F.sum(f"n_{c}").alias(f"all_{c}"), F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"kinds_{c}"))])
        out = out.withColumn("tail", F.substring("gram", ORDER + 1 - k, k)).withColumn("context", F.substring("gram", ORDER + 1 - k, k - 1) if k > 1 else F.lit("")).join(n, "tail", "left").join(context, "context", "left")
        for c in (ALLOW, BLOCK):
            seen, kinds = F.coalesce(F.col(f"all_{c}"), F.lit(0)), F.coalesce(F.col(f"kinds_{c}"), F.lit(0))
            p = (F.coalesce(F.col(f"n_{c}"), F.lit(0)) + kinds * F.col(f"p_{c}")) / (seen + kinds)
            out = out.withColumn(f"p_{c}", F.when(seen > 0, p).otherwise(F.col(f"p_{c}")))
        out = out.select("gram", *[f"p_{c}" for c in (ALLOW, BLOCK)])
    return out.select("gram", (F.log(f"p_{ALLOW}") - F.log(f"p_{BLOCK}")).alias("ratio"))


def judge(urls: DataFrame, rules, *, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule, verdict, and score (null where a rule decides) against the threshold."""
    ruled = with_rules(urls.drop("verdict", "score", "threshold", "text"), url_col, rules).withColumn("text", F.concat("host", "path"))
    # One row a distinct text; all rows of a text have the same rule.
    texts = cut(ruled.groupBy("text").agg(F.first("rule_verdict").alias("rule_verdict"), F.count(F.lit(1)).alias("rows")))
    is_held = F.substring(F.md5("text"), 1, 1).isin(*HELD)
    example = grams(texts.where(F.col("rule_verdict").isNotNull() & ~is_held), "rule_verdict", "rows")
    counts = cut(example.groupBy("gram").agg(*[F.sum(F.when(F.col("rule_verdict") == c, F.col("rows")).otherwise(0)).alias(c) for c in (ALLOW, BLOCK)]))
    # Texts that rules decide are only scored where they calibrate.
    scored = grams(texts.where(F.col("rule_verdict").isNull() | is_held), "text", "rule_verdict")
    known = cut(log_ratios(counts, scored.select("gram").distinct()))
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    scores = cut(scored.join(known, "gram").groupBy("text", "rule_verdict").agg((F.sum("ratio") / F.count("ratio")).alias("score")))
    means = scores.where(F.col("rule_verdict").isNotNull()).groupBy("rule_verdict").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("deviation")).collect()
    threshold = threshold_of({r["rule_verdict"]: (r["mean"], r["deviation"]) for r in means})
    judged = ruled.join(scores.where(F.col("rule_verdict").isNull()).select("text", "score"), "text", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= F.lit(threshold), ALLOW).otherwise(BLOCK))
    return judged.withColumn("verdict", verdict).withColumn("threshold", F.lit(threshold)).drop("text", "rule_verdict")


def threshold_of(classes: dict[str, tuple[float, float]]) -> float:
    """The point equally many deviations from both means; 0 unless both classes have one."""
    if {ALLOW, BLOCK} - set(classes):
        return 0.0
    (a, da), (b, db) = classes[ALLOW], classes[BLOCK]
    return (a * db + b * da) / (da + db) if da + db > 0 else (a + b) / 2

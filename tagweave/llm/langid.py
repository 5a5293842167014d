"""Language identification by hierarchical discrimination.

A first stage tells language families apart, a second one the languages within
the family that was found. Both are one-versus-one linear support vector
machines on the shares of hashed letter n-grams; the pair votes decide, ties
go to the larger sum of margins, then to the smaller name.

The machines are fitted on a bounded sample of labelled rows (SAMPLE_ROWS in
total, an equal bound for each language, chosen by a digest of the id);
features are computed on the executors over whole texts. Predictions use
nothing but the text.

Defined results: null texts and texts without a letter are 'und' with score 0,
as is every text if no row is labelled; texts of any length are used whole;
repeated rows are predicted each; null ids are not held out; an empty table
gives no rows; other columns, of any name, are passed on as they are, but that
identify() puts lang_pred and score in place of columns so named. A label
'und' is learned like any other.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, modest_batches, release_memory, unused

UNKNOWN = "und"
#: Labelled rows that the machines are fitted on at most; of each language one at least.
SAMPLE_ROWS = 2400
#: Bins of single letters and of letter triples.
SINGLES, TRIPLES = 512, 4096
BINS = SINGLES + TRIPLES
#: Characters looked at together.
BLOCK_CHARS = 500_000

#: Families of closely related languages. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "celtic": ("br", "cy", "ga", "gd"),
}


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def binned(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of single letters, bins of triples, starts of texts). Runs of other characters count as one space; each text begins with one and is followed by one."""
    joined = "\x00" + "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    breaks = cp == 0
    is_letter = letters()[cp]
    keep = is_letter | breaks
    keep[1:] |= ~is_letter[1:] & is_letter[:-1] & ~breaks[1:]
    keep[1:] &= ~(~is_letter[1:] & ~breaks[1:] & breaks[:-1])
    cp = np.where(is_letter, cp, np.where(breaks, 0, 32)).astype(np.uint32)[keep]
    starts = np.flatnonzero(cp == 0)[:-1]
    last = len(cp) - 1  # the break after the last text is no part of it
    x = np.where(cp == 0, 32, cp).astype(np.uint32)
    single = (x * np.uint32(0x9E3779B1)) >> np.uint32(23)
    # What stands before a text's first space is no part of it.
    a, b = np.where(cp == 0, 32, np.concatenate([[32], x[:-1]])).astype(np.uint32), np.concatenate([x[1:], [np.uint32(32)]]).astype(np.uint32)
    mixed = (a * np.uint32(0x85EBCA6B)) ^ (x * np.uint32(0xC2B2AE35) + (b * np.uint32(0x27D4EB2F)))
    triple = ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(20)) + np.uint32(SINGLES)
    return single[:last], triple[:last], starts


def features(text: str) -> np.ndarray:
    """Shares of a text's n-grams, in hundredths."""
    single, triple, _ = binned([text.replace("\x00", " ")])
    x = np.zeros(BINS, np.float32)
    n = len(single)
    x += np.bincount(single, minlength=BINS) * (100 / n)
    x += np.bincount(triple, minlength=BINS) * (100 / n)
    return x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine, hinge loss, by dual coordinate descent. y: 1 or -1."""
    scale = np.float32(1 / max(1e-9, np.sqrt(np.einsum("ij,ij->i", x, x)).mean()))
    scaled = np.ones((len(x), x.shape[1] + 1), np.float32)
    x = np.multiply(x, scale, out=scaled[:, :-1]).base
    w, alpha, norms = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    # Rare classes weigh as much as frequent ones.
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum()))) * 10
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


@dataclass
class Machines:
    """One-versus-one machines between classes; weights: (bins, pairs)."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str]) -> Machines:
        classes = sorted(set(names))
        y = np.array([classes.index(n) for n in names])
        fitted = [fit_pair(x[m], np.where(y[m] == a, 1, -1)) for a, b in combinations(range(len(classes)), 2) for m in [(y == a) | (y == b)]]
        return cls(classes, np.array([w for w, _ in fitted], np.float32).reshape(len(fitted), BINS).T.copy(), np.array([b for _, b in fitted], np.float64))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, confidence from 0 to 1) for rows of pair margins."""
        n, k = len(margins), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            m = margins[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            for c, s in ((a, m), (b, -m)):
                sums[:, c] += s
                least[:, c] = np.minimum(least[:, c], s)
        best = (votes + 1e-3 * np.tanh(sums / 100)).argmax(1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(n), best], -10, 10)))


@dataclass
class Model:
    families: Machines | None = None
    within: dict[str, Machines] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        if not langs:
            return cls()
        names = [family(g) for g in langs]
        model = cls(Machines.fit(x, names))
        for name in model.families.classes:
            rows = [i for i, n in enumerate(names) if n == name]
            model.within[name] = Machines.fit(x[rows], [langs[i] for i in rows])
        return model

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.families is None:
            return out, score
        stages = [self.families, *self.within.values()]
        weights = np.concatenate([m.weights for m in stages], 1)
        edges = np.cumsum([0, *(m.weights.shape[1] for m in stages)])
        todo = [i for i, t in enumerate(texts) if has_letter(t)]
        while todo:
            some, chars = [], 0
            while todo and (not some or chars + len(texts[todo[-1]]) <= BLOCK_CHARS):
                some.append(todo.pop())
                chars += len(texts[some[-1]])
            single, triple, starts = binned([texts[i].replace("\x00", " ") for i in some])
            if weights.shape[1]:
                total = np.stack([np.add.reduceat(w[single] + w[triple], starts, dtype=np.float64) for w in np.ascontiguousarray(weights.T)], 1)
            else:
                total = np.zeros((len(some), 0))
            n = np.diff(np.append(starts, len(single)))
            margins = total * (100 / n)[:, None]
            chosen, sure = self.families.decide(margins[:, : edges[1]] + self.families.bias)
            for k, (name, m) in enumerate(self.within.items(), 1):
                rows = np.flatnonzero(chosen == self.families.classes.index(name))
                if len(rows):
                    best, conf = m.decide(margins[rows, edges[k] : edges[k + 1]] + m.bias)
                    for r, b, c in zip(rows, best, conf):
                        out[some[r]], score[some[r]] = m.classes[b], min(c, sure[r])
        return out, score


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows with a language; docs: the rows that may be learned from."""
    rows = docs.select(column(id_col).cast("string").alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model()
    each = max(1, sample_rows // len(counts))
    # Rows below a share of the digest's range: twice the bound on average, cut to it afterwards.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * each / r["count"])))])
    spot = F.conv(F.substring(F.md5(F.coalesce(F.col("id"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    def work(batches):
        for batch in batches:
            x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("lang"), batch.column("spot"), pa.array(x, pa.binary())], ["lang", "spot", "x"])

    modest_batches(docs.sparkSession)
    got = rows.withColumn("spot", spot).where(F.col("spot") < share[F.col("lang")]).select("lang", "spot", "text").mapInArrow(work, "lang string, spot double, x binary").collect()
    taken: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["spot"], r["lang"], bytes(r["x"]))):
        taken.setdefault(r["lang"], [])
        if len(taken[r["lang"]]) < each:
            taken[r["lang"]].append(r["x"])
    del got
    langs = [g for g, xs in sorted(taken.items()) for _ in xs]
    x = np.empty((len(langs), BINS), np.float32)
    for row, data in zip(x, (x for _, xs in sorted(taken.items()) for x in xs)):
        row[:] = np.frombuffer(data, np.float16)
    del taken
    model = Model.fit(x, langs)
    release_memory()
    return model


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, called names, in place of any columns so named."""
    kept = [c for c in docs.columns if c.lower() not in names and (keep_text or c != text_col)]
    at = len(kept)
    plain = [f"c{i}" for i in range(at + 2)]

    def work(batches):
        for batch in batches:
            langs, score = model.predict(batch.column(at).to_pylist())
            yield pa.record_batch([*batch.columns[:at], pa.array(langs, pa.string()), pa.array(score, pa.float64())], plain)
        release_memory()

    modest_batches(docs.sparkSession)
    rows = docs.select(*[column(c).alias(x) for c, x in zip([*kept, text_col], plain)])
    types = [*rows.schema.fields[:at], T.StructField(plain[at], T.StringType()), T.StructField(plain[at + 1], T.DoubleType())]
    return rows.mapInArrow(work, T.StructType(types)).toDF(*kept, *names)


def held_out(doc_id: Column) -> Column:
    """The fold that is kept from training: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def keep_known(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents of which the language can be told, unchanged; those without letters or below the least score go."""
    model = fit(docs.where(~held_out(column(id_col))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    lang, score = names = unused(docs.columns, "lang_pred", "score")
    return identify(docs, model, text_col=text_col, names=tuple(names)).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*map(column, docs.columns))

"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of its characters given the ones before, with absolute discounts and lower orders built from the number
of different characters a string follows. The models of all languages are stored together: per order a sorted array of
hashes and, beside it, the log probabilities of each string in every language. A text gets the language with the
lowest cross-entropy per character. Scores and the bounds for rejection are calibrated on documents the models have not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.llm.common import stage, text_pass

BETWEEN = re.compile(r"[\W\d_]+")
UNDETERMINED = "und"
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Characters scored at once.
CHUNK = 1 << 18
#: Sampling is by the hash of a document and the number of a piece of its text, in so many parts.
PARTS = 1 << 20
#: Characters of a piece; most documents are one piece.
PIECE = 100_000
RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("cross_entropy", T.DoubleType()),
])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def normal(text: str) -> str:
    """Lower case, with one space for each stretch without letters."""
    return BETWEEN.sub(" ", text.lower()).strip()


def padded(text: str, order: int) -> str:
    return " " * (order - 1) + normal(text) + " "


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each string of ``width`` characters."""
    out = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * STEP + codes[i : i + len(out)] + np.uint64(1)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


@dataclass
class Level:
    """Strings of one length: sorted hashes, log probability of the last character in every language, and the log weight that each
    language gives to shorter strings after this one."""

    keys: np.ndarray
    log_p: np.ndarray
    log_rest: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return place, self.keys[place] == wanted


@dataclass
class Models:
    languages: list[str]
    order: int
    levels: list[Level] = field(default_factory=list)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0
    power: float = 0.5
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def cross_entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Nats per character in every language, and the number of characters."""
        codes = code_points(padded(text, self.order))
        n = len(codes) - self.order + 1
        total = np.zeros(len(self.languages))
        for start in range(0, n, CHUNK):
            total -= self.log_probability(codes[start : start + CHUNK + self.order - 1])
        return total / n, n

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Of all characters after the first ``order`` - 1, by the longest string that any language has seen."""
        total = np.zeros(len(self.languages))
        left = np.arange(self.order - 1, len(codes))
        for width in range(self.order, 0, -1):
            level = self.levels[width - 1]
            place, hit = level.find(hashes(codes, width)[left - width + 1])
            total += level.log_p[place[hit]].sum(axis=0, dtype=np.float64)
            left = left[~hit]
            if not len(left):
                return total
            if width > 1:
                before = self.levels[width - 2]
                place, hit = before.find(hashes(codes, width - 1)[left - width + 1])
                total += before.log_rest[place[hit]].sum(axis=0, dtype=np.float64)
        return total + len(left) * self.unseen

    def predict(self, text: str | None) -> tuple:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False, None
        entropy, n = self.cross_entropies(text)
        best = int(entropy.argmin())
        share = np.exp(-self.sharpness * n**self.power * (entropy - entropy[best]))
        return self.languages[best], float(1 / share.sum()), bool(entropy[best] <= self.bounds[best]), float(entropy[best])


def discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def build(counts: pd.DataFrame, order: int) -> Models:
    """Models from ``counts`` (lang, gram, n) with strings of ``order`` characters."""
    languages = sorted(counts["lang"].unique())
    alphabet = len(set("".join(counts["gram"]))) + 1
    seen: list[dict[str, pd.Series]] = [{} for _ in range(order + 1)]
    for lang in languages:
        now = counts[counts["lang"] == lang].set_index("gram")["n"].astype(float)
        seen[order][lang] = now
        for width in range(order - 1, 0, -1):
            now = now.groupby(now.index.str[1:]).size().astype(float)  # different characters before
            seen[width][lang] = now
    models = Models(languages, order)
    # the weight of an even distribution below single characters
    cut = {lang: discount(seen[1][lang].to_numpy()) for lang in languages}
    rest = np.array([cut[lang] * len(seen[1][lang]) / seen[1][lang].sum() for lang in languages])
    models.unseen = np.log(rest / alphabet)
    shorter: pd.DataFrame | None = None
    strings = set(counts["gram"])
    unions = {order: strings}
    for width in range(order - 1, 0, -1):
        unions[width] = {g[1:] for g in unions[width + 1]} | {g[:-1] for g in unions[width + 1]}
    for width in range(1, order + 1):
        union = pd.Index(sorted(unions[width]))
        p = np.empty((len(union), len(languages)))
        for j, lang in enumerate(languages):
            own = seen[width][lang]
            d = discount(own.to_numpy())
            heads = own.groupby(own.index.str[:-1])
            total, kinds = heads.sum(), heads.size()
            head = union.str[:-1]
            weight = (d * kinds / total).reindex(head).fillna(1.0).to_numpy()
            lower = np.full(len(union), 1 / alphabet) if width == 1 else shorter[lang].reindex(union.str[1:]).to_numpy()
            direct = np.maximum(own.reindex(union).fillna(0.0).to_numpy() - d, 0) / total.reindex(head).fillna(np.inf).to_numpy()
            p[:, j] = direct + weight * lower
        keys = np.concatenate([hashes(code_points(g), width) for g in union]) if len(union) else np.zeros(0, dtype=np.uint64)
        log_rest = np.zeros_like(p)
        if width < order:
            for j, lang in enumerate(languages):
                after = seen[width + 1][lang]
                d = discount(after.to_numpy())
                heads = after.groupby(after.index.str[:-1])
                log_rest[:, j] = np.log((d * heads.size() / heads.sum()).reindex(union).fillna(1.0).to_numpy())
        by_key = np.argsort(keys)
        models.levels.append(Level(keys[by_key], np.log(p)[by_key].astype(np.float32), log_rest[by_key].astype(np.float32)))
        shorter = pd.DataFrame(p, index=union, columns=languages)
    return models


def calibrate(models: Models, scored: pd.DataFrame, reject: float) -> None:
    """Sharpness and length power of the score that fit ``scored`` (lang, n, entropies) best, and each language's bound
    on the cross-entropy, beyond which the share ``reject`` of its own documents lie."""
    models.bounds = np.full(len(models.languages), np.inf)
    known = scored[scored["lang"].isin(models.languages)]
    if not len(known):
        return
    entropy, n = np.stack(known["entropies"]), known["n"].to_numpy(dtype=float)
    truth = known["lang"].map({lang: i for i, lang in enumerate(models.languages)}).to_numpy()
    rows = np.arange(len(known))
    best = math.inf
    for power in (0.0, 0.5, 1.0):
        for sharpness in np.geomspace(0.05, 50, 25):
            z = -sharpness * (n**power)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
            loss = float((np.log(np.exp(z).sum(axis=1)) - z[rows, truth]).mean())
            if loss < best - 1e-12:
                best, models.power, models.sharpness = loss, power, float(sharpness)
    for i in range(len(models.languages)):
        own = entropy[truth == i, i]
        if len(own):
            # one standard deviation more than the largest usual value, since long texts vary less than short ones
            models.bounds[i] = np.quantile(own, 1 - reject) + own.std()


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 5


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, sample_chars: int = 3_000_000, reject: float = 0.001
) -> Models:
    """Models from documents whose id's remainder is 2, 3 or 4; remainder 1 calibrates, remainder 0 is never read.

    Both use a sample by hash with about ``sample_chars`` characters of each language and part, which bounds the models'
    size; languages and characters are counted over all documents. What is taken or left is a piece of PIECE characters of a text,
    so that a few long documents neither go missing nor come whole, and at least one piece of each language and part is taken.
    Documents without text, language or id teach nothing."""
    part = remainder(F.col(id_col))
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), part.alias("part"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    rows = rows.filter(F.col("part").isNotNull() & (F.col("part") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("teaches", F.col("part") > 1)
    last = F.greatest(F.ceil(F.length("text") / PIECE).cast("int") - 1, F.lit(0))

    def place(i: Column) -> Column:
        """Of piece ``i`` among the PARTS; a text's first piece goes by the text's hash."""
        return F.pmod(F.when(i == 0, F.col("h")).otherwise(F.xxhash64("h", i)), F.lit(PARTS))

    def cut(those: Callable[[Column], Column]) -> Column:
        """Pieces ``those`` holds for: text, and whether it begins and ends a document. Only these are copied."""
        numbers = F.filter(F.sequence(F.lit(0), last), those)
        return F.transform(numbers, lambda i: F.struct(F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)).alias("text"), (i == 0).alias("first"), (i == last).alias("last")))

    least = F.array_min(F.transform(F.sequence(F.lit(0), last), place))
    sizes = rows.groupBy("lang", "teaches").agg(F.sum(F.length("text")).alias("chars"), F.min(least).alias("least")).collect()
    if not any(r["teaches"] for r in sizes):
        return Models([], order)
    rates = {(r["lang"], r["teaches"]): math.ceil(PARTS * min(1.0, sample_chars / max(r["chars"], 1))) for r in sizes}
    most, lacking = F.lit(0), F.lit(-1)
    for r in sizes:
        rate = rates[r["lang"], r["teaches"]]
        here = (F.col("lang") == r["lang"]) & (F.col("teaches") == r["teaches"])
        most = F.when(here, F.lit(rate)).otherwise(most)
        if r["least"] >= rate:
            lacking = F.when(here, F.lit(r["least"])).otherwise(lacking)
    pieces = rows.select("lang", "teaches", F.explode(cut(lambda i: place(i) < most)).alias("piece"))
    if any(r["least"] >= rates[r["lang"], r["teaches"]] for r in sizes):
        # repeated rows share their place, so one of them is taken
        single = rows.select("lang", "teaches", F.explode(cut(lambda i: place(i) == lacking)).alias("piece"))
        pieces = pieces.unionByName(single.groupBy("lang", "teaches").agg(F.min("piece").alias("piece")))
    sample = stage(pieces.select("lang", "teaches", "piece.*"), "language-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams: Counter = Counter()
            for lang, text, first, last in zip(batch["lang"], batch["text"], batch["first"], batch["last"]):
                line = padded(text, order)
                # a cut is no border of a word
                line = line[0 if first else order - 1 : len(line) if last else -1]
                for i in range(0, len(line), CHUNK):
                    piece = line[i : i + CHUNK + order - 1]
                    grams.update((lang, piece[j : j + order]) for j in range(len(piece) - order + 1))
            if grams:
                yield pd.DataFrame([(lang, g, n) for (lang, g), n in grams.items()], columns=["lang", "gram", "n"])

    counted = sample.filter("teaches").mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = build(counted.toPandas(), order)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            usable = batch[batch["text"].map(has_letter)]
            scored = [models.cross_entropies(t) for t in usable["text"]]
            yield pd.DataFrame({"lang": usable["lang"], "n": [n for _, n in scored], "entropies": [e for e, _ in scored]})

    calibrate(models, sample.filter("not teaches").mapInPandas(measure, "lang string, n bigint, entropies array<double>").toPandas(), reject)
    return models


def predict_language(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, lang_pred, score, accepted and cross_entropy.

    The prediction reads the text alone, whole. Text that is null or has no letter is ``und`` with score 0, as is every text
    where nothing was learned. ``accepted`` is false where the cross-entropy is beyond the language's bound: the text is probably in
    none of the languages. Equal cross-entropies go to the first language by code point. Repeated rows and null ids
    stay; an empty table gives no rows; other columns are not looked at."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("l_text"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return text_pass(rows, "l_text", RESULT, lambda texts: map(shared.value.predict, texts))

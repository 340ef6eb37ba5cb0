"""Quality rules with robust multivariate outliers.

Fixed rules come first. For the documents that pass them, a vector of transformed statistics is compared with a minimum
covariance determinant estimate of its (language, source) group: the mean and covariance of the part of the group, of a given
share, that lies closest together. Documents whose Mahalanobis distance is above a chi-square bound are rejected.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.llm.common import stage, text_pass
from washboard.llm.stats import chi_square_cdf, chi_square_quantile

SYMBOLS = "#*$%&|<>"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
STRETCH = 50
FEATURES = ("word_length", "punctuation", "capitals", "variety")
#: Standard deviations below these are raised to them, so that groups of near copies do not make everything else an outlier.
LEAST_SD = (0.06, 0.25, 0.25, 0.06)
P = len(FEATURES)

BASE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("features", T.ArrayType(T.DoubleType()))]
)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def statistics(text: str | None) -> tuple:
    """The columns of BASE for one text. Splitting bytes on white space splits exactly at the ASCII white space of the
    word pattern."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    word_chars = sum(map(len, words)) - sum(1 for b in raw if b & 0xC0 == 0x80) if not raw.isascii() else sum(map(len, words))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    features = None
    if not failed:
        joined = b"".join(words)
        marks = len(joined) - len(joined.translate(None, PUNCTUATION))
        capitals = len(joined) - len(joined.translate(None, CAPITALS))
        # the last stretch ends at the last word, so that every word counts
        starts = [*range(0, n - STRETCH, STRETCH), n - STRETCH]
        stretches = [words[i : i + STRETCH] for i in starts]
        variety = sum(len(set(s)) for s in stretches) / (STRETCH * len(stretches))
        features = [math.log(word_chars / n), math.log((marks + 1) / n), math.log((capitals + 1) / n), math.log(variety)]
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, features


def with_statistics(docs: DataFrame, text_col: str, keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns of BASE, without its text unless ``keep_text``."""
    return text_pass(docs, text_col, BASE, lambda texts: map(statistics, texts), keep_column=keep_text)


def regular(covariance: np.ndarray) -> np.ndarray:
    """``covariance`` with small variances raised."""
    out = covariance.copy()
    spread = np.diag(out)
    out[np.diag_indices(P)] = spread + np.maximum(np.square(LEAST_SD) - spread, 0)
    return out


def consistency(share: float) -> float:
    """Factor that makes the covariance of the closest ``share`` of normal data that of all."""
    if share >= 1:
        return 1.0
    return share / chi_square_cdf(chi_square_quantile(share, P), P + 2)


def distances(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    z = np.linalg.solve(np.linalg.cholesky(regular(covariance)), (x - mean).T)
    return np.einsum("ij,ij->j", z, z)


def block_estimate(x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps over a block of bounded size, from the coordinates' medians and spreads."""
    h = max(P + 1, math.ceil(share * len(x)))
    mean = np.median(x, axis=0)
    covariance = np.diag(np.square(1.4826 * np.median(np.abs(x - mean), axis=0)))
    last = None
    for _ in range(50):
        closest = np.sort(np.argsort(distances(x, mean, covariance), kind="stable")[:h])
        if last is not None and np.array_equal(closest, last):
            break
        last, part = closest, x[closest]
        mean, covariance = part.mean(axis=0), np.cov(part.T, bias=True) * consistency(h / len(x))
    return mean, covariance


MODEL = T.StructType(
    [T.StructField("cell", T.StringType()), T.StructField("log_det", T.DoubleType())]
    + [T.StructField(f"m{i}", T.DoubleType()) for i in range(P)]
    + [T.StructField(f"w{i}_{j}", T.DoubleType()) for i in range(P) for j in range(i + 1)]
)


def model_row(cell: str, mean: np.ndarray, covariance: np.ndarray) -> pd.DataFrame:
    """Mean and inverse Cholesky factor of one cell."""
    lower = np.linalg.cholesky(regular(covariance))
    white = np.linalg.inv(lower)
    return pd.DataFrame([[cell, 2 * float(np.log(np.diag(lower)).sum()), *mean, *(white[i, j] for i in range(P) for j in range(i + 1))]], columns=MODEL.names)


def squared_distance() -> F.Column:
    """Squared Mahalanobis distance of x0.. from the model columns of the same row."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + z * z
    return total


#: Squared distances are cut into so many ranges an octave; a share of a cell ends with a whole range.
RANGES, LOWEST, HIGHEST = 32, -20, 30


def refit(rows: DataFrame, model: DataFrame, bound: float | None, share: float) -> DataFrame:
    """One concentration step over whole cells: the mean and covariance of the closest ``share`` of each cell or, with
    ``bound``, of the rows up to that squared distance. One aggregate, combined before its shuffle; each cell then has
    at most one row per range of distances."""
    distance = squared_distance()
    place = F.floor(F.log2(F.greatest(distance, F.lit(2.0**LOWEST))) * RANGES)
    place = F.least(place, F.lit(HIGHEST * RANGES)) if bound is None else F.when(distance <= bound, 0).otherwise(1)
    sums = [F.sum(F.col("n")).alias("n")]
    sums += [F.sum(F.col("n") * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(P) for j in range(i + 1)]
    gathered = rows.join(model, "cell").groupBy("cell", place.alias("place")).agg(*sums)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place").reset_index(drop=True)
        reached = part["n"].cumsum().to_numpy()
        if bound is None:
            part = part[np.concatenate([[0], reached[:-1]]) < share * reached[-1]]
        elif (part["place"] == 0).any():
            part = part[part["place"] == 0]
        n = float(part["n"].sum())
        mean = np.array([part[f"s{i}"].sum() / n for i in range(P)])
        covariance = np.empty((P, P))
        for i in range(P):
            for j in range(i + 1):
                covariance[i, j] = covariance[j, i] = part[f"q{i}_{j}"].sum() / n - mean[i] * mean[j]
        within = n / reached[-1] if bound is None else chi_square_cdf(bound, P)
        return model_row(part["cell"].iloc[0], mean, covariance * consistency(within))

    return stage(gathered.groupBy("cell").applyInPandas(fit, MODEL), "quality-model")


def quality_rules(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",),
    share: float = 0.75, reject: float = 1e-7, least_rows: int = 200, block_rows: int = 2000, steps: int = 3,
) -> DataFrame:
    """One row per document: the columns ``keep``, the statistics of BASE, squared distance ``distance`` and ``kept``.

    The estimate is fitted to the distinct vectors of each cell, so copies count once. A cell is a (language, source)
    pair; pairs with fewer than ``least_rows`` vectors are judged by the cell of their whole language, large pairs included, and
    where that has too few as well, by one of the whole table.
    A cell is first cut into blocks of about ``block_rows`` vectors by their hash, each of which gives an estimate of its own;
    their mean starts ``steps`` concentration steps over the whole cell, followed by one over all rows within the 97.5 %
    bound. No task holds more than a block. ``reject`` is the part of normal data beyond the final bound.

    Null text has no words and fails the base rules, as do empty texts; null languages and sources are values of their own.
    Documents that fail the base rules have no distance and are not fitted. Repeated rows are kept as they are. A table of fewer than
    ``least_rows`` vectors rejects nothing. An empty table gives no rows. Columns not named are not
    looked at; names in ``keep`` must differ from the result's own."""
    own = {*BASE.names, "distance", "kept", "q_lang", "q_source"}
    if own & set(keep):
        raise ValueError(f"columns would be overwritten: {sorted(own & set(keep))}")
    narrow = docs.select(F.col(lang_col).alias("q_lang"), F.col(source_col).alias("q_source"), F.col(text_col).alias("q_text"))
    group = [F.col(lang_col).alias("q_lang"), F.col(source_col).alias("q_source")]
    if text_col in keep:
        rows = with_statistics(docs.select(*keep, *group), text_col, keep_text=True)
    else:
        rows = with_statistics(docs.select(*keep, *group, F.col(text_col).alias("q_text")), "q_text")

    key = F.to_json(F.struct(F.col("q_lang").alias("l"), F.col("q_source").alias("s")))
    by_lang = F.to_json(F.struct(F.col("q_lang").alias("l"), F.lit("*").alias("all")))
    x = [F.col("features")[i].alias(f"x{i}") for i in range(P)]
    # texts are read once for the vectors and once more for the result, which costs less than storing them
    passed = with_statistics(narrow, "q_text").filter(~F.col("base_failed"))
    named_x = [f"x{i}" for i in range(P)]
    distinct = stage(passed.select(key.alias("pair"), by_lang.alias("lang"), *x).groupBy("pair", "lang", *named_x).agg(F.lit(1).alias("n")), "quality-vectors")
    pairs = stage(distinct.groupBy("pair", "lang").agg(F.count(F.lit(1)).alias("rows")), "quality-pairs")
    # a language with small pairs has a cell of all its vectors, and the table has one if such a language is small itself
    pooled = distinct.join(pairs.filter(F.col("rows") < least_rows).select("lang").distinct(), "lang", "left_semi")
    pooled = stage(pooled.select(F.col("lang").alias("cell"), *named_x, "n").distinct(), "quality-pooled")
    langs = stage(pooled.groupBy("cell").agg(F.count(F.lit(1)).alias("lang_rows")).withColumnRenamed("cell", "lang"), "quality-langs")
    cell = F.when(F.col("rows") >= least_rows, F.col("pair")).when(F.col("lang_rows") >= least_rows, F.col("lang")).otherwise("*")
    cells = stage(pairs.join(langs, "lang", "left").select("pair", cell.alias("cell")), "quality-cells")
    used = cells.select("cell").distinct()
    vectors = distinct.select(F.col("pair").alias("cell"), *named_x, "n").unionByName(pooled).join(used, "cell", "left_semi")
    if not langs.filter(F.col("lang_rows") < least_rows).isEmpty():
        vectors = vectors.unionByName(distinct.select(*named_x, "n").distinct().withColumn("cell", F.lit("*")))
    vectors = stage(vectors, "quality-cell-vectors")
    sizes = vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.col("rows") / block_rows)

    def start(part: pd.DataFrame) -> pd.DataFrame:
        mean, covariance = block_estimate(part[[f"x{i}" for i in range(P)]].to_numpy(), share)
        return pd.DataFrame([[part["cell"].iloc[0], *mean, *covariance.ravel()]], columns=["cell", *(f"m{i}" for i in range(P)), *(f"c{i}" for i in range(P * P))])

    estimate = T.StructType([T.StructField("cell", T.StringType())] + [T.StructField(f"{k}{i}", T.DoubleType()) for k, m in (("m", P), ("c", P * P)) for i in range(m)])
    usable = sizes.filter(F.col("rows") >= least_rows)
    dealt = vectors.join(usable, "cell").withColumn("block", F.pmod(F.xxhash64(*[f"x{i}" for i in range(P)]), blocks))
    starts = dealt.groupBy("cell", "block").applyInPandas(start, estimate)
    means = starts.groupBy("cell").agg(*[F.avg(n).alias(n) for n in estimate.names[1:]])

    def first(batches):
        for part in batches:
            for _, row in part.iterrows():
                values = row.to_numpy()[1:].astype(float)
                yield model_row(row["cell"], values[:P], values[P:].reshape(P, P))

    model = stage(means.mapInPandas(first, MODEL), "quality-model")
    for _ in range(steps):
        model = refit(vectors, model, None, share)
    model = refit(vectors, model, chi_square_quantile(0.975, P), share)

    named = stage(model.join(cells, "cell").drop("cell", "log_det"), "quality-models")
    judged = rows.withColumn("q_pair", key).join(named, F.col("q_pair") == named["pair"], "left")
    for i in range(P):
        judged = judged.withColumn(f"x{i}", F.col("features")[i])
    distance = F.when(~F.col("base_failed"), squared_distance())
    verdict = ~F.col("base_failed") & F.coalesce(distance <= chi_square_quantile(1 - reject, P), F.lit(True))
    return judged.select(*keep, *BASE.names, distance.alias("distance"), verdict.alias("kept"))

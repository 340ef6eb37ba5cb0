"""Term shares of each source of a language and how far sources lie apart, counted with a translate table.

One pass of ``bytes.translate`` over a text's UTF-8 bytes lowers A-Z and blanks every other ASCII character that is no letter;
``bytes.split`` then gives the terms and a Counter per document the sparse counts. A task adds up the Counters of its documents per
(language, source) and writes them out when they hold many terms, so what is shuffled grows with terms and groups and not
with words. All shares are whole numbers of billionths.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washboard.llm.common import stage
from washboard.operators.lookup import BROADCAST_ROWS

#: Lower-case letters for A-Z, blanks for all other ASCII characters but a-z; bytes of longer characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: (group, term) counts that a task holds before it writes them out.
HELD_TERMS = 300_000
#: Terms and sources of one block of the comparison of sources.
BLOCK_TERMS, BLOCK_SOURCES = 2_048, 64
ONE = 1_000_000_000
COUNTS = "lang string, source string, term string, documents bigint, occurrences bigint"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def term_counts(docs: DataFrame, held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, documents, occurrences) of ``docs`` (lang, source, text), added up; nulls are ''.

    A group whose documents have no terms comes up with the term '' and no occurrences: no term is empty."""

    def flush(held: dict) -> pa.RecordBatch:
        keys = [(lang, source, term, n) for (lang, source), seen in held.items() for term, n in seen.items()]
        lang, source, term, counts = zip(*keys)
        documents, occurrences = zip(*counts)
        names = ["lang", "source", "term", "documents", "occurrences"]
        texts = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*texts, pa.array(documents, pa.int64()), pa.array(occurrences, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(dict)
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang"), batch.column("source"), batch.column("text")):
                seen = held[lang.as_py(), source.as_py()]
                before = len(seen)
                seen.setdefault(b"", [0, 0])
                for term, n in Counter(terms(text.as_py())).items():
                    known = seen.get(term)
                    if known is None:
                        seen[term] = [1, n]
                    else:
                        known[0] += 1
                        known[1] += n
                size += len(seen) - before
                if size > held_terms:
                    yield flush(held)
                    held.clear()
                    size = 0
        if held:
            yield flush(held)

    partial = docs.mapInArrow(run, COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact for counts of up to 28 digits."""
    wide = "decimal(28,0)"
    over = (count + 5).cast(wide) * F.lit(ONE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + 5 * kept).cast(wide)) + 1


def block_distances(cells: pd.DataFrame) -> pd.DataFrame:
    """Sum of |p_a - p_b| over one block of terms for the sources of two blocks.

    ``cells``: lang, left and right block of sources, term (place in the block, null for a source's share of terms it lacks), side
    (0 left, 1 right), source (place in its block), name, p. Terms of the block that no source of a side has are in no cell."""
    places = cells["term"].dropna().unique()
    column = {t: i for i, t in enumerate(places)}
    sides = []
    for side in (0, 1):
        own = cells[cells["side"] == side]
        base = own[own["term"].isna()].sort_values("source")
        row = {s: i for i, s in enumerate(base["source"])}
        p = np.repeat(base["p"].to_numpy(np.int64)[:, None], len(places), axis=1)
        there = own[own["term"].notna()]
        p[[row[s] for s in there["source"]], [column[t] for t in there["term"]]] = there["p"].to_numpy(np.int64)
        sides.append((base["name"].to_numpy(), base["p"].to_numpy(np.int64), p))
    (a, za, left), (b, zb, right) = sides
    rows = []
    for i in range(len(a)):
        # what the terms of these cells add to the distance of the two shares of terms that neither source has
        value = np.abs(right - left[i]).sum(axis=1) - len(places) * np.abs(zb - za[i])
        rows.append(pd.DataFrame({"source": a[i], "item": b, "value": value}))
    out = pd.concat(rows) if rows else pd.DataFrame({"source": [], "item": [], "value": []})
    out.insert(0, "lang", cells["lang"].iloc[0])
    return out


def source_divergence(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = 30, most_terms: int = 50
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of all pairs of sources of a language (part ``pair``, twice each) and the
    terms of each source that its language has less of (part ``term``, at most ``most_terms``).

    A language keeps the terms in at least ``least_documents`` of its documents. p of a term is 1 + floor(10^9 (count + 5) /
    (N + 5 V)) in a (language, source) group or language with N occurrences of its V kept terms. A pair's value is the sum
    of |p - q| over all kept terms, a term's is p - q for q of the language. Ranks start at 1, by descending value, then by the
    bytes of the item.

    Null language, source and text are ''. Groups without terms count like others; a language without kept terms has distances of
    zero and no terms; a single source has no pairs. Repeated rows count each time. An empty table gives no rows. Other columns are
    not looked at, whatever their names."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"), F.col(text_col).alias("text"))
    counts = stage(term_counts(rows), "divergence-counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("documents").alias("n"), F.sum("occurrences").alias("whole"))
    kept = stage(kept.filter(F.col("n") >= least_documents).drop("n"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_total"))
    # a term of few documents is dropped, so no term is joined to more rows than there are sources
    cells = stage(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "occurrences", "whole"), "divergence-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    groups = counts.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stage(groups.fillna(0, ["v", "lang_total", "total"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "divergence-groups")
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(F.lit(0)).alias("zero")
    # one row per group; beyond the limit a group's terms meet in a task, which holds no more than the kept terms
    known = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    shared = cells.join(known, ["lang", "source"]).select("*", share(F.col("occurrences"), F.col("total"), F.col("v")).alias("p"))
    shared = stage(shared, "divergence-shares")
    pairs = distances(shared, groups.select("*", zero))
    gain = F.col("p") - share(F.col("whole"), F.col("lang_total"), F.col("v"))
    better = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain.alias("value")).filter("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # a task keeps its own first rows of a group before they are shuffled
    best = better.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(best)


def distances(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all ordered pairs of sources of a language.

    Blocks of terms and of sources are compared in one task each; only terms that some source of the language has come up. The
    distance of the shares of terms that two sources lack is added for all kept terms of the language and taken back for those of
    the cells."""
    blocks = F.floor(F.col("place") / BLOCK_SOURCES)
    sides = groups.groupBy("lang").agg(F.max(blocks).alias("last"), F.max("v").alias("v"))
    term_blocks = F.ceil(F.col("v") / BLOCK_TERMS)
    term_block = F.pmod(F.xxhash64("term"), F.greatest(term_blocks, F.lit(1)))

    def dealt(df: DataFrame) -> DataFrame:
        """Each row once as the left and once as the right side of every block of sources it meets."""
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))
        df = df.join(sides.select("lang", "last"), "lang").withColumn("own", blocks).withColumn("other", other)
        left = df.withColumns({"left": F.col("own"), "right": F.col("other"), "side": F.lit(0)})
        return left.unionByName(df.withColumns({"left": F.col("other"), "right": F.col("own"), "side": F.lit(1)}))

    columns = ["lang", "block", "left", "right", "side", F.col("place").alias("source"), F.col("source").alias("name"), "term", "p"]
    there = dealt(shared.withColumn("block", term_block)).select(*columns)
    all_blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(term_blocks, F.lit(1)) - 1))
    bases = groups.select("lang", "source", "place", all_blocks.alias("block"), F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"))
    both = there.unionByName(dealt(bases).select(*columns))
    summed = both.groupBy("lang", "block", "left", "right").applyInPandas(block_distances, "lang string, source string, item string, value bigint")
    summed = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("over"))
    ends = groups.select("lang", F.col("source").alias("name"), F.col("zero").alias("z"), "v")
    found = summed.filter("source <> item").join(ends, (summed["lang"] == ends["lang"]) & (summed["source"] == ends["name"])).select(
        summed["lang"], "source", "item", "over", F.col("z").alias("z_own"), "v")
    other = ends.select(F.col("lang").alias("o_lang"), F.col("name").alias("o_name"), F.col("z").alias("z_other"))
    found = found.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("item") == F.col("o_name")))
    value = F.col("over") + F.col("v") * F.abs(F.col("z_own") - F.col("z_other"))
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))

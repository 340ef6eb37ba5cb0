"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to appear ``target / source size`` times on average. The whole copies are certain; for
the fraction left a fixed-size sample without replacement is drawn by Pareto order: each document gets the ratio
of the odds of a random number to the odds of its inclusion probability, and the smallest ratios are taken until their
sizes come nearest to what the source still lacks. An importance column makes the inclusion probabilities unequal
within a source too; certain copies are the whole part of each document's expected number of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washboard.llm.common import stage

#: Ranks are first gathered in so many equal ranges a source; only the range in which the sample ends is ordered row by row.
RANGES = 1 << 16
#: Base for the random number: 13 hexadecimal digits, a whole number below 2 ** 52.
DIGITS = 13


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_number(key: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the key and seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") + 0.5) / float(16**DIGITS)


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Sources sorted by code point, null last, get ``weights`` in turn. All targets add up to all sizes; none is above
    ``most`` times its size, and what this cuts goes to the others by weight until none is above. Every uncut
    target is then the same multiple of its weight, so the cut ones are those with the smallest size per weight, and
    running sums in that order find the multiple. The windows see one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    ratio = most * F.col("source_size") / F.col("weight")
    before = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        weighed.withColumn("ratio", ratio)
        .withColumn("cut_before", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("multiple", (F.sum("source_size").over(every) - F.col("cut_before")) / (F.sum("weight").over(every) - F.col("weight_before")))
        .withColumn("cut", F.col("ratio") <= F.col("multiple"))
    )
    # the first source that is not cut has the multiple of all that are not cut
    multiple = F.min(F.when(~F.col("cut"), F.struct("ratio", "multiple"))).over(every)["multiple"]
    target = F.when(F.col("cut"), most * F.col("source_size").cast("double")).otherwise(F.col("weight") * multiple)
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance_col: str | None = None,
    weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``id_col``, ``keep``, size, source_size, target and copies, taken (``size * copies``).

    The result depends on the rows alone, so reruns agree. Null text has size 0; documents of size 0 get no
    copy by sampling. A null source is a source of its own. Ties in the order are broken by id, then size; rows that are
    equal in both and in the source are the same to the sample, which may take either. An empty table gives no rows.
    Rows with the same id are different documents. With ``importance_col`` (null or negative: 0) the expected copies
    of a document are proportional to it, at most ``most``; what that cut removes is not spread again.

    ``keep`` names further columns to return; they must differ from those above."""
    wanted = [F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), n_words(F.col(text_col)).alias("m_size")]
    share = F.coalesce(F.greatest(F.col(importance_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance_col else F.lit(1.0)
    rows = docs.select(*wanted, share.alias("m_share"), *[F.col(k) for k in keep])
    if not keep:
        rows = stage(rows, "mix-rows")  # narrow; wide rows are read again instead
    source = F.col("m_source").alias("source")
    sums = stage(
        rows.groupBy(source).agg(F.sum("m_size").alias("source_size"), F.sum(F.col("m_size") * F.col("m_share")).alias("shared")),
        "mix-sources",
    )
    goal = stage(targets(sums.select("source", "source_size"), weights, most).join(
        sums.select(F.col("source").alias("s2"), "shared"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-targets")
    goal = goal.withColumnRenamed("source", "g_source")
    joined = rows.join(goal, F.col("m_source").eqNullSafe(F.col("g_source"))).drop("g_source")
    expected = F.when(F.col("shared") > 0, F.least(F.lit(float(most)), F.col("m_share") * F.col("target") / F.col("shared"))).otherwise(0.0)
    u = random_number(F.concat_ws(":", F.col("m_id").cast("string"), F.col("m_size").cast("string")), seed)
    chance = F.col("m_chance")
    ranked = (
        joined.withColumn("m_expected", expected)
        .withColumn("m_certain", F.floor("m_expected"))
        .withColumn("m_chance", F.col("m_expected") - F.col("m_certain"))
        .withColumn("m_u", u)
        # odds of u over odds of the inclusion probability, kept below 1 as x / (1 + x) so that ranges can be cut
        .withColumn("m_odds", F.when((chance > 0) & (F.col("m_size") > 0), (F.col("m_u") / (1 - F.col("m_u"))) / (chance / (1 - chance))))
        .withColumn("m_rank", F.col("m_odds") / (1 + F.col("m_odds")))
        .withColumn("m_range", F.least(F.floor(F.col("m_rank") * RANGES), F.lit(RANGES - 1)))
        .drop("m_odds", "m_u")
    )
    # words a source still lacks, and the range in which the sample ends
    filled = (
        ranked.groupBy("m_source", "m_range")
        .agg(F.sum("m_size").alias("words"), F.sum(F.col("m_size") * F.col("m_certain")).alias("certain"), F.first("target").alias("target"))
    )
    of_source = Window.partitionBy("m_source")
    up_to = of_source.orderBy(F.col("m_range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    words = F.when(F.col("m_range").isNotNull(), F.col("words")).otherwise(0)
    fits = (F.col("lack") > 0) & (F.col("before") < F.col("lack")) & (F.col("before") + F.col("words") >= F.col("lack"))
    ranges = (
        filled.withColumn("lack", F.col("target") - F.sum("certain").over(of_source))
        .withColumn("before", F.coalesce(F.sum(words).over(up_to), F.lit(0)))
        .groupBy(F.col("m_source").alias("e_source"))
        .agg(F.max("lack").alias("lack"), F.min(F.when(F.col("m_range").isNotNull() & fits, F.struct("m_range", "before"))).alias("end"))
        .select("e_source", "lack", F.col("end.m_range").alias("e_range"), F.col("end.before").alias("before"))
    )
    ends = stage(ranges, "mix-ends")
    at_end = ranked.join(ends, F.col("m_source").eqNullSafe(F.col("e_source")), "left")
    last = (F.col("m_range") == F.col("e_range")) & F.col("m_rank").isNotNull()
    order = Window.partitionBy("m_source").orderBy("m_rank", "m_id", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = at_end.filter(last).withColumn("m_before", F.col("before") + F.coalesce(F.sum("m_size").over(order), F.lit(0)))
    # a document is taken if that brings the source's words nearer to its target
    inside = inside.withColumn("m_extra", (F.col("lack") - F.col("m_before") >= F.col("m_size") / 2).cast("int")).drop("m_before")
    # no end: the source lacks nothing, or all documents with a chance together
    outside = at_end.filter(~F.coalesce(last, F.lit(False))).withColumn(
        "m_extra", F.when(F.col("m_rank").isNull() | (F.col("lack") <= 0), 0).when(F.col("e_range").isNull(), 1).otherwise((F.col("m_range") < F.col("e_range")).cast("int"))
    )
    copies = (F.col("m_certain") + F.col("m_extra")).cast("bigint")
    return outside.unionByName(inside).select(
        F.col("m_id").alias(id_col), *keep, F.col("m_size").alias("size"), "source_size", "target", copies.alias("copies"),
        (F.col("m_size") * copies).alias("taken"),
    )

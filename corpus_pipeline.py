"""From raw documents to packed token sequences, in five stages.

Each stage takes all its predecessor kept. The first four return the columns of documents; the columns are renamed by place inside a
stage, so that no name a table brings can clash with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washboard.llm.common import documents, stage
from washboard.llm.mixing import mix_sources
from washboard.llm.packing import pack_documents
from washboard.llm.quality import quality_rules
from washboard.llm.secrets import blob_of, masked, scan_history
from washboard.llm.simhash import fingerprints, simhash_components
from washboard.session import stage_alone

#: Near copies: words of a shingle, and percent of shingles in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, .., and the new name of each old one."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    rows, c = by_place(docs)
    judged = quality_rules(rows, text_col=c["text"], lang_col=c["lang"], source_col=c["source"], keep=tuple(c.values()))
    return restored(judged.filter("kept"), c)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once if its row is repeated. Near copies share 80 % or more of
    their shingles of five words, or have fingerprints of these that differ in two bits at most.

    Texts do not move unless too many rows go for a broadcast: rows to be dropped are known by id and fingerprint."""
    rows, c = by_place(docs)
    doc_id = c["doc_id"]
    grouped = stage(simhash_components(rows, id_col=doc_id, text_col=c["text"], words=NEAR_WORDS, similar=NEAR_PERCENT), "pipeline-groups")
    order = F.struct(F.col("id").isNull(), "id", "fingerprint")
    pairs = grouped.groupBy(F.col(doc_id).alias("id"), "fingerprint", "component_key").agg(F.count(F.lit(1)).alias("rows"))
    pairs = stage(pairs, "pipeline-pairs")
    first = pairs.groupBy(F.col("component_key").alias("key")).agg(F.min(order).alias("first"))
    judged = pairs.join(first, F.col("component_key") == F.col("key")).withColumn("stays", F.col("first") == order)
    # most rows are alone in their group and do not come up here
    marked = judged.filter(~F.col("stays") | (F.col("rows") > 1)).select("id", F.conv("fingerprint", 16, -10).cast("bigint").alias("marked_fp"), "stays")
    marked = stage(marked, "pipeline-marked")
    with_fp = fingerprints(rows, c["text"], "fp", keep_text=True, words=NEAR_WORDS)
    joined = with_fp.join(marked, F.col(doc_id).eqNullSafe(F.col("id")) & (F.col("fp") == F.col("marked_fp")), "left")
    repeated = joined.filter("stays").dropDuplicates([doc_id, "fp"])
    return restored(joined.filter(F.col("stays").isNull()).unionByName(repeated), c)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark. ``n_chars`` follows the text."""
    rows, c = by_place(docs)
    text = F.col(c["text"])
    ledger = scan_history(rows, id_col=c["doc_id"], text_col=c["text"]).added
    found = stage(ledger.filter(F.size("spans") > 0).select("blob", "spans"), "pipeline-secrets")
    joined = rows.withColumn("blob", blob_of(text)).join(found, "blob", "left")
    clean = joined.withColumn(c["text"], F.when(F.col("spans").isNull(), text).otherwise(masked(text, F.col("spans"))))
    if "n_chars" in c:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn(c["n_chars"], F.when(F.col("spans").isNull(), F.col(c["n_chars"])).otherwise(F.length(text).cast(kind)))
    return restored(clean, c)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows, c = by_place(docs)
    mixed = mix_sources(rows.withColumn("id", F.col(c["doc_id"])), id_col="id", text_col=c["text"], source_col=c["source"], keep=tuple(c.values()))
    copies = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return restored(copies, c)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mix_sources", mix),
    ("sum_of_squares_packing", pack),
]

#: Robust estimates, hashes of shingles and token ids have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; its own intermediate tables and the result of the
    one before are deleted then. The last result stays as one written table, which ``session.release`` or an outer
    ``session.staging`` deletes."""

    def upto(n: int) -> DataFrame:
        name, function = STAGES[n]
        return stage_alone(spark, lambda: function(spark, upto(n - 1) if n else documents(spark, sf_dir), sf_dir), f"pipeline-{name}")

    return upto(len(STAGES) - 1)

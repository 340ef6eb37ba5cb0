"""One query per operator over its whole table, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washboard.llm.common import documents, stage, table
from washboard.llm.divergence import source_divergence
from washboard.llm.jaccard import jaccard_components
from washboard.llm.language import predict_language, remainder, train
from washboard.llm.lm_scores import lm_scores
from washboard.llm.merkle import audit_columns, build_manifest, proofs
from washboard.llm.mixing import mix_sources
from washboard.llm.neighbours import nearest_neighbours
from washboard.llm.packing import pack_documents
from washboard.llm.quality import quality_rules
from washboard.llm.repeats import remove_repeats
from washboard.llm.secrets import digest_columns, scan_history
from washboard.llm.simhash import simhash_components
from washboard.llm.token_counts import build_trees, redactions, update_trees


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("features")


def op2_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op3_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir)).drop("component_key")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    predicted = predict_language(docs, train(docs))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_history(documents(spark, sf_dir)).findings
    return found.select("doc_id", *digest_columns(F.col("spans")), F.hex("blob").alias("blob"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after mail addresses and long numbers are redacted."""
    docs = documents(spark, sf_dir)
    trees = stage(build_trees(docs), "token-trees")
    counts = update_trees(docs, trees, redactions(docs).distinct())
    return counts.select("doc_id", "n_edits", "n_encoded", "n_chars", "tokens_before", "tokens_after")


def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its proof; in each seventh id or so the number of characters is tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = proofs(build_manifest(documents(spark, sf_dir), changes={"n_chars": tampered}))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", *audit_columns())


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_prefix_free_parsing": op2_prefix_free_parsing,
    "op3_simhash_popcount": op3_simhash_popcount,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_edit_aware_counts": op9_edit_aware_counts,
    "op10_stable_projections": op10_stable_projections,
    "op11_prefix_tree": op11_prefix_tree,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), o AS (
  SELECT *, 3 * source_size / weight AS ratio,
         coalesce(sum(3 * source_size) OVER b, 0) AS cut_before, coalesce(sum(weight) OVER b, 0.0) AS weight_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weight_total
  FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT *, ratio <= (total - cut_before)::DOUBLE / (weight_total - weight_before) AS cut,
         (total - cut_before)::DOUBLE / (weight_total - weight_before) AS multiple
  FROM o
), t AS (
  SELECT source, source_size,
         coalesce(CASE WHEN cut THEN (3 * source_size)::DOUBLE
                       ELSE weight * (SELECT arg_min(multiple, ratio) FROM m WHERE NOT cut) END, 0.0) AS target
  FROM m
), e AS (
  SELECT doc_id, d.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(3.0, 1.0 * target / source_size) ELSE 0.0 END AS expected,
         (('0x' || substr(md5('7:' || doc_id::VARCHAR || ':' || size::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS chance FROM e
), q AS (
  SELECT *, CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM p
), r AS (
  SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS lack,
         CASE WHEN odds IS NOT NULL THEN coalesce(sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER
           (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before
  FROM q
), c AS (
  SELECT *, (certain + CASE WHEN odds IS NULL OR lack <= 0 THEN 0 WHEN lack - before >= size / 2 THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
  FROM d
), n AS (
  SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * n_both >= 90 * (nx.size + ny.size - n_both)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x
)
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, size
"""

OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), w AS (
  SELECT lang, source, doc, unnest(found) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(whole)::HUGEINT AS n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.whole + 5)) // (l.n + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))) AS crc
  FROM documents
), f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(text) || ':' || text, '-') AS after, n_chars + CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN 1 ELSE 0 END AS tampered
  FROM d
), l AS (
  SELECT r, doc_id, tree, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
         sha256(before || coalesce(strlen(tampered::VARCHAR) || ':' || tampered, '-') || after) AS changed
  FROM f
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l
), nodes(tree, level, i, h) AS (
  SELECT tree, 0, i, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes)
  WHERE n > 1 GROUP BY tree, level, i // 2
), subroots AS (
  SELECT tree, max(level) AS height, arg_max(h, level) AS h FROM nodes GROUP BY tree
), tops(level, i, h) AS (
  SELECT 0, tree, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE (SELECT count(*) FROM tops) > 1 GROUP BY level, i // 2
), top AS (
  SELECT max(level) AS height, arg_max(h, level) AS h FROM tops
), places AS (
  SELECT r, leaves.tree, unnest(range(height)) AS step, 0 AS below, i FROM leaves JOIN subroots USING (tree)
), steps AS (
  SELECT r, step, n.h, (p.i >> step) & 1 = 1 AS on_left FROM places p LEFT JOIN nodes n ON n.tree = p.tree AND n.level = step AND n.i = xor(p.i >> step, 1)
  UNION ALL
  SELECT r, u.height + u.step, t.h, (u.tree >> u.step) & 1 = 1
  FROM (SELECT r, leaves.tree, s.height, unnest(range((SELECT height FROM top))) AS step FROM leaves JOIN subroots s USING (tree)) u
  LEFT JOIN tops t ON t.level = u.step AND t.i = xor(u.tree >> u.step, 1)
), fold(r, step, h) AS (
  SELECT r, 0::BIGINT, changed FROM leaves
  UNION ALL
  SELECT r, fold.step + 1, sha256(CASE WHEN s.h IS NULL THEN fold.h WHEN on_left THEN s.h || fold.h ELSE fold.h || s.h END)
  FROM fold JOIN steps s USING (r) WHERE s.step = fold.step
), folded AS (
  SELECT r, arg_max(h, step) AS folded_root FROM fold GROUP BY r
), proofs AS (
  SELECT r, coalesce(string_agg(h, '' ORDER BY step), '') AS others FROM steps GROUP BY r
)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top) AS root, sha256(coalesce(others, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM top) AS verified
FROM leaves JOIN subroots s USING (tree) JOIN folded USING (r) LEFT JOIN proofs USING (r)
"""

ORACLE_SQL = {
    "op7_pareto_mixing": OP7_SQL,
    "op11_prefix_tree": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}

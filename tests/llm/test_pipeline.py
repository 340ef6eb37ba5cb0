from pathlib import Path

import pytest
from pyspark.sql import functions as F
from samples import collected, docs, none, odd, odd_rows  # noqa: F401
from test_jaccard import plain_links, plain_set, roots
from test_packing import check
from test_quality import plain
from test_secrets import plain as plain_spans
from test_simhash import plain_fingerprint

import corpus_pipeline as P
from washboard.llm.common import stage
from washboard.llm.mixing import mix_sources

FUNCTIONS = dict(P.STAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_names_and_order():
    assert list(FUNCTIONS) == ["quality_rules", "simhash_near_dedup", "secret_scan", "mix_sources", "sum_of_squares_packing"]


@pytest.fixture(params=["table", "odd"])
def given(request, docs, odd):
    return docs if request.param == "table" else odd


def test_quality_stage(spark, given, sf_dir):
    kept = FUNCTIONS["quality_rules"](spark, given, sf_dir)
    assert kept.columns == given.columns
    left = rows_of(kept)
    everything = rows_of(given)
    passed = [r for r in everything if not plain(r[1])[5]]
    assert set(left) <= set(passed)
    assert len(left) >= 0.75 * len(passed)


def test_quality_stage_keeps_what_was_labelled_good(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = {r["doc_id"]: r["quality"] for r in labels.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in FUNCTIONS["quality_rules"](spark, docs, sf_dir).collect()}
    assert all(i in kept for i, good in judged.items() if good and i in text and not plain(text[i])[5])


def plain_groups(texts):
    """Group of each text: links of similar sets of five-word shingles, and of fingerprints of these that are 2 bits apart at most."""
    sets, prints = [plain_set(t, 5) for t in texts], [plain_fingerprint(t, 5) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    return roots(len(texts), near + plain_links(sets, 80))


def test_near_dedup_stage(spark, given, sf_dir):
    out = FUNCTIONS["simhash_near_dedup"](spark, given, sf_dir)
    assert out.columns == given.columns
    everything = sorted((tuple(r) for r in given.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    group = plain_groups([r[1] for r in everything])
    expected = [everything[c] for i, c in enumerate(group) if c == i]
    assert rows_of(out) == sorted(expected, key=str)


def test_near_copies_are_dropped(spark, sf_dir):
    """On a larger table: of all similar pairs at most a tenth stay, of equal texts none, and no document goes without a reason."""
    docs = spark.read.parquet(f"{Path(sf_dir).parent}/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = {r["doc_id"] for r in FUNCTIONS["simhash_near_dedup"](spark, docs, sf_dir).collect()}
    pairs = plain_links([plain_set(t, 5) for _, t in rows], 80)
    left = [1 for i, j in pairs if rows[i][0] in kept and rows[j][0] in kept]
    assert pairs and len(left) <= 0.1 * len(pairs)
    texts = [t for i, t in rows if i in kept]
    assert len(set(texts)) == len(texts)
    group = plain_groups([t for _, t in rows])
    assert kept == {rows[g][0] for g in set(group)}


def test_secret_stage(spark, given, sf_dir):
    secret = F.when(F.col("doc_id") == 1, F.concat(F.lit("secret = 'abcdefgh' "), F.col("text"), F.lit(" " + "0a" * 20))).otherwise(F.col("text"))
    before = stage(given.withColumn("text", secret), "test")
    out = FUNCTIONS["secret_scan"](spark, before, sf_dir)
    assert out.columns == given.columns
    expected = []
    for r in before.collect():
        text, done, new = r["text"], -1, ""
        for _, s, e in plain_spans(text or ""):
            if s > done:
                new += text[max(done, 0) : s] + "[secret]"
            done = max(done, e)
        if done >= 0:
            text = new + text[done:]
        changed = {"text": text, "n_chars": len(text)} if done >= 0 else {}
        expected.append(tuple((r.asDict() | changed).values()))
    assert rows_of(out) == sorted(expected, key=str)
    assert out.filter("contains(text, '[secret]')").count() >= 1


def test_mix_stage(spark, given, sf_dir):
    out = FUNCTIONS["mix_sources"](spark, given, sf_dir)
    assert out.columns == given.columns
    copies = {}
    for g in collected(mix_sources(given, keep=("text",))):
        key = (g["doc_id"], g["text"])
        copies[key] = copies.get(key, 0) + g["copies"]
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: n for k, n in copies.items() if n}


def test_whole_run(spark, docs, sf_dir):
    packed = P.run(spark, sf_dir)
    before = docs
    for name, function in P.STAGES[:-1]:
        before = stage(function(spark, before, sf_dir), "test")
    check(before)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    again = P.pack(spark, before, sf_dir)
    assert rows_of(packed.select(*columns)) == rows_of(again.select(*columns))


def test_empty_table(spark, none, sf_dir):
    for name, function in P.STAGES:
        assert function(spark, none, sf_dir).count() == 0, name

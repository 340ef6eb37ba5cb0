import random
from collections import Counter

from samples import collected, docs, none, odd, odd_rows  # noqa: F401

from washboard.llm.token_counts import REDACT, SegmentTree, apply_edits, build_trees, merged, redactions, segments, update_trees, version_of
from washboard.llm.tokens import ids


def redacted(text):
    return REDACT.sub(lambda m: f"<{m.lastgroup}>", text or "")


def test_counts_follow_the_redactions(docs):
    got = {g["doc_id"]: g for g in collected(update_trees(docs, build_trees(docs), redactions(docs)))}
    edited = 0
    for r in docs.collect():
        g, new = got[r["doc_id"]], redacted(r["text"])
        assert g["tokens_before"] == len(ids().encode(r["text"])) and g["tokens_after"] == len(ids().encode(new))
        assert g["n_chars"] == len(new) and g["tokens"][1] == g["tokens_after"]
        assert (g["n_edits"] == 0) == (g["n_encoded"] == 0)
        edited += g["n_edits"] > 0
    assert edited


def test_only_touched_regions_are_encoded(spark):
    text = " ".join(["word"] * 20_000)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").withColumn("version", version_of("text"))
    edits = df.selectExpr("doc_id", "version", "50000 AS start", "50004 AS end", "'other' AS replacement")
    g = collected(update_trees(df, build_trees(df), edits))[0]
    assert g["tokens_after"] == len(ids().encode(text[:50000] + "other" + text[50004:])) and 0 < g["n_encoded"] < 2000


def test_random_edits():
    rng = random.Random(3)
    for _ in range(400):
        length = rng.choice([0, 3, 30, 2000])
        if rng.random() < 0.5:
            text = "".join(rng.choice(" ab\n.é '1一　 \t") for _ in range(length))
        else:
            text = " ".join(rng.choice(["the", "don't", "x", "12", " ", "\n"]) for _ in range(length // 3))
        tree = SegmentTree.build(segments(text), ids())
        edits = []
        for _ in range(rng.randint(0, 5)):
            start = rng.randint(0, len(text))
            edits.append((start, start + rng.choice([0, 0, 1, 5, 700]), rng.choice([None, "", " ", "a", " a b ", "\n", "z" * 600 + " " + "q" * 700])))
        expected = text
        for start, end, new in reversed(merged(edits, len(text))):
            expected = expected[:start] + new + expected[end:]
        got, _ = apply_edits(text, tree, edits, ids())
        assert got == expected
        assert (tree.chars[1], tree.tokens[1]) == (len(expected), len(ids().encode(expected)))


def test_overlapping_edits_are_joined():
    assert merged([(4, 6, "b"), (0, 5, "a"), (9, 99, None), (-3, 0, "c")], 10) == [(0, 0, "c"), (0, 6, "ab"), (9, 10, "")]


def test_odd_rows(odd, none):
    trees = build_trees(odd)
    got = collected(update_trees(odd, trees, redactions(odd).distinct()))
    assert Counter((g["doc_id"], g["tokens_after"]) for g in got) == Counter((r[0], len(ids().encode(redacted(r[1])))) for r in odd_rows())
    stale = redactions(odd).selectExpr("doc_id", "version + 1 AS version", "start", "end", "replacement")
    assert all(g["n_edits"] == 0 for g in collected(update_trees(odd, trees, stale)))
    assert update_trees(none, build_trees(none), redactions(none)).count() == 0

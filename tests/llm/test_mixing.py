import re
from collections import defaultdict

import pytest

from samples import SCHEMA, collected, docs, none, odd, odd_rows  # noqa: F401
from washboard.llm.mixing import mix_sources


def plain_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Share by weight, cut, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= above
    return out


def check(rows, got, slack):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for g, source in got:
        assert g["source_size"] == sizes[source] and g["target"] == pytest.approx(targets[source])
        assert g["taken"] == g["size"] * g["copies"] and g["copies"] <= 3
        taken[source] += g["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= slack(source)


def test_targets_are_met_and_reruns_agree(docs):
    rows = [tuple(r) for r in docs.collect()]
    source = {r[0]: r[3] for r in rows}
    largest = defaultdict(int)
    for r in rows:
        largest[r[3]] = max(largest[r[3]], len(r[1].split()))
    got = collected(mix_sources(docs))
    check(rows, [(g, source[g["doc_id"]]) for g in got], lambda s: largest[s] / 2 + 1)
    again = collected(mix_sources(docs.repartition(7)))
    assert sorted((g["doc_id"], g["taken"]) for g in got) == sorted((g["doc_id"], g["taken"]) for g in again)


def test_odd_rows(odd, none):
    got = collected(mix_sources(odd, keep=("source",)))
    assert len(got) == len(odd_rows())
    check(odd_rows(), [(g, g["source"]) for g in got], lambda s: 20_000)
    assert mix_sources(none).count() == 0


def test_cut_sources_pass_their_excess_on(spark):
    rows = [(i, "w " * 10, None, s, None) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 2)]
    got = collected(mix_sources(spark.createDataFrame(rows, SCHEMA), keep=("source",)))
    check(rows, [(g, g["source"]) for g in got], lambda s: 5)
    assert {g["target"] for g in got if g["source"] == "c"} == {60.0}


def test_importance_sets_the_expected_copies(spark):
    rows = [(i, "w " * 10, "x", float(i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, worth double")
    got = collected(mix_sources(df, importance_col="worth"))
    assert all(g["copies"] == (2 if g["doc_id"] % 2 else 0) for g in got)

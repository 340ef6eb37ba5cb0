import re
from collections import Counter, defaultdict

import pandas as pd
from samples import docs, none, odd, odd_rows  # noqa: F401

from washboard.llm import divergence
from washboard.llm.divergence import block_distances, source_divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rows(rows, least=30, most=50):
    """Rows (lang, source, part, item, value, rank) for (lang, source, text), sorted."""
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = plain_terms(text)
        groups[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: c for (name, s), c in groups.items() if name == lang}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in own if r != s]
            better = [(t, p[s][t] - q[t]) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", better, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in source_divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms():
    for text in (None, "", "Ab-cD é9È_x\x00y\x7fz\x80w [q]{r}", "".join(map(chr, range(0x250))), "漢字　と ÀÉ", " A\x85B\x1cC"):
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_table(docs):
    rows = docs.select("lang", "source", "text").collect()
    for least in (30, 3):
        assert got(docs, least_documents=least) == plain_rows(rows, least)


def test_blocks_and_early_counts_do_not_matter(docs, monkeypatch):
    """Blocks are made on the driver's side; what a task holds is set where it runs, so its limit is tried below."""
    rows = docs.select("lang", "source", "text").collect()
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 37)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 3)
    assert got(docs) == plain_rows(rows)


def test_counts_written_in_parts(spark, docs):
    small = docs.repartition(3)
    whole = divergence.term_counts(small.select("lang", "source", "text"))
    parts = divergence.term_counts(small.select("lang", "source", "text"), held_terms=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_odd_rows(odd, none):
    rows = [(r[2], r[3], r[1]) for r in odd_rows()]
    for least, most in ((1, 50), (2, 1), (30, 50)):
        assert got(odd, least_documents=least, most_terms=most) == plain_rows(rows, least, most)
    assert got(none) == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    big = 9_000_000_000_000_000
    row = spark.createDataFrame([(big, 2 * big, 3)], "c bigint, n bigint, v bigint")
    assert row.select(divergence.share(row["c"], row["n"], row["v"])).first()[0] == 1 + 1_000_000_000 * (big + 5) // (2 * big + 15)


def test_block_without_terms():
    cells = pd.DataFrame({"lang": "en", "side": [0, 0, 1, 1], "source": [0, 1, 0, 1], "name": ["a", "b"] * 2, "term": None, "p": [5, 7, 5, 7]})
    assert block_distances(cells)["value"].tolist() == [0, 0, 0, 0]

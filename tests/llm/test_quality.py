import re
from collections import Counter

import numpy as np
import pytest

from samples import SCHEMA, collected, docs, none, odd, odd_rows, prose  # noqa: F401
from washboard.llm.quality import P, block_estimate, consistency, quality_rules, statistics
from washboard.llm.stats import chi_square_cdf, chi_square_quantile


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeats = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeats) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeats), failed


def columns(g):
    return tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_base_statistics(docs, odd):
    for df in (docs, odd):
        got = Counter((r["doc_id"], *columns(r)) for r in collected(quality_rules(df)))
        assert got == Counter((r["doc_id"], *plain(r["text"])) for r in df.select("doc_id", "text").collect())


def test_outliers_go_and_clean_documents_stay(spark):
    clean = [(i, prose(i, 60 + i % 300, 300), "en", "big" if i % 3 else "small", None) for i in range(900)]
    copies = [(1000 + i, clean[0][1], "en", "big", None) for i in range(600)]
    shout = [(2000 + i, prose(i, 100).upper().replace(" ", "!! "), "en", "big", None) for i in range(40)]
    table = [(3000 + i, prose(i, 100).replace(" ", " | "), "en", "small", None) for i in range(40)]
    got = collected(quality_rules(spark.createDataFrame(clean + copies + shout + table, SCHEMA), block_rows=150))
    assert {g["doc_id"] for g in got if not g["kept"]} == {r[0] for r in shout + table}


def test_same_result_for_any_partitions(spark, docs):
    one, two = (sorted((g["doc_id"], g["kept"]) for g in collected(quality_rules(docs.repartition(n), least_rows=30))) for n in (1, 9))
    assert one == two


def test_odd_rows(odd, none):
    got = collected(quality_rules(odd, keep=("doc_id", "text", "size")))
    assert len(got) == len(odd_rows())
    assert all(g["kept"] != g["base_failed"] for g in got)  # too few rows for outliers
    fitted = collected(quality_rules(odd, least_rows=3))
    assert len(fitted) == len(got) and all(g["distance"] is not None for g in fitted if not g["base_failed"])
    assert quality_rules(none).count() == 0
    with pytest.raises(ValueError):
        quality_rules(odd, keep=("doc_id", "kept"))


def test_estimate_resists_a_fifth_of_outliers():
    rng = np.random.default_rng(5)
    good = rng.standard_normal((1600, P)) @ np.diag([1, 2, 3, 0.5])
    x = np.concatenate([good, rng.standard_normal((400, P)) + 40])
    mean, covariance = block_estimate(x, 0.75)
    assert np.abs(mean).max() < 0.4
    assert np.sqrt(np.diag(covariance)) == pytest.approx([1, 2, 3, 0.5], rel=0.35)
    assert consistency(1.0) == 1.0


def test_chi_square():
    # values from published tables
    assert chi_square_quantile(0.95, 1) == pytest.approx(3.841459, rel=1e-6)
    assert chi_square_quantile(0.99, 10) == pytest.approx(23.20925, rel=1e-6)
    assert chi_square_cdf(4, 2) == pytest.approx(1 - np.exp(-2))
    assert chi_square_cdf(0, 3) == 0 and chi_square_cdf(1e6, 3) == 1


def test_every_word_counts_for_variety(spark):
    varied = [f"w{i}" for i in range(50)]
    assert statistics(" ".join(varied))[-1][3] == 0
    assert statistics(" ".join(varied * 2))[-1] is None  # repeats
    assert statistics(" ".join(varied + ["same"] * 49))[-1][3] == pytest.approx(np.log((50 + 2) / 100))
    clean = [(i, prose(i, 60 + i % 300, 300), "en", "big", None) for i in range(600)]
    tails = [(1000 + i, prose(i, 50, 300) + " same" * 49, "en", "big", None) for i in range(20)]
    got = collected(quality_rules(spark.createDataFrame(clean + tails, SCHEMA)))
    assert {g["doc_id"] for g in got if not g["kept"]} == {r[0] for r in tails}


def test_small_cells_are_judged_by_their_language_or_the_table(spark):
    clean = [(i, prose(i, 60 + i % 300, 300), "en", "big", None) for i in range(500)]
    few = [(500 + i, prose(500 + i, 100, 300), "en", "new", None) for i in range(5)]
    shout = [(1000 + i, prose(i, 100).upper().replace(" ", "!! "), "en", "new", None) for i in range(30)]
    other = [(2000 + i, prose(i, 100).replace(" ", " | "), "xx" if i % 2 else None, "new", None) for i in range(30)]
    got = collected(quality_rules(spark.createDataFrame(clean + few + shout + other, SCHEMA)))
    assert {g["doc_id"] for g in got if not g["kept"]} == {r[0] for r in shout + other}

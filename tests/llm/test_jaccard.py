import random
import re

import numpy as np
import pytest
from samples import collected, docs, none, odd, odd_rows, prose  # noqa: F401

from washboard.llm.jaccard import bands, edges, jaccard_components, shingle_set
from washboard.llm.prefix_tree import PrefixTree


def plain_set(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)} or ({tuple(found)} if found else set())


def roots(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_links(sets, percent):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def plain_rows(rows, words=3, percent=90):
    """Sorted (doc_id, n_shingles, component_id) for (doc_id, text)."""
    sets = [plain_set(t, words) for _, t in rows]
    of = roots(len(rows), plain_links(sets, percent))
    least = {}
    for (doc_id, _), r in zip(rows, of):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, of)), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[f"new{rng.randrange(999)}"], [], [words[i], f"more{rng.randrange(999)}"]])
    return words


def family(seed, n, words, edits):
    """Copies of a text with up to ``edits`` changes, some made from other copies."""
    rng = random.Random(seed)
    made = [prose(seed, words, 3000).split()]
    for _ in range(n - 1):
        made.append(edited(rng.choice(made), rng, rng.randint(1, edits)))
    return [" ".join(w) for w in made]


def test_sets():
    for t in (None, "", " \n", "A", "b A", "Ab c\x0bD\x1fE\x85F g", "x x x x x", prose(4, 300)):
        assert len(shingle_set(t, 3)) == len(plain_set(t))
        assert np.array_equal(shingle_set(t, 3), np.unique(shingle_set(t, 3)))
    assert np.array_equal(shingle_set("A b\nC", 3), shingle_set("a B c ", 3))


@pytest.mark.parametrize("percent", [90, 80, 65])
def test_similar_sets_share_an_edge(percent):
    rng, values = random.Random(percent), np.random.default_rng(percent)
    for _ in range(400):
        n = rng.choice([1, 2, 8, 9, 10, 11, 19, 20, 40, 100, 700])
        a = np.unique(values.integers(0, 2**64, n, dtype=np.uint64))
        # as many members taken out and put in as the bound allows
        out = rng.randint(0, n)
        most = max((k for k in range(0, n + 2) if 100 * (n - out) >= percent * (n + k)), default=-1)
        if most < 0 or (out == 0 and most == 0):
            continue
        b = np.unique(np.concatenate([values.permutation(a)[out:], values.integers(0, 2**64, most, dtype=np.uint64)]))
        assert len(np.intersect1d(edges(a, percent), edges(b, percent)))
    assert all(k >= 2 for k in bands(percent)[1])


@pytest.mark.parametrize("percent", [90, 70])
def test_trie_finds_all_links(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (1, 5, 30, 31, 200):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for _ in range(12):
            lost = rng.random(size) < rng.choice([0.02, 0.1, 0.3])
            sets.append(np.unique(np.concatenate([base[~lost], rng.integers(0, 2**64, int(lost.sum() * rng.random()) + 1, dtype=np.uint64)])))
    expected = plain_links([set(s.tolist()) for s in sets], percent)
    tree = PrefixTree(sets, percent)
    assert roots(len(sets), tree.links(np.arange(len(sets)))) == roots(len(sets), expected)
    # every link of a set asked for, but none within a group
    group = np.array(roots(len(sets), expected))
    assert tree.links(group) == []
    q, f = tree.similar(np.arange(len(sets)), np.arange(len(sets)))
    assert {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for a, b in zip(q, f)} == {(j, i) for i, j in expected}
    asked = np.arange(len(sets)) % 3 == 0
    some = tree.links(np.arange(len(sets)), asked)
    assert roots(len(sets), some) == roots(len(sets), [(i, j) for i, j in expected if asked[i] or asked[j]])


def test_table(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == plain_rows(rows)


def test_families_in_blocks(spark):
    """Groups of edited copies of many sizes, cut into small blocks so that every step is taken."""
    texts = family(1, 90, 150, 4) + family(2, 40, 30, 2) + family(3, 25, 12, 1) + family(4, 60, 400, 30) + ["only two"] * 3 + [prose(s, 60) for s in range(30)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plain_rows(rows)
    assert len({r[2] for r in expected}) > 40
    for most in (1_500_000, 4_000):
        assert got(df, block_members=most) == expected
    assert got(df, words=2, percent=75, block_members=6_000) == plain_rows(rows, 2, 75)


def test_odd_rows(odd, none):
    assert got(odd) == plain_rows([(r[0], r[1]) for r in odd_rows()])
    assert got(none) == []
    kept = collected(jaccard_components(odd, keep=("size", "source")))
    assert len(kept) == len(odd_rows()) and {"size", "source"} <= set(kept[0])

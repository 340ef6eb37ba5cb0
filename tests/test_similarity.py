import random

import pytest
from pyspark.sql import functions as F

from washboard import domain
from washboard.functions import similarity as S


def table_lcs(a, b):
    """Textbook table, one cell per pair of prefixes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def table_ratio(a, b):
    return 200.0 * table_lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def every_window(a, b):
    """Partial ratio by looking at every window, without passing any over."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    sides = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    return max(
        table_ratio(s, t[max(0, i):i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t))
    )


def words(rng, letters, longest):
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))


@pytest.mark.parametrize("letters", ["ab", "abc ", "abcdefgh "])
def test_scores_against_brute_force(letters):
    rng = random.Random(7)
    for _ in range(300):
        a, b = words(rng, letters, 8), words(rng, letters, 16)
        assert S.ratio(a, b) == pytest.approx(table_ratio(a, b))
        assert S.partial_ratio(a, b) == pytest.approx(every_window(a, b)), (a, b)


@pytest.mark.parametrize("a, b, score", [
    ("hyderbad", "Hyderabad", 82.352941), ("transportaion", "Transportation", 88.888889),
    ("shaheed benazirabd", "Shaheed Benazirabad", 86.486486), ("village land  community", "Village Land / Community", 82.6),
])
def test_known_pairs(a, b, score):
    assert S.weighted_ratio(a, b) >= score - 0.1
    assert S.ratio(a, b) <= S.weighted_ratio(a, b) <= 100


def test_shared_word_lifts_long_texts():
    # lengths differ by more than half, one word in common: 0.95 * 0.9 * 100
    assert S.weighted_ratio("House in Badin town", "Badin") == pytest.approx(90.0)
    assert S.weighted_ratio("x Badin yy", "Badin") == pytest.approx(90.0)
    assert S.weighted_ratio("badi " + "z" * 60, "Badin") <= 60


def test_cutoff_only_drops_lower_scores():
    rng = random.Random(3)
    for _ in range(400):
        a, b = words(rng, "abcd ", 30), words(rng, "abcd ", 8)
        full, cut = S.weighted_ratio(a, b), S.weighted_ratio(a, b, at_least=70)
        assert cut == full or full < 70


def test_best_choice_ties_and_empty_values():
    # 3 characters to 2 is a factor of 1.5 already, so the partial score counts: 0.9 * 100
    assert S.best_choice("ab", ["abd", "abc"]) == ("abc", 90)
    assert S.best_choice("", ["a"]) is None
    assert S.best_choice(None, ["a"]) is None
    assert S.best_choice("zzz", ["abc"], at_least=70) is None


def test_native_ratio_equals_python(spark):
    rng = random.Random(5)
    pairs = [(words(rng, "abc é", 9), words(rng, "abc é", 9)) for _ in range(150)] + [("", ""), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.indel_ratio("a", "b").alias("r"))
    for a, b, r in df.collect():
        assert r == pytest.approx(table_ratio(a, b)), (a, b)


def test_udf_keeps_rows_in_place(spark):
    values = ["hyderbad", None, "", "thatta", "hyderbad", "sukur"] * 50
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    best = S.best_choice_udf({0: domain.DISTRICTS}, 70)
    found = {r["i"]: r["b"] for r in df.select("i", best(F.lit(0), "v").alias("b")).collect()}
    for i, v in enumerate(values):
        expected = S.best_choice(v, domain.DISTRICTS, 70) or (None, None)
        assert tuple(found[i]) == expected


def test_native_ratio_of_long_texts(spark):
    """Patterns of one word of bits, exactly one, and several, with runs that carry across words."""
    rng = random.Random(11)
    pairs = [(words(rng, "ab", n), words(rng, "abc", m)) for n, m in ((59, 60), (60, 60), (61, 200), (120, 121), (181, 400), (300, 70))]
    pairs += [("a" * n, "a" * m) for n, m in ((60, 61), (61, 61), (120, 120), (121, 300))] + [("ba" * 90, "ab" * 90), ("x" * 70, "y" * 130), ("é漢" * 50, "漢" * 99)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.indel_ratio("a", "b").alias("r"))
    for a, b, r in df.collect():
        assert r == pytest.approx(table_ratio(a, b)), (a, b)


def spelling(rng, labels):
    """A label with some edits, or made of parts of several."""
    text = rng.choice(labels)
    for _ in range(rng.randint(0, 4)):
        i = rng.randint(0, len(text))
        text = rng.choice([text[:i] + rng.choice("abe xyz é") + text[i:], text[:i] + text[i + 1:], text + " " + rng.choice(labels)[:rng.randint(1, 9)]])
    return text


LABEL_LISTS = [
    [d.lower() for d in domain.DISTRICTS], ["a", "ab", "ba", "ab ba", "ab ab", "", " ", "abab", "b a b"],
    ["house in town", "town house", "a house in a town", "land", "land / village", "village land", "zzzz zzzz"],
]


@pytest.mark.parametrize("labels", LABEL_LISTS)
@pytest.mark.parametrize("at_least", [0, 70, 80])
def test_index_loses_nothing(labels, at_least):
    rng = random.Random(len(labels) + at_least)
    texts = [spelling(rng, labels) for _ in range(250)] + [words(rng, "abc  ", 12) for _ in range(150)] + ["", " ", "a"]
    index = S.LabelIndex(labels)
    assert index.best(texts, at_least) == [S.best_choice(t, labels, at_least) for t in texts]
    bounds = index.bounds(texts)
    for text, row in zip(texts, bounds):
        for label, bound in zip(index.labels, row):
            assert S.weighted_ratio(text, label) <= bound + 1e-9, (text, label)


def test_index_scores_few_labels(monkeypatch):
    scored, full = [], S.weighted_ratio
    monkeypatch.setattr(S, "weighted_ratio", lambda *a: scored.append(1) or full(*a))
    labels = [d.lower() for d in domain.DISTRICTS]
    rng = random.Random(2)
    texts = [f"{rng.choice(labels)}{rng.randrange(99999)}" for _ in range(300)]
    S.LabelIndex(labels).best(texts, 70)
    assert len(scored) < 3 * len(texts)

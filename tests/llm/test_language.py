import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from samples import collected, docs, none, odd, odd_rows  # noqa: F401

from washboard.llm.language import build, padded, predict_language, remainder, train


def plain_probability(counts: dict[str, int], alphabet: int, order: int):
    """Interpolated Kneser-Ney by its definition."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        before = defaultdict(set)
        for g in levels[k + 1]:
            before[g[1:]].add(g[0])
        levels[k] = {g: len(b) for g, b in before.items()}

    def discount(k):
        n = Counter(levels[k].values())
        return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / alphabet
        after = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total, d = sum(after.values()), discount(k)
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * p(gram[1:])

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_models_are_kneser_ney(order):
    texts = {"a": "the cat sat on the mat and the dog sat too", "b": "le chat et le chien de la rue", "c": "x"}
    counts = [(lang, padded(t, order)[i : i + order]) for lang, t in texts.items() for i in range(len(padded(t, order)) - order + 1)]
    table = pd.DataFrame([(lang, g, n) for (lang, g), n in Counter(counts).items()], columns=["lang", "gram", "n"])
    models = build(table, order)
    alphabet = len({ch for _, g in counts for ch in g}) + 1
    for text in ("the chat", "zzz le mat", "the dog é"):
        line = padded(text, order)
        entropies, n = models.cross_entropies(text)
        for j, lang in enumerate(models.languages):
            p = plain_probability({g: c for (l, g), c in Counter(counts).items() if l == lang}, alphabet, order)
            expected = -sum(math.log(p(line[i : i + order])) for i in range(n)) / n
            assert entropies[j] == pytest.approx(expected, rel=1e-5)


def test_held_out_accuracy(spark, docs):
    got = predict_language(docs, train(docs)).join(docs.select("doc_id", "lang", remainder(docs["doc_id"]).alias("part")), "doc_id").collect()
    held = [r for r in got if r["part"] == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == (r["part"] == 0) for r in got)
    assert sum(r["accepted"] for r in got) >= 0.95 * len(got)


def test_held_out_documents_teach_nothing_and_the_rest_is_no_input(spark, docs):
    models = train(docs)
    changed = docs.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz zz', text) AS text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz', lang) AS lang")
    other = train(changed)
    assert models.languages == other.languages
    assert all(np.array_equal(a.log_p, b.log_p) for a, b in zip(models.levels, other.levels))
    one = predict_language(docs, models).select("lang_pred", "score").collect()
    assert one == predict_language(docs.selectExpr("-doc_id AS doc_id", "text"), models).select("lang_pred", "score").collect()


def test_unknown_text_is_rejected(spark, docs):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(300))
    got = collected(predict_language(spark.createDataFrame([(1, noise), (2, docs.first()["text"])], "doc_id bigint, text string"), train(docs)))
    assert [g["accepted"] for g in sorted(got, key=lambda g: g["doc_id"])] == [False, True]


def test_odd_rows(spark, odd, none, docs):
    got = collected(predict_language(odd, train(odd)))
    assert len(got) == len(odd_rows())
    by_id = defaultdict(list)
    for g in got:
        by_id[g["doc_id"]].append(g)
    for doc_id in (4, 5, 6, 100):
        assert [g["lang_pred"] for g in by_id[doc_id]] == ["und"] and by_id[doc_id][0]["score"] == 0
    assert by_id[1][0] == by_id[1][1] and by_id[1][0]["lang_pred"] in ("en", "fr", "de")
    assert predict_language(none, train(none)).count() == 0
    assert {g["lang_pred"] for g in collected(predict_language(odd, train(none)))} == {"und"}
    assert predict_language(none, train(docs)).count() == 0


def test_long_documents_are_sampled_in_pieces(spark):
    # of the ids, each part has some; whole documents would be taken at a rate of 2 % at most
    letters = {"aa": "abcde fghij ", "bb": "klmno pqrst "}
    rows = [(i, letters[lang] * 250_000, lang) for lang, start in (("aa", 0), ("bb", 50)) for i in range(start, start + 6)]
    few = [(1000 + i, "uvwxyz " * 50, "cc") for i in range(30)]
    docs = spark.createDataFrame(rows + few, "doc_id bigint, text string, lang string")
    models = train(docs, sample_chars=200_000)
    assert models.languages == ["aa", "bb", "cc"]
    assert np.isfinite(models.bounds).all()
    assert [models.predict(t)[0] for t in ("abcde fghij", "klmno pqrst", "uvwxyz")] == models.languages
    # at a rate near zero one piece of each is left
    assert train(docs, sample_chars=1).languages == models.languages

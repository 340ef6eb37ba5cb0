import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from samples import collected, docs, none, odd, odd_rows, prose  # noqa: F401

from washboard.llm.repeats import groups, remove_repeats


def plain(texts: list[bytes], length: int = 400) -> list[tuple]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not gone[i - 1] if i else bool(g) for i, g in enumerate(gone[:-1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(df, **sizes):
    got = Counter((g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in collected(remove_repeats(df, **sizes)))
    rows = df.select("doc_id", "text").collect()
    assert got == Counter((r["doc_id"], *p) for r, p in zip(rows, plain([(r["text"] or "").encode() for r in rows])))


def test_table_in_many_small_blocks(docs):
    same(docs, block_bytes=20_000, part_bytes=40_000)


def test_passages_at_every_edge(spark):
    rng = random.Random(8)
    passages = [prose(900 + i, 90) for i in range(3)] + ["ab" * 300, "x" * 900, "".join(rng.choice("éßñ漢 ") for _ in range(500)), prose(950, 600)]
    rows = []
    for i in range(90):
        parts = [prose(i * 7 + k, rng.randint(0, 60), 10_000) for k in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts.insert(rng.randint(0, 3), p[a : len(p) - rng.randint(0, 60)])
        rows.append((i, rng.choice(["", " "]).join(parts)))
    # strings of exactly 399, 400 and 401 bytes shared by two documents each
    for k, n in enumerate((399, 400, 401)):
        shared = prose(2000 + k, 100, 10_000)[:n]
        rows += [(200 + k, "<" + shared + ">"), (300 + k, shared + "!"), (400 + k, "?" + shared)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(df.repartition(3), block_bytes=8_000, part_bytes=10_000)
    same(df.coalesce(1))


def test_odd_rows(odd, none):
    same(odd)
    same(odd, block_bytes=1)
    assert remove_repeats(none).count() == 0
    kept = remove_repeats(odd.filter("doc_id = 3"), texts=True).first()
    assert kept["kept"].decode() == odd_rows()[3][1]
    with pytest.raises(ValueError):
        remove_repeats(odd, length=100)


def test_groups_cover_each_start_once():
    rng = np.random.default_rng(3)
    for n in (0, 399, 400, 401, 3000):
        for data in (rng.integers(0, 256, n), rng.integers(97, 100, n), np.full(n, 97)):
            found = groups(data.astype(np.uint8), 400)
            starts = sorted(s for _, _, a, b in found.tolist() for s in range(a, b + 1))
            assert starts == list(range(max(0, n - 399)))

import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F
from samples import collected, docs, none, odd, odd_rows, prose  # noqa: F401

from washboard.llm.components import components
from washboard.llm.simhash import around, bit_counts, fingerprint, grid_points, simhash_components


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int]) -> list[int]:
    """Index of the first row of each row's component."""
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    texts = [prose(i, n) for i, n in enumerate((1, 2, 3, 4, 50, 700))] + [None, "", " \n", "ÀÉ ABC Straße x y", "A\x0bB\x1fC\x85D E  F"]
    for t in texts:
        assert fingerprint(t) % (1 << 64) == plain_fingerprint(t)


def test_components_of_the_table(docs):
    got = collected(simhash_components(docs))
    rows = sorted(docs.select("doc_id", "text").collect())
    values = [plain_fingerprint(r["text"]) for r in rows]
    expected = {r["doc_id"]: (f"{v:016x}", rows[c]["doc_id"]) for r, v, c in zip(rows, values, plain_components(values))}
    assert {g["doc_id"]: (g["fingerprint"], g["component_id"]) for g in got} == expected


def test_odd_rows(odd, none):
    got = collected(simhash_components(odd))
    assert len(got) == len(odd_rows())
    empty = {g["component_id"] for g in got if g["fingerprint"] == "0" * 16}
    assert empty == {4}  # null, empty and blank texts, and the row without id
    assert {g["component_id"] for g in got if g["doc_id"] in (1, 2)} == {1}
    assert all(g["component_key"] is not None for g in got)
    assert simhash_components(none).count() == 0


def test_grid_bounds_the_distance_and_hubs_verify_it(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(4):
            values.append(v := v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values += [0, (1 << 64) - 1, 1 << 63, 3 << 62]
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    df = spark.createDataFrame(signed, "fp bigint")
    out = {r["fp"]: r for r in df.select("fp", bit_counts(F.col("fp")).alias("v"), grid_points(F.col("fp")).alias("cells"), around(F.col("fp")).alias("hubs")).collect()}
    for (a,), x in zip(signed, values):
        assert out[a]["v"] % (1 << 64) == sum((x >> s & 3).bit_count() << s for s in range(0, 64, 2))
        for (b,), y in zip(signed, values):
            manhattan = sum(abs((x >> s & 3).bit_count() - (y >> s & 3).bit_count()) for s in range(0, 64, 2))
            assert bool(set(out[a]["cells"]) & set(out[b]["cells"])) == (manhattan <= 2)
            assert bool(set(out[a]["hubs"]) & set(out[b]["hubs"])) == ((x ^ y).bit_count() <= 2)


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[310], names[311])] * 3
    links += [(names[320], names[320])]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for start in {a for a, b in links if a != b}:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[start] == min(seen)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

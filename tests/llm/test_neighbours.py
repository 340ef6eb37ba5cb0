import math
from collections import defaultdict

import numpy as np
import pytest
from samples import collected

from washboard.llm.neighbours import Cells, dealt, leaves, nearest_neighbours


def plain(rows, k=10, every=100):
    """{row of a query: [(score, id)]} by brute force."""
    usable = [(i, n, np.array(v, dtype=float)) for i, (n, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, n, v in usable:
        if n is not None and n % every == 0:
            near = [(math.sqrt(((v - w) ** 2).sum()), m if m is not None else math.inf) for j, m, w in usable if j != i and len(w) == len(v)]
            out[i] = sorted(near)[:k]
    return out


def test_recall_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    got = defaultdict(list)
    for g in collected(nearest_neighbours(df, every=10, block_rows=60)):
        got[g["query_id"]].append((g["rank"], g["score"], g["vec_id"]))
    hit = total = 0
    vectors = {n: np.array(v, dtype=float) for n, v in rows}
    for i, near in plain(rows, every=10).items():
        found = sorted(got[rows[i][0]])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [s for _, s, _ in found] == sorted(s for _, s, _ in found)
        for _, score, n in found:
            assert score == pytest.approx(np.linalg.norm(vectors[n] - vectors[rows[i][0]]), rel=1e-12)
        hit += len({n for _, n in near} & {n for _, _, n in found})
        total += len(near)
    assert hit >= 0.93 * total


def test_few_hot_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(60)] + [(60 + i, rng.standard_normal(3).tolist()) for i in range(60)]
    rows += [(100, same), (None, same), (200, None), (300, []), (400, [0.0] * 3), (500, [1.0, None, 2.0]), (600, [1.0, float("nan"), 2.0]), (700, [float("inf"), 1.0, 1.0])]
    rows += [(800, [1.0, 0.0]), (900, [0.0, 2.0]), (901, [0.5, 0.5]), (1000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS size", "2 AS cell", "3 AS row", "4 AS score")
    got = defaultdict(list)
    for g in collected(nearest_neighbours(df, block_rows=16, certainty=0.9999)):
        got[g["query_id"]].append((g["rank"], round(g["score"], 9), g["vec_id"] if g["vec_id"] is not None else math.inf))
    expected = defaultdict(list)
    for i, near in plain(rows).items():
        expected[rows[i][0]] += [(r + 1, round(s, 9), n) for r, (s, n) in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in expected.items() if v}
    assert nearest_neighbours(df.filter("false")).count() == 0


def test_cells_and_leaves_hold_each_point_once():
    rng = np.random.default_rng(7)
    points = rng.standard_normal((3000, 4))
    cells = Cells(points[:500], 4)
    of = cells.of(points)
    assert len(cells.low) == 16 and set(of.tolist()) == set(range(16))
    for p, c in zip(points[:200], of[:200]):
        assert cells.gaps(p)[c] == 0
    assert sorted(np.concatenate(leaves(points)).tolist()) == list(range(3000))
    assert len(Cells(np.ones((50, 3)), 5).low) == 1


def test_queries_of_a_cell_are_dealt_too(spark):
    index = spark.range(300).selectExpr("3 AS size", "0 AS cell", "cast(id % 5 AS int) AS block", "id AS row")
    asked = spark.range(1000).selectExpr("3 AS size", "0 AS cell", "id AS row", "'x' AS vector")
    left, right = dealt(index, asked, spark.createDataFrame([(3, 0, 5)], "size int, cell int, blocks int"), 60)
    keys = ["size", "cell", "block", "part"]
    for side in (left, right):
        assert max(r["count"] for r in side.groupBy(*keys).count().collect()) <= 2 * 60
    met = left.select(*keys, "row").join(right.select(*keys, right["row"].alias("asked")), keys)
    assert met.count() == met.distinct().count() == 300 * 1000


def test_hot_id(spark):
    rng = np.random.default_rng(3)
    rows = [(100 if i % 3 else i, rng.standard_normal(3).tolist()) for i in range(150)]
    got = defaultdict(list)
    for g in collected(nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block_rows=16, certainty=0.9999)):
        got[g["query_id"]].append((g["rank"], round(g["score"], 9), g["vec_id"]))
    expected = defaultdict(list)
    for i, near in plain(rows).items():
        expected[rows[i][0]] += [(r + 1, round(s, 9), n) for r, (s, n) in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in expected.items()}

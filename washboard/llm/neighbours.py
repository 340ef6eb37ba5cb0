"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on a few Gaussian directions: the squared projected distance of two vectors, over their squared distance, is
chi-square distributed. Projected points are indexed by a kd-tree, whose upper part deals them to cells and whose lower
part is built over each block of a cell. A query takes projected neighbours from near to far, computes their true
distances and stops once the next projected distance is so large, compared with the k-th true distance found, that
a vector nearer than that would have been met with probability ``certainty``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washboard.llm.common import stage
from washboard.llm.stats import chi_square_quantile

LEAF = 32
#: Stands for a null id where pandas would make floats of numbers with nulls; no id may be the smallest long.
NO_ID = -(1 << 63)
FOUND = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score double"


def directions(width: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, width))


class Cells:
    """Upper part of the kd-tree: median splits of sample points along the widest axis, ``depth`` deep."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        width = sample.shape[1]
        self.axis, self.value, self.children, low, high = [], [], [], [], []

        def split(points: np.ndarray, left: int, lo: np.ndarray, hi: np.ndarray) -> int:
            """Number of the node: inner nodes count from 0, cells from -1 downwards."""
            spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(width)
            axis = int(spread.argmax())
            value = float(np.median(points[:, axis])) if len(points) else 0.0
            below = points[:, axis] < value
            if not left or not below.any():
                low.append(lo)
                high.append(hi)
                return -len(low)
            node = len(self.axis)
            self.axis.append(axis)
            self.value.append(value)
            self.children.append(None)
            upper, lower = hi.copy(), lo.copy()
            upper[axis] = lower[axis] = value
            self.children[node] = (split(points[below], left - 1, lo, upper), split(points[~below], left - 1, lower, hi))
            return node

        self.root = split(sample, depth, np.full(width, -np.inf), np.full(width, np.inf))
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """Cell of each point."""
        out = np.empty(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                below = points[rows, self.axis[node]] < self.value[node]
                left, right = self.children[node]
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each cell."""
        return box_gaps(point, self.low, self.high)


def box_gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.square(np.maximum(np.maximum(low - point, point - high), 0)).sum(axis=1)


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """Lower part of the kd-tree: rows of each leaf, by median splits along the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = rows[np.argsort(part[:, axis], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def search_block(index: pd.DataFrame, queries: pd.DataFrame, k: int, stop: float) -> pd.DataFrame:
    """The ``k`` nearest found in one block for each query. ``bound`` is the k-th squared distance a query brings along."""
    x, points = np.stack(index["vector"]).astype(float), np.stack(index["point"])
    ids, rows = index["vec_id"].to_numpy(), index["row"].to_numpy()
    parts = leaves(points)
    low = np.array([points[p].min(axis=0) for p in parts])
    high = np.array([points[p].max(axis=0) for p in parts])
    found = []
    for q in queries.itertuples():
        vector, point = np.asarray(q.vector, dtype=float), np.asarray(q.point)
        gaps, bound = box_gaps(point, low, high), q.bound
        best, where = np.empty(0), np.empty(0, dtype=np.int64)
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > stop * bound:
                break
            near = parts[leaf]
            near = near[(np.square(points[near] - point).sum(axis=1) <= stop * bound) & (rows[near] != q.row)]
            best = np.concatenate([best, np.square(x[near] - vector).sum(axis=1)])
            where = np.concatenate([where, near])
            if len(best) > k:
                nearest = np.lexsort((rows[where], ids[where], ids[where] == NO_ID, best))[:k]
                best, where = best[nearest], where[nearest]
            if len(best) == k:
                bound = min(bound, best.max())
        found.append(pd.DataFrame({"query_row": q.row, "query_id": q.vec_id, "vec_id": ids[where], "row": rows[where], "score": np.sqrt(best)}))
    return pd.concat(found) if found else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []})


def dealt(index: DataFrame, asked: DataFrame, counts: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """``index`` (size, cell, block, row, ..) and ``asked`` (size, cell, row, ..) with the columns block and part, where ``counts`` has
    the blocks of each size and cell: all that share size, cell, block and part are about ``block_rows`` rows at most on either side,
    and each row asked meets each index row of its cell once. Queries are copied to each block of their cell, blocks to each part of its queries."""
    parts = asked.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    copied = index.join(parts, ["size", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # another seed than the blocks' hash, so that parts do not depend on blocks
    each = asked.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "row"), F.col("parts")).cast("int"))
    each = each.join(counts, ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return copied, each.select(*[F.col(c).alias(c) for c in each.columns])  # both sides come from one table


def nearest_neighbours(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, width: int = 8,
    certainty: float = 0.98, block_rows: int = 4096, sample_rows: int = 20_000, most_depth: int = 10, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` nearest found among all other rows.

    Rows whose vector is null, empty or zero, or holds a null or a number that is not finite, take no part. Vectors of different lengths are
    not compared. A null id is never a query and comes last among ties; repeated ids are different rows, each of
    which is found and, where divisible, asked for. Queries with fewer candidates get all of them. An empty table gives no
    rows. Columns not named are not looked at.

    The cells are fitted to at most about ``sample_rows`` projected rows (chosen by hash); all rows are indexed. A cell is dealt to
    blocks of about ``block_rows``, and so are its queries, so that neither a hot vector nor a hot id fills one task. A query
    first searches its own cell, then those that the stopping test does not rule out given the distance found there."""
    stop = chi_square_quantile(certainty, width)
    numbers = F.col("vector")
    usable = F.coalesce(
        F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(numbers, lambda v: v != 0), F.lit(False)
    )
    rows = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(usable).withColumn("row", F.monotonically_increasing_id())

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, np.ndarray] = {}
        for part in batches:
            points = []
            for v in part["vector"]:
                if len(v) not in ready:
                    ready[len(v)] = directions(width, len(v), seed)
                points.append(np.asarray(v) @ ready[len(v)])
            yield part.assign(point=points)

    shape = "vec_id bigint, vector array<double>, row bigint, point array<double>"
    projected = stage(rows.mapInPandas(project, shape), "ann-points")
    total = projected.count()
    rate = min(1.0, sample_rows / max(total, 1))
    chosen = projected.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < math.ceil(rate * (1 << 20))).select("point").limit(2 * sample_rows).collect()
    depth = min(most_depth, max(0, math.ceil(math.log2(max(total, 1) / block_rows)))) if chosen else 0
    cells = Cells(np.array([r["point"] for r in chosen]) if chosen else np.zeros((0, width)), depth)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(cell=cells.of(np.stack(part["point"])) if len(part) else [])

    placed = projected.mapInPandas(assign, f"{shape}, cell int").withColumn("size", F.size("vector"))
    placed = stage(placed, "ann-cells")
    counts = placed.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    index = placed.join(counts, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    queries = placed.filter((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))

    def search(asked: DataFrame) -> DataFrame:
        """Candidates of ``asked`` (size, cell, row, vec_id, vector, point, bound) from all blocks of the cells named."""
        copied, each = dealt(index, asked, counts, block_rows)
        keys = ("size", "cell", "block", "part")
        both = copied.groupBy(*keys).cogroup(each.groupBy(*keys))

        def run(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(block) or not len(wanted):
                return search_block(index=pd.DataFrame({"vector": [np.zeros(1)], "point": [np.zeros(1)], "vec_id": [0], "row": [0]}), queries=wanted.head(0), k=k, stop=stop)
            return search_block(block, wanted, k, stop)

        return both.applyInPandas(run, FOUND)

    home = stage(search(queries.withColumn("bound", F.lit(float("inf")))), "ann-home")
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id") == NO_ID, "vec_id", "row")
    bounds = home.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_row", (F.col("score") * F.col("score")).alias("bound"))
    bounded = queries.join(bounds, queries["row"] == bounds["query_row"], "left").drop("query_row")
    bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            near = [np.flatnonzero((cells.gaps(np.asarray(p)) <= stop * b) & (np.arange(len(cells.low)) != c)).tolist() for p, b, c in zip(part["point"], part["bound"], part["cell"])]
            yield part.assign(cell=near)[["row", "cell", "bound"]].explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

    # the cells named are counted and then searched; vectors are joined only where they are searched
    named = stage(bounded.select("row", "point", "cell", "bound").mapInPandas(further, "row bigint, cell int, bound double"), "ann-asked")
    asked = queries.drop("cell").join(named, "row")
    found = home.unionByName(search(asked))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")

"""Exact Jaccard join of word n-gram sets by prefix trees.

All sets are ordered alike, by hash, and cut at the same places of that order into classes. Two sets that are similar enough differ in
at most ``d`` members, so of the first d + 2 classes at least two are equal: every set is filed under its first classes, as under
the first edges of a trie, and only sets that share an edge are held against each other. A class with fewer than two members says little
and is filed only together with another such class.

Sets that share edges gather around the smallest of them. Each set first meets one of its gatherings, in blocks of bounded size, where
a prefix tree finds the links; a gathering whose sets are not all joined by then is searched whole, its blocks against the sets outside of its
largest component. Only enough links to join what is linked are written. Equal sets count as one throughout, and sets move only
if they share an edge with another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.llm.common import stage, text_pass
from washboard.llm.components import components
from washboard.llm.prefix_tree import PrefixTree, cuts
from washboard.operators.lookup import BROADCAST_ROWS, members_of

SEED = 42
#: Members of the sets that one task holds, each set counted as so many more.
BLOCK_MEMBERS, SET_WEIGHT = 1_500_000, 256
#: Sizes of sets whose edges are cut alike, as a ratio.
BAND = 1.25
TINY = 2
#: Edges that are broadcast at most, the ones with at least that part of all shared filings.
HOT_EDGES = 20_000
#: Hashes of texts (8 bytes) that are broadcast at most.
MOST_HASHES = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; of the whole sequence where it has fewer words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line, n = b" ".join(found), len(found) - words + 1
    if n <= 1:
        return np.array([xxhash.xxh3_64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    make = xxhash.xxh3_64_intdigest
    return np.unique(np.array([make(line[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype=np.uint64))


@lru_cache
def bands(percent: int) -> tuple[list[int], list[int]]:
    """Smallest size of each band, and the number of classes its sets are cut into."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
    return lows, [most_different(high - 1, percent) + 2 for high in lows[1:]]


def most_different(size: int, percent: int) -> int:
    """Members in which a set of ``size`` and a similar one that is not smaller differ, at most."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX
    return values ^ (values >> np.uint64(29))


def edges(values: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set is filed, in its own band and in lower ones that hold sets similar to it."""
    lows, numbers = bands(percent)
    n = len(values)
    own = int(np.searchsorted(lows, n, side="right")) - 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(values))])
    out = [np.zeros(0, dtype=np.uint64)]
    for band in range(own, -1, -1):
        largest = min(n, lows[band + 1] - 1)
        if percent * n > 100 * largest:
            break
        different = most_different(largest, percent)
        if not different:
            continue  # only equal sets
        at = cuts(values, numbers[band])[: different + 3]
        name = mixed(np.arange(different + 2, dtype=np.uint64) + np.uint64((band + 1) << 40))
        key = mixed((sums[at[1:]] - sums[at[:-1]]) ^ name)
        tiny = np.diff(at) < TINY
        few = key[tiny]
        a, b = np.triu_indices(len(few), 1)
        out += [key[~tiny], mixed(few[a] ^ mixed(few[b]))]
    return np.unique(np.concatenate(out))


def set_name(values: np.ndarray) -> int:
    """64-bit name of a set, signed. Different sets share one with a chance of n^2 / 2^65 for n sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), SEED)).astype(np.int64))


DESCRIPTION = [T.StructField("j_size", T.LongType()), T.StructField("j_node", T.LongType()), T.StructField("j_edges", T.ArrayType(T.LongType()))]


def description(values: np.ndarray, keys: Callable[[np.ndarray], np.ndarray]) -> tuple:
    """Size and name of a set, and the ``keys`` it is filed under."""
    return (len(values), set_name(values), keys(values).view(np.int64)) if len(values) else (0, None, [])


def described(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """``docs`` with j_size, j_node (the set's name) and j_edges in place of the text."""

    def make(texts: list) -> list[tuple]:
        return [description(shingle_set(t, words), lambda s: edges(s, percent)) for t in texts]

    return text_pass(docs, text, T.StructType(DESCRIPTION), make)


def set_bytes(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(node, members) of the texts of ``docs``, once for each set."""
    kinds = [("node", T.LongType()), ("members", T.BinaryType())]

    def make(texts: list) -> list[tuple]:
        return [(set_name(s), s.tobytes()) for s in (shingle_set(t, words) for t in texts)]

    found = text_pass(docs.select(text), text, T.StructType([T.StructField(*k) for k in kinds]), make)
    return found.groupBy("node").agg(F.first("members").alias("members"))


LINKS = "a bigint, b bigint"


def block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links among the sets of a block (node, component, query, members), none between sets of one component.

    Where some rows are queries, links of these to the others are looked for."""
    rows = rows.sort_values(["query", "node"]).drop_duplicates("node", keep="last")
    asked = rows["query"].to_numpy(bool)
    nodes = rows["node"].to_numpy()
    if len(nodes) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    tree = PrefixTree([np.frombuffer(m, dtype=np.uint64) for m in rows["members"]], percent)
    found = tree.links(rows["component"].to_numpy(), asked if asked.any() else None)
    a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return pd.DataFrame({"a": nodes[a], "b": nodes[b]})


def searched(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``tasks`` (hub, block, other, node, component, query), one prefix tree for each (hub, block, other)."""
    # written first, so that no partitioning by hub alone is taken over for the groups
    rows = stage(tasks, "jaccard-tasks").join(sets, "node")
    return rows.groupBy("hub", "block", "other").applyInPandas(lambda block: block_links(block, percent), LINKS)


def small(df: DataFrame) -> DataFrame:
    """The written table ``df``, broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def number_of_blocks(weight: Column, most: int) -> Column:
    return F.ceil(weight / most).cast("bigint")


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), words: int = 3, percent: int = 90,
    block_members: int = BLOCK_MEMBERS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep``, n_shingles and component_id, the smallest id that links reach.

    A text's set are its distinct n-grams of ``words`` words (runs without ASCII white space, A-Z lower-cased), or all its words
    as one if there are fewer. Two texts are linked if 100 x common members >= ``percent`` x members of either.

    Null and empty texts and texts without words have the empty set, which is linked with nothing: their component is their own id.
    Repeated rows and ids stay, equal sets are linked; a row without id gets the component of its set, null if that reaches no id. An
    empty table gives no rows. Texts are read whole. Columns not named are not looked at; ``keep`` must not hold the new names."""
    if {"n_shingles", "component_id"} & set(keep):
        raise ValueError("columns would be overwritten")
    text = F.col(text_col)
    selected = docs.select(F.col(id_col), *[F.col(k) for k in keep], F.xxhash64(text).alias("j_text_hash"), text.alias("j_text"))
    rows = stage(described(selected, "j_text", words, percent), "jaccard-rows")
    links = all_links(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("j_text")), rows, words, percent, block_members)
    full = rows.filter("j_size > 0")
    nodes = full.groupBy(F.col("j_node").alias("node")).agg(F.min(F.col(id_col).cast("bigint")).alias("doc"), F.count(F.lit(1)).alias("j_rows"))
    grouped = components(links, "jaccard-links").withColumnRenamed("node", "linked")
    known = stage(nodes.join(grouped, F.col("node") == F.col("linked"), "left").select("node", "doc", "j_rows", F.coalesce("component", "node").alias("root")), "jaccard-known")
    names = known.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = stage(known.join(names, "root").select(F.col("node").alias("j_node"), "component_id", "j_rows"), "jaccard-names")
    columns = [id_col, *keep, F.col("j_size").alias("n_shingles")]
    joined = members_of(full, named, ["j_node"], "j_rows").select(*columns, "component_id")
    return joined.unionByName(rows.filter("j_size = 0").select(*columns, F.col(id_col).cast("bigint").alias("component_id")))


def all_links(texts: DataFrame, rows: DataFrame, words: int, percent: int, block_members: int) -> DataFrame:
    """Links (a, b) of nodes that join all sets that similarity joins, as far as similar sets share one of their ``j_edges``.

    ``texts`` are (text_hash, j_text), ``rows`` (j_text_hash, j_size, j_node, j_edges)."""
    weight = F.col("j_size") + SET_WEIGHT
    filed = rows.select(F.col("j_node").alias("node"), weight.alias("weight"), F.explode("j_edges").alias("edge"))
    shared = filed.groupBy("edge").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("rows"))
    shared = stage(shared.filter("hub < last").drop("last"), "jaccard-edges")
    pairs = members_of(filed, shared, ["edge"], "rows", limit=HOT_EDGES).filter("node <> hub").select("hub", "node", "weight").distinct()
    pairs = stage(pairs, "jaccard-pairs")
    hubs = pairs.select(F.col("hub").alias("node")).distinct()
    wanted = stage(pairs.select("node").unionByName(hubs).distinct(), "jaccard-wanted")
    hashes = rows.join(small(wanted), F.col("j_node") == F.col("node"), "left_semi").groupBy(F.col("j_text_hash").alias("text_hash")).agg(F.count(F.lit(1)).alias("rows"))
    found = members_of(texts, stage(hashes, "jaccard-texts"), ["text_hash"], "rows", limit=MOST_HASHES)
    sets = stage(set_bytes(found, "j_text", words), "jaccard-sets")
    alone = [F.lit(0).cast("bigint").alias("other"), "node", F.col("node").alias("component"), F.lit(False).alias("query")]

    # each set meets the sets of one gathering, with the hub in each of its blocks
    chosen = stage(pairs.groupBy("node").agg(F.min("hub").alias("hub"), F.first("weight").alias("weight")), "jaccard-chosen")
    weights = chosen.groupBy("hub").agg(number_of_blocks(F.sum("weight"), block_members).alias("blocks"), F.count(F.lit(1)).alias("chose"))
    weights = stage(weights, "jaccard-weights")
    dealt = chosen.join(small(weights), "hub").select("hub", F.pmod(F.xxhash64("node"), "blocks").alias("block"), *alone)
    centres = weights.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    first = stage(searched(dealt.unionByName(centres.select("hub", "block", *alone)), sets, percent), "jaccard-found")

    # gatherings that were not searched whole and are still apart
    reached = components(first, "jaccard-first").withColumnRenamed("node", "linked")
    gathered = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("sets"), F.sum("weight").alias("whole"))
    gathered = gathered.join(weights, "hub", "left").filter("blocks is null or blocks > 1 or chose < sets").select("hub", "whole", "sets")
    gathered = stage(gathered, "jaccard-gathered")
    rest = members_of(pairs, gathered, ["hub"], "sets").select("hub", "node", "whole", "weight")
    rest = rest.unionByName(gathered.select("hub", F.col("hub").alias("node"), "whole", F.lit(SET_WEIGHT).cast("bigint").alias("weight")))
    rest = rest.join(reached, F.col("node") == F.col("linked"), "left").withColumn("component", F.coalesce("component", "node")).drop("linked")
    rest = stage(rest, "jaccard-rest")
    apart = rest.groupBy("hub").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("sets"))
    apart = stage(apart.filter("least < most").select("hub", "sets"), "jaccard-hubs")
    apart = stage(members_of(rest, apart, ["hub"], "sets"), "jaccard-apart")
    one = apart.filter(F.col("whole") <= block_members).select("hub", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("other"), "node", "component", F.lit(False).alias("query"))
    tasks = one.unionByName(crossed(apart.filter(F.col("whole") > block_members), block_members))
    second = searched(tasks, sets, percent)
    return stage(first.unionByName(second), "jaccard-links")


def crossed(apart: DataFrame, block_members: int) -> DataFrame:
    """Tasks for large gatherings: each block of their sets against each block of the sets outside the largest component."""
    sizes = apart.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("in"), F.first("whole").alias("whole"))
    plan = sizes.groupBy("hub").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("whole").alias("whole"),
                                    (F.sum("in") - F.max_by("in", F.struct("n", "component"))).alias("outside"))
    blocks, others = number_of_blocks(F.col("whole"), block_members), number_of_blocks(F.col("outside"), block_members)
    plan = stage(plan.select("hub", "largest", blocks.alias("blocks"), others.alias("others")), "jaccard-plan")
    known = apart.join(small(plan), "hub")
    every = {n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)) for n in ("blocks", "others")}
    columns = ["hub", "block", "other", "node", "component", "query"]
    place = {n: F.pmod(F.xxhash64("node"), n) for n in every}
    held = known.withColumns({"block": place["blocks"], "other": every["others"], "query": F.lit(False)}).select(*columns)
    asked = known.filter("component <> largest").withColumns({"other": place["others"], "block": every["blocks"], "query": F.lit(True)})
    return held.unionByName(asked.select(*columns))

"""SimHash near-duplicates by segment popcounts.

A fingerprint's segments of a few bits each give a vector of bit counts. The Manhattan distance of two such vectors is at most
the Hamming distance of the fingerprints, so pairs within the Hamming bound lie within it on the grid of vectors too.
Two grid points at distance 2 or less share a point at distance 1 or less from both: every fingerprint is put into the cells of
its own and all neighbouring points, and a fingerprint that is alone in each of its cells has no link. The rest are verified exactly
the same way in the space of fingerprints: two fingerprints differ in at most 2 bits exactly if some 64-bit value differs from
each of them in at most 1 bit. All fingerprints around such a value are linked to the smallest document among them, so a
group of any size gives as many links as it has members and no pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.llm.common import stage, text_pass
from washboard.llm.components import components
from washboard.llm.jaccard import BLOCK_MEMBERS, DESCRIPTION, all_links, description, mixed, shingle_set

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 14
#: Bands of minima for candidates of similar sets, and minima of a band.
BANDS, BAND_ROWS = 20, 5


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit fingerprint. Lower-casing bytes changes A-Z alone, and splitting them splits at ASCII white space alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - words_per_shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
        ends = (ends[words_per_shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends)]
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i : i + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str, name: str = "fp", keep_text: bool = False, words: int = 3) -> DataFrame:
    """``docs`` with the fingerprint ``name``, in place of the text unless ``keep_text``."""
    added = T.StructType([T.StructField(name, T.LongType())])
    return text_pass(docs, text_col, added, lambda texts: ((fingerprint(t, words),) for t in texts), keep_column=keep_text)


@lru_cache
def random_orders(number: int) -> tuple[np.ndarray, np.ndarray]:
    """What turns 32-bit hashes into as many others, each an order of its own."""
    draw = np.random.default_rng(SEED)
    seeds, factors = (draw.integers(0, 2**32, number, dtype=np.uint32) for _ in range(2))
    return seeds, factors | np.uint32(1)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """One key per band of ``rows`` minima of the set under random orders. Two sets of similarity s share one with a chance of
    1 - (1 - s ** rows) ** bands: 0.9996 for 0.8."""
    seeds, factors = random_orders(bands * rows)
    least = np.full(bands * rows, 2**32 - 1, dtype=np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), CHUNK // 8):
        least = np.minimum(least, ((short[i : i + CHUNK // 8, None] ^ seeds) * factors).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for own in least.reshape(bands, rows).T:
        key = mixed(key ^ own.astype(np.uint64))
    return np.unique(key)


def similar_links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of fingerprints whose texts have similar sets of n-grams, and of those with equal sets.

    Sets that share a band are held against each other exactly, see ``jaccard.all_links``."""
    links = all_links(docs.select(F.xxhash64("s_text").alias("text_hash"), F.col("s_text").alias("j_text")), rows, words, percent, BLOCK_MEMBERS)
    owners = stage(rows.filter("j_size > 0").groupBy(F.col("j_node").alias("node"), "s_fp").agg(F.lit(1)).select("node", "s_fp"), "simhash-owners")
    first = stage(owners.groupBy("node").agg(F.min("s_fp").alias("fp")), "simhash-first")
    equal = owners.join(first, "node").select(F.col("fp").alias("a"), F.col("s_fp").alias("b"))
    a, b = first.select(F.col("node").alias("a"), F.col("fp").alias("fp_a")), first.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    near = links.join(a, "a").join(b, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return equal.unionByName(near).filter("a <> b")


def bit(k: int) -> int:
    """The signed value with bit ``k`` alone."""
    return -(1 << 63) if k == 63 else 1 << k


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bit_counts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in two bits of the result."""
    low, odd = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    ones = fp.bitwiseXOR(low).bitwiseAND(odd)
    twos = fp.bitwiseAND(low).bitwiseAND(odd)
    return ones.bitwiseOR(F.shiftleft(twos, 1))


def grid_points(fp: Column) -> Column:
    """The fingerprint's grid point and all points at Manhattan distance 1 whose counts are from 0 to 2.

    In a segment, flipping the lower bit turns 0 and 1 into each other, flipping both turns 1 and 2 into each other."""
    v = bit_counts(fp)
    points = [v]
    for s in range(0, BITS, 2):
        count = F.shiftrightunsigned(v, s).bitwiseAND(F.lit(3))
        points += [F.when(count < 2, v.bitwiseXOR(F.lit(bit(s)))), F.when(count > 0, v.bitwiseXOR(F.lit(signed(3 << s))))]
    return F.filter(F.array(*points), lambda p: p.isNotNull())


def around(fp: Column) -> Column:
    """All values that differ from the fingerprint in at most one bit."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(bit(k))) for k in range(BITS)])


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), words: int = 3, similar: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep``, fingerprint (16 hexadecimal digits), component_id, the smallest id that
    links of at most 2 differing bits reach, and component_key, a number of the component that is never null. Fingerprints are made of
    shingles of ``words`` words. With ``similar``, texts whose sets of shingles have at least that many percent of their members in common
    are linked as well; a pair just that similar is missed with a chance of 0.0004, an equal one never.

    Null and empty texts and texts without words have fingerprint zero and are linked like others. Repeated rows and ids stay;
    rows without id get the component of their fingerprint (null if no row reached has an id). Texts are read whole. An empty
    table gives no rows. Columns not named are not looked at; ``keep`` must not hold these names."""
    if {"fingerprint", "component_id", "component_key"} & set(keep):
        raise ValueError("columns would be overwritten")
    selected = docs.select(F.col(id_col), *[F.col(k) for k in keep], F.col(text_col).alias("s_text"))
    if similar:
        hashed = selected.withColumn("j_text_hash", F.xxhash64("s_text"))
        added = T.StructType([T.StructField("s_fp", T.LongType()), *DESCRIPTION])
        made = text_pass(hashed, "s_text", added, lambda texts: ((fingerprint(t, words), *description(shingle_set(t, words), band_keys)) for t in texts))
        rows = stage(made, "simhash-rows")
    else:
        rows = stage(fingerprints(selected, "s_text", "s_fp", words=words), "simhash-rows")
    # one node per fingerprint; the fingerprint itself is the node, its smallest document decides the name
    nodes = stage(rows.groupBy(F.col("s_fp").alias("fp")).agg(F.min(F.col(id_col).cast("bigint")).alias("doc")), "simhash-nodes")
    cells = nodes.select("fp", F.explode(grid_points(F.col("fp"))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    near = stage(cells.join(shared, "cell", "left_semi").select("fp").distinct(), "simhash-near")
    hubs = stage(near.select("fp", F.explode(around(F.col("fp"))).alias("hub")), "simhash-hubs")
    centres = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub", "a")
    links = hubs.join(centres, "hub").select("a", F.col("fp").alias("b")).filter("a <> b").distinct()
    if similar:
        links = links.unionByName(similar_links(selected, rows, words, similar))
    groups = components(links, "simhash-links")
    known = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("root"))
    known = stage(known, "simhash-known")
    names = known.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = known.join(names, "root").select(F.col("fp").alias("s_fp"), "component_id", F.col("root").alias("component_key"))
    result = rows.join(named, "s_fp")
    return result.select(id_col, *keep, F.lower(F.lpad(F.hex("s_fp"), 16, "0")).alias("fingerprint"), "component_id", "component_key")

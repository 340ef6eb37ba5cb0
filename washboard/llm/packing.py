"""Packing documents into sequences by the sum-of-squares rule.

Each piece goes where the sum over all residual gaps of the squared number of open sequences with that gap becomes smallest.
That keeps the gaps varied, so that later pieces find a gap that fits exactly. Pieces are dealt to shards of bounded size, each
packed on its own with the longest pieces first; a shard leaves at most a few sequences partly filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washboard.llm.common import stage
from washboard.llm.tokens import VOCABULARY, ids

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones but for the first, which takes what is left over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """(doc, piece, start, length, ids_crc32), without a shuffle. The id travels as text, since pandas makes floats of
    numbers with nulls."""
    schema = f"doc string, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids(vocabulary)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                rows, place, start, length, check = [], [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    all_ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                    for k, (s, n) in enumerate(cut(len(all_ids), capacity)):
                        rows.append(i)
                        place.append(k)
                        start.append(s)
                        length.append(n)
                        check.append(zlib.crc32(all_ids[s : s + n]))
                columns = [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(place, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in (start, length, check)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def place_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, by the sum-of-squares rule in the order given, and the number of sequences.

    Putting a piece of ``s`` into a gap of ``g`` changes the sum by 2 (count[g - s] - count[g] + 1), one less if it fills
    the gap, since full sequences are not counted; a new sequence changes it by 2 count[capacity - s] + 1. Equal
    changes are settled for the smaller gap, and for an open sequence rather than a new one."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            here = count[s:capacity]
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] <= 2 * count[capacity - s] + 1:
                gap = best + s
        if gap == capacity:
            bin_id, made = made, made + 1
        else:
            bin_id = opened[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = bin_id, capacity - gap
        if gap > s:
            opened[gap - s].append(bin_id)
            count[gap - s] += 1
    return sequence, offset, made


def merge_open(sequence: np.ndarray, offset: np.ndarray, lengths: np.ndarray, made: int, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins sequences that are still partly filled, the fullest first, each into the fullest one that has room."""
    filled = np.bincount(sequence, weights=lengths, minlength=made).astype(np.int64)
    part = np.flatnonzero(filled < capacity)
    part = part[np.argsort(-filled[part], kind="stable")]
    where, shift, room = np.arange(made), np.zeros(made, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kept: list[int] = []
    for b in part.tolist():
        fits = np.flatnonzero(room >= filled[b])
        if len(fits):
            k = int(fits[room[fits].argmin()])
            where[b], shift[b] = kept[k], capacity - room[k]
            room[k] -= filled[b]
        else:
            kept.append(b)
            room = np.append(room, capacity - filled[b])
    return where[sequence], offset + shift[sequence]


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0,
    shard_pieces: int = 100_000,
) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id and offset.

    A document is the ids of its whole text and ``end_id``; null text is empty, which leaves ``end_id`` alone. Only documents of
    more than ``capacity`` ids are cut. Each row is packed, so repeated rows and ids are packed as often as they come; null
    ids stay null. An empty table gives no rows. Columns not named are not looked at. A piece of ``capacity`` ids is a sequence of its
    own and goes to no shard. A shard holds about ``shard_pieces`` of the shorter pieces, whatever their documents or copies, and numbers its
    sequences from shard * 2 ** 32; the whole pieces' numbers come after those of all shards."""
    cut_up = stage(pieces(docs, id_col, text_col, capacity, vocabulary, end_id).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    short = cut_up.filter(F.col("length") < capacity)
    shards = -(-short.count() // shard_pieces) or 1
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "row"], ascending=[False, True]).reset_index(drop=True)
        lengths = part["length"].to_numpy()
        sequence, offset, made = place_pieces(lengths, capacity)
        sequence, offset = merge_open(sequence, offset, lengths, made, capacity)
        return part.assign(sequence_id=sequence + (int(part["shard"].iloc[0]) << 32), offset=offset)[
            ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    packed = dealt.groupBy("shard").applyInPandas(pack, f"doc string, {PIECES}, sequence_id bigint, offset bigint")
    whole = cut_up.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(shards << 32) + F.col("row"))
    packed = packed.unionByName(whole.withColumn("offset", F.lit(0).cast("bigint")).select(*packed.columns))
    return packed.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), *packed.columns[1:])

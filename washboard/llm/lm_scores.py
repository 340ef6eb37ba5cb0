"""Stupid-backoff scores of documents, from n-gram counts over the same corpus.

The n-grams of token ids are exact whole numbers. Documents are gathered into blocks; a block counts its n-grams once and sends
them, split by hash, to the parts of the count table. Each part adds up what it gets and answers every block with
the totals of that block's n-grams. Blocks then score their documents. What moves is one entry per distinct n-gram and
block, so an n-gram that a third of all documents hold is no heavier than others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washboard.llm.common import bucketed, partitions_for, size_of
from washboard.llm.tokens import VOCABULARY, ids

BASE = np.int64(50_258)
MIX = np.uint64(0x9E3779B97F4A7C15)
BACKOFF = 0.4
#: Tokens of a block at most, beyond its last document's, and documents: a trigram and a document fit into 64 bits.
BLOCK_TOKENS, BLOCK_DOCUMENTS = 1_000_000, 100_000
#: Files stay countable at any size; a bucket may hold any number of blocks, which are read one at a time.
MOST_BUCKETS = 20_000
#: Text bytes for which the count table has a part of its own. A task holds one part; larger parts suit larger executors.
PART_BYTES = 8 << 20


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: equal bytes of all numbers side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 3)


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def ngrams(tokens: np.ndarray, document: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to ``order``, the places where an n-gram of one document ends, and the n-grams as whole
    numbers. N-grams of different lengths never meet, since no digit is 0, and longer ones are larger."""
    digits = tokens.astype(np.int64) + 1
    keys = digits
    yield np.arange(len(tokens)), keys
    for n in range(2, order + 1):
        if len(tokens) < n:
            yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            continue
        keys = keys[:-1] * BASE + digits[n - 1 :]
        inside = np.flatnonzero(document[n - 1 :] == document[: len(document) - n + 1])
        yield inside + n - 1, keys[inside]


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * MIX) >> np.uint64(33)).astype(np.int64) % parts


def block_counts(tokens: np.ndarray, document: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of all lengths in a block, with their counts."""
    whole = [np.unique(keys, return_counts=True) for _, keys in ngrams(tokens, document, order)]
    return np.concatenate([k for k, _ in whole]), np.concatenate([c for _, c in whole])


@dataclass
class Occurrences:
    """N-grams of one length in a block, sorted: the places they end at, the distinct n-grams, which of them each is, and how
    often its document has it."""

    ends: np.ndarray
    distinct: np.ndarray
    which: np.ndarray
    own: np.ndarray


def in_order(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` sorted, and their ``places``, ascending where values are equal. Both are sorted as one number if they fit into 64 bits,
    which is several times faster than sorting places by values."""
    bits = int(places[-1]).bit_length() if len(places) else 0
    if len(values) and int(values.max()).bit_length() + bits > 64:
        by_value = np.argsort(values, kind="stable")
        return values[by_value], places[by_value]
    both = (values.astype(np.uint64) << np.uint64(bits)) | places.astype(np.uint64)
    both.sort()
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def occurrences(tokens: np.ndarray, document: np.ndarray, order: int) -> list[Occurrences]:
    """One for each length. A longer n-gram is sorted by the rank of its beginning in the block and its last token. Documents ascend
    with places, so those of one n-gram lie together as well."""
    out: list[Occurrences] = []
    rank = np.zeros(len(tokens), dtype=np.int64)
    digits, whole = tokens.astype(np.int64) + 1, np.empty(len(tokens), dtype=np.int64)
    for n, (ends, keys) in enumerate(ngrams(tokens, document, order), 1):
        ordered, places = in_order(rank[ends - 1] * BASE + digits[ends] if n > 1 else digits, ends)
        new_key = np.ones(len(places), dtype=bool)
        new_key[1:] = ordered[1:] != ordered[:-1]
        new_pair, of = new_key.copy(), document[places]
        new_pair[1:] |= of[1:] != of[:-1]
        runs = np.diff(np.append(np.flatnonzero(new_pair), len(places)))
        whole[ends] = keys
        which = np.cumsum(new_key) - 1
        rank[places] = which
        out.append(Occurrences(places, whole[places[new_key]], which, np.repeat(runs, runs)))
    return out


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Order of keys by part; short numbers are sorted digit by digit."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def counts_at(found: list[Occurrences], totals: np.ndarray, tokens: int, leave_out: bool) -> list[np.ndarray]:
    """For each length, the count of the n-gram that ends at each place (0 where there is none), without those of the
    place's own document if ``leave_out``. ``totals`` belong to the distinct n-grams of all lengths, in order."""
    out, seen = [], 0
    for each in found:
        counts = totals[seen : seen + len(each.distinct)][each.which]
        seen += len(each.distinct)
        full = np.zeros(tokens)
        full[each.ends] = counts - each.own if leave_out else counts
        out.append(full)
    return out


def score_block(lengths: np.ndarray, counts: list[np.ndarray], tokens_in_all: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log scores of each document, and its tokens scored at each order.

    A token's score is the share of its n-gram in those of the context, for the longest context for which the n-gram is there; each
    token the context is shortened by costs the backoff factor. A token seen nowhere else counts as half a token."""
    document = np.repeat(np.arange(len(lengths)), lengths)
    everything = np.maximum(tokens_in_all - (lengths if leave_out else 0 * lengths), 1)[document]
    score, used = np.log(np.maximum(counts[0], 0.5) / everything), np.ones(len(document), dtype=np.int64)
    place = np.arange(len(document)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for k in range(2, len(counts) + 1):
        here, context = counts[k - 1], np.concatenate([[0.0], counts[k - 2][:-1]]) if len(document) else counts[k - 2]
        seen = here > 0
        longer = np.log(np.where(seen, here, 1.0)) - np.log(np.where(seen, context, 1.0))
        score = np.where(seen, longer, score + np.log(BACKOFF) * (place >= k - 1))
        used[seen] = k
    orders = np.bincount(document * len(counts) + used - 1, minlength=len(lengths) * len(counts)).reshape(-1, len(counts))
    return np.bincount(document, weights=score, minlength=len(lengths)), orders


def lm_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, leave_out: bool = True, vocabulary: str = VOCABULARY,
    block_tokens: int = BLOCK_TOKENS, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, log_score (sum of natural logarithms), mean_log_score, and orders, the number of
    tokens scored at each order from 1 up. ``order`` is 3 at most, so that an n-gram is an exact long.

    Counts are over whole texts of all documents, each row counted as often as it comes. Null and empty texts have no tokens, a log_score
    of 0 and no mean. Null ids and repeated rows stay; an empty table gives no rows; other columns are not looked at."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()  # ids travel as text, since pandas makes floats of numbers with nulls
    _, volume = size_of(docs, text_col)
    parts = partitions_for(spark, volume, part_bytes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for the documents of each block."""
        encoder = ids(vocabulary)
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids_of = pa.concat_arrays(names)
            columns = [
                pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids_of)], pa.int32()), ids_of),
                pa.array([pack(np.concatenate(held).astype("<u2"))], pa.binary()), pa.array([pack(np.array([len(d) for d in held], dtype="<i8"))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "data", "n"])

        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                for i, text in enumerate(batch.column("text").to_pylist()):
                    held.append(encoder.encode(text or ""))
                    names.append(batch.column("id").slice(i, 1))
                    size += len(held[-1])
                    if size >= block_tokens or len(held) >= BLOCK_DOCUMENTS:
                        yield close()
                        held, names, size = [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # bucketed by block, so that the documents stay where they are when the answers come
    texts = bucketed(rows.mapInArrow(gather, "block bigint, ids array<string>, data binary, n binary"), min(parts, MOST_BUCKETS), "block", "lm-blocks")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each part of the count table that a block asks."""
        for batch in batches:
            for block, data, n in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "n")), strict=True):
                lengths = unpack(n, "<i8")
                keys, counts = block_counts(unpack(data, "<u2"), np.repeat(np.arange(len(lengths)), lengths), order)
                part = parts_of(keys, parts)
                dealt = by_part(part, parts)
                edges = np.searchsorted(part[dealt], np.arange(parts + 1))
                full = np.flatnonzero(np.diff(edges))
                keys, counts = keys[dealt].astype("<i8"), counts[dealt].astype("<i4")
                cut = [slice(edges[p], edges[p + 1]) for p in full]
                columns = [pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32())]
                columns += [pa.array([pack(np.diff(keys[c], prepend=0)) for c in cut], pa.binary()), pa.array([pack(counts[c]) for c in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "data", "n"])

    requests = texts.select("block", "data", "n").mapInArrow(send, "block bigint, part int, data binary, n binary")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tokens": [int(unpack(n, "<i8").sum()) for n in batch["n"]]})

    everything = int(texts.select("n").mapInPandas(sizes, "tokens bigint").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])

    def add_up(got: pd.DataFrame) -> pd.DataFrame:
        each = [np.cumsum(unpack(d, "<i8")) for d in got["data"]]
        distinct, place = np.unique(np.concatenate(each), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([unpack(n, "<i4") for n in got["n"]]), minlength=len(distinct)).astype("<i8")[place]
        edges = np.cumsum([len(k) for k in each])[:-1]
        return pd.DataFrame({"block": got["block"], "part": got["part"], "totals": [pack(t) for t in np.split(totals, edges)]})

    answers = requests.groupBy("part").applyInPandas(add_up, "block bigint, part int, totals binary")

    def score(held: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        lengths, tokens = unpack(held["n"].iloc[0], "<i8"), unpack(held["data"].iloc[0], "<u2")
        document = np.repeat(np.arange(len(lengths)), lengths)
        found = occurrences(tokens, document, order)
        keys = np.concatenate([each.distinct for each in found])
        totals = np.empty(len(keys), dtype=np.int64)
        if len(got):
            totals[by_part(parts_of(keys, parts), parts)] = np.concatenate([unpack(t, "<i8") for t in got.sort_values("part")["totals"]])
        counts = counts_at(found, totals, len(tokens), leave_out)
        del found, keys, totals
        sums, orders = score_block(lengths, counts, everything, leave_out)
        mean = [s / k if k else None for s, k in zip(sums.tolist(), lengths.tolist())]
        return pd.DataFrame({"id": pd.Series(list(held["ids"].iloc[0]), dtype=object), "n_tokens": lengths, "log_score": sums, "mean_log_score": mean, "orders": list(orders)})

    result = "id string, n_tokens bigint, log_score double, mean_log_score double, orders array<bigint>"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, result).select(
        F.col("id").cast(kind).alias(id_col), "n_tokens", "log_score", "mean_log_score", "orders"
    )

"""Repeated byte strings by prefix-free parsing.

A rolling hash over the text triggers phrase ends that depend on the last few bytes alone, so equal strings are parsed alike but
for their edges. The start of a long string is then told by the next phrase end after it: what precedes that end in the phrase (a suffix of
a dictionary phrase) and what follows it (a prefix of the parse). All starts that share a phrase end form a group.
Whether two starts have the same next 400 bytes is decided for groups first and for single starts only where groups differ:

1. the 200 bytes after the phrase end (or before it, for starts further away): groups alone with theirs have no repeats;
2. all bytes that a group's strings cover: groups that share them repeat at every start. Most of a repeated passage ends here;
3. which of those meet a group that is still open, since one copy of them then takes part in the last step;
4. every single string of the groups still open.

Instead of the sorted order of dictionary and parse, which needs a row for every byte, each step compares digests of the same strings, as
the order is only asked which neighbours are equal. Documents are kept in blocks. In each step a block sends its distinct
keys, dealt by hash, and gets back for each key whether other blocks have it too; no key is heavier than one
entry per block, and texts do not move.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washboard.llm.common import bucketed, partitions_for, size_of, stage_briefly

WINDOW = 8
#: Bytes that decide whether a phrase ends: a window and the windows before it, which must not end one.
CONTEXT = 2 * WINDOW - 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: A phrase ends where the top bits of the hash are zero: every 32 bytes on average.
TRIGGER_BITS = 5
NEAR, SHORT, SHORT_FROM = 200, 336, 64
RIGHT, LEFT, BARE = 1, 2, 3
BLOCK_BYTES = 4 << 20
#: Text bytes for which the table of keys has a part of its own. A task holds one part; larger parts suit larger executors.
PART_BYTES = 12 << 20
#: Files stay countable at any size; a bucket may hold any number of blocks, which are read one at a time.
MOST_BUCKETS = 20_000
ELSEWHERE, WANTED, FIRST = 1, 2, 4


def phrase_ends(data: np.ndarray) -> np.ndarray:
    """Places where a phrase ends and the next begins."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    window = np.ndarray(n, dtype="<u8", buffer=np.ascontiguousarray(data).data, strides=(1,))  # WINDOW bytes from each place
    hits = np.flatnonzero((window * MULTIPLIER) >> np.uint64(64 - TRIGGER_BITS) == 0)
    # of hits close together only the first counts, so that runs of one byte are not cut everywhere
    return hits[np.diff(hits, prepend=-WINDOW) >= WINDOW] + WINDOW


def groups(data: np.ndarray, length: int) -> np.ndarray:
    """Groups of starts of strings of ``length`` bytes: rows (kind, phrase end, first start, last start)."""
    n = len(data)
    last = n - length
    if last < 0:
        return np.zeros((0, 4), dtype=np.int64)
    ends = phrase_ends(data)
    ends = ends[ends >= CONTEXT]
    after = np.append(ends, n + length + 1)  # no phrase end at all: further than any string reaches
    low = np.maximum(np.concatenate([[0], ends - CONTEXT + 1]), 0)
    high = np.minimum(after - CONTEXT, last)
    near = np.stack([np.full(len(after), RIGHT), after, np.maximum(low, after - NEAR), high], axis=1)
    far = np.stack([np.full(len(after), LEFT), after, np.maximum(low, after - length), np.minimum(high, after - NEAR - 1)], axis=1)
    found = np.concatenate([near, far])
    found = found[found[:, 2] <= found[:, 3]]
    open_from, open_to = low, np.minimum(high, after - length - 1)
    bare = [np.arange(a, b + 1) for a, b in zip(open_from, open_to) if a <= b]
    if bare:
        starts = np.concatenate(bare)
        found = np.concatenate([found, np.stack([np.full(len(starts), BARE), starts, starts, starts], axis=1)])
    return found


def digests(texts: list[bytes], doc: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool) -> np.ndarray:
    """Digest of each piece of a text, as rows of one or two longs; ``doc`` is sorted."""
    make = xxhash.xxh3_128_digest if wide else xxhash.xxh3_64_digest
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out: list[bytes] = []
    for d in np.unique(doc).tolist():
        own, text = slice(edges[d], edges[d + 1]), texts[d]
        out += [make(text[i:j]) for i, j in zip(start[own].tolist(), end[own].tolist())]
    return np.frombuffer(b"".join(out), dtype=">u8").astype(np.uint64).reshape(len(doc), 2 if wide else 1)


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each ``first`` to its ``last``, and the place of the pair they come from."""
    counts = last - first + 1
    of = np.repeat(np.arange(len(first)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + first[of], of


class Keys:
    """Distinct keys of a block in sorted order; ``place`` has the place among them of each value given."""

    def __init__(self, values: np.ndarray, marks: np.ndarray | None = None) -> None:
        order = np.lexsort((values[:, 1], values[:, 0]))
        ranked = values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        self.distinct = ranked[new]
        self.place = np.empty(len(values), dtype=np.int32)
        self.place[order] = np.cumsum(new) - 1
        self.marks = np.zeros(len(self.distinct), dtype=bool)
        if marks is not None:
            self.marks[self.place[marks]] = True

    def requests(self, parts: int) -> list[dict]:
        part = ((self.distinct[:, 1] ^ self.distinct[:, 0]) * MULTIPLIER >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        signed, marks = self.distinct[order].view(np.int64), self.marks[order].astype(np.uint8)
        self.dealt = np.empty(len(order), dtype=np.int32)
        self.dealt[order] = np.arange(len(order))
        cuts = [(p, slice(edges[p], edges[p + 1])) for p in np.flatnonzero(np.diff(edges)).tolist()]
        return [{"part": p, "hi": signed[c, 0], "lo": signed[c, 1], "mark": marks[c].tobytes()} for p, c in cuts]

    def answered(self) -> np.ndarray:
        """Where the answer for each value given will be, once those of all parts are put together in order."""
        return self.dealt[self.place]


def twice(place: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which values come up again, here or in another block."""
    return (np.bincount(place, minlength=len(codes))[place] > 1) | (codes[place] & ELSEWHERE > 0)


def first_here(place: np.ndarray) -> np.ndarray:
    out = np.zeros(len(place), dtype=bool)
    out[np.unique(place, return_index=True)[1]] = True
    return out


State = dict[str, np.ndarray]


def ask_contexts(texts: list[bytes], length: int) -> tuple[Keys, State]:
    doc, rows = parsed(texts, length)
    return Keys(context_keys(texts, doc, rows, length)), {}


def parsed(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of all texts, and the text of each."""
    each = [groups(np.frombuffer(t, dtype=np.uint8), length) for t in texts]
    return np.repeat(np.arange(len(texts)), [len(r) for r in each]), np.concatenate(each)


def context_keys(texts: list[bytes], doc: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    kind, end, start = rows[:, 0], rows[:, 1], rows[:, 2]
    begin = np.select([kind == RIGHT, kind == LEFT], [end, end - NEAR], start)
    finish = np.select([kind == RIGHT, kind == LEFT], [end + NEAR, end], start + length)
    return np.concatenate([kind[:, None].astype(np.uint64), digests(texts, doc, begin, finish, False)], axis=1)


def ask_covers(texts: list[bytes], state: State, codes: np.ndarray, length: int) -> tuple[Keys, State]:
    """All bytes of each group whose context comes up again, and for groups near their phrase end a longer context."""
    doc, rows = parsed(texts, length)
    alive = twice(state["place"], codes)
    doc, rows = doc[alive], rows[alive]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kind, end, start, last = rows.T
    short = (kind == RIGHT) & (sizes[doc] - end >= SHORT) if len(rows) else np.zeros(0, dtype=bool)
    covers = digests(texts, doc, start, last + length, True)
    longer = digests(texts, doc[short], end[short], end[short] + SHORT, False)
    longer = np.concatenate([np.full((len(longer), 1), 4, dtype=np.uint64), longer], axis=1)
    keys = Keys(np.concatenate([covers, longer]))
    return keys, {"doc": doc, "rows": rows, "short": short, "context": context_keys(texts, doc, rows, length)}


def ask_meetings(state: State, codes: np.ndarray) -> tuple[Keys, State]:
    """Contexts of groups that are still open, marked, and of those that are settled."""
    rows, short, place = state["rows"], state["short"], state["place"]
    again, m = twice(place, codes), len(rows)
    settled, chance = again[:m], np.ones(m, dtype=bool)
    chance[short] = again[m:]
    chance |= (rows[:, 0] != RIGHT) | (rows[:, 1] - rows[:, 2] > SHORT_FROM)
    one_copy = settled & (codes[place[:m]] & FIRST > 0) & first_here(place)[:m]
    left = settled | chance
    kept = {"doc": state["doc"][left], "rows": rows[left], "settled": settled[left], "one_copy": one_copy[left]}
    return Keys(state["context"][left], ~kept["settled"]), kept


def ask_starts(texts: list[bytes], state: State, codes: np.ndarray, length: int) -> tuple[Keys, State]:
    """Every string of the open groups, and of one copy of each settled group that meets one of them."""
    stands_in = state["one_copy"] & (codes[state["place"]] & WANTED > 0)
    detail = ~state["settled"] | stands_in
    starts, of = spread(state["rows"][detail, 2], state["rows"][detail, 3])
    doc = state["doc"][detail][of]
    keys = Keys(digests(texts, doc, starts, starts + length, True))
    spans = np.stack([state["doc"], state["rows"][:, 2], state["rows"][:, 3]], axis=1)
    return keys, {"whole": spans[state["settled"]], "detail": spans[detail], "open": ~state["settled"][detail]}


def repeated_starts(state: State, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of every start of a string that comes up again."""
    starts, of = spread(state["detail"][:, 1], state["detail"][:, 2])
    found = twice(state["place"], codes) & state["open"][of]
    places, whole = spread(state["whole"][:, 1], state["whole"][:, 2])
    return np.concatenate([state["whole"][whole, 0], state["detail"][of[found], 0]]), np.concatenate([places, starts[found]])


def saved(state: State) -> bytes:
    out = io.BytesIO()
    np.savez(out, **state)
    return zstandard.compress(out.getvalue(), 3)


def loaded(data: bytes) -> State:
    with np.load(io.BytesIO(zstandard.decompress(data))) as arrays:
        return dict(arrays)


def without(text: bytes, starts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them and the bytes left, when all strings at ``starts`` go."""
    if not len(starts):
        return 0, 0, text
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


REQUEST = "block bigint, part int, hi array<bigint>, lo array<bigint>, mark binary"
ANSWER = "block bigint, part int, codes binary"


def answer(got: pd.DataFrame) -> pd.DataFrame:
    """One part of the table of keys: for each block's keys whether another block has them, whether any block marked them and
    whether the block is the first to have them."""
    got = got.sort_values("block", kind="stable")
    sizes = got["hi"].map(len).to_numpy()
    hi, lo = np.concatenate(got["hi"].to_numpy()), np.concatenate(got["lo"].to_numpy())
    mark = np.frombuffer(b"".join(got["mark"]), dtype=np.uint8)
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    key, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    many = np.diff(np.append(starts, len(order))) > 1
    marked = np.maximum.reduceat(mark[order], starts) > 0
    codes = np.empty(len(order), dtype=np.uint8)
    codes[order] = many[key] * ELSEWHERE + marked[key] * WANTED + new * FIRST
    return pd.DataFrame({"block": got["block"], "part": got["part"], "codes": [c.tobytes() for c in np.split(codes, np.cumsum(sizes)[:-1])]})


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, texts: bool = False,
    block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the bytes kept (kept).

    Removed is every byte covered by a string of ``length`` bytes that also starts anywhere else in the table, in the same document
    too; overlapping strings count, and all are judged on the input. Strings never cross documents, and places are bytes of
    UTF-8. Null text is empty; texts shorter than ``length`` keep all bytes. Repeated rows are copies of each other and lose what they share;
    null and repeated ids stay; an empty table gives no rows; other columns are not looked at. ``length`` is at least 400."""
    if length < 400:
        raise ValueError("strings of at least 400 bytes")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()  # ids travel as text, since pandas makes floats of numbers with nulls
    _, volume = size_of(docs, text_col)
    parts = partitions_for(spark, volume, part_bytes)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, place = 0, block_bytes, 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                blocks, places = [], []
                for size in batch.column("size").to_pylist():
                    if filled + size > block_bytes:
                        block, filled, place = uuid.uuid4().int >> 65, 0, 0
                    filled, place = filled + size, place + 1
                    blocks.append(block)
                    places.append(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), batch.column("id"), batch.column("text")], ["block", "place", "id", "text"]
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.octet_length(text).alias("size"))
    # bucketed by block, so that the texts stay where they are in every step
    held = bucketed(source.mapInArrow(gather, "block bigint, place bigint, id string, text string"), min(parts, MOST_BUCKETS), "block", "repeat-blocks")

    def unpacked(got: pd.DataFrame) -> tuple[State, np.ndarray]:
        """The state a step left and the answers to what it asked."""
        state = loaded(got.loc[got["part"] < 0, "codes"].iloc[0])
        return state, np.frombuffer(b"".join(got[got["part"] >= 0].sort_values("part")["codes"]), dtype=np.uint8)

    def in_order(rows: pd.DataFrame) -> list[bytes]:
        return [t.encode() for t in rows.sort_values("place")["text"]]

    def sent(block: int, keys: Keys, state: State) -> pd.DataFrame:
        made = keys.requests(parts)
        note = {"part": -1, "hi": None, "lo": None, "mark": saved(state | {"place": keys.answered()})}
        out = pd.DataFrame([note, *made], columns=["part", "hi", "lo", "mark"])
        return out.assign(block=block)[["block", "part", "hi", "lo", "mark"]]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return sent(rows["block"].iloc[0], *ask_contexts(in_order(rows), length))

    def second(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return sent(rows["block"].iloc[0], *ask_covers(in_order(rows), *unpacked(got), length))

    def third(got: pd.DataFrame) -> pd.DataFrame:
        return sent(got["block"].iloc[0], *ask_meetings(*unpacked(got)))

    def fourth(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return sent(rows["block"].iloc[0], *ask_starts(in_order(rows), *unpacked(got), length))

    def finish(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        doc, starts = repeated_starts(*unpacked(got))
        by_doc = np.argsort(doc, kind="stable")
        edges, starts = np.searchsorted(doc[by_doc], np.arange(len(rows) + 1)), starts[by_doc]
        out = []
        for i, data in enumerate(map(str.encode, rows["text"])):
            removed, runs, kept = without(data, starts[edges[i] : edges[i + 1]], length)
            out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept if texts else None))
        made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return pd.concat([rows[["id"]].reset_index(drop=True), made], axis=1)

    def replies(asked: DataFrame, before: Callable[[], None] | None = None) -> tuple[DataFrame, Callable[[], None]]:
        """The answers to a step, with the states it left. Tables that are used up are deleted on the way."""
        asked, drop = stage_briefly(asked, "repeat-requests")
        if before:
            before()
        requests = asked.filter(F.col("part") >= 0).groupBy("part").applyInPandas(answer, ANSWER)
        out = stage_briefly(requests.unionByName(asked.filter(F.col("part") < 0).select("block", "part", F.col("mark").alias("codes"))), "repeat-answers")
        drop()
        return out

    by_block = held.groupBy("block")
    got, drop = replies(by_block.applyInPandas(first, REQUEST))
    got, drop = replies(by_block.cogroup(got.groupBy("block")).applyInPandas(second, REQUEST), drop)
    got, drop = replies(got.groupBy("block").applyInPandas(third, REQUEST), drop)
    got, _ = replies(by_block.cogroup(got.groupBy("block")).applyInPandas(fourth, REQUEST), drop)
    result = "id string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    done = by_block.cogroup(got.groupBy("block")).applyInPandas(finish, result)
    columns = [F.col("id").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    return done.select(*columns)

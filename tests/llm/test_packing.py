import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from samples import collected, docs, none, odd, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from washboard.llm.packing import cut, merge_open, pack_documents, place_pieces

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_pieces(doc_id, text, capacity=2048):
    ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def check(df, **how):
    got = collected(pack_documents(df, **how))
    rows = df.select("doc_id", "text").collect()
    expected = Counter(p for r in rows for p in plain_pieces(r["doc_id"], r["text"]))
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == expected
    sequences = defaultdict(list)
    for g in got:
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    return len(sequences), sum(g["length"] for g in got)


def test_table_is_packed_tightly(docs):
    made, tokens = check(docs)
    assert made <= 1.02 * tokens / 2048 + 1
    check(docs, shard_pieces=40)


def test_odd_rows(odd, none):
    check(odd)
    assert pack_documents(none).count() == 0


def test_texts_beyond_the_quick_way(spark):
    texts = ["<|endoftext|>", "a<|endoftext|> b", "ǅ ᾳ ⅷ ² \x1c\x1d \x85  　x", "漢字かな 한글 🙂", "I'll don't WE'VE  \n\n  x\t\ty   ", "ſ's ŉ", "  a ", "nul\x00byte"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_each_place_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(2)
    capacity = 30
    lengths = rng.integers(1, capacity + 1, 400)
    sequence, offset, made = place_pieces(lengths, capacity)
    filled: dict[int, int] = {}

    def total(state):
        return sum(n * n for n in Counter(capacity - f for f in state.values() if f < capacity).values())

    for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        assert filled.get(b, 0) == o
        choices = [total(filled | {c: f + s}) for c, f in filled.items() if f + s <= capacity] + [total(filled | {-1: s})]
        filled[b] = o + s
        assert total(filled) == min(choices)
    assert made == len(filled)
    joined, places = merge_open(sequence, offset, lengths, made, capacity)
    assert len(set(joined.tolist())) <= made
    ends = defaultdict(int)
    for b, o, s in sorted(zip(joined.tolist(), places.tolist(), lengths.tolist())):
        assert o == ends[b]
        ends[b] += s
    assert max(ends.values()) <= capacity


def test_only_long_documents_are_cut():
    assert cut(1, 2048) == [(0, 1)] and cut(2048, 2048) == [(0, 2048)]
    assert cut(2049, 2048) == [(0, 1), (1, 2048)] and cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_whole_pieces_go_to_no_shard(spark):
    df = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([9000] * 6 + [30] * 9)], "doc_id bigint, text string")
    got = collected(pack_documents(df))
    whole, short = [[g for g in got if (g["length"] == 2048) == w] for w in (True, False)]
    assert len(whole) == 6 * 4 and len({g["sequence_id"] for g in whole}) == len(whole)
    assert all(g["sequence_id"] >= 1 << 32 for g in whole) and all(g["sequence_id"] < 1 << 32 for g in short)
    check(df)

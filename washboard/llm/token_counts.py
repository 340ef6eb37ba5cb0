"""Token counts that follow edits without encoding whole documents again.

A document is cut into segments before spaces that follow a word or mark. The tokenizer's pre-tokens never cross such a place and never look
back over it, so the tokens of the segments are those of the document. A binary tree over the segments keeps the characters
and tokens below each node. An edit finds its segments by the characters, joins neighbours while its edges are no longer
such places, encodes the new text of these segments alone and updates the sums above them.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washboard.llm.common import stage, text_pass
from washboard.llm.tokens import VOCABULARY, Ids, ids

#: A place between segments: a space after a word character or an ASCII mark.
PLACE = re.compile(r"(?<=[\w!-~]) ")
ENDS = re.compile(r"[\w!-~]")
#: Characters a segment has at least, as far as there is a place to end it.
SEGMENT = 512
TREE = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("chars", T.ArrayType(T.IntegerType())),
    T.StructField("tokens", T.ArrayType(T.IntegerType())),
])


def segments(text: str, most: int | None = None) -> list[str]:
    """``text`` in segments, at most ``most`` of them."""
    out, start = [], 0
    while most is None or len(out) + 1 < most:
        m = PLACE.search(text, start + SEGMENT)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


class SegmentTree:
    """Heap-ordered sums: node i has the children 2 i and 2 i + 1, the leaves are the last half."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = list(chars), list(tokens)
        self.leaves = len(self.chars) // 2

    @classmethod
    def build(cls, parts: list[str], encoder: Ids) -> SegmentTree:
        leaves = 1 << max(0, (len(parts) - 1).bit_length())
        pad = [0] * (leaves - len(parts))
        tree = cls([0] * leaves + [len(p) for p in parts] + pad, [0] * leaves + [len(encoder.encode(p)) for p in parts] + pad)
        for node in range(leaves - 1, 0, -1):
            tree._sum(node)
        return tree

    def _sum(self, node: int) -> None:
        for sums in (self.chars, self.tokens):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        self.chars[node], self.tokens[node] = chars, tokens
        while node > 1:
            node //= 2
            self._sum(node)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` (the last one with characters, if at the end), and where that leaf starts."""
        node, start = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start


def merged(edits: list[tuple[int, int, str]], length: int) -> list[tuple[int, int, str]]:
    """Edits by place, cut to the text. Those that overlap become one over their union, with their replacements in order."""
    out: list[tuple[int, int, str]] = []
    for start, end, new in sorted((min(max(s, 0), length), min(max(s, e, 0), length), r or "") for s, e, r in edits):
        if out and (start < out[-1][1] or start == out[-1][0] == out[-1][1] == end):
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + new)
        else:
            out.append((start, end, new))
    return out


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], encoder: Ids) -> tuple[str, int]:
    """The edited text, with ``tree`` updated, and the number of characters encoded again. Edits are applied from the
    last to the first, so that their places stay those of the text they were made for."""
    encoded = 0
    for start, end, new in reversed(merged(edits, len(text))):
        first, begin = tree.find(start)
        last, last_begin = tree.find(max(end - 1, start))
        finish = last_begin + tree.chars[last + tree.leaves]
        while True:
            changed = text[begin:start] + new + text[end:finish]
            # a border holds if the text before it ends a word or mark and the text after it starts with a space
            left = begin == 0 or (changed or text[finish:])[:1] == " " and ENDS.match(text[begin - 1])
            right = finish == len(text) or text[finish] == " " and ENDS.match((changed or text[:begin] or " ")[-1])
            if left and right:
                break
            if not left:
                first, begin = tree.find(begin - 1)
            if not right:
                last, last_begin = tree.find(finish)
                finish = last_begin + tree.chars[last + tree.leaves]
        parts = segments(changed, last - first + 1)
        parts += [""] * (last - first + 1 - len(parts))
        for leaf, part in zip(range(first, last + 1), parts, strict=True):
            tree.set(leaf, len(part), len(encoder.encode(part)))
        encoded += len(changed)
        text = text[:begin] + changed + text[finish:]
    return text, encoded


def version_of(text: Column) -> Column:
    """What edits and trees are made for: a hash of the text (null counts as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, version, chars and tokens (the sums of the tree's nodes, the root's at place 1).

    Null and empty texts have a tree of one empty segment. Text without places to cut is one segment. Repeated rows and null
    ids stay, an empty table gives no rows, other columns are not looked at."""
    rows = docs.select(F.col(id_col), version_of(F.col(text_col)).alias("version"), F.col(text_col).alias("t_text"))

    def make(texts):
        encoder = ids(vocabulary)
        for text in texts:
            tree = SegmentTree.build(segments(text or ""), encoder)
            yield tree.chars, tree.tokens

    return text_pass(rows, "t_text", T.StructType(TREE.fields[1:]), make)



def update_trees(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per row of ``trees``: ``id_col``, version, n_edits, n_encoded (characters encoded again), tokens_before, tokens_after,
    n_chars and the updated chars and tokens.

    ``edits`` has ``id_col``, version, start, end, replacement: the characters from start to end (exclusive) of that version of
    the document give way to the replacement (null: nothing). Places beyond the text are cut to it, edits
    that overlap are joined, and edits of a version that is not there change nothing. Documents without edits
    are not read again. A null id is an id like any other; every row with the same id and version gets the same edits."""
    key = [F.col(id_col), F.col("version")]
    wanted = edits.select(*key, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("replacement")).alias("edit"))
    lists = stage(wanted.groupBy(F.col(id_col).alias("e_id"), F.col("version").alias("e_version")).agg(F.collect_list("edit").alias("edits")), "token-edits")
    same = F.col(id_col).eqNullSafe(F.col("e_id")) & (F.col("version") == F.col("e_version"))
    texts = docs.select(F.col(id_col), version_of(F.col(text_col)).alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    touched = texts.join(lists, same).select("e_id", "e_version", "text", "edits").dropDuplicates(["e_id", "e_version"])
    first_tree = trees.select(F.col(id_col).alias("r_id"), F.col("version").alias("r_version"), "chars", "tokens").dropDuplicates(["r_id", "r_version"])
    work = touched.join(first_tree, F.col("e_id").eqNullSafe(F.col("r_id")) & (F.col("e_version") == F.col("r_version"))).drop("r_id", "r_version")

    def run(batches):
        encoder = ids(vocabulary)
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                rows = []
                for text, chars, tokens, changes in zip(*(batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits")), strict=True):
                    tree = SegmentTree(chars, tokens)
                    _, encoded = apply_edits(text, tree, [(e["start"], e["end"], e["replacement"]) for e in changes], encoder)
                    rows.append((len(changes), encoded, tree.chars, tree.tokens))
                made = pd.DataFrame(rows, columns=["n_edits", "n_encoded", "new_chars", "new_tokens"])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("e_id"), batch.column("e_version"), pa.array(made["n_edits"], pa.int64()), pa.array(made["n_encoded"], pa.int64()),
                     pa.array(made["new_chars"], ints), pa.array(made["new_tokens"], ints)],
                    ["e_id", "e_version", "n_edits", "n_encoded", "new_chars", "new_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    updated = work.mapInArrow(run, f"e_id {kind}, e_version bigint, n_edits bigint, n_encoded bigint, new_chars array<int>, new_tokens array<int>")
    updated = stage(updated, "token-updates")
    none = F.lit(0).cast("bigint")
    after = trees.join(updated, same, "left")
    return after.select(
        F.col(id_col), "version", F.coalesce("n_edits", none).alias("n_edits"), F.coalesce("n_encoded", none).alias("n_encoded"),
        F.col("tokens")[1].cast("bigint").alias("tokens_before"), F.coalesce("new_tokens", "tokens")[1].cast("bigint").alias("tokens_after"),
        F.coalesce("new_chars", "chars")[1].cast("bigint").alias("n_chars"),
        F.coalesce("new_chars", "chars").alias("chars"), F.coalesce("new_tokens", "tokens").alias("tokens"),
    )


REDACT = re.compile(r"(?P<mail>[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255})|(?P<number>\+?[0-9][0-9 ()-]{6,62}[0-9])")


def redactions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits that replace mail addresses by ``<mail>`` and long numbers by ``<number>``."""
    rows = docs.select(F.col(id_col), version_of(F.col(text_col)).alias("version"), F.col(text_col).alias("t_text"))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("replacement", T.StringType())]))

    def find(texts):
        for text in texts:
            yield ([{"start": m.start(), "end": m.end(), "replacement": f"<{m.lastgroup}>"} for m in REDACT.finditer(text or "")],)

    found = text_pass(rows, "t_text", T.StructType([T.StructField("found", spans)]), find)
    return found.filter(F.size("found") > 0).select(id_col, "version", F.inline("found"))

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from samples import collected, docs, none, odd, odd_rows  # noqa: F401

from washboard.llm import merkle
from washboard.llm.merkle import append_log, audit_columns, build_manifest, height_of, node, position, proofs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return H(*fields)


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def plain_path(levels, i):
    """(sibling or None, whether it is on the left) for each level."""
    out = []
    for row in levels[:-1]:
        out.append((row[i ^ 1] if i ^ 1 < len(row) else None, bool(i & 1)))
        i >>= 1
    return out


def plain_fold(leaf, path):
    for other, on_left in path:
        leaf = H(leaf) if other is None else H(other, leaf) if on_left else H(leaf, other)
    return leaf


def plain_audit(rows):
    """Rows of the query for (doc_id, text, lang, source, n_chars), sorted."""
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, plain_leaf(doc_id, source, lang, n_chars + 1, text) if hit else leaf))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    built = {n: plain_levels([x[2] for x in sorted(trees[n])]) for n in names}
    top = plain_levels([built[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (_, _, leaf, doc_id, changed) in enumerate(sorted(trees[n])):
            path = plain_path(built[n], i) + plain_path(top, k)
            folded = plain_fold(changed, path)
            out.append((doc_id, leaf, built[n][-1][0], top[-1][0], H(*[p for p, _ in path if p]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def audit(df, block_height=merkle.BLOCK_HEIGHT):
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    manifest = build_manifest(df, changes={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, block_height=block_height)
    return proofs(manifest).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", *audit_columns())


def test_positions_are_those_of_completion():
    for n in range(1, 70):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        height = height_of(n)
        log = append_log(leaves, height)
        levels = plain_levels([x.hex() for x in leaves])
        assert len(levels) == height + 1 and len(log) == 32 * sum(map(len, levels))
        for level, row in enumerate(levels):
            assert [node(log, level, place, n).hex() for place in range(len(row))] == row
    # a tree raised beyond its own height, as the last block of a larger tree is
    raised = append_log([hashlib.sha256(b"x").digest()], 3)
    assert raised[-32:].hex() == H(H(H(hashlib.sha256(b"x").hexdigest())))
    assert position(3, 0, 1) == 3


@pytest.mark.parametrize("height", [3, 11])
def test_table(docs, height):
    got = sorted((tuple(r) for r in audit(docs, height).collect()), key=str)
    expected = plain_audit(docs.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert got == expected
    assert 0 < sum(r[6] for r in got) < len(got)


def test_odd_rows(odd, none):
    got = sorted((tuple(r) for r in audit(odd).collect()), key=str)
    assert len(got) == len(odd_rows())
    assert got == plain_audit(odd_rows())
    assert audit(none).count() == 0
    empty = build_manifest(none)
    assert empty.root().count() == 0 and empty.roots().count() == 0


def test_one_row_and_one_tree(odd):
    for rows in (odd.filter("doc_id = 4"), odd.filter("doc_id = 5"), odd.filter("lang = 'de'")):
        plain = rows.select("doc_id", "text", "lang", "source", "n_chars").collect()
        assert sorted((tuple(r) for r in audit(rows).collect()), key=str) == plain_audit(plain)


def test_log_places(docs):
    manifest = build_manifest(docs, block_height=2)
    for tree in collected(manifest.roots()):
        own = {r["position"]: r["hash"] for r in collected(manifest.log().filter(F.col("tree") == tree["tree"]))}
        n = tree["leaves"]
        leaves = [own[position(0, i, n)] for i in range(n)]
        levels = plain_levels(leaves)
        assert levels[-1][0] == tree["subroot"]
        for level in range(3):
            assert [own[position(level, i, n)] for i in range(len(levels[level]))] == levels[level]

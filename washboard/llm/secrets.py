"""Secret scan over every historical version of every path, with a ledger of content-addressed blobs.

A version is a row (path, text); its blob is the SHA-256 of its bytes. The ledger holds one entry per blob and rule
version. A run scans only pairs that the ledger lacks and joins the spans back to all paths that have the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washboard.llm.common import stage

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"
#: A task remembers the blobs it has scanned, up to so many at a time.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base patterns and their least lengths. For a run of one class the least length is part of the
# pattern, which finds the same spans: the longest run is always taken, and a shorter run holds no long one.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# A private key runs from its header over fields such as DEK-Info and the key's characters to the END line. Line breaks may be
# escaped, and lines may be quoted, commented or marked as in a diff. Without an END line that follows so, it ends with the last line of
# such characters alone, or the last long stretch of them.
BREAK = r"(?:\r\n?|\n|(?:\\+r)?\\+n)"
BASE64 = r"[A-Za-z0-9+/=]"
AROUND = r"""[\x20\t"'>\#*|,;]*+"""
FIELDS = rf"(?:(?:{BREAK}{AROUND}[A-Za-z][A-Za-z-]{{0,40}}:(?:(?!\\+[nr])[^\r\n]){{0,200}}+){{1,8}}+(?:{BREAK}{AROUND}(?={BREAK}))?+)?+"
TO_END = rf"""(?:[A-Za-z0-9+/=\s"'>\#*|,;\\]|(?<=[\r\n])-(?!----))*+-?-----END (?:[A-Z]+ )*PRIVATE KEY-----"""
TO_LAST = rf"""(?:(?:\\+[nr]|[\s"'>\#*|,;])*+{BASE64}{{32,}}+|{BREAK}{AROUND}-?{BASE64}++(?={AROUND}(?:{BREAK}|\Z)))++"""
MORE_RULES = (
    Rule("pem", rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{FIELDS}(?:{TO_END}|{TO_LAST}))?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "2"


def find_spans(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Spans in code points, end exclusive, by start and then by the rules' order. A match that is dropped for its
    length still uses up its characters."""
    found = []
    for place, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def compiled(rules: tuple[Rule, ...]) -> list[tuple[Rule, re.Pattern]]:
    """Letters in either case are the ASCII letters alone."""
    return [(r, re.compile(r.pattern, re.ASCII)) for r in rules]


def scan(versions: DataFrame, rules: tuple[Rule, ...], rule_version: str) -> DataFrame:
    """Ledger entries of the blobs in ``versions`` (blob, text), one per blob.

    Texts stay where they are read: each task scans each of its blobs once, and only the spans move to be merged. A blob
    that several tasks hold is scanned in each, which costs less than moving all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, seen = compiled(rules), set()
        for batch in batches:
            blobs, spans = [], []
            for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text"), strict=True):
                if blob in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(blob)
                blobs.append(blob)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text.as_py(), ready)])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(spans, kinds)], ["blob", "spans"])

    found = versions.select("blob", "text").mapInArrow(run, f"blob binary, spans {SPANS}")
    return found.groupBy("blob").agg(F.first("spans").alias("spans")).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


@dataclass(frozen=True)
class BlobScan:
    """``added``: new ledger entries (a written table), to be appended to the stored ledger. ``findings``: one row per
    version with its spans."""

    added: DataFrame
    findings: DataFrame


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_history(
    versions: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION,
) -> BlobScan:
    """Scan the versions whose (blob, rule version) pair is not in ``ledger`` (columns blob, rule_version, spans).

    Findings have ``id_col``, blob and spans (an array of kind, start, end; empty where nothing is found), one row
    per row of ``versions``: repeated rows and ids stay as they are, other columns are not looked at. A null text is
    the empty text; null ids are kept. An empty table gives no rows and no entries. Texts of any length are scanned whole."""
    addressed = versions.select(F.col(id_col), blob_of(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unseen = addressed
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans")
        unseen = addressed.join(known.select("blob"), "blob", "left_anti")
    added = stage(scan(unseen, rules, rule_version), "blob-ledger")
    entries = added.select("blob", "spans")
    if ledger is not None:
        entries = entries.unionByName(known)
    # only blobs with spans are joined, which leaves a small table
    with_spans = entries.filter(F.size("spans") > 0)
    findings = addressed.select(id_col, "blob").join(with_spans, "blob", "left").select(
        F.col(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )
    return BlobScan(added, findings)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(spans: Column) -> list[Column]:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    base = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return [*counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans")]


MASK = "[secret]"


def masked(text: Column, spans: Column) -> Column:
    """``text`` with the union of ``spans`` (sorted by start) replaced, one mark for each stretch of spans that touch or overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(-1).alias("done"))

    def step(so_far: Column, span: Column) -> Column:
        done = F.greatest(so_far["done"], F.lit(0))
        before = F.substring(text, done + 1, span["start"] - done)
        out = F.when(span["start"] > so_far["done"], F.concat(so_far["out"], before, F.lit(MASK))).otherwise(so_far["out"])
        return F.struct(out.alias("out"), F.greatest(so_far["done"], span["end"]).alias("done"))

    return F.aggregate(spans, start, step, lambda end: F.concat(end["out"], F.substring(text, F.greatest(end["done"], F.lit(0)) + 1, F.length(text))))
